"""Transforms in two passes and by chirp against numpy's and against sums written out."""

import numpy as np
import pandas as pd
import pytest

from voltlake.operators import filters as D
from voltlake.operators import fourier as U
from voltlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
#: Lengths: within a task, with a good divisor, with a poor one, primes, one past the bound.
LENGTHS = {"a": 1, "b": 2, "c": 30, "d": 31, "e": 144, "f": 150, "g": 202, "h": 211, "i": 1024, "j": 997, None: 360}
SIGNAL = "recording string, t long, x double"


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    return {k: rng.normal(1, 2, n) for k, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def signal(spark, series):
    return spark.createDataFrame([(k, 3 * t - 5, float(v)) for k, x in series.items() for t, v in enumerate(x)], SIGNAL).repartition(3)


def of(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["recording"], {})[r["t"]] = tuple(r[c] for c in columns)
    return {k: np.array([v[t] for t in range(len(v))]) for k, v in out.items()}


@pytest.mark.parametrize("inverse", [False, True])
def test_dft(spark, inverse):
    rng = np.random.default_rng(4)
    z = {k: rng.normal(size=n) + 1j * rng.normal(size=n) for k, n in LENGTHS.items()}
    rows = [(k, len(v), t, float(c.real), float(c.imag)) for k, v in z.items() for t, c in enumerate(v)]
    got = U.dft(spark.createDataFrame(rows, "recording string, n long, k long, re double, im double"), inverse=inverse, whole=30)
    got = of(got.withColumnRenamed("k", "t"), "re", "im")
    for k, v in z.items():
        want = np.fft.ifft(v) if inverse else np.fft.fft(v)
        np.testing.assert_allclose(got[k][:, 0] + 1j * got[k][:, 1], want, atol=1e-9)


def test_absent_values_are_zero(spark):
    rows = [("a", 144, 5, 1.0, 0.0), ("p", 211, 210, 0.0, 2.0)]
    got = of(U.dft(spark.createDataFrame(rows, "recording string, n long, k long, re double, im double"), whole=30).withColumnRenamed("k", "t"), "re", "im")
    for k, n, at, v in (("a", 144, 5, 1.0), ("p", 211, 210, 2j)):
        x = np.zeros(n, complex)
        x[at] = v
        np.testing.assert_allclose(got[k][:, 0] + 1j * got[k][:, 1], np.fft.fft(x), atol=1e-9)


@pytest.mark.parametrize("whole", [30, 1 << 20])
def test_analytic(signal, series, whole):
    got = of(U.analytic_rows(signal, whole=whole), "re", "im")
    for k, x in series.items():
        np.testing.assert_allclose(got[k][:, 0] + 1j * got[k][:, 1], D.analytic(x), atol=1e-9)


@pytest.mark.parametrize(("new", "old"), [(50.0, 100.0), (64.0, 100.0), (130.0, 100.0), (100.0, 100.0), (1.0, 100.0)])
def test_fourier_resampled(signal, series, new, old):
    got = of(U.fourier_resampled(signal, new, old, whole=30), "x")
    for k, x in series.items():
        want = D.fft_resample(x, new, old)
        if len(want):
            np.testing.assert_allclose(got[k][:, 0], want, atol=1e-9)
        else:
            assert k not in got


def test_operators_on_long_series(spark, series, signal):
    """The same rows whether a series counts as short or as long."""
    cases = {
        "hilbert": lambda s, w: D.hilbert_envelope(s, 100.0, 50.0, cut=10.0, power=2 / 3, whole=w),
        "gamma": lambda s, w: D.gamma_envelope(s, 10.0, 40.0, 100.0, smooth=5, keys=["recording"], whole=w),
        "rectified gamma": lambda s, w: D.gamma_envelope(s, 10.0, 40.0, 100.0, rectify=True, keys=["recording"], whole=w),
        "speech": lambda s, w: D.speech_envelope(s, 100.0, 50.0, 8.0, whole=w),
    }
    long = signal.where("recording IS NULL OR recording IN ('h', 'i', 'c')")
    for name, f in cases.items():
        a, b = of(f(long, 30), "x"), of(f(long, 1 << 20), "x")
        assert set(a) == set(b) == {None, "h", "i", "c"}
        for k in a:
            np.testing.assert_allclose(a[k], b[k], atol=1e-8, err_msg=name)
    a, b = (D.band_envelopes(long, [(5.0, 10.0), (10.0, 40.0)], 100.0, 8.0, whole=w).orderBy("recording", "band", "t").toPandas() for w in (30, 1 << 20))
    assert a[["recording", "band", "t"]].equals(b[["recording", "band", "t"]])
    np.testing.assert_allclose(a["x"], b["x"], atol=1e-8)


def test_a_long_series_lines_only(spark, monkeypatch):
    """A series of 600,000 samples, at most 1,000 in a line."""
    n = 600_000
    s = spark.range(n).selectExpr("'r' AS recording", "id AS t", "cos(2 * pi() * 37 * id / 600000) * 3 AS x")
    got = U.envelope_rows(s, whole=1000).selectExpr("min(x) AS a", "max(x) AS b", "count(*) AS n", "max(t) AS t").first()
    assert got.n == n and got.t == n - 1 and abs(got.a - 3) < 1e-9 and abs(got.b - 3) < 1e-9


def test_empty(spark):
    none = spark.createDataFrame([], SIGNAL)
    assert U.envelope_rows(none).count() == 0 and U.fourier_resampled(none, 50.0, 100.0).count() == 0


def test_channel_modes(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(2, 1, (2, 300))
    audio = spark.createDataFrame([("r", c, t, float(x[c, t])) for c in (0, 1) for t in range(300)], "recording string, channel int, t long, x double")
    want = {}
    for name, v in (("mean", x.mean(0)), ("self", x[0]), ("other", x[1])):
        z = np.fft.fft(v - v.mean())
        z[1:150] *= 2
        z[151:] = 0
        want[name] = D.resample(D.zero_phase(abs(np.fft.ifft(z)), D.butterworth(4, 8.0, 100.0)), 50.0, 100.0)
    for mode in ("mean", "self", "other", "all"):
        got = D.channel_envelopes(audio, mode, 100.0, 50.0, 8.0).orderBy("t").toPandas()
        assert set(got["feature"]) == ({mode} if mode != "all" else {"mean", "self", "other"})
        for f, g in got.groupby("feature"):
            np.testing.assert_allclose(g["x"], want[f], atol=1e-9)
    with pytest.raises(ValueError, match="two channels"):
        D.channel_envelopes(audio.where("channel = 0"), "other", 100.0, 50.0, 8.0)
    with pytest.raises(ValueError):
        D.channel_envelopes(audio, "self", 100.0, 50.0, 50.0)


def test_fft_resample_query(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    got = {k: g.sort_values("t")["x"].to_numpy() for k, g in QUERIES["fft_resample"](spark, SF).toPandas().groupby("recording")}
    for k, g in events.groupby("user_id"):
        x = g["value"].to_numpy(float)
        n, m = len(x), round(len(x) / 2)
        bins = [sum(v * np.exp(-2j * np.pi * f * t / n) for t, v in enumerate(x)) for f in range(m // 2 + 1)]
        weigh = [1 if f == 0 or 2 * f == m else 2 for f in range(m // 2 + 1)]
        want = [sum(w * (b * np.exp(2j * np.pi * f * t / m)).real for f, (w, b) in enumerate(zip(weigh, bins))) / n for t in range(m)]
        np.testing.assert_allclose(got.get(k, []), want, atol=2e-6)
