"""Filter queries without SQL: their own rows against sums written out, sample by sample."""

import cmath
import math

import numpy as np
import pandas as pd
import pytest

from voltlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events():
    return pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])


@pytest.fixture(scope="module")
def series(events):
    return {k: g["value"].to_numpy(float) for k, g in events.groupby("user_id")}


def check(spark, name, series, f):
    got = {k: g.sort_values("t") for k, g in QUERIES[name](spark, SF).toPandas().groupby("recording")}
    assert set(got) == set(series)
    for k, x in series.items():
        want = f(x)
        assert got[k]["t"].tolist() == list(range(len(want)))
        np.testing.assert_allclose(got[k]["x"], want, rtol=1e-6, atol=2e-6)


def lowpass(cut, rate, n):
    """h[k] = 2c sinc(2ck), Hamming, sum 1."""
    c, half = cut / rate, n // 2
    h = [(2 * c if k == 0 else math.sin(2 * math.pi * c * k) / (math.pi * k)) * (0.54 + 0.46 * math.cos(math.pi * k / half)) for k in range(-half, half + 1)]
    return [v / sum(h) for v in h]


def mirrored(x, taps):
    """Each output is a sum over taps; samples beyond an end are those as far inside it, none beyond the series' length."""
    n, half = len(x), len(taps) // 2
    at = {**{i: x[i] for i in range(n)}, **{-i: x[i] for i in range(1, min(n, half + 1))}, **{n - 1 + i: x[n - 1 - i] for i in range(1, min(n, half + 1))}}
    return np.array([sum(h * at.get(i + half - j, 0.0) for j, h in enumerate(taps)) for i in range(n)])


def rational(x, up, down):
    half = 10 * max(up, down)
    h = [np.sinc(k / max(up, down)) * np.i0(5.0 * math.sqrt(1 - (k / half) ** 2)) / np.i0(5.0) for k in range(-half, half + 1)]
    scale = up / sum(h)
    n = -(-len(x) * up // down)
    return np.array([sum(v * scale * h[m * down - k * up + half] for k, v in enumerate(x) if abs(m * down - k * up) <= half) for m in range(n)])


def dft(x):
    n = len(x)
    return [sum(v * cmath.exp(-2j * math.pi * f * k / n) for k, v in enumerate(x)) for f in range(n)]


def envelope(x):
    n, s = len(x), dft(x)
    weight = [1 if f == 0 or 2 * f == n else 2 if 2 * f < n else 0 for f in range(n)]
    return np.array([abs(sum(w * v * cmath.exp(2j * math.pi * f * k / n) for f, (w, v) in enumerate(zip(weight, s))) / n) for k in range(n)])


def test_highpass(spark, series):
    check(spark, "highpass", series, lambda x: x - mirrored(x, lowpass(1.0, 100.0, 101)))


def test_rc_smooth(spark, series):
    r = math.exp(-1 / 5.0)

    def f(x):
        once = np.array([[(1 - r) * r ** (i - j) if j <= i else 0.0 for j in range(len(x))] for i in range(len(x))])
        return once.T @ (once @ x)

    check(spark, "rc_smooth", series, f)


def test_resample(spark, series):
    check(spark, "resample", series, lambda x: rational(x, 16, 25))


def test_hilbert_envelope(spark, series):
    check(spark, "hilbert_envelope", series, lambda x: rational(mirrored(envelope(x), lowpass(10.0, 100.0, 101)), 1, 2))


def test_intensity(spark, series):
    w = [np.i0(20.0 * math.sqrt(1 - (k / 4) ** 2)) for k in range(-4, 5)]

    def f(x):
        d = (x - sum(x) / len(x)) ** 2
        return np.array([10 * math.log10(max(sum(w[k + 4] * d[i + k] for k in range(-4, 5) if 0 <= i + k < len(x)) / sum(w), 1e-30)) for i in range(len(x))])

    check(spark, "intensity", series, f)


def test_notch(spark, series):
    def f(x):
        out = x.copy()
        for freq in (10.0, 20.0):
            for a in range(0, len(x), 64):
                t = np.arange(a, min(a + 64, len(x)))
                s, c = np.sin(2 * math.pi * freq * t / 100.0), np.cos(2 * math.pi * freq * t / 100.0)
                v = out[t]
                out[t] = v - (v @ s) / max(s @ s, 1e-12) * s - (v @ c) / max(c @ c, 1e-12) * c
        return out

    check(spark, "notch", series, f)


def test_stream_refractory(spark, events):
    want = set()
    for user, g in events.groupby("user_id"):
        last = None
        for ts in g["ts"]:
            if last is None or (ts - last).total_seconds() >= 86400.0:
                want.add((user, ts))
                last = ts
    got = QUERIES["stream_refractory"](spark, SF).toPandas()
    users, times = (next(c for c in got.columns if ("user" in c) == is_user) for is_user in (True, False))
    assert len(got) == len(want) and set(zip(got[users], pd.to_datetime(got[times]))) == want


def test_minimum_phase(spark, series):
    """The taps have the prototype's autocorrelation and no zero outside the circle, which no other taps have (but for the sign)."""
    from voltlake.operators import filters

    for h in (filters.lowpass_taps(10.0, 100.0, 101), filters.highpass_taps(1.0, 100.0), filters.lowpass_taps(30.0, 100.0, 101) - filters.lowpass_taps(8.0, 100.0, 101)):
        early = filters.minimum_phase(h)
        w = np.exp(-1j * np.outer(np.linspace(0, math.pi, 3001), np.arange(101)))
        np.testing.assert_allclose(abs(w @ early), abs(w @ h), atol=1e-6)
        np.testing.assert_allclose([early[k:] @ early[: 101 - k] for k in range(101)], [h[k:] @ h[: 101 - k] for k in range(101)], atol=1e-7)
        assert abs(np.roots(early)).max() < 1.001 and early[0] > 0
        assert all(np.cumsum(early**2) >= np.cumsum(h**2) - 1e-9)
    early = filters.minimum_phase(filters.highpass_taps(1.0, 100.0))
    check(spark, "minimum_phase_highpass", series, lambda x: np.array([sum(early[k] * x[i - k] for k in range(min(i, 100) + 1)) for i in range(len(x))]))
    rows = spark.createDataFrame([("a", t, float(t * t % 17)) for t in range(500)], "recording string, t long, x double")
    got = filters.fir_filtered(rows, filters.highpass_taps(1.0, 100.0), "minimum", block=60).orderBy("t").toPandas()["x"]
    np.testing.assert_allclose(got, filters.causal(np.array([t * t % 17 for t in range(500)], float), early), atol=1e-9)
    with pytest.raises(ValueError):
        filters.fir_filtered(rows, early, "linear")


@pytest.mark.parametrize("n", [1, 5, 33, 34, 35, 101])
def test_filters_of_short_series(n):
    """A series shorter than the taps isn't shifted."""
    from voltlake.operators import filters

    x = np.random.default_rng(n).normal(size=n)
    np.testing.assert_allclose(filters.highpass(x, 1.0, 100.0), x - mirrored(x, lowpass(1.0, 100.0, 101)), atol=1e-9)
