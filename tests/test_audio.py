"""Composed audio features: sums written out, and long series as short ones."""

import cmath
import math

import numpy as np
import pandas as pd
import pytest

from voltlake.operators import audio as Y
from voltlake.operators import filters as D
from voltlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SIGNAL = "recording string, t long, x double"


def rc(x, tau, rate):
    r, y, out = math.exp(-1 / (tau * rate)), 0.0, []
    for v in x:
        y = (1 - r) * v + r * y
        out.append(y)
    return out


def written_out(x, rate, new):
    """Specific loudness step by step: a DFT by its sum, every band, a recurrence, straight lines, signs, 13 double passes."""
    n, m = len(x), int(len(x) * new / rate)
    s = [sum(v * cmath.exp(-2j * math.pi * f * t / n) for t, v in enumerate(x)) for f in range(n)]
    total = [0.0] * m
    for band in range(1, 23):
        sign = 0 if band < 3 else -1 if band > 19 else 1
        shaped = [0j] * n
        for k in range(1, n // 2):
            f = k * rate / n
            d = 13 * math.atan(0.00076 * f) + 3.5 * math.atan(f / 7500) ** 2 - band - 0.215
            shaped[k] = s[k] * 10 ** (0.7 - 0.75 * d - 1.75 * (0.196 + d * d))
        level = [sum(c * cmath.exp(2j * math.pi * k * t / n) for k, c in enumerate(shaped)).real / n for t in range(n)]
        level = rc(rc([v * v for v in level], 0.0013, rate)[::-1], 0.0013, rate)[::-1]
        level = [math.sqrt(max(v, 1e-20)) for v in level]
        for j in range(m):
            at = j * rate / new
            k = min(int(at), n - 1)
            total[j] += sign * (level[k] + (at - k) * (level[min(k + 1, n - 1)] - level[k]))
    for _ in range(13):
        if m < 2:
            break
        pad = min(9, m - 1)
        w = [2 * total[0] - total[k] for k in range(pad, 0, -1)] + total + [2 * total[-1] - total[m - 1 - k] for k in range(1, pad + 1)]
        for _ in range(2):
            w = [(w[k] + w[max(k - 1, 0)] + w[max(k - 2, 0)]) / 3 for k in range(len(w))][::-1]
        total = w[pad : pad + m]
    return total


@pytest.mark.parametrize(("n", "new"), [(1, 40), (2, 100), (3, 100), (11, 40), (64, 40), (65, 37.5), (90, 100)])
def test_loudness_written_out(n, new):
    x = np.random.default_rng(n).normal(size=n)
    np.testing.assert_allclose(Y.loudness_of(x, 100.0, new), written_out(x.tolist(), 100.0, new), atol=1e-9)


def test_loudness_query(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    got = {k: g.sort_values("t")["x"].to_numpy() for k, g in QUERIES["specific_loudness"](spark, SF).toPandas().groupby("recording")}
    for k, g in events.groupby("user_id"):
        np.testing.assert_allclose(got.get(k, []), written_out(g["value"].tolist(), 100.0, 40.0), atol=2e-6)


def test_loudness_tracks_slow_modulation(spark):
    """3 s of a carrier of 800 Hz at 20,000 samples a second, its amplitude moving twice a second: finite, varying, following."""
    n = 60_000
    s = spark.range(n).selectExpr("'r' AS recording", "id AS t", "(1 + 0.7 * sin(2 * pi() * 2 * id / 20000)) * sin(2 * pi() * 800 * id / 20000) AS x")
    y = Y.specific_loudness(s, 20_000.0, 100.0).orderBy("t").toPandas()["x"].to_numpy()
    want = np.log(1 + 0.7 * np.sin(2 * np.pi * 2 * np.arange(300) / 100))
    assert len(y) == 300 and np.isfinite(y).all() and y.std() > 1e-6
    assert np.corrcoef(y[40:-40], want[40:-40])[0, 1] > 0.6


def of(df, value="x"):
    out = {}
    for r in df.collect():
        out.setdefault(r["recording"], {})[r["t"]] = r[value]
    return {k: np.array([v[t] for t in range(len(v))]) for k, v in out.items()}


def test_long_series_as_short_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(k, t, float(v)) for k, n in (("a", 150), ("b", 211), (None, 144), ("short", 20)) for t, v in enumerate(rng.normal(size=n))]
    s = spark.createDataFrame(rows, SIGNAL)
    a, b = of(Y.specific_loudness(s, 100.0, 40.0, whole=30)), of(Y.specific_loudness(s, 100.0, 40.0))
    assert set(a) == set(b) == {"a", "b", None, "short"}
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)


def frames_of(x, n_fft, hop, width, boundary):
    w = [0.5 - 0.5 * math.cos(2 * math.pi * k / width) for k in range(width)]
    if boundary == "reflect":
        wide, length, scale = np.pad(x, n_fft // 2, mode="reflect"), n_fft, 1.0
    else:
        wide, length, scale = np.pad(x, width // 2) if boundary else x, width, sum(w)
    wide = np.pad(wide, (0, max(length - len(wide), 0)))
    return [[sum(w[k] * wide[a + k] * cmath.exp(-2j * math.pi * b * k / n_fft) for k in range(width)) / scale for b in range(n_fft // 2 + 1)] for a in range(0, len(wide) - length + 1, hop)]


@pytest.mark.parametrize(("n_fft", "hop", "width", "boundary"), [(16, 8, None, "reflect"), (16, 5, 12, "reflect"), (16, 8, None, "zeros"), (16, 3, 12, "zeros"), (15, 4, None, "zeros"), (16, 16, None, None), (16, 6, 10, None)])
@pytest.mark.parametrize("block", [1, 1 << 16])
def test_spectrogram(spark, n_fft, hop, width, boundary, block):
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=300), "b": rng.normal(size=64), None: rng.normal(size=129), "short": rng.normal(size=9)}
    s = spark.createDataFrame([(k, t, float(v)) for k, y in x.items() for t, v in enumerate(y)], SIGNAL).repartition(3)
    got = Y.spectrogram(s, n_fft, hop, 100.0, width, boundary, block=block).toPandas()
    for k, y in x.items():
        want = np.abs(frames_of(y, n_fft, hop, width or n_fft, boundary)) ** 2
        mine = got[got["recording"].isna() if k is None else got["recording"] == k].sort_values(["frame", "bin"])
        assert len(mine) == want.size and not mine.duplicated(["frame", "bin"]).any()
        np.testing.assert_allclose(mine["value"].to_numpy().reshape(want.shape), want, atol=1e-9)
        assert mine["freq"].iloc[1] == 100 / n_fft


def test_spectrogram_outputs_and_grid(spark):
    n = 24_000
    s = spark.range(n).selectExpr("'r' AS recording", "id AS t", "sin(2 * pi() * 500 * id / 16000) AS x")
    power = Y.spectrogram(s, 1024, 160, 16_000.0, boundary="zeros")
    peak = power.groupBy("freq").avg("value").orderBy("avg(value)", ascending=False).first()
    assert abs(peak["freq"] - 500) < 2.5 * 16_000 / 1024
    log = Y.spectrogram(s, 1024, 160, 16_000.0, boundary="zeros", output="log_power", low=400, high=600)
    assert log.selectExpr("min(freq) >= 400 AND max(freq) <= 600 AND min(value) >= -12").first()[0]
    both = log.alias("a").join(power.alias("b"), ["frame", "bin"]).selectExpr("max(abs(a.value - log10(greatest(b.value, 1e-12))))").first()[0]
    assert both < 1e-6
    grid = Y.spectrogram_on_grid(log, 100.0, 50.0, 80).groupBy("bin").agg({"t": "max", "*": "count"}).collect()
    assert {(r["max(t)"], r["count(1)"]) for r in grid} == {(79, 80)}
    with pytest.raises(ValueError):
        Y.spectrogram(s, 16, 8, 100.0, window=17)


def test_envelope_feature(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    s = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], SIGNAL)
    env = np.maximum(D.resample(D.zero_phase(np.abs(x), D.butterworth(2, 10.0, 100.0)), 50.0, 100.0), 0)
    for kind, change, n, want in (("broadband", "none", 230, np.pad(env, (0, 30))), ("broadband", "diff", 150, np.diff(env[:150], prepend=env[:1]) * 50), ("loudness", "none", 200, Y.loudness_of(x, 100.0, 50.0))):
        np.testing.assert_allclose(of(Y.envelope_feature(s, kind, 100.0, 50.0, n, change=change))["a"], want, atol=1e-8)
    for bad in ({"kind": "other"}, {"kind": "broadband", "cut": 60.0}, {"kind": "loudness", "n_times": 0}):
        with pytest.raises(ValueError):
            Y.envelope_feature(s, **{"rate": 100.0, "grid_rate": 50.0, "n_times": 10, **bad})


def test_envelope_query(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    got = {k: g.sort_values("t")["x"].to_numpy() for k, g in QUERIES["envelope_feature"](spark, SF).toPandas().groupby("recording")}
    for k, g in events.groupby("user_id"):
        env = np.maximum(D.resample(D.zero_phase(np.abs(g["value"].to_numpy(float)), D.butterworth(2, 10.0, 100.0)), 50.0, 100.0), 0)
        env = np.pad(env, (0, max(32 - len(env), 0)))[:32]
        np.testing.assert_allclose(got[k], np.abs(np.diff(env, prepend=env[:1])) * 50, atol=2e-6)
