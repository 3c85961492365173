"""Filters by blocks give what the same filters give on the whole series."""

import numpy as np
import pytest

from voltlake.operators import filters as D

SECTIONS = D.butterworth(2, 8.0, 100.0)
FILTERS = {
    "highpass": (lambda x: D.highpass(x, 1.0, 100.0), 101, 1, 1),
    "rc_smooth": (lambda x: D.rc_smooth(x, 0.02, 100.0), D.rc_reach(0.02, 100.0), 1, 1),
    "zero_phase": (lambda x: D.zero_phase(np.abs(x), SECTIONS), D.sections_reach(SECTIONS), 1, 1),
    "down": (lambda x: D.resample(x, 64.0, 100.0), D.resample_reach(64.0, 100.0), 16, 25),
    "up": (lambda x: D.resample(x, 300.0, 100.0), D.resample_reach(300.0, 100.0), 3, 1),
}


@pytest.fixture(scope="module")
def rows(spark):
    """A long series, one whose t has gaps and starts below 0, short ones, one of a null key; lengths about the block's edges."""
    rng, out = np.random.default_rng(5), []
    for key, n, step in (("long", 1000, 1), ("gaps", 431, 7), ("edge", 200, 1), ("over", 201, 1), ("one", 1, 1), ("two", 2, 1), (None, 130, 1)):
        out += [(key, int(t), float(x)) for t, x in zip(np.arange(n) * step - (90 if key == "gaps" else 0), rng.normal(3, 1, n))]
    return out


def of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["recording"], {})[r["t"]] = r["x"]
    return got


@pytest.mark.parametrize("name", FILTERS)
def test_blocks_equal_whole_series(spark, rows, name):
    f, reach, up, down = FILTERS[name]
    got = of(D.per_block(spark.createDataFrame(rows, "recording string, t long, x double"), f, reach, up=up, down=down, block=100))
    for key in {r[0] for r in rows}:
        whole = f(np.array([x for k, _, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])]))
        assert sorted(got[key]) == list(range(len(whole)))
        np.testing.assert_allclose([got[key][t] for t in range(len(whole))], whole, rtol=0, atol=1e-9)


def test_no_task_holds_a_series(spark, rows):

    def longest(x):
        return np.full(len(x), float(len(x)))

    seen = D.per_block(spark.createDataFrame(rows, "recording string, t long, x double"), longest, 10, block=100)
    lengths = [r["x"] for r in seen.collect()]
    assert len(lengths) == len(rows) and max(lengths) == 120


def test_empty(spark):
    empty = spark.createDataFrame([], "recording string, t long, x double")
    assert D.per_block(empty, lambda x: x, 10).count() == 0
    assert D.intensity_db(empty, 100.0, 11).count() == 0


def test_operators_by_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(D.per_block, "__defaults__", (("recording",), 1, 1, 100))
    s = spark.createDataFrame(rows, "recording string, t long, x double")
    x = np.array([v for k, _, v in rows if k == "long"])
    k = np.kaiser(11, 20.0)
    want = 10 * np.log10(np.maximum(np.convolve((x - x.mean()) ** 2, k / k.sum(), mode="same"), 1e-30))
    np.testing.assert_allclose([v for _, v in sorted(of(D.intensity_db(s, 100.0, 11))["long"].items())], want, atol=1e-6)
    want = np.maximum(D.resample(D.zero_phase(np.abs(x), D.butterworth(2, 8.0, 100.0)), 50.0, 100.0), 0)
    np.testing.assert_allclose([v for _, v in sorted(of(D.rectified_envelope(s, 100.0, 8.0, 50.0))["long"].items())], want, atol=1e-9)
    up = D.resample(x, 300.0, 100.0)
    want = D.resample(np.diff(up, prepend=up[:1]) * 300, 100.0, 300.0)[: len(x)]
    np.testing.assert_allclose([v for _, v in sorted(of(D.derivative(s, "hr", 100.0, 3))["long"].items())], want, atol=1e-6)
