"""Recursive filters: recurrences written out, one sample after the other, against spans, blocks and registered queries."""

import math

import numpy as np
import pandas as pd
import pytest

from voltlake.operators import recursive as R
from voltlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
DESIGNS = {
    "band 4": R.butterworth_band(4, 8.0, 30.0, 100.0), "band 3": R.butterworth_band(3, 0.5, 49.0, 100.0), "band 1": R.butterworth_band(1, 5.0, 20.0, 100.0), "gamma": R.butterworth_band(4, 70.0, 150.0, 1000.0),
    "low 4": R.butterworth(4, 8.0, 100.0), "low 5": R.butterworth(5, 3.0, 100.0), "high 2": R.butterworth(2, 1.0, 100.0, high=True),
}


def once(x, sections, steady=True):
    """y = b0 x + b1 x(-1) + b2 x(-2) - a1 y(-1) - a2 y(-2); before the start x and y are as for ever equal to the first."""
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        x1 = x2 = x[0] if steady else 0.0
        y1 = y2 = gain * x1
        out = []
        for v in x:
            y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        x = out
    return x


def twice(x, sections):
    n, pad = len(x), min(3 * (2 * len(sections) + 1), len(x) - 1)
    if n < 2:
        return np.array(x)
    wide = [2 * x[0] - x[k] for k in range(pad, 0, -1)] + list(x) + [2 * x[-1] - x[n - 1 - k] for k in range(1, pad + 1)]
    return np.array(once(once(wide, sections)[::-1], sections)[::-1][pad : pad + n])


@pytest.mark.parametrize("name", DESIGNS)
def test_spans_equal_recurrence(name):
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 1000):
        x = rng.normal(4, 1, n)
        np.testing.assert_allclose(R.both_ways(x, R.System.of_sections(DESIGNS[name]), R.padding(DESIGNS[name])), twice(x.tolist(), DESIGNS[name]), atol=1e-9)
        np.testing.assert_allclose(R.System.of_sections(DESIGNS[name]).run(x)[0], once(x.tolist(), DESIGNS[name], steady=False), atol=1e-9)


@pytest.mark.parametrize(("order", "low", "high", "rate"), [(1, 5, 20, 100), (2, 5, 20, 100), (3, 0.5, 49, 100), (4, 70, 150, 1000), (5, 8, 30, 100)])
def test_band_pass_design(order, low, high, rate):
    """|H|^2 = 1 / (1 + ((s^2 - w1 w2) / ((w2 - w1) s))^(2 order)) over warped frequencies, and the poles lie inside the circle."""
    sections = R.butterworth_band(order, low, high, rate)
    f = np.linspace(rate / 500, rate / 2.02, 200)
    z, s = np.exp(-2j * np.pi * f / rate), np.tan(np.pi * f / rate)
    h = np.prod([(b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2) for b0, b1, b2, a1, a2 in sections], axis=0)
    w1, w2 = math.tan(math.pi * low / rate), math.tan(math.pi * high / rate)
    np.testing.assert_allclose(abs(h) ** 2, 1 / (1 + ((s * s - w1 * w2) / ((w2 - w1) * s)) ** (2 * order)), atol=1e-9)
    assert len(sections) == order and all(np.abs(np.roots([1, a1, a2])).max() < 1 for *_, a1, a2 in sections)
    middle = np.exp(-2j * math.atan(math.sqrt(w1 * w2)))
    assert np.prod([(b0 + b2 * middle**2) / (1 + a1 * middle + a2 * middle**2) for b0, _, b2, a1, a2 in sections]) == pytest.approx(1)


def test_edges():
    with pytest.raises(ValueError):
        R.butterworth_band(4, 30.0, 8.0, 100.0)
    with pytest.raises(ValueError):
        R.butterworth_band(4, 8.0, 50.0, 100.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(5), []
    for key, n, step in (("long", 1000, 1), ("gaps", 431, 7), ("edge", 200, 1), ("under", 199, 1), ("over", 201, 1), ("one", 1, 1), ("two", 2, 1), ("ten", 10, 1), (None, 330, 1)):
        out += [(key, int(t), float(x)) for t, x in zip(np.arange(n) * step - (90 if key == "gaps" else 0), rng.normal(3, 1, n))]
    return out


def of(df):
    got = {}
    for r in df.collect():
        assert r["t"] not in got.setdefault(r["recording"], {})
        got[r["recording"]][r["t"]] = r["x"]
    return got


@pytest.mark.parametrize("name", ["band 4", "band 1", "low 4", "rc", "rc slow", "ahead", "rest"])
def test_blocks_equal_recurrence(spark, rows, name):
    s = spark.createDataFrame(rows, "recording string, t long, x double").repartition(3)
    if name.startswith("rc"):
        tau = 0.05 if name == "rc" else 20.0  # slow: states carry over many blocks
        got = of(R.rc_smoothed(s, tau, 100.0, block=100))
        r = math.exp(-1 / (tau * 100))
        section = [(1 - r, 0.0, 0.0, -r, 0.0)]
        want = lambda x: np.array(once(once(x, section, False)[::-1], section, False)[::-1])
    elif name in ("ahead", "rest"):
        steady = name == "ahead"
        got = of(R.recursive(s, R.System.of_sections(DESIGNS["low 5"]), steady=steady, backward=False, block=100))
        want = lambda x: np.array(once(x, DESIGNS["low 5"], steady))
    else:
        system = R.System.of_sections(DESIGNS[name])
        got = of(R.recursive(s, system, pad=R.padding(DESIGNS[name]), block=100))
        want = lambda x: twice(x, DESIGNS[name])
    for key in {r[0] for r in rows}:
        x = [x for k, _, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])]
        assert sorted(got[key]) == list(range(len(x)))
        np.testing.assert_allclose([got[key][t] for t in range(len(x))], want(x), rtol=0, atol=1e-9)


def test_tasks_hold_blocks_only(spark, rows):
    class Limited(R.System):  # defined here, so that it reaches the workers by value
        """Refuses a stretch of more than two blocks and the ends' continuation."""

        def run(self, x, state=None):
            assert len(x) <= 2 * 100 + 2 * 27, len(x)
            return R.System.run(self, x, state)

    s = spark.createDataFrame(rows, "recording string, t long, x double")
    system = Limited.of_sections(DESIGNS["band 4"])
    assert R.recursive(s, system, pad=27, block=100).count() == len(rows)
    with pytest.raises(Exception, match="AssertionError"):
        R.recursive(s, system, pad=27, block=1000).count()


def test_million_samples_one_series(spark):
    s = spark.range(1_000_000).selectExpr("'r' AS recording", "id AS t", "sin(id * id % 1009) + 2 AS x")
    got = R.band_passed(s, 8.0, 30.0, 100.0, block=50_000).where("t >= 600000 AND t < 600500").orderBy("t").toPandas()
    x = s.where("t >= 590000 AND t < 610000").orderBy("t").toPandas()["x"].to_numpy()  # far enough from the cut ends
    np.testing.assert_allclose(got["x"], R.both_ways(x, R.System.of_sections(DESIGNS["band 4"]), 27)[10_000:10_500], atol=1e-9)


def test_several_keys_and_empty(spark):
    rng = np.random.default_rng(6)
    data = [(a, b, t, float(v)) for a in ("x", None) for b in (1, 2) for t, v in enumerate(rng.normal(size=250))]
    got = R.low_passed(spark.createDataFrame(data, "recording string, channel int, t long, x double"), 8.0, 100.0, 2, ["recording", "channel"], block=60).toPandas()
    for a in ("x", None):
        for b in (1, 2):
            mine = got[(got["channel"] == b) & (got["recording"].isna() if a is None else got["recording"] == a)].sort_values("t")
            np.testing.assert_allclose(mine["x"], twice([v for p, q, _, v in data if (p, q) == (a, b)], R.butterworth(2, 8.0, 100.0)), atol=1e-9)
    assert R.band_passed(spark.createDataFrame([], "recording string, t long, x double"), 8.0, 30.0, 100.0).count() == 0


def test_band_pass_query(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    got = {k: g.sort_values("t")["x"].to_numpy() for k, g in QUERIES["band_pass"](spark, SF).toPandas().groupby("recording")}
    want = {k: twice(g["value"].tolist(), DESIGNS["band 4"]) for k, g in events.groupby("user_id")}
    assert set(got) == set(want)
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, atol=2e-6)
