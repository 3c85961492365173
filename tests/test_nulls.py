"""Null distributions against sums written out and against brute-force permutations; nearest points by rings against all pairs."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from voltlake.operators import channels as C
from voltlake.operators import permutations as P

SCHEMA = "recording string, t long, y double, p double"


def frame(spark, series):
    return spark.createDataFrame([(k, t, float(a), float(b)) for k, (y, p) in series.items() for t, (a, b) in enumerate(zip(y, p, strict=True))], SCHEMA).repartition(3)


@pytest.mark.parametrize("whole", [30, 1 << 20])
def test_every_rotation(spark, whole):
    rng = np.random.default_rng(1)
    series = {k: (5e5 + rng.normal(size=n), rng.normal(size=n)) for k, n in {"a": 2, "b": 31, "c": 60, None: 144}.items()}
    series["flat"] = (np.full(7, 0.1), rng.normal(size=7))
    series["one"] = ([1.0], [2.0])
    got = {}
    for r in P.rotations(frame(spark, series), ["recording"], "y", "p", whole=whole).collect():
        got.setdefault(r.recording, {})[r["shift"]] = r.r
    for k, (y, p) in series.items():
        want = [np.corrcoef(y, np.roll(p, s))[0, 1] if k not in ("flat", "one") else 0.0 for s in range(len(y))]
        assert np.allclose([got[k][s] for s in range(len(y))], want, atol=1e-9) and len(got[k]) == len(y)
    null = {r.recording: r for r in P.all_rotations_null(frame(spark, series), ["recording"], "y", "p", whole=whole).collect()}
    assert (null["one"].observed, null["one"].null_mean, null["one"].reached) == (0.0, None, None) and null["flat"].reached == 1.0
    c = [got["c"][s] for s in range(60)]
    assert null["c"].reached == sum(v >= c[0] - 1e-9 for v in c[1:]) / 59 and null["c"].null_sd == pytest.approx(np.std(c[1:]))


def test_no_rows(spark):
    empty = frame(spark, {"a": ([1.0], [1.0])}).limit(0)
    assert P.all_rotations_null(empty, ["recording"], "y", "p").count() == 0 and P.permuted_null(empty, ["recording"], "y", "p", 5).count() == 0
    assert C.nearest_contacts(spark.createDataFrame([], "group int, id int, x double, y double, z double"), 3).count() == 0


def test_permutations_are_uniform(spark):
    """Four different values: each of the 24 orders (they have different r) equally often, in blocks or whole."""
    y, p = [0.0, 1.0, 10.0, 100.0], [0.0, 1.0, 3.0, 7.0]
    want = sorted(np.corrcoef(y, q)[0, 1] for q in permutations(p))
    for block, keys in ((8192, 1), (2, 600)):
        times = 6000 // keys
        rows = P.permutations(frame(spark, {f"s{i}": (y, p) for i in range(keys)}), ["recording"], "y", "p", times, seed=3, block=block).collect()
        n = Counter(round(r.r, 9) for r in rows)
        assert sorted(n) == pytest.approx(sorted(round(w, 9) for w in want)) and len(rows) == 6000
        if keys == 1:
            assert sum((v - 250) ** 2 / 250 for v in n.values()) < 50  # chi square, 23 degrees of freedom
        else:
            assert max(n.values()) < 400 and min(n.values()) > 120  # ten repeats of each block order are not independent


def test_permuted_null_is_that_of_a_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.exponential(size=3000)
    p = 0.03 * y + rng.normal(size=3000)
    rows = frame(spark, {"a": (y, p), "b": (y[:50], p[:50] * 0 + 1)}).union(spark.createDataFrame([("a", 9999, None, 1.0), ("a", 9998, float("nan"), 1.0)], SCHEMA))
    brute = np.array([np.corrcoef(y, rng.permutation(p))[0, 1] for _ in range(2000)])
    for block in (8192, 500):
        got = {r.recording: r for r in P.permuted_null(rows, ["recording"], "y", "p", 2000, seed=1, block=block).collect()}
        a = got["a"]
        assert a.n == 3000 and a.observed == pytest.approx(np.corrcoef(y, p)[0, 1])
        assert abs(a.null_mean) < 4 * brute.std() * (1 / 2000 + 1 / min(block, 3000)) ** 0.5 and a.null_sd == pytest.approx(brute.std(), rel=0.08)
        assert a.p == pytest.approx((1 + (brute >= a.observed).sum()) / 2001, abs=0.05)
        assert (got["b"].observed, got["b"].null_sd, got["b"].p) == (0.0, 0.0, 1.0)


def test_permutations_rerun_alike(spark):
    rng = np.random.default_rng(4)
    rows = frame(spark, {"a": rng.normal(size=(2, 300))})
    first, again, other = ({r.number: round(r.r, 12) for r in P.permutations(x, ["recording"], "y", "p", 20, seed, 64).collect()} for x, seed in ((rows, 5), (rows.repartition(7), 5), (rows, 6)))
    assert first == again and first != other


def brute_nearest(points, k):
    out = set()
    for i, a in points:
        d = sorted((np.sqrt(sum((u - v) ** 2 for u, v in zip(a, b, strict=True))), j) for j, b in points if j != i)
        out |= {(i, j, rank, round(float(v), 9)) for rank, (v, j) in enumerate(d[:k], 1)}
    return out


CLOUDS = {
    "spread": lambda rng: rng.normal(size=(400, 3)),
    "one place": lambda rng: np.ones((60, 3)),
    "lattice": lambda rng: np.array([(a, b, c) for a in range(7) for b in range(7) for c in range(7)], float),
    "tight and far": lambda rng: np.concatenate([1e-4 * rng.normal(size=(200, 3)), 1e3 * rng.normal(size=(40, 3)), np.zeros((20, 3))]),
    "line": lambda rng: np.stack([np.arange(150.0) ** 2, np.zeros(150), np.zeros(150)], axis=1),
    "few": lambda rng: rng.normal(size=(3, 3)),
    "offset": lambda rng: 1e6 + rng.uniform(size=(200, 3)),
}


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_by_rings(spark, k):
    """All clouds as groups of one table, so that a grid that suits one need not suit another, and each alone."""
    rng = np.random.default_rng(6)
    clouds = {name: [(i, tuple(map(float, v))) for i, v in enumerate(f(rng))] for name, f in CLOUDS.items()}
    rows = [(name, i, *v) for name, c in clouds.items() for i, v in c]
    bad = [("few", 90, None, 0.0, 0.0), ("few", 91, float("nan"), 0.0, 0.0), ("few", None, 0.0, 0.0, 0.0), (None, 92, 0.0, 0.0, 0.0), ("few", 0, *clouds["few"][0][1])]
    df = spark.createDataFrame(rows + bad, "group string, id int, x double, y double, z double")
    got = C.nearest_contacts(df, k).collect()
    for name, c in clouds.items():
        assert {(r.id, r.other, r["rank"], round(r.distance, 9)) for r in got if r.group == name} == brute_nearest(c, k), name
    for name in ("tight and far", "lattice"):
        alone = C.nearest_contacts(df.where(df.group == name), k).collect()
        assert {(r.id, r.other, r["rank"], round(r.distance, 9)) for r in alone} == brute_nearest(clouds[name], k)
    assert len({(r.group, r.id, r["rank"]) for r in got}) == len(got)
