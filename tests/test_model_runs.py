"""Model runs against refits by brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.operators import encoding as E
from voltlake.operators import model_runs as M
from voltlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ALPHAS = [0.1, 1.0, 10.0, 100.0]


def ridge(x, y, alpha, w=None):
    w = np.ones(len(x)) if w is None else w
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    a, b = (x - mx).T @ ((x - mx) * w[:, None]), (x - mx).T @ ((y - my) * w[:, None])
    coef = np.linalg.solve(a + alpha * np.eye(len(a)), b)
    return coef, my - mx @ coef


def scores(y, p):
    r = [0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1] for a, b in zip(y.T, p.T)]
    return np.array(r), 1 - ((y - p) ** 2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)


@pytest.fixture(scope="module")
def data():
    """Runs of different lengths, two features, four outputs, means of a million."""
    rng = np.random.default_rng(1)
    kernel, out = rng.normal(size=(3 * 2, 4)), {}
    for run, n in enumerate((300, 220, 400, 150, 260)):
        x = rng.normal(size=(n, 2))
        lagged = np.hstack([np.vstack([np.zeros((k, 2)), x[: n - k]]) for k in range(3)])
        out[run] = x + 1e6, lagged @ kernel + 0.2 * rng.normal(size=(n, 4)) - 1e6
    return out


@pytest.fixture(scope="module")
def design(spark, data):
    rows = [(r, t, x[t].tolist(), y[t].tolist()) for r, (x, y) in data.items() for t in range(len(x))]
    return E.lagged(spark.createDataFrame(rows, "recording int, t long, x array<double>, y array<double>").repartition(5), [0, 1, 2])


def local(data):
    return {r: (np.hstack([x[2 - k : len(x) - k] for k in range(3)]), y[2:]) for r, (x, y) in data.items()}


def together(parts):
    return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])


def test_leave_one_run_out_equals_refits(design, data):
    rows = design.select(F.col("recording").alias("fold"), F.floor((F.col("t") - 2) / 50).alias("segment"), "lagged", "y")
    got = {b: {(r.fold, r.alpha, r.output): (r.pearson, r.r2) for r in M.left_out(rows, ALPHAS, by_duration=b).collect()} for b in (True, False)}
    runs = local(data)
    for fold in runs:
        x, y = together([runs[r] for r in runs if r != fold])
        for alpha in ALPHAS:
            coef, c = ridge(x - 1e6, y + 1e6, alpha)
            tx, ty = runs[fold][0] - 1e6, runs[fold][1] + 1e6
            cuts = list(range(0, len(tx), 50))
            each = [scores(ty[a : a + 50], tx[a : a + 50] @ coef + c) for a in cuts]
            sizes = np.array([min(50, len(tx) - a) for a in cuts], float)
            for b, w in ((True, sizes / sizes.sum()), (False, np.full(len(cuts), 1 / len(cuts)))):
                want = [sum(wi * e[k] for wi, e in zip(w, each)) for k in (0, 1)]
                for o in range(4):
                    np.testing.assert_allclose(got[b][fold, alpha, o], (want[0][o], want[1][o]), atol=1e-6)


def test_weights_and_near_rows(design, data):
    weighted = design.withColumn("w", F.when(F.col("recording") == 1, 3.0).when(F.col("recording") == 3, 0.0).otherwise(1.0)).select(F.col("recording").alias("fold"), F.lit(0).alias("segment"), "lagged", "y", "w")
    near = design.where("recording = 2 AND t < 102").select(F.lit(0).alias("fold"), "lagged", "y")
    got = {(r.fold, r.output): r.r2 for r in M.left_out(weighted, [1.0]).collect()}
    gone = {(r.fold, r.output): r.r2 for r in M.left_out(weighted.drop("w"), [1.0], near=near).collect()}
    runs, weight = local(data), {1: 3.0, 3: 0.0}
    for fold in runs:
        x, y = together([runs[r] for r in runs if r != fold])
        w = np.concatenate([np.full(len(runs[r][0]), weight.get(r, 1.0)) for r in runs if r != fold])
        coef, c = ridge(x - 1e6, y + 1e6, 1.0, w)
        want = scores(runs[fold][1] + 1e6, (runs[fold][0] - 1e6) @ coef + c)[1]
        np.testing.assert_allclose([got[fold, o] for o in range(4)], want, atol=1e-6)
    x, y = together([(runs[r][0][100:], runs[r][1][100:]) if r == 2 else runs[r] for r in runs if r != 0])
    coef, c = ridge(x - 1e6, y + 1e6, 1.0)
    np.testing.assert_allclose([gone[0, o] for o in range(4)], scores(runs[0][1] + 1e6, (runs[0][0] - 1e6) @ coef + c)[1], atol=1e-6)


def test_run_and_saved_model(spark, data, tmp_path):
    rows = spark.createDataFrame([(r, t, x[t].tolist(), y[t].tolist()) for r, (x, y) in data.items() for t in range(len(x))], "recording int, t long, x array<double>, y array<double>")
    run = M.run_model(rows, [0, 1, 2], 100.0, ALPHAS)
    z = {r: tuple((v - v.mean(0)) / v.std(0) for v in p) for r, p in data.items()}
    z = {r: (np.hstack([np.vstack([np.zeros((k, 2)), x[: len(x) - k]]) for k in range(3)]), y) for r, (x, y) in z.items()}
    held = {a: np.mean([scores(z[f][1], z[f][0] @ ridge(*together([z[r] for r in z if r != f]), a)[0])[0].mean() for f in z]) for a in ALPHAS}
    assert run.alpha == max(held, key=held.get) and run.warnings == ()
    coef, c = ridge(*together(list(z.values())), run.alpha)
    m = run.model.first()
    np.testing.assert_allclose(m.coef, coef.ravel(), atol=1e-8)
    np.testing.assert_allclose(m.intercept, c, atol=1e-8)
    for r in run.scores.collect():
        np.testing.assert_allclose((r.pearson, r.r2), [s[r.output] for s in scores(z[r.recording][1], z[r.recording][0] @ coef + c)], atol=1e-8)
    run.save(str(tmp_path / "m"))
    model, meta = M.load_model(spark, str(tmp_path / "m"))
    assert model.first().coef == m.coef and meta["lags"] == [0, 1, 2] and meta["alpha"] == run.alpha and meta["backend"] == "ridge"
    one = M.run_model(rows.where("recording = 1"), [0], 100.0, ALPHAS, alpha=7.0)
    assert one.alpha == 7.0 and one.held_out is None and len(one.warnings) == 1


def test_lasso(design, data):
    """The conditions that the best coefficients meet, and zeros where the penalty is large."""
    x, y = together(list(local(data).values()))
    x, y = x - x.mean(0), y - y.mean(0)
    for alpha in (1.0, 300.0, 1e9):
        w = np.array(M.fit_sums(design, [alpha], "lasso").first().coef).reshape(6, 4)
        slope = x.T @ (y - x @ w)
        assert (np.abs(slope) <= alpha * (1 + 1e-6) + 1e-4).all()
        on = w != 0
        np.testing.assert_allclose(slope[on], alpha * np.sign(w[on]), rtol=1e-5, atol=1e-3)
    assert not on.any()


def test_backends(spark, design):
    assert M.backends() == ["lasso", "ridge"]
    with pytest.raises(KeyError, match="lasso, ridge"):
        M.backend_of("forest")
    with pytest.raises(ValueError):
        M.register_backend("ridge", M.Ridge())
    rows = design.select(F.lit(1).alias("fold"), F.lit(0).alias("segment"), "lagged", "y")
    with pytest.raises(Exception, match="leaves no rows"):
        M.left_out(rows, [1.0]).collect()
    with pytest.raises(ValueError):
        M.left_out(rows, [0.0])
    with pytest.raises(ValueError, match="no rows"):
        M.left_out(rows.limit(0), [1.0])


def test_segments_and_folds(spark):
    rows = spark.createDataFrame([(r, t) for r, n in ((1, 100), (2, 95)) for t in range(n)], "recording int, t long")
    n = lambda df: sorted((r["recording"], r["segment"], r["count"]) for r in df.groupBy("recording", "segment").count().collect())
    assert n(M.segments_of(rows, 10.0, seconds=4.0)) == [(1, 0, 40), (1, 1, 40), (1, 2, 20), (2, 0, 40), (2, 1, 40), (2, 2, 15)]
    assert n(M.segments_of(rows, 10.0, seconds=4.0, drop_last=True)) == [(1, 0, 40), (1, 1, 40), (2, 0, 40), (2, 1, 40)]
    assert n(M.segments_of(rows, 10.0, per_run=2)) == [(1, 0, 50), (1, 1, 50), (2, 0, 47), (2, 1, 48)]
    assert M.segments_of(rows.where("recording = 1"), 10.0, seconds=5.0, per_run=2).count() == 100
    with pytest.raises(Exception, match="don't fit"):
        M.segments_of(rows, 10.0, seconds=5.0, per_run=2).count()
    segments = M.segments_of(rows, 10.0, seconds=1.0).select("recording", "segment").distinct()
    for rule in ("round_robin", "blocked_per_run"):
        plain = {(r.recording, r.segment): r.fold for r in M.segment_folds(segments, 4, rule).collect()}
        assert all(f == (s % 4 if rule == "round_robin" else s * 4 // 10) for (_, s), f in plain.items())
        a, b, c = ({(r.recording, r.segment): r.fold for r in M.segment_folds(s, 4, rule, seed=k).collect()} for s, k in ((segments, 1), (segments.repartition(7), 1), (segments, 2)))
        assert a == b and a != c and a != plain and sorted(a.values()) == sorted(plain.values())
    with pytest.raises(ValueError):
        M.segment_folds(segments, 50)


def test_lasso_query(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    code = {"click": 1, "error": 2, "purchase": 3, "signup": 4}
    parts = {}
    for user, g in events.groupby("user_id"):
        x, y = g["event_type"].map(lambda e: code.get(e, 5)).to_numpy(float), g["value"].to_numpy(float)
        parts[user] = np.stack([x[2 - k : len(x) - k] for k in range(3)], axis=1), np.stack([y, np.sqrt(np.abs(y))], axis=1)[2:]
    got = {(r.fold, r.alpha): r.score for r in QUERIES["lasso_cross_validation"](spark, SF).collect()}
    folds = {u % 4 for u in parts}
    assert set(got) == {(f, a) for f in folds for a in (1.0, 1000.0)}
    for fold, alpha in got:
        x, y = together([p for u, p in parts.items() if u % 4 != fold])
        mx, my, w = x.mean(0), y.mean(0), np.zeros((3, 2))
        for _ in range(3000):  # proximal gradient, another way to the same minimum
            step = 1 / np.linalg.norm((x - mx).T @ (x - mx), 2)
            w = w + step * (x - mx).T @ ((y - my) - (x - mx) @ w)
            w = np.sign(w) * np.maximum(np.abs(w) - step * alpha, 0)
        each = [(len(p[0]), scores(p[1], (p[0] - mx) @ w + my)[1]) for u, p in parts.items() if u % 4 == fold and len(p[0])]
        want = np.median(sum(n * s for n, s in each) / sum(n for n, _ in each))
        assert abs(got[fold, alpha] - want) < 2e-5
