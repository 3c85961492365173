"""The encoding queries against numpy over all events."""

import datetime

import numpy as np
import pytest

from voltlake.operators import encoding as E
from voltlake.plans.catalog import QUERIES

CODES = {"click": 1.0, "error": 2.0, "purchase": 3.0, "signup": 4.0, "view": 5.0}
GAIN = {0: 3.0, 1: -2.0, 2: 1.0}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Eight recordings whose values follow the codes of the last three events."""
    d, zero, rng = str(tmp_path_factory.mktemp("coded")), datetime.datetime(2024, 1, 1), np.random.default_rng(5)
    series, rows = {}, []
    for u, n in {1: 90, 2: 70, 3: 80, 4: 60, 45: 50, 46: 40, 47: 30, 48: 120}.items():
        kinds = rng.choice(list(CODES), n)
        x = np.array([CODES[k] for k in kinds])
        y = sum(g * np.concatenate([np.zeros(k), x[: n - k]]) for k, g in GAIN.items()) + rng.normal(size=n)
        series[u] = x, y
        rows += [(1000 * u + t, u, zero + datetime.timedelta(seconds=t), str(kinds[t]), float(y[t])) for t in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").repartition(3).write.parquet(f"{d}/events.parquet")
    return d, series


def design(series, lags):
    """fold, lagged rows and y of each recording, without its first rows."""
    return [(u % 4, np.stack([x[lags - 1 - k : len(x) - k] for k in range(lags)], 1), y[lags - 1 :]) for u, (x, y) in series.items()]


def ridge(rows, alpha):
    x, y = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - y.mean()))
    return w, y.mean() - x.mean(0) @ w


def scores(rows, alphas):
    out = {}
    for fold in range(4):
        x, y = (np.concatenate([r[k] for r in rows if r[0] == fold]) for k in (1, 2))
        for a in alphas:
            w, b = ridge([r for r in rows if r[0] != fold], a)
            out[fold, a] = np.corrcoef(x @ w + b, y)[0, 1]
    return out


def test_cross_validation_over_all_events(spark, events):
    d, series = events
    want = scores(design(series, 5), [0.01, 1.0, 100.0])
    assert {(r.fold, r.alpha): r.score for r in QUERIES["encoding_cross_validation"](spark, d).collect()} == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_model_over_all_events(spark, events):
    d, series = events
    rows = design(series, 3)
    found = scores(rows, [0.1, 1e4])
    alpha = max([0.1, 1e4], key=lambda a: np.mean([found[f, a] for f in range(4)]))
    w, b = ridge(rows, alpha)
    x, y = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
    r = QUERIES["encoding_model"](spark, d).first()
    assert r.r == pytest.approx(np.corrcoef(x @ w + b, y)[0, 1], abs=1e-4) and r.r2 == pytest.approx(1 - ((y - x @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)


def test_fold_scores_equal_those_of_predicted_rows(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=(400, 3)), rng.normal(size=(400, 2))
    y = x @ np.array([[1.0, -2.0], [0.5, 0.0], [0.0, 3.0]]) + e + [5.0, -100.0]
    frame = spark.createDataFrame([(k // 200, k % 200, x[k].tolist(), y[k].tolist()) for k in range(400)], "recording long, t long, lagged array<double>, y array<double>")
    rows = E.time_folds(frame, 4, 10)
    fold = np.array([min(t * 10 // 200 // 3 if t * 10 // 200 < 6 else 2 + (t * 10 // 200 - 6) // 2, 3) for t in list(range(200)) * 2])
    assert {(r.recording, r.t): r.fold for r in rows.collect()} == {(k // 200, k % 200): fold[k] for k in range(400)}
    t = np.arange(400) % 200
    got = {(r.fold, r.alpha, r.output): (r.pearson, r.r2) for r in E.fold_scores(rows, [0.1, 50.0], E.near_rows(rows, 7)).collect()}
    for f in range(4):
        own, span = fold == f, t[fold == f]
        train = ~own & ~((t >= span.min() - 7) & (t <= span.max() + 7))
        for a in (0.1, 50.0):
            c = x[train] - x[train].mean(0)
            w = np.linalg.solve(c.T @ c + a * np.eye(3), c.T @ (y[train] - y[train].mean(0)))
            p = (x[own] - x[train].mean(0)) @ w + y[train].mean(0)
            for k in range(2):
                r2 = 1 - ((y[own, k] - p[:, k]) ** 2).sum() / ((y[own, k] - y[own, k].mean()) ** 2).sum()
                assert got[f, a, k] == (pytest.approx(np.corrcoef(p[:, k], y[own, k])[0, 1], abs=1e-8), pytest.approx(r2, abs=1e-8))
    assert len(got) == 16


def test_a_fold_without_training_rows_fails(spark):
    rows = spark.createDataFrame([(0, [1.0], [2.0]), (0, [2.0], [1.0])], "fold int, lagged array<double>, y array<double>")
    with pytest.raises(Exception, match="no rows to train on"):
        E.fold_scores(rows, [1.0]).collect()


def test_scores_of_a_constant_output_are_zero(spark):
    rows = spark.createDataFrame([(k % 2, [float(k)], [7.0]) for k in range(8)], "fold int, lagged array<double>, y array<double>")
    assert {(r.fold, r.pearson, r.r2) for r in E.fold_scores(rows, [1.0]).collect()} == {(0, 0.0, 0.0), (1, 0.0, 0.0)}
