"""Lagged linear encoding models: design, folds, distributed normal equations, ridge, prediction and scores.

Features and outputs are arrays on each sample (x, y); sums over samples are the only thing that is shuffled, and a
fold's sums are reused for every penalty.  What is solved on one machine has lags times features unknowns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys whose sums a task holds before it emits them.
HELD = 64
#: The sums over samples, beside their number, in the order in which they are held.
SUMS = ("sx", "sy", "xx", "xy", "yy")


def lagged(signal: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("recording",), mode: str = "valid", value: str = "x") -> DataFrame:
    """Adds ``lagged``: the value (or feature array, flattened lag by lag) at t - lag.  valid drops edge rows, same fills zeros."""
    w = Window.partitionBy(*keys).orderBy("t")
    is_array = signal.schema[value].dataType.typeName() == "array"
    zero = F.transform(F.col(value), lambda v: F.lit(0.0)) if is_array else F.lit(0.0)
    cols = [F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w) for k in lags]
    filled = [F.coalesce(c, zero) for c in cols]
    out = signal.withColumn("lagged", F.flatten(F.array(*filled)) if is_array else F.array(*filled))
    if mode == "same":
        return out
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    row = F.row_number().over(w) - 1
    return out.withColumns({"_n": n, "_row": row}).where((F.col("_row") >= max(*lags, 0)) & (F.col("_row") < F.col("_n") + min(*lags, 0))).drop("_n", "_row")


def gram(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rows (lagged, y: arrays) -> one row a key and task's worth of sums, added up: n, sx, sy, xx, xy (flat, row-major), yy (by output).

    Rows are summed by key in numpy, batch after batch, and a task emits each key's sums once (HELD keys at most at a time).
    """
    names = list(keys)
    schema = ", ".join([*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in names], "n double, " + ", ".join(f"{c} array<double>" for c in SUMS)])

    def sums(batches):
        held: dict[tuple, list] = {}

        def frame() -> pd.DataFrame:
            return pd.DataFrame([[*key, *total] for key, total in held.items()], columns=[*names, "n", *SUMS])

        for pdf in batches:
            for key, g in pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]:
                if not len(g):
                    continue
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                x, y = np.array(g["lagged"].tolist(), float), np.array(g["y"].tolist(), float)
                own = [float(len(g)), x.sum(0), y.sum(0), (x.T @ x).ravel(), (x.T @ y).ravel(), (y * y).sum(0)]
                held[key] = [a + b for a, b in zip(held[key], own, strict=True)] if key in held else own
            if len(held) > HELD:
                yield frame()
                held.clear()
        if held:
            yield frame()

    part = rows.select(*names, "lagged", "y").mapInPandas(sums, schema)
    return add_sums(part, names)


def add_sums(part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds array columns place by place: exploded with their index, so partial sums are combined before the shuffle."""
    cols = [c for c in SUMS if c in part.columns]
    named = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])
    flat = part.select(*keys, "n", F.explode(named).alias("a")).select(*keys, "n", "a.c", F.posexplode("a.v").alias("i", "v"))
    total = flat.groupBy(*keys, "c", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    pick = [F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("i", "v")))), lambda s: s["v"]).alias(c) for c in cols]
    return total.groupBy(*keys).agg(F.max("n").alias("n"), *pick)


def ridge(sums: DataFrame, alphas: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One row a key and alpha: coef (flat, input by output) and intercept, from centred sums."""
    names = list(keys)
    schema = ", ".join([*[f"{k} {sums.schema[k].dataType.simpleString()}" for k in names], "alpha double, coef array<double>, intercept array<double>"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                p, q = len(r.sx), len(r.sy)
                mx, my = np.asarray(r.sx) / r.n, np.asarray(r.sy) / r.n
                a = np.asarray(r.xx).reshape(p, p) - r.n * np.outer(mx, mx)
                b = np.asarray(r.xy).reshape(p, q) - r.n * np.outer(mx, my)
                values, vectors = np.linalg.eigh((a + a.T) / 2)  # once for all alphas
                rotated = vectors.T @ b
                for alpha in alphas:
                    w = vectors @ (rotated / (np.maximum(values, 0) + alpha)[:, None])
                    out.append([*[getattr(r, k) for k in names], float(alpha), w.ravel(), my - mx @ w])
            yield pd.DataFrame(out, columns=[*names, "alpha", "coef", "intercept"])

    return sums.select(*names, "n", "sx", "sy", "xx", "xy").mapInPandas(solve, schema)


def predict(rows: DataFrame, models: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """rows (lagged) with ``predicted``: an array over outputs.  models has one row a key (and alpha)."""
    if not on:  # a single model: a second one fails the query
        models = models.agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several models, but no key to choose by")).cast("struct<coef:array<double>,intercept:array<double>>")).otherwise(F.first(F.struct("coef", "intercept"))).alias("_m")).select("_m.*")
    met = rows.join(models, list(on)) if on else rows.join(F.broadcast(models))
    q = F.size("intercept")
    one = lambda k: F.aggregate(F.zip_with("lagged", F.filter("coef", lambda v, i: i % q == k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.element_at("intercept", (k + 1).cast("int"))
    return met.withColumn("predicted", F.transform(F.sequence(F.lit(0), q - 1), one)).drop("coef", "intercept")


def kernel_predict(signal: DataFrame, kernel: dict[int, float], keys: Sequence[str] = ("recording",), intercept: float = 0.0, mode: str = "same") -> DataFrame:
    """kernel: lag -> coefficient.  yhat[t] = sum of x[t - lag] * coefficient + intercept, in one window; valid: 0 where a lag is beyond the edge."""
    w = Window.partitionBy(*keys).orderBy("t")
    moved = [F.lag("x", k).over(w) if k >= 0 else F.lead("x", -k).over(w) for k in kernel]
    total = sum(F.coalesce(m, F.lit(0.0)) * float(c) for m, c in zip(moved, kernel.values(), strict=True)) + intercept
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.isNotNull()
    return signal.select(*keys, "t", (total if mode == "same" else F.when(inside, total).otherwise(0.0)).alias("yhat"))


def purge(train: DataFrame, test: DataFrame, gap: int, key: str = "recording") -> DataFrame:
    """Train segments (start, stop) further than gap from every test segment of the same fold and recording."""
    b = test.select(F.col(key).alias("_k"), F.col("fold").alias("_f"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    near = (F.col(key) == F.col("_k")) & (F.col("fold") == F.col("_f")) & ~((F.col("stop") + gap <= F.col("_s")) | (F.col("_e") + gap <= F.col("start")))
    return train.join(b, near, "left_anti")


def gap_mask(rows: DataFrame, folds: DataFrame, gap: int, key: str = "recording") -> DataFrame:
    """Rows outside the hull of their fold's test samples, widened by gap."""
    hull = folds.groupBy(key, "fold").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    return rows.join(hull, key).where((F.col("t") < F.col("_lo") - gap) | (F.col("t") > F.col("_hi") + gap)).drop("_lo", "_hi")


def pearson(a: str, b: str) -> Column:
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def r2(y: str, predicted: str) -> Column:
    rest = F.sum(F.pow(F.col(y) - F.col(predicted), F.lit(2.0)))
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - rest / total).otherwise(0.0)


def weighted_score(score: str, weight: str) -> Column:
    return F.sum(F.col(score) * F.col(weight)) / F.sum(weight)


def best_alpha(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The alpha of the highest mean score over folds; of equal ones the smallest."""
    mean = scores.groupBy(*keys, "alpha").agg(F.avg("score").alias("score"))
    return mean.groupBy(*keys).agg(F.max_by("alpha", F.struct(F.col("score"), -F.col("alpha"))).alias("alpha"), F.max("score").alias("score"))


def fold_scores(rows: DataFrame, alphas: Sequence[float], near: DataFrame | None = None) -> DataFrame:
    """rows (fold, lagged, y) -> fold, alpha, output, pearson, r2 of each held-out fold, from sums alone: rows are read once.

    A fold's training sums are the total less its own, and less those of ``near``: rows (fold, lagged, y) of other folds that
    lie too close to this one.  A prediction is linear in the inputs, so its sums over the held-out rows follow from theirs.
    """
    own = gram(rows, ["fold"])
    total = add_sums(own.drop("fold"), []).select(F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in SUMS])
    met = own.join(F.broadcast(total))  # a row a fold
    if near is not None:
        close = gram(near, ["fold"]).select("fold", F.col("n").alias("near_n"), *[F.col(c).alias(f"near_{c}") for c in SUMS])
        met = met.join(close, "fold", "left")
        less = {c: F.zip_with(c, F.coalesce(F.col(f"near_{c}"), F.transform(c, lambda v: F.lit(0.0))), lambda a, b: a + b) for c in SUMS}
        gone = F.col("n") + F.coalesce("near_n", F.lit(0.0))
    else:
        less, gone = {c: F.col(c) for c in SUMS}, F.col("n")
    test = F.struct("n", *SUMS).alias("test")
    train = met.select("fold", test, (F.col("_n") - gone).alias("n"), *[F.zip_with(f"_{c}", less[c], lambda a, b: a - b).alias(c) for c in SUMS])
    checked = train.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("a fold leaves no rows to train on")).cast("double")))
    models = ridge(checked, alphas, ["fold"])
    kind = rows.schema["fold"].dataType.simpleString()

    def judged(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                s = r.test
                n, sx, sy, yy = s["n"], np.asarray(s["sx"]), np.asarray(s["sy"]), np.asarray(s["yy"])
                p, q = len(sx), len(sy)
                w, b = np.asarray(r.coef).reshape(p, q), np.asarray(r.intercept)
                mx, my = sx / n, sy / n
                xx = np.asarray(s["xx"]).reshape(p, p) - n * np.outer(mx, mx)
                xy = np.asarray(s["xy"]).reshape(p, q) - n * np.outer(mx, my)
                both, own, whole = (w * xy).sum(0), np.maximum((w * (xx @ w)).sum(0), 0), np.maximum(yy - n * my * my, 0)
                off = my - mx @ w - b  # mean of what is left
                flat = (own <= 1e-12 * n) | (whole <= 1e-12 * n)
                corr = np.where(flat, 0.0, both / np.sqrt(np.where(flat, 1.0, own * whole)))
                rest = np.maximum(whole - 2 * both + own, 0) + n * off * off
                fit = np.where(whole > 0, 1 - rest / np.where(whole > 0, whole, 1.0), 0.0)
                out += [[r.fold, r.alpha, k, float(corr[k]), float(fit[k])] for k in range(q)]
            yield pd.DataFrame(out, columns=["fold", "alpha", "output", "pearson", "r2"])

    pairs = models.join(own.select("fold", test), "fold")
    return pairs.select("fold", "alpha", "coef", "intercept", "test").mapInPandas(judged, f"fold {kind}, alpha double, output int, pearson double, r2 double")


def cross_validate(rows: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """rows (fold, lagged, y) -> fold, alpha, score: the mean Pearson over outputs on each held-out fold."""
    return fold_scores(rows, alphas).groupBy("fold", "alpha").agg(F.avg("pearson").alias("score"))


def time_folds(samples: DataFrame, folds: int, blocks: int, key: str = "recording") -> DataFrame:
    """samples (key, t, ...) with ``fold``: each key's time in equal blocks, and those, in order, in folds (the first ones a block longer)."""
    if folds > blocks:
        raise ValueError(f"{folds} folds of {blocks} blocks")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy("t")) - 1
    block = F.floor(at * blocks / n)
    more = blocks % folds
    size, edge = blocks // folds, more * (blocks // folds + 1)
    fold = F.when(block < edge, F.floor(block / (size + 1))).otherwise(more + F.floor((block - edge) / size))
    return samples.withColumn("fold", fold.cast("int"))


def near_rows(rows: DataFrame, gap: int, key: str = "recording") -> DataFrame:
    """rows (key, t, fold) of other folds within gap samples of a fold's span, once for each such fold."""
    span = rows.groupBy(key, F.col("fold").alias("_fold")).agg((F.min("t") - gap).alias("_lo"), (F.max("t") + gap).alias("_hi"))
    met = rows.join(span, key).where((F.col("fold") != F.col("_fold")) & F.col("t").between(F.col("_lo"), F.col("_hi")))
    return met.withColumn("fold", F.col("_fold")).drop("_fold", "_lo", "_hi")


def best_alpha_by_output(scores: DataFrame, score: str = "r2") -> DataFrame:
    """fold_scores' rows of each output at its own best alpha (highest mean over folds; of equal ones the smallest)."""
    best = best_alpha(scores.withColumn("score", F.col(score)), ["output"]).select("output", "alpha")
    return scores.join(best, ["output", "alpha"])


def simulated(spark, runs: int, samples: int, kernel: Sequence[float], noise: float = 0.2, seed: int = 1) -> DataFrame:
    """recording, t, x, y: y is x through the kernel, plus noise."""
    base = spark.range(runs * samples).select((F.col("id") / samples).cast("long").alias("recording"), (F.col("id") % samples).alias("t"), F.randn(seed).alias("x"), F.randn(seed + 1).alias("e"))
    w = Window.partitionBy("recording").orderBy("t")
    clean = sum(F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) * float(c) for k, c in enumerate(kernel))
    return base.withColumn("y", clean + noise * F.col("e")).drop("e")
