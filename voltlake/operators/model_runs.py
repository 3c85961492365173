"""Runs of encoding models: backends by name, leave-one-run-out and blocked folds without refits, segment weights, saved models.

A backend accumulates sums over samples, merges and subtracts them, and finalises them to coefficients.  Tasks
accumulate, Spark merges by key, a fold's training sums are the total less its own: rows are read once however many runs,
penalties and folds there are, and what a held-out segment scores follows from its own sums.

Sums are taken about one sample of the data, so that a mean that is large against the spread costs no digits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.operators import encoding
from voltlake.operators.blocks import types_of
from voltlake.storage import written


@dataclass
class Sums:
    """Weighted sums of inputs x and outputs y about a common origin."""

    n: float
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray  # by output

    @classmethod
    def of_row(cls, r) -> Sums:
        x, y = np.asarray(r["sx"], float), np.asarray(r["sy"], float)
        return cls(r["n"], x, y, np.asarray(r["xx"], float).reshape(len(x), len(x)), np.asarray(r["xy"], float).reshape(len(x), len(y)), np.asarray(r["yy"], float))

    def row(self) -> list:
        return [self.n, self.x, self.y, self.xx.ravel(), self.xy.ravel(), self.yy]

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Means, and the second moments about them: of inputs, of inputs with outputs, of outputs."""
        mx, my = self.x / self.n, self.y / self.n
        return mx, my, self.xx - self.n * np.outer(mx, mx), self.xy - self.n * np.outer(mx, my), np.maximum(self.yy - self.n * my * my, 0)


class Backend:
    """Linear models from sums; a backend of its own overrides ``finalise``."""

    def accumulate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
        xw = x * w[:, None]
        return Sums(float(w.sum()), xw.sum(0), w @ y, xw.T @ x, xw.T @ y, w @ (y * y))

    def merge(self, a: Sums, b: Sums) -> Sums:
        return Sums(*(p + q for p, q in zip(vars(a).values(), vars(b).values(), strict=True)))

    def less(self, a: Sums, b: Sums) -> Sums:
        return Sums(*(p - q for p, q in zip(vars(a).values(), vars(b).values(), strict=True)))

    def finalise(self, sums: Sums, alphas: Sequence[float]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """alpha, coefficients (inputs by outputs) and intercept, about the sums' origin."""
        raise NotImplementedError


class Ridge(Backend):
    """Squares of the coefficients weigh alpha; one eigendecomposition serves all alphas."""

    def finalise(self, sums: Sums, alphas: Sequence[float]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        mx, my, a, b, _ = sums.centred()
        values, vectors = np.linalg.eigh((a + a.T) / 2)
        rotated = vectors.T @ b
        for alpha in alphas:
            w = vectors @ (rotated / (np.maximum(values, 0) + alpha)[:, None])
            yield alpha, w, my - mx @ w


class Lasso(Backend):
    """Half the squared error plus alpha times the coefficients' sizes, by coordinate descent on the sums; the next alpha starts from the last."""

    sweeps, least = 1000, 1e-10

    def finalise(self, sums: Sums, alphas: Sequence[float]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        mx, my, a, b, _ = sums.centred()
        w, found = np.zeros_like(b), {}
        for alpha in sorted(set(alphas), reverse=True):
            for _ in range(self.sweeps):
                most = 0.0
                for k in np.flatnonzero(np.diag(a) > 0):
                    pull = b[k] - a[k] @ w + a[k, k] * w[k]
                    new = np.sign(pull) * np.maximum(np.abs(pull) - alpha, 0) / a[k, k]
                    most = max(most, float(np.abs(new - w[k]).max(initial=0)))
                    w[k] = new
                if most <= self.least * max(float(np.abs(w).max(initial=0)), 1e-300):
                    break
            found[alpha] = w.copy()
        for alpha in alphas:
            yield alpha, found[alpha], my - mx @ found[alpha]


_BACKENDS: dict[str, Backend] = {}


def register_backend(name: str, backend: Backend) -> None:
    if name in _BACKENDS:
        raise ValueError(f"backend {name} is registered already")
    _BACKENDS[name] = backend


def backend_of(name: str) -> Backend:
    if name not in _BACKENDS:
        raise KeyError(f"no backend {name}; there are {', '.join(backends())}")
    return _BACKENDS[name]


def backends() -> list[str]:
    return sorted(_BACKENDS)


register_backend("ridge", Ridge())
register_backend("lasso", Lasso())

#: Products of a batch's rows up to which the sums of its keys are taken at once.
MANY_VALUES = 4_000_000
_SUMS = "n double, " + ", ".join(f"{c} array<double>" for c in encoding.SUMS)


def origin_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """One sample of the data, always the same: inputs and outputs are taken about it."""
    r = rows.agg(F.min_by(F.struct("lagged", "y"), F.struct(F.xxhash64("lagged", "y"), "lagged", "y")).alias("o")).first()["o"]
    if r is None:
        raise ValueError("no rows to fit on")
    return np.nan_to_num(np.asarray(r["lagged"], float)), np.nan_to_num(np.asarray(r["y"], float))


def sums_by(rows: DataFrame, keys: Sequence[str], backend: Backend, origin: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows (keys, lagged, y and, if there, w) -> a row a key: its sums, merged over tasks."""
    names = list(keys)
    weighted = "w" in rows.columns

    def summed(pdf: pd.DataFrame) -> pd.DataFrame | None:
        """A batch of many keys at once; None where they are few, or the rows wide, or the backend sums in its own way."""
        code = pdf.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
        wide = len(origin[0]) * (len(origin[0]) + len(origin[1])) * len(pdf)
        if type(backend).accumulate is not Backend.accumulate or code.max() < encoding.HELD or wide > MANY_VALUES:
            return None
        order = np.argsort(code, kind="stable")
        at = np.searchsorted(code[order], np.arange(code.max() + 1))
        x, y = (np.array(pdf[c].tolist(), float)[order] - o for c, o in (("lagged", origin[0]), ("y", origin[1])))
        w = pdf["w"].to_numpy(float)[order] if weighted else np.ones(len(pdf))
        xw, flat = x * w[:, None], lambda v: v.reshape(len(v), -1)
        parts = (xw, y * w[:, None], flat(xw[:, :, None] * x[:, None, :]), flat(xw[:, :, None] * y[:, None, :]), y * y * w[:, None])
        out = pdf[names].iloc[order[at]].reset_index(drop=True).assign(n=np.add.reduceat(w, at))
        return out.assign(**{c: list(np.add.reduceat(v, at, axis=0)) for c, v in zip(encoding.SUMS, parts, strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Sums] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([[*k, *s.row()] for k, s in held.items()], columns=[*names, "n", *encoding.SUMS])

        for pdf in batches:
            many = summed(pdf) if names and len(pdf) else None
            if many is not None:
                yield many
                continue
            for key, g in pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]:
                if not len(g):
                    continue
                key = tuple(None if pd.isna(k) else k for k in key)
                x, y = np.array(g["lagged"].tolist(), float) - origin[0], np.array(g["y"].tolist(), float) - origin[1]
                own = backend.accumulate(x, y, g["w"].to_numpy(float) if weighted else np.ones(len(g)))
                held[key] = backend.merge(held[key], own) if key in held else own
            if len(held) > encoding.HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    part = rows.select(*names, "lagged", "y", *(["w"] if weighted else [])).mapInPandas(run, ", ".join(x for x in (types_of(rows, names) if names else "", _SUMS) if x))
    return encoding.add_sums(part, names)


def scores_of(s: Sums, w: np.ndarray, intercept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pearson and R2 of each output over the samples that the sums hold."""
    mx, my, xx, xy, whole = s.centred()
    both, own, off = (w * xy).sum(0), np.maximum((w * (xx @ w)).sum(0), 0), my - mx @ w - intercept
    flat = (own <= 1e-12 * s.n) | (whole <= 1e-12 * s.n)
    corr = np.where(flat, 0.0, both / np.sqrt(np.where(flat, 1.0, own * whole)))
    rest = np.maximum(whole - 2 * both + own, 0) + s.n * off * off
    return corr, np.where(whole > 0, 1 - rest / np.where(whole > 0, whole, 1.0), 0.0)


def left_out(rows: DataFrame, alphas: Sequence[float], backend: str = "ridge", by_duration: bool = True, near: DataFrame | None = None) -> DataFrame:
    """rows (fold, segment, lagged, y; w: a sample's weight in training) -> fold, alpha, output, pearson, r2.

    Each fold is scored by the model of all others, without those rows of ``near`` (fold, lagged, y) that lie too close to it.
    A segment is scored by itself; a fold's score is the mean over its segments, by their samples or each the same.
    A fold that leaves nothing to train on is an error.
    """
    if not alphas or min(alphas) <= 0:
        raise ValueError("alphas must be above 0")
    b = backend_of(backend)
    origin = origin_of(rows)
    train_part = written(sums_by(rows, ["fold", "segment"], b, origin), "sums")
    test_part = written(sums_by(rows.drop("w"), ["fold", "segment"], b, origin), "sums") if "w" in rows.columns else train_part
    own = encoding.add_sums(train_part.drop("segment"), ["fold"])
    total = encoding.add_sums(own.drop("fold"), [])
    close = sums_by(near, ["fold"], b, origin).select("fold", F.struct("n", *encoding.SUMS).alias("near")) if near is not None else None
    met = own.select("fold", F.struct("n", *encoding.SUMS).alias("own")).join(F.broadcast(total.select(F.struct("n", *encoding.SUMS).alias("all"))))  # one row
    met = met.join(close, "fold", "left") if close is not None else met.withColumn("near", F.lit(None).cast(met.schema["own"].dataType))
    kind = types_of(rows, ["fold"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                train = b.less(Sums.of_row(r.all), Sums.of_row(r.own))
                if r.near is not None:
                    train = b.less(train, Sums.of_row(r.near))
                if train.n <= 1e-9:
                    raise ValueError(f"fold {r.fold} leaves no rows to train on")
                out += [[r.fold, alpha, w.ravel(), c] for alpha, w, c in b.finalise(train, alphas)]
            yield pd.DataFrame(out, columns=["fold", "alpha", "coef", "intercept"])

    models = met.select("fold", "own", "all", "near").mapInPandas(solve, f"{kind}, alpha double, coef array<double>, intercept array<double>")
    pairs = test_part.select("fold", F.struct("n", *encoding.SUMS).alias("s")).join(models, "fold")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                s = Sums.of_row(r.s)
                corr, fit = scores_of(s, np.asarray(r.coef).reshape(len(s.x), len(s.y)), np.asarray(r.intercept))
                out += [[r.fold, r.alpha, k, s.n, float(corr[k]), float(fit[k])] for k in range(len(s.y))]
            yield pd.DataFrame(out, columns=["fold", "alpha", "output", "n", "pearson", "r2"])

    judged = pairs.mapInPandas(judge, f"{kind}, alpha double, output int, n double, pearson double, r2 double")
    weight = F.col("n") if by_duration else F.lit(1.0)
    mean = lambda c: (F.sum(F.col(c) * weight) / F.sum(weight)).alias(c)
    return judged.groupBy("fold", "alpha", "output").agg(mean("pearson"), mean("r2"))


def over_outputs(scores: DataFrame, how: str = "mean", score: str = "pearson") -> DataFrame:
    """fold, alpha, score: the mean or median over outputs."""
    if how not in ("mean", "median"):
        raise ValueError(how)
    return scores.groupBy("fold", "alpha").agg((F.avg(score) if how == "mean" else F.median(score)).alias("score"))


def segments_of(rows: DataFrame, rate: float, seconds: float | None = None, per_run: int | None = None, tolerance: float = 0.01, drop_last: bool = False, key: str = "recording") -> DataFrame:
    """rows (key, t from 0) with ``segment``: pieces of a length in seconds, or a number a run; where both are given they must agree.

    Agreement is within ``tolerance`` of the given length; a run that departs is an error.  drop_last: a shorter last piece goes.
    """
    if seconds is None and per_run is None:
        raise ValueError("segments need a length or a number a run")
    if (seconds is not None and seconds <= 0) or (per_run is not None and per_run <= 0) or rate <= 0:
        raise ValueError("lengths, numbers and rates must be above 0")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    if seconds is not None and per_run is not None:
        off = F.abs(n / rate / per_run - seconds) / seconds
        n = F.when(off > tolerance, F.raise_error(F.concat(F.lit(f"{per_run} segments of {seconds} s don't fit a run of samples: "), n.cast("string"))).cast("long")).otherwise(n)
    size = F.lit(max(int(round(seconds * rate)), 1)).cast("long") if seconds is not None else F.greatest(F.floor(n / per_run), F.lit(1))
    out = rows.withColumns({"_n": n, "_size": size}).where(F.col("_n") > 0).withColumn("segment", F.floor(F.col("t") / F.col("_size")))
    if seconds is None:
        out = out.where(F.col("segment") < per_run) if drop_last else out.withColumn("segment", F.least("segment", F.lit(per_run - 1)))
    elif drop_last:
        out = out.where((F.col("segment") + 1) * F.col("_size") <= F.col("_n"))
    return out.drop("_n", "_size")


def segment_folds(segments: DataFrame, folds: int, rule: str = "round_robin", seed: int | None = None, key: str = "recording") -> DataFrame:
    """segments (key, segment) with ``fold``: dealt in turn or in stretches, in order of the segment or, with a seed, of a hash of it.

    More folds than segments is an error.
    """
    if folds <= 1 or rule not in ("round_robin", "blocked_per_run"):
        raise ValueError(f"{folds} folds by {rule}")
    if segments.limit(folds).count() < folds:
        raise ValueError(f"{folds} folds, but fewer segments")
    order = [F.xxhash64(F.lit(seed), key, "segment"), F.col("segment")] if seed is not None else [F.col("segment")]
    j = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    m = F.count(F.lit(1)).over(Window.partitionBy(key))
    return segments.withColumn("fold", (j % folds if rule == "round_robin" else F.least(F.floor(j * folds / m), F.lit(folds - 1))).cast("int"))


def standardised(rows: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """x and y (arrays) of each run less their means, over their population deviations; a constant one becomes 0."""
    names = list(keys)
    out = rows
    for c in ("x", "y"):
        flat = rows.select(*names, F.posexplode(c).alias("_i", "_v")).groupBy(*names, "_i").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
        stats = flat.groupBy(*[F.col(k).alias(f"_{k}") for k in names]).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias(f"_{c}"))
        same = F.lit(True)
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(stats, same).drop(*[f"_{k}" for k in names])
        out = out.withColumn(c, F.zip_with(c, f"_{c}", lambda v, s: F.when((s["_s"] > 0) & v.isNotNull() & ~F.isnan(v), (v - s["_m"]) / s["_s"]).otherwise(0.0))).drop(f"_{c}")
    return out


@dataclass
class ModelRun:
    """What a run leaves: the model, its penalty, held-out scores by fold and penalty, scores of the fit by run, warnings."""

    lags: tuple[int, ...]
    rate: float
    backend: str
    alpha: float
    model: DataFrame  # alpha, coef, intercept
    held_out: DataFrame | None
    scores: DataFrame  # recording, output, pearson, r2
    warnings: tuple[str, ...] = field(default=())

    def save(self, path: str) -> None:
        """The model as a table with what is needed to use it; ``load_model`` reads it."""
        meta = json.dumps({"lags": list(self.lags), "rate": self.rate, "backend": self.backend, "alpha": self.alpha, "warnings": list(self.warnings)})
        self.model.withColumn("meta", F.lit(meta)).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The model (alpha, coef, intercept) that ``ModelRun.save`` wrote, and its lags, rate, backend, alpha and warnings."""
    table = spark.read.parquet(path)
    return table.select("alpha", "coef", "intercept"), json.loads(table.select("meta").first()["meta"])


def fit_sums(rows: DataFrame, alphas: Sequence[float], backend: str = "ridge") -> DataFrame:
    """rows (lagged, y, maybe w) -> alpha, coef, intercept."""
    b, origin = backend_of(backend), origin_of(rows)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                out = [[a, w.ravel(), c + origin[1] - origin[0] @ w] for a, w, c in b.finalise(Sums.of_row(r), alphas)]
                yield pd.DataFrame(out, columns=["alpha", "coef", "intercept"])

    return sums_by(rows, [], b, origin).mapInPandas(solve, "alpha double, coef array<double>, intercept array<double>")


def run_model(rows: DataFrame, lags: Sequence[int], rate: float, alphas: Sequence[float], alpha: float = 1.0, backend: str = "ridge", how: str = "mean", zscore: bool = True, mode: str = "same") -> ModelRun:
    """rows (recording, t, x array, y array): standardised, lagged, the penalty chosen by leaving out each run, fitted on all, scored by run.

    With one run no choice is made: ``alpha`` is used, and a warning says so.
    """
    rows = standardised(rows) if zscore else rows
    design = written(encoding.lagged(rows, lags, mode=mode).select("recording", "t", "lagged", "y"), "design")
    warnings, held = [], None
    if design.select("recording").distinct().limit(2).count() > 1:
        held = written(left_out(design.select(F.col("recording").alias("fold"), F.lit(0).alias("segment"), "lagged", "y"), alphas, backend), "held-out")
        alpha = encoding.best_alpha(over_outputs(held, how)).first()["alpha"]
    else:
        warnings.append("one run only: the penalty is the given one")
    model = written(fit_sums(design, [alpha], backend), "model")
    r = model.first()
    w, c = np.asarray(r["coef"]), np.asarray(r["intercept"])
    b, origin = backend_of(backend), origin_of(design)
    q = len(c)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                s = Sums.of_row(row)
                corr, fit = scores_of(s, w.reshape(-1, q), c + origin[0] @ w.reshape(-1, q) - origin[1])
                out += [[row["recording"], k, float(corr[k]), float(fit[k])] for k in range(q)]
            yield pd.DataFrame(out, columns=["recording", "output", "pearson", "r2"])

    scores = sums_by(design, ["recording"], b, origin).mapInPandas(judge, f"{types_of(design, ['recording'])}, output int, pearson double, r2 double")
    return ModelRun(tuple(lags), rate, backend, float(alpha), model, held, scores, tuple(warnings))
