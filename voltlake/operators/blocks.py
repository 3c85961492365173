"""Series cut for tasks: whole series dealt by key, or blocks of a series with their neighbours' samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a block.
BLOCK = 1 << 16


def types_of(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)


def starts(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Where each group of sorted rows begins, and the end."""
    group = pdf.groupby(list(names), dropna=False, sort=False).ngroup().to_numpy()
    return np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(pdf)]])


def by_group(names: Sequence[str], done: Callable[[pd.DataFrame], pd.DataFrame]):
    """For ``mapInPandas`` over rows sorted by names: done on whole groups, many short ones at once; a group is held until its end."""
    names = list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            last = int(starts(pdf, names)[-2])
            if last or (held and not pdf[names].iloc[[0]].reset_index(drop=True).equals(held[-1][names].iloc[[-1]].reset_index(drop=True))):
                ready = pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
                held = []
                yield done(ready)
            held.append(pdf.iloc[last:])
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return run


def per_series(signal: DataFrame, f: Callable[..., np.ndarray], keys: Sequence[str] = ("recording",), keyed: bool = False) -> DataFrame:
    """f on each series in the order of t (keyed: f(x, key)); the result may have another length.

    Series are dealt by key and sorted, and a task streams through them: many short ones share a batch, a long one is
    held until its end.
    """
    names = list(keys)
    schema = f"{types_of(signal, names)}, t long, x double"

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        cut = starts(pdf, names)
        x, heads = pdf["x"].to_numpy(float), pdf[names].iloc[cut[:-1]]
        of = heads.itertuples(index=False, name=None)
        out = [np.asarray(f(x[p:q], k) if keyed else f(x[p:q]), float) for p, q, k in zip(cut[:-1], cut[1:], of, strict=True)]
        lens = [len(y) for y in out]
        got = heads.loc[heads.index.repeat(lens)].reset_index(drop=True)
        return got.assign(t=np.concatenate([np.arange(n) for n in lens]), x=np.concatenate(out))[[*names, "t", "x"]]

    rows = signal.select(*names, "t", F.col("x").cast("double").alias("x"))
    return rows.repartition(*names).sortWithinPartitions(*names, "t").mapInPandas(by_group(names, done), schema)


def numbered(signal: DataFrame, keys: Sequence[str], block: int = BLOCK, count: bool = False) -> DataFrame:
    """(keys, t, x; with count also _n, the series' length) with t numbered from 0 in each series by the order of t (null first).  No task sorts a whole series: rows are numbered in ranges of t."""
    names = list(keys)
    rows = signal.select(*names, F.floor(F.col("t") / block).alias("_range"), F.col("t").alias("_at"), F.col("x").cast("double").alias("x"))
    n = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in names], F.col("_range").alias("__range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_{k}" for k in names]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    whole = [F.sum("_n").over(Window.partitionBy(*[f"_{k}" for k in names])).alias("_whole")] if count else []
    n = n.select("*", *whole).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*names, "_range").orderBy("_at")) - 1
    same = F.col("_range").eqNullSafe(F.col("__range"))
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.withColumn("_own", own).join(n, same).select(*names, (F.col("_before") + F.col("_own")).alias("t"), "x", *([F.col("_whole").alias("_n")] if count else []))


def per_block(signal: DataFrame, f: Callable[..., np.ndarray], reach: int, keys: Sequence[str] = ("recording",), up: int = 1, down: int = 1, block: int = BLOCK, *, keyed: bool = False) -> DataFrame:
    """What ``per_series`` gives for an f whose samples depend on at most ``reach`` samples to each side, by blocks of a series.

    f turns n samples into ceil(n * up / down); keyed: f(x, key).  Memory is a block and its neighbours' samples, not the series.
    """
    size, halo = max(block // down, 1) * down, -(-reach // down) * down
    blocks = F.sequence(F.greatest(F.floor((F.col("t") - halo) / size), F.lit(0)), F.floor((F.col("t") + halo) / size))
    spread = numbered(signal, keys, size).select(*keys, "t", "x", F.explode(blocks).alias("_block"))

    def one(x: np.ndarray, key: tuple) -> np.ndarray:
        skip = min(int(key[-1]) * size, halo)
        own = min(size, len(x) - skip)
        if own <= 0:  # past the series' end: only a neighbour's samples
            return np.zeros(0)
        first = skip * up // down
        return (f(x, key[:-1]) if keyed else f(x))[first : first + -(-own * up // down)]

    out = per_series(spread, one, [*keys, "_block"], keyed=True)
    return out.select(*keys, (F.col("_block") * (size * up // down) + F.col("t")).alias("t"), "x")
