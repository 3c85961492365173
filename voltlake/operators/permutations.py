"""Null distributions of a correlation: all rotations of a series from one transform, and seeded permutations.

Rows are (keys, t, y, prediction).  A null or NaN value of either counts as its series' mean in rotations (a rotation needs
every place) and leaves its row out of permutations.  A series that does not vary has correlation 0 in all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.blocks import by_group, starts, types_of
from voltlake.operators.fourier import WHOLE, dft
from voltlake.storage import written

#: Rows of a block, within which values are permuted.
BLOCK = 8192


def _same(a: Sequence[str], b: Sequence[str]):
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def _scaled(rows: DataFrame, names: list[str], y: str, predicted: str) -> DataFrame:
    """(keys, t, _y, _p, _n): centred and of length one, so that the sum of products is the correlation; 0 where a series doesn't vary."""
    value = {c: F.nanvl(F.col(of).cast("double"), F.lit(None).cast("double")) for c, of in (("_y", y), ("_p", predicted))}
    rows = rows.select(*names, "t", *[v.alias(c) for c, v in value.items()])
    own = [f"_of_{k}" for k in names]
    stats = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(names, own, strict=True)]).agg(
        F.count(F.lit(1)).alias("_n"), *[f.alias(f"{c}{s}") for c in ("_y", "_p") for s, f in (("_mean", F.avg(c)), ("_size", F.sqrt(F.var_pop(c) * F.count(c))))]
    )
    scaled = {c: F.when(F.col(f"{c}_size") > 0, F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_size"), F.lit(0.0))).otherwise(0.0) for c in ("_y", "_p")}
    return rows.join(stats, _same(names, own)).select(*names, "t", *[v.alias(c) for c, v in scaled.items()], "_n")


def rotations(rows: DataFrame, keys: Sequence[str], y: str, predicted: str, whole: int = WHOLE) -> DataFrame:
    """rows (keys, t from 0 without holes) -> (keys, n, shift, r): the correlation of y at t with the prediction at t - shift (modulo n), for all n shifts.

    The cross-correlation is the inverse transform of one series' transform times the other's conjugate: rows are
    shuffled a fixed number of times, however many shifts there are, and a series of over ``whole`` samples in two passes.
    """
    names = list(keys)
    scaled = _scaled(rows, names, y, predicted)
    parts = F.explode(F.array(F.struct(F.lit(0).alias("_which"), F.col("_y").alias("re")), F.struct(F.lit(1).alias("_which"), F.col("_p").alias("re")))).alias("_part")
    sent = written(scaled.select(*names, F.col("_n").alias("n"), F.col("t").alias("k"), parts).select(*names, "n", "k", "_part.*", F.lit(0.0).alias("im")), "scaled")
    longest = sent.agg(F.max("n")).first()[0] or 0
    both = dft(sent, [*names, "_which"], whole=whole, longest=longest)
    got = both.groupBy(*names, "n", "k").agg(*[F.max(F.when(F.col("_which") == w, F.col(c))).alias(f"{p}_{c}") for w, p in ((0, "_y"), (1, "_p")) for c in ("re", "im")])
    re = F.col("_y_re") * F.col("_p_re") + F.col("_y_im") * F.col("_p_im")
    im = F.col("_y_im") * F.col("_p_re") - F.col("_y_re") * F.col("_p_im")
    back = dft(got.select(*names, "n", "k", re.alias("re"), im.alias("im")), names, inverse=True, whole=whole, longest=longest)
    return back.select(*names, "n", F.col("k").alias("shift"), F.col("re").alias("r"))


def all_rotations_null(rows: DataFrame, keys: Sequence[str], y: str, predicted: str, tolerance: float = 1e-9, whole: int = WHOLE) -> DataFrame:
    """(keys, n, observed, null_mean, null_sd, reached): over all rotations but none; reached is the share whose correlation is
    at least the observed one, less the tolerance.  The last three are null for a series of one sample."""
    names = list(keys)
    each = rotations(rows, names, y, predicted, whole)
    here = each.where("shift = 0").select(*[F.col(k).alias(f"_of_{k}") for k in names], F.col("r").alias("observed"))
    met = each.join(here, _same(names, [f"_of_{k}" for k in names]))
    turned = F.col("shift") != 0
    r = F.when(turned, F.col("r"))
    return met.groupBy(*names, "n", "observed").agg(F.avg(r).alias("null_mean"), F.stddev_pop(r).alias("null_sd"), F.avg(F.when(turned, (F.col("r") >= F.col("observed") - tolerance).cast("double"))).alias("reached"))


def _dealt(rows: DataFrame, names: list[str], value: str, kind: int, seed: int, block: int) -> DataFrame:
    """(keys, _block, _kind, _place, v): rows by their rank in the order of a keyed hash, cut into blocks.  Ranks are counted in ranges of the hash, so no task sorts a series."""
    h = F.xxhash64(F.lit(seed), F.lit(kind), *names, "t")
    last = F.ceil(F.col("_n") / block)
    span = F.least(F.floor((F.col("_hash") / 2.0**64 + 0.5) * last), last - 1)
    rows = rows.select(*names, "t", "_n", F.col(value).alias("v"), h.alias("_hash")).withColumn("_range", span)
    own = [f"_of_{k}" for k in names]
    n = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(names, own, strict=True)], F.col("_range").alias("_of_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*own).orderBy("_of_range")) - F.col("_rows")
    n = n.withColumn("_before", before)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*names, "_range").orderBy("_hash", "t", "v")) - 1
    met = rows.join(n, _same([*names, "_range"], [*own, "_of_range"])).withColumn("_rank", rank)
    return met.select(*names, F.floor(F.col("_rank") / block).alias("_block"), F.lit(kind).alias("_kind"), (F.col("_rank") % block).alias("_place"), "v")


def permutations(rows: DataFrame, keys: Sequence[str], y: str, predicted: str, times: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(keys, number from 0, r): the correlation under ``times`` seeded permutations of the prediction within each series.

    y and the prediction are each put in the order of a keyed hash of its own, and rows of one rank meet.  The orders are cut
    into blocks, and a task permutes a block's predictions ``times`` over; only its sums of products go on.  So every
    permutation is uniform over all of its series, and rows are shuffled as often for a thousand as for one.  Those of a series
    of one block are independent; those of a longer one share its blocks, which correlates their r by 1 / ``block``.
    """
    names = list(keys)
    sound = rows.where(~F.isnan(F.coalesce(F.col(y).cast("double"), F.lit(float("nan")))) & ~F.isnan(F.coalesce(F.col(predicted).cast("double"), F.lit(float("nan")))))
    scaled = written(_scaled(sound, names, y, predicted), "scaled")
    both = _dealt(scaled, names, "_y", 0, seed, block).unionByName(_dealt(scaled, names, "_p", 1, seed, block))
    group = [*names, "_block"]

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        cut, v = starts(pdf, group), pdf["v"].to_numpy()
        heads, sums = pdf[names].iloc[cut[:-1]], []
        for a, b, head in zip(cut[:-1], cut[1:], pdf[group].iloc[cut[:-1]].itertuples(index=False, name=None), strict=True):
            half = (b - a) // 2
            left, right = v[a : a + half], v[a + half : b]
            rng = np.random.default_rng([seed & 0xFFFF_FFFF, zlib.crc32(repr(tuple(map(str, head))).encode()), int(head[-1])])
            step = max(1, (1 << 19) // max(half, 1))
            sums.append(np.concatenate([rng.permuted(np.broadcast_to(right, (min(step, times - i), half)), axis=1) @ left for i in range(0, times, step)]))
        return heads.reset_index(drop=True).assign(sums=sums)

    dealt = both.repartition(*group).sortWithinPartitions(*group, "_kind", "_place")
    parts = dealt.mapInPandas(by_group(group, done), f"{types_of(rows, names)}, sums array<double>")
    return parts.select(*names, F.posexplode("sums").alias("number", "r")).groupBy(*names, "number").agg(F.sum("r").alias("r"))


def permuted_null(rows: DataFrame, keys: Sequence[str], y: str, predicted: str, times: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(keys, n, observed, null_mean, null_sd, p): p is (1 + permutations that reach the observed r) / (1 + times)."""
    names = list(keys)
    sound = rows.where(~F.isnan(F.coalesce(F.col(y).cast("double"), F.lit(float("nan")))) & ~F.isnan(F.coalesce(F.col(predicted).cast("double"), F.lit(float("nan")))))
    here = _scaled(sound, names, y, predicted).groupBy(*[F.col(k).alias(f"_of_{k}") for k in names]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_p")).alias("observed"))
    met = permutations(rows, names, y, predicted, times, seed, block).join(here, _same(names, [f"_of_{k}" for k in names]))
    reached = F.sum((F.col("r") >= F.col("observed") - 1e-12).cast("long"))
    return met.groupBy(*names, "n", "observed").agg(F.avg("r").alias("null_mean"), F.stddev_pop("r").alias("null_sd"), ((reached + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
