"""Time-series operators on long signals: (recording, t, x) or (recording, channel, t, x).

Every window names its partition, so a recording's rows are sorted once and stream through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from voltlake.storage import written


def by(keys: Sequence[str] = ("recording",), order: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def difference(x: Column, w: WindowSpec, rate: float = 1.0, absolute: bool = False) -> Column:
    """First difference times the rate, 0 at the start."""
    d = F.coalesce((x - F.lag(x).over(w)) * rate, F.lit(0.0))
    return F.abs(d) if absolute else d


def moving_average(x: Column, w: WindowSpec, width: int) -> Column:
    """Centred, zeros beyond the edges: divided by the width everywhere.  An even width leans back by one."""
    before = width // 2
    return F.sum(x).over(w.rowsBetween(-before, width - 1 - before)) / width


def zscore(x: Column, keys: Sequence[str]) -> Column:
    """Population z-score; a constant series is 0."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(0.0)


def intervals(onsets: DataFrame, keys: Sequence[str], onset: str) -> DataFrame:
    """Each onset but the last with the time to the next."""
    w = Window.partitionBy(*keys).orderBy(onset)
    return onsets.withColumn("interval", F.lead(onset).over(w) - F.col(onset)).where("interval is not null")


def rising_edges(signal: DataFrame, threshold: Column, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Samples above the threshold whose predecessor is not."""
    w = by(keys)
    up = F.col("x") > threshold
    return signal.withColumn("_up", up).withColumn("_edge", F.col("_up") & ~F.coalesce(F.lag("_up").over(w), F.lit(False))).where("_edge").drop("_up", "_edge")


def refractory(onsets: DataFrame, gap: float, keys: Sequence[str] = ("recording",), onset: str = "sec") -> DataFrame:
    """Keeps an onset if it is gap or more after the last one kept: kept ones depend on kept ones.

    Groups are dealt by key and sorted; a task goes through them once and holds the last kept onset only.
    """
    names = list(keys)

    def keep(batches):
        key = last = None
        for pdf in batches:
            marks = []
            for k, v in zip(pdf[names].itertuples(index=False, name=None), pdf[onset].tolist(), strict=True):
                if k != key:
                    key, last = k, None
                marks.append(last is None or v - last >= gap)
                last = v if marks[-1] else last
            yield pdf[marks]

    rows = onsets.select(*names, onset)
    return rows.repartition(*names).sortWithinPartitions(*names, onset).mapInPandas(keep, rows.schema)


def segments(signal: DataFrame, length: int, keys: Sequence[str] = ("recording",), drop_last: bool = False) -> DataFrame:
    """Tumbling segments: seg, start, stop (exclusive) of each recording; a short last one is kept unless drop_last."""
    n = signal.groupBy(*keys).agg((F.max("t") + 1).alias("n"))
    many = F.floor(F.col("n") / length) if drop_last else F.ceil(F.col("n") / length)
    return n.where(many > 0).select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).alias("seg")).select(*keys, "seg", (F.col("seg") * length).alias("start"), F.least(F.col("seg") * length + length, F.col("n")).alias("stop"))


def fold_of(rule: str, k: int, w: WindowSpec, whole: WindowSpec) -> Column:
    """round_robin, blocked (floor(j * k / m)) or contiguous (the first folds one larger)."""
    j = (F.row_number().over(w) - 1).cast("long")
    if rule == "round_robin":
        return j % k
    if rule == "blocked":
        return F.least(F.floor(j * k / F.count(F.lit(1)).over(whole)), F.lit(k - 1)).cast("long")
    return (F.ntile(k).over(w) - 1).cast("long")


def time_blocks(signal: DataFrame, blocks: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Block edges floor(n * b / blocks) of each recording."""
    n = signal.groupBy(*keys).agg((F.max("t") + 1).alias("n"))
    b = n.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    return b.select(*keys, "block", F.floor(F.col("n") * F.col("block") / blocks).alias("start"), F.floor(F.col("n") * (F.col("block") + 1) / blocks).alias("stop"))


def running_offset(files: DataFrame, length: str, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Where each file starts when a group's files are put end to end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0).cast("long"))).withColumn("stop", F.col("start") + F.col(length))


def force_length(signal: DataFrame, length: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Cropped, or padded with zeros, to the length."""
    spine = signal.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    return spine.join(signal.where(F.col("t") < length), [*keys, "t"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def common_length(signal: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """All recordings cropped to the shortest."""
    shortest = signal.groupBy(*keys).agg(F.max("t").alias("_m")).agg(F.min("_m").alias("_m"))
    return signal.join(F.broadcast(shortest), F.col("t") <= F.col("_m")).drop("_m")  # one row


def align_by_start(a: DataFrame, b: DataFrame, starts: DataFrame, key: str = "recording") -> DataFrame:
    """Samples of a and b at the same time after each one's start (starts: key, start_a, start_b), where both have one."""
    x = a.join(starts, key).where(F.col("t") >= F.col("start_a")).select(key, (F.col("t") - F.col("start_a")).alias("t"), F.col("x").alias("xa"))
    y = b.join(starts, key).where(F.col("t") >= F.col("start_b")).select(key, (F.col("t") - F.col("start_b")).alias("t"), F.col("x").alias("xb"))
    return x.join(y, [key, "t"])


def interpolate(known: DataFrame, grid: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Piecewise-linear values at the grid's t, the edge values held beyond them.  One sorted pass over both."""
    rows = known.select(*keys, "t", "x", F.lit(False).alias("_g")).unionByName(grid.select(*keys, "t", F.lit(None).cast("double").alias("x"), F.lit(True).alias("_g")))
    w = Window.partitionBy(*keys).orderBy("t", "_g")
    at = F.when(F.col("x").isNotNull(), F.struct("t", "x"))
    before = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("_g"))  # a running frame: one step a row
    after = F.last(at, True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumns({"_p": before, "_n": after}).where("_g")
    p, n = F.col("_p"), F.col("_n")
    between = p["x"] + (n["x"] - p["x"]) * (F.col("t") - p["t"]) / (n["t"] - p["t"])
    return got.select(*keys, "t", F.when(p.isNull(), n["x"]).when(n.isNull() | (n["t"] == p["t"]), p["x"]).otherwise(between).alias("x"))


def pad_start(signal: DataFrame, samples: int, keys: Sequence[str] = ("recording",)) -> DataFrame:
    zeros = signal.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long")))).withColumn("x", F.lit(0.0))
    return zeros.unionByName(signal.select(*keys, (F.col("t") + samples).alias("t"), "x"))


def robust_mean(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.5) -> DataFrame:
    """Mean without values of modified z-score limit or more; the median where the median deviation is 0."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    dev = df.join(med, list(keys)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = dev.groupBy(*keys).agg(F.median("_dev").alias("_mad"))
    keep = F.when(0.6745 * F.col("_dev") / F.col("_mad") < limit, F.col(value))
    out = dev.join(mad, list(keys)).groupBy(*keys).agg(F.first("_med").alias("_med"), F.first("_mad").alias("_mad"), F.avg(F.when(F.col("_mad") > 0, keep)).alias("_m"))
    return out.select(*keys, F.when(F.col("_mad") > 0, F.col("_m")).otherwise(F.col("_med")).alias("robust_mean"))


def average_rank(x: Column, keys: Sequence[str]) -> Column:
    """Ranks from 1, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0


def robust_mean_of(values: str, limit: float = 3.5) -> Column:
    """robust_mean of an array that is short."""
    def middle(a: Column) -> Column:
        a = F.sort_array(a)
        return (F.get(a, ((F.size(a) - 1) / 2).cast("int")) + F.get(a, (F.size(a) / 2).cast("int"))) / 2

    med = middle(F.col(values))
    off = F.transform(values, lambda v: F.struct(v.alias("v"), F.abs(v - med).alias("d")))
    mad = middle(off["d"])
    kept = F.filter(off, lambda s: 0.6745 * s["d"] / F.nullif(mad, F.lit(0.0)) < limit)["v"]
    mean = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept)
    return F.when(mad > 0, mean).otherwise(med)


def centred_ranks(counted: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """counted (keys, value, count) -> keys, value, _rank: the average rank of each different value less its key's mean rank, nulls last.

    Values are dealt by ranges and sorted there; only a range's counts by key meet in one place, so no task holds a key's values.
    """
    names = list(keys)
    order = [*names, F.asc_nulls_last(value)]
    values = counted.groupBy(*names, value).agg(F.sum(count).alias("_n"))
    dealt = written(values.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "values")
    part = dealt.groupBy(*names, "_part").agg(F.sum("_n").alias("_n"))  # a row a range, and one more for each key that begins within it
    w = Window.partitionBy(*names)
    start = part.select(*[F.col(k).alias(f"_of_{k}") for k in names], F.col("_part").alias("_of_part"), (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    same = F.col("_part") == F.col("_of_part")
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    upto = F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy(F.asc_nulls_last(value)))
    met = dealt.withColumn("_upto", upto).join(start, same)
    return met.select(*names, value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0 - (F.col("_all") + 1) / 2.0).alias("_rank"))


def delta(x: Column, w: WindowSpec, whole: WindowSpec, reach: int = 2) -> Column:
    """Regression slope over 2 * reach + 1 samples, the edge samples repeated."""
    first, last = F.first(x).over(whole), F.last(x).over(whole)
    total = sum(k * (F.coalesce(F.lead(x, k).over(w), last) - F.coalesce(F.lag(x, k).over(w), first)) for k in range(1, reach + 1))
    return total / (2.0 * sum(k * k for k in range(1, reach + 1)))


def outliers(df: DataFrame, keys: Sequence[str], value: str, k: float = 6.0) -> DataFrame:
    """is_outlier: beyond k interquartile ranges from the quartiles (exact, interpolated)."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q")) if keys else df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    got = df.join(q, list(keys)) if keys else df.join(F.broadcast(q))  # one row
    iqr = F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-12))
    return got.withColumn("is_outlier", (F.col(value) < F.col("_q")[0] - k * iqr) | (F.col(value) > F.col("_q")[1] + k * iqr)).drop("_q")
