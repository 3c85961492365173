"""Rereferencing and channel quality on (recording, channel, t, x) signals with a contact number a channel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators import series
from voltlake.storage import written

#: Halvings of the extent of all points, down to the finest grid cells that ``nearest_contacts`` tells apart.
LEVELS = 20
#: Places a task, where each becomes many rows: its cells of all levels, and the points it meets.
TASK_PLACES = 5_000


def common_average(signal: DataFrame, groups: Sequence[str] = (), pool: str | None = None) -> DataFrame:
    """x less the mean over the pool's channels at the sample (by group, such as the shaft); channels outside the pool are unchanged."""
    inside = F.col(pool) if pool else F.lit(True)
    mean = F.avg(F.when(inside, F.col("x"))).over(Window.partitionBy("recording", "t", *groups))
    return signal.withColumn("x", F.when(inside & mean.isNotNull(), F.col("x") - mean).otherwise(F.col("x")))


def bipolar(signal: DataFrame, shaft: Sequence[str] = ()) -> DataFrame:
    """Each contact less the next one of its shaft, at the samples that both have: channel a-b."""
    a, b = signal.alias("a"), signal.alias("b")
    on = (F.col("a.recording") == F.col("b.recording")) & (F.col("a.t") == F.col("b.t")) & (F.col("b.contact") == F.col("a.contact") + 1)
    for s in shaft:
        on = on & (F.col(f"a.{s}") == F.col(f"b.{s}"))
    return a.join(b, on).select("a.recording", F.concat_ws("-", "a.channel", "b.channel").alias("channel"), "a.t", (F.col("a.x") - F.col("b.x")).alias("x"))


def laplacian(signal: DataFrame, shaft: Sequence[str] = ()) -> DataFrame:
    """Each contact less the mean of the two beside it; a contact at the end of its shaft is unchanged."""
    w = Window.partitionBy("recording", "t", *shaft).orderBy("contact")
    beside = (F.lag("x").over(w) + F.lead("x").over(w)) / 2.0
    return signal.withColumn("x", F.coalesce(F.col("x") - beside, F.col("x")))


def graph_laplacian(signal: DataFrame, edges: DataFrame) -> DataFrame:
    """x less the mean of the channel's neighbours (edges: channel, neighbour) at the sample; without neighbours unchanged."""
    other = signal.select("recording", "t", F.col("channel").alias("neighbour"), F.col("x").alias("_x"))
    mean = edges.join(other, "neighbour").groupBy("recording", "channel", "t").agg(F.avg("_x").alias("_m"))
    return signal.join(mean, ["recording", "channel", "t"], "left").withColumn("x", F.col("x") - F.coalesce("_m", F.lit(0.0))).drop("_m")


def mapped_reference(signal: DataFrame, reference: DataFrame) -> DataFrame:
    """x less its reference channel (reference: channel, ref) at the sample; channels that are not mapped are unchanged."""
    ref = signal.select("recording", "t", F.col("channel").alias("ref"), F.col("x").alias("_x"))
    named = signal.join(reference, "channel", "left")
    return named.join(ref, ["recording", "t", "ref"], "left").withColumn("x", F.col("x") - F.coalesce("_x", F.lit(0.0))).drop("_x", "ref")


def list_reference(signal: DataFrame, contacts: Sequence[str]) -> DataFrame:
    """All channels less the mean of the listed ones."""
    mean = F.avg(F.when(F.col("channel").isin(list(contacts)), F.col("x"))).over(Window.partitionBy("recording", "t"))
    return signal.withColumn("x", F.col("x") - F.coalesce(mean, F.lit(0.0)))


def nearest_contacts(points: DataFrame, k: int, radius: float | None = None, cell: float | None = None) -> DataFrame:
    """points (group, id, x, y, z) -> (group, id, other, distance, rank): the k nearest others of the same group, ties by other.

    With a radius, only points of neighbouring grid cells meet.  Without one each point searches rings of cells as large as
    its surroundings need (``_by_rings``).  Points with a null group or id, or a null or non-finite coordinate, take no part;
    without a radius an id has one place, of several the smallest.
    """
    if radius is None:
        return _by_rings(points, k)
    a = points
    b = points.select(F.col("group"), F.col("id").alias("other"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    on = ["group"]
    size = cell or radius
    for c in "xyz":
        a = a.withColumn(f"c{c}", F.floor(F.col(c) / size))
        own = F.floor(F.col(f"_{c}") / size)
        b = b.withColumn(f"c{c}", F.explode(F.array(own - 1, own, own + 1)))
    on += ["cx", "cy", "cz"]
    met = a.join(b, on).where("id <> other").select("group", "id", "other", _distance().alias("distance"))
    return _ranked(met.where(F.col("distance") <= radius), k)


def _distance() -> Column:
    return F.sqrt(sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"))


def _ranked(met: DataFrame, k: int) -> DataFrame:
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("group", "id").orderBy("distance", "other"))).where(F.col("rank") <= k)


def _by_rings(points: DataFrame, k: int) -> DataFrame:
    """The k nearest without a radius: grids of halved cells, and at most two rings a place.

    A place asks at the finest grid at which its own cell holds k + 1 points, so what it meets follows from k and not from
    the group's size.  The cells around its own hold all points within one cell's width: where the k + 1 nearest (its own
    point counts) are that near, they are certain.  Else the next ring is searched too: k + 1 points of one cell are within
    its diagonal, 1.74 widths, and two rings hold all within two.  Points of one place share a search, and only their k + 1
    smallest ids are met.
    """
    sound = F.col("group").isNotNull() & F.col("id").isNotNull()
    for c in "xyz":
        sound = sound & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))  # NaN is the largest double
    at = F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"])
    rows = written(points.where(sound).groupBy("group", "id").agg(F.min(at).alias("_at")).select("group", "id", "_at.*"), "points")
    place = ["group", "x", "y", "z"]
    low = rows.agg(*[F.min(c) for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]), F.count(F.lit(1))).first()
    width = 2.0 ** (math.frexp(low[3])[1] if low[3] else 0)  # over the extent
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("id"))).where(F.col("_r") <= k + 1)
    places = written(first.groupBy(*place).agg(F.sort_array(F.collect_list("id")).alias("ids")), "places")

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumns({f"c{c}": F.floor((F.col(c) - (low[i] or 0.0)) * F.pow(F.lit(2.0), F.col("level")) / width) for i, c in enumerate("xyz")})

    key = ["group", "level", "cx", "cy", "cz"]
    tasks = 1 + low[4] // TASK_PLACES
    dealt = places.repartition(tasks, *place)  # each counts at all levels, which mostly are cells of its own
    at_all = cells(dealt.select(*place, F.size("ids").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")))
    full = at_all.groupBy(*key).agg(F.sum("n").alias("_n")).where((F.col("_n") > k) | (F.col("level") == 0)).drop("_n")
    asked = written(at_all.join(full, key, "left_semi").groupBy(*place).agg(F.max("level").alias("level")), "asked")

    def nearest(asking: DataFrame, ring: int) -> DataFrame:
        """group, x, y, z, level, other, distance of the k + 1 nearest points in the cells up to ``ring`` away."""
        steps = F.array(*[F.lit(i) for i in range(-ring, ring + 1)])
        around = cells(asking)
        for c in "xyz":
            around = around.withColumn("_s", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_s")).where((F.col(f"c{c}") >= 0) & (F.col(f"c{c}") < F.pow(F.lit(2.0), F.col("level")))).drop("_s")
        there = cells(places.join(asking.select("group", "level").distinct(), "group"))
        there = there.select(*key, "ids", *[F.col(c).alias(f"_{c}") for c in "xyz"])
        met = around.repartition(tasks, *key).join(there.repartition(tasks, *key), key)  # a task sorts what few places meet
        met = met.select(*place, "level", _distance().alias("distance"), F.explode("ids").alias("other"))
        return met.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("distance", "other"))).where(F.col("_r") <= k + 1).drop("_r")

    one = written(nearest(asked, 1), "ring")
    near = F.lit(width * (1 - 1e-6)) / F.pow(F.lit(2.0), F.col("level"))  # cells are exact but for a millionth of their width
    far = one.groupBy(*place, "level").agg(F.max("distance").alias("_d"), F.count(F.lit(1)).alias("_n")).where((F.col("level") > 0) & ((F.col("_d") > near) | (F.col("_n") <= k)))
    far = written(far.select(*place, "level"), "uncertain")
    found = one.join(far, [*place, "level"], "left_anti").unionByName(nearest(far, 2)).drop("level")
    return _ranked(rows.join(found, place).where("id <> other").select("group", "id", "other", "distance"), k)


def channel_quality(signal: DataFrame, flat: float = 1e-12) -> DataFrame:
    """Variance, its log10, and flat and outlier flags of each channel (outliers among a recording's channels)."""
    v = signal.groupBy("recording", "channel").agg(F.var_pop("x").alias("variance"), F.count(F.lit(1)).alias("n"))
    v = v.withColumns({"log_variance": F.log10(F.greatest("variance", F.lit(flat))), "is_flat": F.col("variance") <= flat})
    return series.outliers(v, ["recording"], "log_variance")


def view_summary(signal: DataFrame, rate: float) -> DataFrame:
    return signal.groupBy("recording").agg(F.count_distinct("channel").alias("channels"), ((F.max("t") + 1) / rate).alias("duration"))


def bad_channels(recorded: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed bad channels that are in the recording, and those that are not."""
    bad = listed.where(F.lower(F.trim("status")) == "bad").select("channel").distinct()
    names = recorded.select("channel").distinct()
    return bad.join(names, "channel", "left_semi"), bad.join(names, "channel", "left_anti")


def top_variance(signal: DataFrame, k: int = 12) -> DataFrame:
    return signal.groupBy("recording", "channel").agg(F.var_pop("x").alias("variance")).orderBy(F.desc("variance"), "recording", "channel").limit(k)


def identical_samples(signal: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Samples at which all of several channels hold the same value."""
    return signal.groupBy("recording", "t").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("spread")).where((F.col("spread") <= tolerance) & (F.col("n") > 1))
