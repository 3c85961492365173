"""Filters, projections and small reports on contacts, scores, events and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold(value: Column, limit: float, rule: str = "ge") -> Column:
    """ge, gt, le or lt; null and NaN fail."""
    test = {"ge": value >= limit, "gt": value > limit, "le": value <= limit, "lt": value < limit}[rule]
    return F.coalesce(test & ~F.isnan(value), F.lit(False))


def in_hemisphere(name: Column, side: str) -> Column:
    """An apostrophe marks the left side."""
    left = F.contains(name, F.lit("'"))
    return left if side == "left" else ~left if side == "right" else F.lit(True)


def roi_label(label: Column, probability: Column, least: float = 10.0) -> Column:
    """The label, or none where it is unknown or too unlikely."""
    return F.when((probability >= least) & (label != "Unknown"), label).otherwise("none")


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as numbers; rows with one that doesn't parse or isn't finite go."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    for c in columns:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out


#: Channel types that carry brain signals.
BRAIN = ("seeg", "ecog")


def brain_channels(channels: DataFrame, bads: bool = False) -> DataFrame:
    out = channels.where(F.lower("ch_type").isin(*BRAIN))
    return out if bads else out.where(~F.coalesce("is_bad", F.lit(False)))


def pick(df: DataFrame, names: Sequence[str], column: str = "channel") -> DataFrame:
    """Rows of the names that are there, with the names' own order as ``rank``."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return df.withColumn("rank", place).where("rank > 0")


def drop_channels(df: DataFrame, names: Sequence[str], column: str = "channel") -> DataFrame:
    return df.where(~F.col(column).isin(list(names)))


def rename_values(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values by a map; unknown ones stay."""
    if not names:
        return df
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def default_types(channel: Column, kind: str = "seeg") -> Column:
    return F.when(F.upper(channel) == "ECG", "ecg").otherwise(kind)


def aliased(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Columns under their first alias that is there, in any case; absent ones are null."""
    have = {c.lower(): c for c in df.columns}
    found = {n: next((have[a.lower()] for a in (n, *others) if a.lower() in have), None) for n, others in names.items()}
    return df.select(*[(F.col(c) if c else F.lit(None)).alias(n) for n, c in found.items()])


def first_event(events: DataFrame, keys: Sequence[str], code: Column, onset: str = "onset") -> DataFrame:
    return events.where(code).groupBy(*keys).agg(F.min(onset).alias(onset))


def conversation_bounds(events: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Earliest start event and the earliest end event after it."""
    first = events.where(F.col("kind") == start).groupBy(*keys).agg(F.min("onset").alias("begin"))
    last = events.where(F.col("kind") == end).join(first, list(keys)).where("onset > begin").groupBy(*keys).agg(F.min("onset").alias("stop"))
    return first.join(last, list(keys))


def crop(signal: DataFrame, bounds: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Half-open [begin, stop)."""
    return signal.join(bounds, list(keys)).where((F.col(at) >= F.col("begin")) & (F.col(at) < F.col("stop"))).drop("begin", "stop")


def candidate_descriptions(marks: DataFrame, keys: Sequence[str] = ("recording",), least: int = 2) -> DataFrame:
    """Descriptions with enough onsets that are no housekeeping."""
    low = F.lower("description")
    kept = marks.where(~F.startswith(low, F.lit("bad")) & ~F.startswith(low, F.lit("new segment")))
    return kept.groupBy(*keys, "description").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def score_column(df: DataFrame) -> str | None:
    """score, r or r2, else the first numeric column."""
    kinds = dict(df.dtypes)
    named = [c for c in ("score", "r", "r2") if c in kinds]
    return (named or [c for c, t in kinds.items() if t in ("double", "float", "int", "bigint")] or [None])[0]


def in_metres(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coordinates in metres: values of 1 or more anywhere mean that the table is in millimetres."""
    top = df.agg(F.max(F.greatest(*[F.abs(F.coalesce(c, F.lit(0.0))) for c in columns])).alias("_top"))
    out = df.join(F.broadcast(top))  # one row
    return out.withColumns({c: F.when(F.col("_top") >= 1, F.col(c) / 1000.0).otherwise(F.col(c)) for c in columns}).drop("_top")


def keyword_top(df: DataFrame, text: str, words: dict[str, float], k: int = 4, tie: Sequence[str] = ()) -> DataFrame:
    """The k rows of the highest sum of the weights of the words in their text; rows without any go."""
    score = sum(F.when(F.contains(F.lower(text), F.lit(w.lower())), float(v)).otherwise(0.0) for w, v in words.items())
    return df.withColumn("keyword_score", score).where("keyword_score > 0").orderBy(F.desc("keyword_score"), *tie).limit(k)


def compact(values: Column, head: int = 30, tail: int = 10) -> Column:
    """The first and last of a long array, with what was left out between them."""
    gone = F.size(values) - head - tail
    middle = F.array(F.concat(F.lit("... "), gone.cast("string"), F.lit(" more ...")))
    return F.when(gone > 0, F.concat(F.slice(values, 1, head), middle, F.slice(values, -tail, tail))).otherwise(values)


def symmetric_limit(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    return df.agg(F.percentile(F.abs(value), q).alias("limit"))


def meaningful_threshold(df: DataFrame, score: str, q: float = 0.75, floor: float = 0.1) -> DataFrame:
    return df.agg(F.greatest(F.percentile(F.abs(score), q), F.lit(floor)).alias("threshold"))


def midpoint_threshold(signal: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Half way between the 5th and 95th percentile of each recording.

    A percentile between two values is low * (1 - d) + high * d, rounded once (a fused multiply-add), as SQL's quantile_cont
    has it: values of few digits lie half way between two roundings often, and there the last bit counts.
    """
    w = Window.partitionBy(*keys)
    placed = signal.withColumns({"_n": F.count("x").over(w), "_i": F.row_number().over(w.orderBy(F.asc_nulls_last("x"))) - 1})
    at = {p: (F.col("_n") - 1) * F.lit(q) for p, q in (("a", 0.05), ("b", 0.95))}
    ends = {f"_{p}{e}": F.max(F.when(F.col("_i") == f(at[p]), F.col("x"))) for p in at for e, f in (("low", F.floor), ("high", F.ceil))}
    got = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[c.alias(n) for n, c in ends.items()])

    def between(p: str) -> Column:
        low, high, d = F.col(f"_{p}low"), F.col(f"_{p}high"), at[p] - F.floor(at[p])
        fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - d, high * d).cast("double")
        return F.when(d == 0, low).when(F.col("_n") > 0, fused)

    return got.select(*keys, ((between("a") + between("b")) / 2).alias("threshold"))


def min_max(value: Column, low: float, high: float, keys: Sequence[str] = ()) -> Column:
    """Scaled to [low, high] by the smallest and largest value."""
    w = Window.partitionBy(*keys)
    a, b = F.min(value).over(w), F.max(value).over(w)
    return F.when(b > a, low + (value - a) * (high - low) / (b - a)).otherwise((low + high) / 2)


def scene(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centre and largest extent of each group of points."""
    c = points.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"], F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("extent"))
    return c


def atlas_rows(atlas: DataFrame, id_: str, labels: str, probabilities: str) -> DataFrame:
    """A row a contact and label with its probability, from parallel arrays."""
    return atlas.select(id_, F.posexplode(F.arrays_zip(F.col(labels).alias("label"), F.col(probabilities).alias("prob"))).alias("i", "z")).select(id_, "i", "z.label", "z.prob")


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    none = F.lit(False)
    for c in columns:
        none = none | F.col(c).isNull()
    return df.agg(F.avg(none.cast("double")).alias("missing_share"))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The primary rows, and the fallback's for keys that have none."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti"))


def any_rule(rules: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Whether any rule of a key sets each flag."""
    return rules.groupBy(*keys).agg(*[F.bool_or(F.coalesce(f, F.lit(False))).alias(f) for f in flags])


def kernel_faults(kernel: DataFrame, value: str = "coef") -> DataFrame:
    """How many coefficients are null or not finite."""
    return kernel.agg(F.count_if(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).alias("faults"), F.count(F.lit(1)).alias("n"))


def joined_labels(rows: Column) -> Column:
    """One label from an array of characters, without the padding."""
    return F.trim(F.array_join(rows, ""))


def nested_faults(documents: DataFrame, id_: str, items: str, key: str, pattern: str) -> DataFrame:
    """Faults of an array of structs within a document: keys that don't fit the pattern, and keys that repeat (the first is no fault)."""
    one = documents.select(id_, F.posexplode(items).alias("pos", "item")).withColumn("_k", F.col("item")[key])
    again = F.row_number().over(Window.partitionBy(id_, "_k").orderBy("pos")) > 1
    code = F.when(F.coalesce(~F.rlike("_k", F.lit(pattern)), F.lit(True)), "pattern").when(again, "repeated")
    return one.withColumn("code", code).where("code is not null").select(id_, "pos", F.col("_k").alias("key"), "code")
