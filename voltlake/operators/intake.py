"""Finding inputs, checking them before use, and the small maps of names and units around that."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.registry import issues
from voltlake.operators.series import centred_ranks
from voltlake.storage import written


def run_ids(listings: Sequence[DataFrame], keys: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Distinct run numbers named in any of the listings, in order; paths without one are left out."""
    rows = listings[0].select(*keys, path)
    for more in listings[1:]:
        rows = rows.union(more.select(*keys, path))
    return rows.select(*keys, F.regexp_extract(path, r"run-(\d+)", 1).alias("run")).where("run <> ''").distinct().orderBy(*keys, "run")


def shortest_path(candidates: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """One path a key, the shortest (of equal ones the first by name), with the number of candidates."""
    return candidates.groupBy(*keys).agg(F.min_by(path, F.struct(F.length(path), path)).alias(path), F.count(F.lit(1)).alias("candidates"))


def ordered_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The different values of each key as an array, in the order in which they appear first."""
    first = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))


def is_task_name(name: Column, others: Sequence[str] = ("rest", "resting")) -> Column:
    """Whether a file name belongs to the task: it holds none of the words, in any case."""
    out = F.lit(True)
    for word in others:
        out = out & ~F.contains(F.lower(name), F.lit(word))
    return out


def trial_type(event_type: Column, event_name: Column) -> Column:
    """The trial type of a behaviour row, by its kind and, for sounds and pictures, its own name where it has one."""
    kind, name = F.lower(F.trim(event_type)), F.coalesce(event_name, F.lit(""))
    known = F.when(kind == "sound", F.when(name == "", "stimulus").otherwise(name)).when(kind == "sound recording", "response_audio").when(kind == "response", "button_response")
    return known.when(kind == "picture", F.when(F.trim(name) == "", "picture").otherwise(F.trim(name))).otherwise(F.replace(kind, F.lit(" "), F.lit("_")))


def part_letter(code: Column, letters: str = "ABCDE") -> Column:
    """The letter of a part by its code from 1; null beyond."""
    return F.when((code >= 1) & (code <= len(letters)), F.substring(F.lit(letters), code.cast("int"), F.lit(1)))


def part_of_name(name: Column, pattern: str) -> Column:
    """The part's letter in a file name (group 1 of the pattern), upper case; null where there is none."""
    return F.upper(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")))


def time_axis(sample: Column, dt: float = 1.0, unit: str = "s") -> Column:
    """Times of samples from 0, in s or ms."""
    if dt <= 0 or unit not in ("s", "ms"):
        raise ValueError(f"dt {dt}, unit {unit}")
    return sample * dt * (1000.0 if unit == "ms" else 1.0)


def downmix(audio: DataFrame, keys: Sequence[str] = ("recording",), how: str = "mean") -> DataFrame:
    """(keys, t, x): one channel, the mean of all (or the first by name); audio without channels stays."""
    if "channel" not in audio.columns:
        return audio.select(*keys, "t", "x")
    if how not in ("mean", "first"):
        raise ValueError(how)
    one = F.avg("x") if how == "mean" else F.min_by("x", "channel")
    return audio.groupBy(*keys, "t").agg(one.alias("x"))


def recording_issues(recordings: DataFrame, key: str = "recording") -> DataFrame:
    """recordings (key, rate, samples): an error for a rate or a number of samples that isn't above 0."""
    return issues(recordings, key, {"rate": ("error", ~(F.col("rate") > 0)), "no_samples": ("error", ~(F.col("samples") > 0))})


def event_issues(events: DataFrame, ids: dict[str, int], key: str) -> DataFrame:
    """events (key, sample, code): samples that are null or negative, codes that no name stands for.  Without names it fails."""
    if not ids:
        raise ValueError("events need names")
    known = F.col("code").isin(sorted(set(ids.values())))
    return issues(events, key, {"sample": ("error", ~(F.col("sample") >= 0)), "code": ("error", ~known)})


def missing_inputs(spec: DataFrame, have: DataFrame, name: str = "name") -> DataFrame:
    """The names of a report's inputs that aren't there."""
    return spec.join(have, name, "left_anti")


def match_summary(matches: DataFrame, keys: Sequence[str], offset: str, error: str, ok: str) -> DataFrame:
    """Median offset, mean absolute error, whether all match, and how many don't."""
    return matches.groupBy(*keys).agg(F.median(offset).alias("median_offset"), F.avg(F.abs(error)).alias("mean_error"), F.bool_and(ok).alias("all_match"), F.count_if(~F.col(ok)).alias("mismatches"))


def column_hints(df: DataFrame, words: Sequence[str]) -> list[str]:
    """Columns whose names hold one of the words: they may be private.  From the schema alone."""
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def _pearson(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    from voltlake.operators.encoding import pearson

    return df.groupBy(*keys).agg(pearson(y, p).alias("score"))


def _spearman(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """From different pairs and their numbers: no window holds a key's rows, and ranks are joined from one row a value."""
    names = list(keys)
    pairs = written(df.groupBy(*names, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")), "pairs")
    for c in ("_y", "_p"):
        ranks = centred_ranks(pairs, names, c, "_c").withColumnsRenamed({n: f"_of_{n}" for n in [*names, c]})
        same = F.lit(True)
        for n in [*names, c]:
            same = same & F.col(n).eqNullSafe(F.col(f"_of_{n}"))
        pairs = pairs.join(ranks.withColumnRenamed("_rank", f"{c}_rank"), same, "left").drop(*[f"_of_{n}" for n in [*names, c]])
    a, b, n = F.col("_y_rank"), F.col("_p_rank"), F.col("_c")
    both, own = F.sum(n * a * b), F.sum(n * a * a) * F.sum(n * b * b)
    return pairs.groupBy(*names).agg(F.when(own > 0, both / F.sqrt(own)).otherwise(0.0).alias("score"))


def _r2(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    rest, w = F.sum(F.pow(F.col(y) - F.col(p), F.lit(2.0))), F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(F.when(w > 0, 1 - rest / w).otherwise(0.0).alias("score"))


#: Scores by name: (rows, keys, y, predicted) -> a row a key with its score.
METRICS: dict[str, Callable[..., DataFrame]] = {"pearson": _pearson, "spearman": _spearman, "r2": _r2}


def score_by(name: str, rows: DataFrame, keys: Sequence[str], y: str, predicted: str) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"unknown score {name}")
    return METRICS[name](rows, keys, y, predicted)


def silent_gaps(rows: DataFrame, key: str, order: str, kinds: tuple[str, str], kind: str = "kind") -> DataFrame:
    """Of two modalities of a run: how far their first rows lie apart, and how much longer one lasts."""
    span = rows.where(F.col(kind).isin(*kinds)).groupBy(key, kind).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    pick = lambda f, k: F.max(F.when(F.col(kind) == k, f))
    a, b = kinds
    out = span.groupBy(key).agg((pick(F.col("lo"), b) - pick(F.col("lo"), a)).alias("offset"), (pick(F.col("hi") - F.col("lo"), b) - pick(F.col("hi") - F.col("lo"), a)).alias("longer"))
    return out.where("offset IS NOT NULL")


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
