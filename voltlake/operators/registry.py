"""Metadata registry: overlay, availability, selection, fan-out and privacy projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.scalars import completed_years, iso_date, or_none, record_id


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given; null and blank keys go."""
    fields = [c for c in df.columns if c != key]
    trimmed = df.withColumn(key, F.trim(F.col(key).cast("string"))).where(F.coalesce(F.col(key), F.lit("")) != "")
    best = F.max_by(F.struct(*fields), F.struct(*order))
    return trimmed.groupBy(key).agg(best.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in fields])


def overlay(public: DataFrame, private: DataFrame, key: str = "record_id", reason: str = "exclude_reason", order: Sequence[str] = ()) -> DataFrame:
    """Public rows with the private decision: a non-blank reason excludes.  The last private row of a key wins; unmatched rows are usable."""
    decided = last_per_key(private.select(key, reason, *order), key, order or [reason]).select(F.col(key).alias("_key"), F.trim(F.col(reason)).alias("_reason"))
    met = public.join(decided, F.trim(F.col(key)) == F.col("_key"), "left")
    why = F.coalesce("_reason", F.lit(""))
    return met.withColumns({"excluded": why != "", reason: why}).drop("_key", "_reason")


def availability_index(view: DataFrame, keys: Sequence[str] = ("dataset_id", "task", "protocol_id")) -> DataFrame:
    out = view.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_records"), F.count_if("excluded").alias("excluded_records"))
    out = out.withColumn("usable_records", F.col("total_records") - F.col("excluded_records"))
    return out.withColumn("usable_fraction", F.format_string("%.4f", F.col("usable_records") / F.col("total_records")))


def counts(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("total"), F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded")).alias("usable"))


def list_runs(view: DataFrame, task: str | None = None, qc: str | None = None, usable_only: bool = False) -> DataFrame:
    for wanted, test in ((task, F.col("task") == task), (qc, F.col("qc_status") == qc), (usable_only, ~F.col("excluded"))):
        view = view.where(test) if wanted else view
    return view


def tasks_of(view: DataFrame, subject: object) -> DataFrame:
    return view.where(F.col("subject") == F.lit(subject)).select("task").dropna().distinct()


def subjects_with_tasks(view: DataFrame, tasks: Sequence[str], usable_only: bool = True) -> DataFrame:
    """Subjects that have all the tasks (all subjects if none is asked for)."""
    view = view.where(~F.col("excluded")) if usable_only else view
    if not tasks:
        return view.select("subject").distinct()
    return view.where(F.col("task").isin(list(tasks))).groupBy("subject").agg(F.count_distinct("task").alias("_n")).where(F.col("_n") == len(set(tasks))).select("subject")


def fan_out(left: DataFrame, right: DataFrame, key: str, members: str, keep: str, default: str = "none") -> DataFrame:
    """Left rows once for each right row whose members hold the left key; once with the default where none does."""
    one = right.select(F.explode(members).alias("_member"), F.col(keep)).distinct()
    return left.join(one, left[key] == one["_member"], "left").drop("_member").withColumn(keep, F.coalesce(F.col(keep), F.lit(default)))


def lookup_once(left: DataFrame, right: DataFrame, key: str, value: str, what: str = "key") -> DataFrame:
    """Left join to a side whose key must be unique and complete; a repeated or missing key fails the query."""
    one = right.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    met = left.join(one, left[key] == one["_key"], "left")
    checked = F.when(F.col("_n").isNull() | (F.col("_n") > 1), F.raise_error(F.concat(F.lit(f"no single {what} "), F.col(key).cast("string"))).cast(right.schema[value].dataType)).otherwise(F.col(value))
    return met.withColumn(value, checked).drop("_key", "_n")


def lookup_fallback(left: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Value under (first, second), else under ("", second); accepted only if there is exactly one."""
    side = right.groupBy(first, second).agg(F.collect_set(value).alias("_v"))
    exact = side.select(F.col(first).alias("_f"), F.col(second).alias("_s"), F.col("_v").alias("_exact"))
    loose = side.where(F.col(first) == "").select(F.col(second).alias("_s2"), F.col("_v").alias("_loose"))
    met = left.join(exact, (left[first] == F.col("_f")) & (left[second] == F.col("_s")), "left").join(loose, left[second] == F.col("_s2"), "left")
    found = F.coalesce("_exact", "_loose")
    return met.withColumn(value, F.when(F.size(found) == 1, found[0])).drop("_f", "_s", "_s2", "_exact", "_loose")


def include_exclude(df: DataFrame, include: dict[str, Sequence], exclude: dict[str, Sequence]) -> DataFrame:
    """Rows in all include sets (null passes) and in no exclude set (null never matches)."""
    for c, values in include.items():
        df = df.where(F.col(c).isNull() | F.col(c).isin(list(values)))
    for c, values in exclude.items():
        df = df.where(~F.coalesce(F.col(c).isin(list(values)), F.lit(False)))
    return df


def preferred(df: DataFrame, keys: Sequence[str], choice: str, order: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """One row a key: the earliest choice in the order; other choices count last."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(choice)), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    w = Window.partitionBy(*keys).orderBy(rank, *tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sanitize(private: DataFrame, ids: DataFrame, key: str, public_key: str, allow: Sequence[str], domain: Sequence[str]) -> DataFrame:
    """The allowed columns only, private keys replaced; an absent status is 'unknown', one outside the domain fails the query."""
    out = lookup_once(private, ids, key, public_key)
    if "qc_status" not in out.columns:
        out = out.withColumn("qc_status", F.lit("unknown"))
    bad = ~F.col("qc_status").isin(list(domain))
    out = out.withColumn("qc_status", F.when(bad, F.raise_error(F.concat(F.lit("qc_status "), F.col("qc_status"))).cast("string")).otherwise(F.col("qc_status")))
    return out.select(*[c for c in allow if c in out.columns])


def build_public(acquisitions: DataFrame, protocols: DataFrame) -> DataFrame:
    """Acquisitions (dataset_id, subject, session, acquisition_id, task, sex, birth_date, date) fanned out over protocols, with age and record id."""
    out = fan_out(acquisitions, protocols, "session", "sessions", "protocol_id")
    age = F.coalesce(completed_years(iso_date(F.col("birth_date")), iso_date(F.col("date"))).cast("string"), F.lit(""))
    return out.withColumn("age", age).withColumn("record_id", record_id(F.col("dataset_id"), F.col("subject"), F.col("session"), F.col("acquisition_id"), or_none(F.col("protocol_id")))).drop("birth_date", "date")


def issues(df: DataFrame, key: str, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """checks: code -> (level, failing test).  One row for each failing row and check; one pass over df."""
    rows = F.array(*[F.when(F.coalesce(test, F.lit(True)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, (level, test) in checks.items()])
    return df.select(F.col(key), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_i")).select(key, "_i.level", "_i.code")


def repeated(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Every row of a key but its first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r > 1").drop("_r")


def public_issues(rows: DataFrame, order: str, subject: str = r"^sub-\d{3}$", session: str = r"^ses-[A-Za-z0-9]+$") -> DataFrame:
    """order, level, code of a public registry's rows: patterns, and the record id, which must be there, be the only one of its
    value (the first in the order passes) and equal the one made from its row's parts, where these are there.

    Null and blank count as not there; a row without an id has no further check of it.
    """
    there = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in ("record_id", "dataset_id", "subject", "session", "acquisition_id", "protocol_id")}
    made = F.concat_ws("|", "dataset_id", "subject", "session", "acquisition_id", F.when(there["protocol_id"], F.col("protocol_id")).otherwise("none"))
    whole = there["dataset_id"] & there["subject"] & there["session"] & there["acquisition_id"]
    own = F.when(there["record_id"], F.struct(F.lit(0).cast("long").alias("i"), F.col("record_id").cast("string").alias("id"))).otherwise(F.struct(F.xxhash64(order).alias("i"), F.lit("").alias("id")))  # rows without an id don't meet
    first = F.min(order).over(Window.partitionBy(own))
    checks = {
        "subject_pattern": ("error", there["subject"] & ~F.rlike("subject", F.lit(subject))),
        "session_pattern": ("warning", there["session"] & ~F.rlike("session", F.lit(session))),
        "record_id_missing": ("error", ~there["record_id"]),
        "record_id_repeated": ("error", there["record_id"] & (F.col(order) > F.col("_first"))),
        "record_id_mismatch": ("error", there["record_id"] & whole & (F.col("record_id") != made)),
    }
    return issues(rows.withColumn("_first", first), order, checks)


def missing_columns(df: DataFrame, required: Sequence[str], allowed: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(required but absent, present but neither required nor allowed), from the schema alone."""
    have = set(df.columns)
    return [c for c in required if c not in have], [c for c in df.columns if c not in {*required, *allowed}]


def exit_code(found: DataFrame, strict: bool = False) -> DataFrame:
    """0 without issues, 2 with warnings only (3 if strict), 3 with errors."""
    n = found.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return n.withColumn("exit_code", F.when(F.col("errors") > 0, 3).when(F.col("warnings") > 0, 3 if strict else 2).otherwise(0))
