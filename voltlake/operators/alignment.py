"""Alignment of event streams between clocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators import series


def zip_by_order(left: DataFrame, right: DataFrame, keys: Sequence[str], order_left: Sequence[str], order_right: Sequence[str], strict: bool = True) -> DataFrame:
    """Rows of the same place in either order; strict: different lengths fail the query."""
    def numbered(df: DataFrame, order: Sequence[str], n: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.withColumns({"ordinal": F.row_number().over(w.orderBy(*order)), n: F.count(F.lit(1)).over(w)})

    met = numbered(left, order_left, "_nl").join(numbered(right, order_right, "_nr"), [*keys, "ordinal"])
    if strict:
        same = F.when(F.col("_nl") != F.col("_nr"), F.raise_error(F.lit("sequences differ in length")).cast("int")).otherwise(F.col("ordinal"))
        met = met.withColumn("ordinal", same)
    return met.drop("_nl", "_nr")


def block_onsets(markers: DataFrame, log: DataFrame, codes: DataFrame, rate: float) -> DataFrame:
    """Log rows (part, ms, code) at seconds after their part's start marker (part, sample); names by code where known."""
    met = markers.join(log, "part").join(codes, "code", "left")
    return met.withColumn("onset", F.greatest(F.col("sample") - 1, F.lit(0)) / rate + F.col("ms") / 1000.0)


def nearest_value(reference: DataFrame, target: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Each reference row with the target of the nearest value (ties: the lower index), within the tolerance.

    reference and target: key, i, value.  One sorted pass over both: the nearest is the last before or the first after.
    """
    rows = reference.select(key, value, F.col("i").alias("ref"), F.lit(None).cast("struct<v:double,i:bigint>").alias("_t")).unionByName(
        target.select(key, value, F.lit(None).cast("long").alias("ref"), F.struct(F.col(value).cast("double").alias("v"), F.col("i").cast("long").alias("i")).alias("_t")))
    below = Window.partitionBy(key).orderBy(F.col(value), F.col("_t.i").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(key).orderBy(F.col(value).desc(), F.col("_t.i").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumns({"_b": F.last("_t", True).over(below), "_a": F.last("_t", True).over(above)}).where("ref is not null")
    choice = F.array_min(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["v"] - F.col(value)).alias("d"), F.col(c)["i"].alias("i"), F.col(c)["v"].alias("v"))) for c in ("_b", "_a")]), lambda s: s.isNotNull()))
    return got.withColumn("_c", choice).where(F.col("_c.d") <= tolerance).select(key, "ref", value, F.col("_c.i").alias("target"), F.col("_c.v").alias("target_value"))


def matched(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """One-to-one pairs of two sorted lists within the tolerance: the earlier side advances where they are apart."""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        d = a[i] - b[j]
        if abs(d) <= tolerance:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif d < 0:
            i += 1
        else:
            j += 1
    return out


def greedy_matches(a: DataFrame, b: DataFrame, key: str, onset: str, tolerance: float) -> DataFrame:
    """One-to-one matches a key by two pointers: key, onset_a, onset_b."""
    def pairs(ka: pd.DataFrame, kb: pd.DataFrame) -> pd.DataFrame:
        x, y = np.sort(ka[onset].to_numpy()), np.sort(kb[onset].to_numpy())
        got = matched(x, y, tolerance)
        k = ka[key].iloc[0] if len(ka) else None
        return pd.DataFrame({key: [k] * len(got), "onset_a": [x[i] for i, _ in got], "onset_b": [y[j] for _, j in got]})

    schema = f"{key} {a.schema[key].dataType.simpleString()}, onset_a double, onset_b double"
    return a.select(key, F.col(onset).cast("double").alias(onset)).groupBy(key).cogroup(b.select(key, F.col(onset).cast("double").alias(onset)).groupBy(key)).applyInPandas(pairs, schema)


#: Intervals of a window that is as long as the trains allow: at least, at most.
SHORTEST, LONGEST = 5, 12
#: Rows of found windows that a task holds before it emits them.
HELD = 100_000
#: Where no window is within the tolerance the best one may have so many times it.
WIDE = 5.0


def window_delays(reference: DataFrame, raw: DataFrame, key: str, width: int | None = None, starts: int = 31, limit: float = 0.05) -> DataFrame:
    """Delays from interval windows that fit: every reference window (of the first ``starts``) against every raw one, by RMSE.

    A key's heads meet in one row, and only windows within the limit become rows.
    reference and raw: key, onset, interval.  Candidates are at most starts squared a key.  Without a width it is the
    shorter train's length, LONGEST at most; trains of fewer than SHORTEST intervals have no window.
    """
    def heads(df: DataFrame, p: str) -> DataFrame:
        i = F.row_number().over(Window.partitionBy(key).orderBy("onset", "interval"))
        got = df.select(key, "onset", "interval", i.alias("_i")).where(F.col("_i") < starts + (width or LONGEST))
        rows = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "onset", "interval"))).alias("_h"))
        return rows.select(key, F.col("_h.onset").cast("array<double>").alias(f"{p}_onset"), F.col("_h.interval").cast("array<double>").alias(f"{p}_interval"))

    def frame(found: list[tuple]) -> pd.DataFrame:
        ks, i, j, delay, rmse = zip(*found, strict=True)
        cols = [np.concatenate(c) for c in (i, j, delay, rmse)]
        return pd.DataFrame({key: [k for k, own in zip(ks, i, strict=True) for _ in own], **dict(zip(("ref_start", "raw_start", "delay", "rmse"), cols, strict=True))})

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for k, a_on, a, b_on, b in pdf.itertuples(index=False, name=None):
                n = width or min(LONGEST, len(a), len(b))
                p, q = min(starts, len(a) - n + 1), min(starts, len(b) - n + 1)
                if n < (width or SHORTEST) or p < 1 or q < 1:
                    continue
                a_on, a, b_on, b = (np.asarray(x, float) for x in (a_on, a, b_on, b))
                square = np.zeros((p, q))
                for i in range(n):
                    gap = a[i : i + p, None] - b[None, i : i + q]
                    square += gap * gap
                rmse = np.sqrt(square / n)
                i, j = np.nonzero(rmse <= limit)
                out.append((k, i, j, b_on[j] - a_on[i], rmse[i, j]))
                held += len(i)
                if held > HELD:
                    yield frame(out)
                    out, held = [], 0
            if held:
                yield frame(out)

    met = heads(reference, "ref").join(heads(raw, "raw"), key)
    return met.mapInPandas(fits, f"`{key}` {reference.schema[key].dataType.simpleString()}, ref_start int, raw_start int, delay double, rmse double")


def nearest_windows(reference: DataFrame, raw: DataFrame, key: str, width: int | None, tolerance: float) -> DataFrame:
    """The windows within the tolerance; for a key that has none its best one (of equal ones the first), within WIDE times it."""
    place = F.struct("rmse", "ref_start", "raw_start")
    wide = window_delays(reference, raw, key, width, limit=WIDE * tolerance).withColumn("_best", F.min(place).over(Window.partitionBy(key)))
    return wide.where((F.col("rmse") <= tolerance) | (F.col("_best.rmse") > tolerance) & (F.col("_best") == place)).drop("_best")


def onset_delays(reference: DataFrame, raw: DataFrame, key: str, starts: int = 31) -> DataFrame:
    """Delays from every pair of the first ``starts`` onsets, as window_delays has them; rmse is null."""
    def heads(df: DataFrame, p: str) -> DataFrame:
        i = F.row_number().over(Window.partitionBy(key).orderBy("onset")) - 1
        return df.select(key, i.alias(f"{p}_start"), F.col("onset").alias(f"_{p}")).where(F.col(f"{p}_start") < starts)

    met = heads(reference, "ref").join(heads(raw, "raw"), key)
    return met.select(key, "ref_start", "raw_start", (F.col("_raw") - F.col("_ref")).alias("delay"), F.lit(None).cast("double").alias("rmse"))


def constant_delay(delays: DataFrame, key: str) -> DataFrame:
    """The robust mean of each key's delays (as ``series.robust_mean``).  A key has few of them, so they meet in one array and are computed once."""
    return delays.groupBy(key).agg(F.collect_list("delay").alias("_v")).select(key, series.robust_mean_of("_v").alias("robust_mean"))


def best_delay(candidates: DataFrame, reference: DataFrame, raw: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Of candidate delays (as of window_delays or onset_delays) the one of most one-to-one onset hits, then of least rmse, then the first."""
    def score(cand: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.sort(both.loc[both["side"] == s, "onset"].to_numpy()) for s in (0, 1))
        rows = [(len(matched(x + c.delay, y, tolerance)), 0.0 if pd.isna(c.rmse) else -c.rmse, -c.ref_start, -c.raw_start, c.delay, None if pd.isna(c.rmse) else c.rmse) for c in cand.itertuples()]
        if not rows:
            return pd.DataFrame(columns=[key, "delay", "hits", "rmse"])
        hits, _, _, _, delay, rmse = max(rows, key=lambda r: r[:4])
        fine = [y[j] - x[i] for i, j in matched(x + delay, y, tolerance)]
        return pd.DataFrame({key: [cand[key].iloc[0]], "delay": [float(np.median(fine)) if fine else delay], "hits": [hits], "rmse": pd.Series([rmse], dtype=float)})

    both = reference.select(key, F.col("onset").cast("double").alias("onset"), F.lit(0).alias("side")).unionByName(raw.select(key, F.col("onset").cast("double").alias("onset"), F.lit(1).alias("side")))
    both = both.select(F.col(key).alias("_key"), "onset", "side")
    return candidates.groupBy(key).cogroup(both.groupBy("_key")).applyInPandas(score, f"{key} {candidates.schema[key].dataType.simpleString()}, delay double, hits long, rmse double")


def triplets(rows: DataFrame, keys: Sequence[str], order: str, kind: str, wanted: Sequence[str]) -> DataFrame:
    """Rows that begin a run of the wanted kinds, with the orders of all."""
    w = Window.partitionBy(*keys).orderBy(order)
    got = rows.withColumns({f"at{k}": F.lead(order, k).over(w) for k in range(1, len(wanted))} | {f"_k{k}": F.lead(kind, k).over(w) for k in range(1, len(wanted))})
    test = F.col(kind) == wanted[0]
    for k in range(1, len(wanted)):
        test = test & (F.col(f"_k{k}") == wanted[k])
    return got.where(test).drop(*[f"_k{k}" for k in range(1, len(wanted))])


def log_trials(rows: DataFrame, keys: Sequence[str] = ("recording",), order: str = "t", strict: bool = True) -> DataFrame:
    """rows (keys, order, event_type, code, ms) of a presentation log -> keys, order, recording_ms, picture_ms, isi_ms, stimulus, fault.

    A trial is a microphone row with a picture (.bmp) and an interval picture as the next two rows.  strict: one that is not so
    fails the query; else its row says why (fault; null for a sound trial).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = rows.withColumns({f"_{c}{k}": F.lead(c, k).over(w) for c in ("event_type", "code", "ms") for k in (1, 2)})
    started = ahead.where((F.col("event_type") == "Sound Recording") & (F.col("code") == "Mic_Rec"))
    picture = (F.col("_event_type1") == "Picture") & F.endswith(F.col("_code1"), F.lit(".bmp"))
    rest = (F.col("_event_type2") == "Picture") & (F.col("_code2") == "isi")
    fault = F.when(F.col("_event_type2").isNull(), "incomplete").when(~F.coalesce(picture, F.lit(False)), "no picture").when(~F.coalesce(rest, F.lit(False)), "no isi")
    if strict:
        fault = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("log trial: "), fault)).cast("string"))
    return started.select(*keys, order, F.col("ms").alias("recording_ms"), F.col("_ms1").alias("picture_ms"), F.col("_ms2").alias("isi_ms"), F.col("_code1").alias("stimulus"), fault.alias("fault"))


def log_extras(rows: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Rows of a presentation log beside its trials: keys, trial_type (pause_onset, button_press, run_start), ms, marker (100, the button's number, none)."""
    picture, pressed = F.col("event_type") == "Picture", F.col("event_type") == "Response"
    kind = F.when(picture & (F.col("code") == "pause"), "pause_onset").when(pressed, "button_press").when(picture & (F.col("code") == "start"), "run_start")
    marker = F.when(pressed, F.col("code").cast("int")).when(kind == "pause_onset", 100)
    return rows.select(*keys, kind.alias("trial_type"), "ms", marker.alias("marker")).where("trial_type is not null")


def forward_pattern(marks: DataFrame, start: int, stop: int, skip: Sequence[int], keys: Sequence[str] = ("recording",)) -> DataFrame:
    """From each start code to the next stop code: its order, the stop's, and the last code between that isn't skipped."""
    w = Window.partitionBy(*keys).orderBy("t")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)  # a running frame: one step a row
    body = F.when(~F.col("code").isin(start, stop, *skip), F.struct("t", "code"))
    ends = marks.withColumn("_last", F.last(body, True).over(back)).where(F.col("code") == stop).select(*keys, F.col("t").alias("stop_t"), "_last")
    begins = marks.withColumn("stop_t", F.min(F.when(F.col("code") == stop, F.col("t"))).over(ahead)).where((F.col("code") == start) & F.col("stop_t").isNotNull()).select(*keys, F.col("t").alias("start_t"), "stop_t")
    met = begins.join(ends, [*keys, "stop_t"])
    inside = F.col("_last.t") > F.col("start_t")
    return met.select(*keys, "start_t", "stop_t", F.when(inside, F.col("_last.code")).alias("code"), F.when(inside, F.col("_last.t")).alias("code_t"))


def overlap(tiers: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Intervals clipped to each window that they overlap, shifted to its start; none of length zero."""
    met = tiers.join(windows, key).where((F.col("start") < F.col("w_end")) & (F.col("end") > F.col("w_start")))
    out = met.withColumns({"s": F.greatest("start", "w_start") - F.col("w_start"), "e": F.least("end", "w_end") - F.col("w_start")})
    return out.where("e > s")


def points_in(points: DataFrame, windows: DataFrame, key: str, eps: float = 0.0) -> DataFrame:
    """Points within a window (inclusive, by eps), shifted to its start."""
    met = points.join(windows, key).where((F.col("at") >= F.col("w_start") - eps) & (F.col("at") <= F.col("w_end") + eps))
    return met.withColumn("shifted", F.col("at") - F.col("w_start"))


def event_rows(trials: DataFrame, kinds: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """A row a trial and kind that has an onset, in the order of onset, then of the kinds."""
    rows = F.array(*[F.struct(F.lit(n).alias("trial_type"), F.lit(k + 1).alias("value"), c.alias("onset")) for k, (n, c) in enumerate(kinds.items())])
    return trials.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*").where("onset is not null")


def is_monotonic(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_ok", F.coalesce(F.lag(value).over(w) <= F.col(value), F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("monotonic"))


def first_divergence(a: DataFrame, b: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """The first place at which two sequences differ (a missing row differs), a key."""
    met = a.join(b.withColumnRenamed(value, "_v"), [*keys, at], "full").where(~F.col(value).eqNullSafe(F.col("_v")))
    return met.groupBy(*keys).agg(F.min(F.struct(at, value, F.col("_v").alias("other"))).alias("_d")).select(*keys, "_d.*")
