"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a 64-bit hash.  Words are summed by source and by the hash's first bits; the bucket in which a
source's budget runs out is found from the running sums, and only that bucket is summed again by the next bits.
Rows below the final threshold are taken.  Nothing is sorted by hash and no row of the corpus is shuffled.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows (same
id, source and text) share one hash, and where the threshold falls on them as many of them are taken as come nearest
to the target: they get numbers of their own, over which the same histograms find the threshold.  What is taken of a
row is its size times whole copies.  A very long text is one row and is taken as a whole; a source of size 0 has target
0; an empty table gives an empty result; other columns pass through unread, and the columns added replace others of
the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from voltlake.llm.common import lookup_join, text_of, with_index, written

#: Bits of the hash that each refinement adds: all 64 in the end.
BITS = (12, 12, 12, 12, 16)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_hash(doc_id: Column, source: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, source, text)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size), one row a source -> also ``target``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all words.  A target
    stops at ``cap`` times its source's size and the excess goes to the others by weight, until none is above.
    """
    ranked = with_index(sizes, "source")
    turn = F.pmod(F.col("_index"), F.lit(len(weights))).cast("int")
    w = written(ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1).alias("_w")), "weights")
    total = w.agg(F.sum("source_size")).first()[0] or 0
    top = F.col("source_size") * float(cap)
    level = -1.0
    while True:  # each round is one aggregate with two numbers; the set of capped sources only grows
        capped = top < F.col("_w") * level
        used, left = w.agg(F.sum(F.when(capped, top).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_w")))).first()
        if not left:
            break
        found = (share * total - (used or 0.0)) / left
        if found <= level:
            break
        level = found
    return w.select("source", "source_size", F.least(top, F.col("_w") * max(level, 0.0)).alias("target"))


def _place(h: Column, level: Column) -> Column:
    """The bucket of a hash after so many refinements."""
    cut = [64 - sum(BITS[:k]) for k in range(1, len(BITS) + 1)]
    out = F.shiftrightunsigned(h, cut[-1])
    for k in range(len(BITS) - 1, 0, -1):
        out = F.when(level == k, F.shiftrightunsigned(h, cut[k - 1])).otherwise(out)
    return out


def _below(a: Column, b: Column) -> Column:
    """a < b as unsigned numbers (the last refinement uses all 64 bits)."""
    low = F.lit(-(1 << 63))
    return a.bitwiseXOR(low) < b.bitwiseXOR(low)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows (source, size, h), budgets (source, rest) -> one row a source: its last bucket (prefix), how many rows are in it (n), and how many of these come nearest to what is left (take).

    Everything in buckets below the prefix is taken.  Each level sums the rows of the boundary buckets only.
    """
    plan = budgets.select("source", F.col("rest").alias("_rest"), F.lit(0).cast("long").alias("prefix"))
    for level, bits in enumerate(BITS, 1):
        place = _place(F.col("h"), F.lit(level))
        inside = lookup_join(rows, plan.select(F.col("source").alias("_source"), "_rest", "prefix"), "source", "_source", "inner")
        inside = inside.where(F.shiftrightunsigned(place, bits) == F.col("prefix")) if level > 1 else inside
        summed = inside.groupBy("source", place.alias("_bucket")).agg(F.sum("size").alias("_w"), F.count(F.lit(1)).alias("_n"), F.first("_rest").alias("_rest"))
        order = F.col("_bucket").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned
        run = summed.withColumn("_order", order).withColumn("_cum", F.sum("_w").over(Window.partitionBy("source").orderBy("_order")))
        # the first bucket that holds more than what is left; if none does, the last one, which is then taken whole
        past = F.when(F.col("_cum") > F.col("_rest"), 0).otherwise(1)
        edge = run.groupBy("source").agg(F.min_by(F.struct("_bucket", "_w", "_n", "_cum", "_rest"), F.struct(past, F.when(past == 0, F.col("_order")).otherwise(F.bitwise_not("_order")))).alias("_e"))
        rest = F.col("_e._rest") - (F.col("_e._cum") - F.col("_e._w"))
        take = F.when(F.col("_e._w") > 0, F.least(F.col("_e._n"), F.round(rest * F.col("_e._n") / F.col("_e._w")).cast("long"))).otherwise(0)
        plan = written(edge.select("source", rest.alias("_rest"), F.col("_e._bucket").alias("prefix"), F.col("_e._n").alias("n"), take.alias("take"), F.lit(level).alias("level")), "edges")
        if (plan.agg(F.max("n")).first()[0] or 1) == 1:
            break
    return plan.drop("_rest")


def mix_plan(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """rows (source, size, h) -> one row a source: source_size, target, whole (takes of every row) and the threshold for one more."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sizes, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    goal = written(goal.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "plan")
    edge = thresholds(rows, goal).withColumnRenamed("source", "_of")
    return written(goal.drop("rest").join(edge, goal["source"].eqNullSafe(edge["_of"]), "left").drop("_of"), "plan")


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, size, h and any others) -> also source_size, target, copies, and _tie where the threshold falls among rows of one hash."""
    got = lookup_join(rows, plan.withColumnRenamed("source", "_source"), "source", "_source")
    at = _place(F.col("h"), F.col("level"))
    on = at == F.col("prefix")
    extra = F.when(on, F.col("take") >= F.col("n")).otherwise(_below(at, F.col("prefix")))
    return got.withColumns({"copies": (F.col("whole") + extra.cast("long")).cast("int"), "_tie": on & (F.col("take") > 0) & (F.col("take") < F.col("n"))})


def _settle_ties(ties: DataFrame, plan: DataFrame) -> DataFrame:
    """ties (source, copies, _u: a number of each row's own, and any others) with copies one higher for ``take`` of each source's rows."""
    budgets = plan.select("source", F.col("take").alias("rest"))
    edge = thresholds(ties.select("source", F.lit(1).cast("long").alias("size"), F.col("_u").alias("h")), budgets)
    met = lookup_join(ties, edge.select(F.col("source").alias("_source"), F.col("prefix").alias("_p"), F.col("level").alias("_l")), "source", "_source")
    more = _below(_place(F.col("_u"), F.col("_l")), F.col("_p"))
    return met.withColumn("copies", (F.col("copies") + more.cast("int")).cast("int"))


def _has_ties(plan: DataFrame) -> bool:
    return not plan.where("n > 1 AND take > 0 AND take < n").isEmpty()


def sized(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.withColumns({"size": word_count(text), "h": row_hash(F.col("doc_id"), F.col("source"), text)})


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, copies, taken (size times copies) for each row.  Reruns agree."""
    rows = sized(docs.select("doc_id", "source", "text")).drop("text").withColumn("_u", F.xxhash64(F.monotonically_increasing_id()))
    rows = written(rows, "sizes")  # what tells equal rows apart is fixed from here on
    plan = mix_plan(rows, weights, share, cap)
    got, out = _placed(rows, plan), ["doc_id", "source", "size", "source_size", "target", "copies"]
    if _has_ties(plan):
        got = got.where("NOT _tie").select(*out).unionByName(_settle_ties(got.where("_tie").select(*out, "_u"), plan).select(*out))
    return got.select(*out, (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken (0, 1 or 2 with the defaults), same columns.

    Only the plan (one row a source) is joined to the texts; a plan too large to broadcast is dealt by source, hot ones
    over salts.  Rows on which a threshold falls together are written, so that each keeps the number it was given.
    """
    cols = docs.columns
    rows = written(sized(docs.select("doc_id", "source", "text")).select("source", "size", "h"), "sizes")
    plan = mix_plan(rows, weights, share, cap)
    work = docs.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in cols])).select("_all", "doc_id", "source", "text")
    got = _placed(sized(work).drop("text"), plan)
    if _has_ties(plan):
        ties = written(got.where("_tie").select("_all", "source", "copies", F.xxhash64(F.monotonically_increasing_id()).alias("_u")), "ties")
        got = got.where("NOT _tie").select("_all", "copies").unionByName(_settle_ties(ties, plan).select("_all", "copies"))
    # as many rows as copies; copies is at most cap, rounded up
    return got.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("_all")[c].alias(c) for c in cols])
