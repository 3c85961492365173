"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are found by three patterns.  A text's matches are kept as lengths (between matches, and of each match) on
its own row; only those of texts that have any go on, a row a match, and running sums give their places.  Weak parts
(identifiers, values and endpoints that alone prove nothing) are reported only when a complementary part starts
within SCOPE characters: a weak identifier or value needs the other (or an endpoint beside a value), an endpoint
needs both.  The meeting is an interval join: parts are summed by text and SCOPE-wide bin to the smallest and largest
start of each class, and a candidate meets three bins, so no pair of parts is ever written out.

Defined results: a null text is empty and has no spans; rows of one text share its spans; a very long text is one row,
its matches spread over as many rows and bins as it has, and the work grows as its length; an empty table gives an
empty result; other columns pass through unread.  Positions are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import lookup_join, text_of, written

#: Fixed patterns of the base kinds: assign, access, hex.  The last two leave out runs that are too short to count,
#: which no later match could begin inside.
VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?" + f"({VALUE})"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Weak kinds and their patterns.
WEAK = {
    "weak_access": r"(?:ASIA|AROA|AIDA|AGPA|ANPA)[A-Z0-9]{12,}|(?i:client_?id|access_?key_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=@-]{3,}",
    "weak_secret": r"(?i:pwd|pass_?phrase|(?:secret|private|access)_?key|credential|auth)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=]))(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}",
    "endpoint": r"https?://[^\s\"'<>]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
}
#: What a text must hold for a kind's pattern to match at all: plain searches that spare most texts the pattern.
HOLDS = {"assign": (":", "="), "access": ("AKIA",), "weak_access": (":", "=", "ASIA", "AROA", "AIDA", "AGPA", "ANPA")}
#: Characters between the starts of parts that belong together.
SCOPE = 300
KINDS = ("assign", "access", "hex", *WEAK)
#: Characters of a piece of text that redaction cuts from.
CHUNK = 1024
_STEPS = "array<struct<kind:int,p:int,m:int,ok:boolean>>"


def _steps(text: Column, kind: int, pattern: str, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of pattern: characters since the last match, of this one, and whether it counts (group 1 has ``least`` characters)."""
    between, match = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lens = F.zip_with(F.slice(between, F.lit(1), F.size(match)), match, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.length) if least else F.transform(match, lambda m: F.lit(0))
    found = F.zip_with(lens, value, lambda x, v: F.struct(F.lit(kind).alias("kind"), x["p"].alias("p"), x["m"].alias("m"), (v >= least).alias("ok")))
    may = F.lit(False)
    for part in HOLDS.get(KINDS[kind], ()):
        may = may | F.contains(text, F.lit(part))
    test = F.rlike(text, F.lit(pattern))
    return F.when(may & test if KINDS[kind] in HOLDS else test, found).otherwise(F.array().cast(_STEPS))


def matches(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """keep, and for each row: key (of a text that has matches, else null) and the steps of each kind."""
    text, patterns = text_of(docs), [ASSIGN, ACCESS, HEX, *WEAK.values()]
    found = docs.select(*keep, text.alias("_text"), *[_steps(text, k, p, ASSIGN_LEAST if k == 0 else 0).alias(n) for k, (n, p) in enumerate(zip(KINDS, patterns, strict=True))])
    return found.withColumn("key", F.when(sum((F.size(n) for n in KINDS), F.lit(0)) > 0, F.sha2("_text", 256))).drop("_text")


def _parts(rows: DataFrame) -> DataFrame:
    """rows of ``matches`` -> one row a span: key, kind, s, e.  Repeated texts count once."""
    one = rows.where("key IS NOT NULL").select("key", *KINDS).dropDuplicates(["key"])
    each = one.select("key", F.explode(F.array(*KINDS)).alias("x")).select("key", F.posexplode("x").alias("i", "x")).select("key", "i", "x.*")
    end = F.sum(F.col("p") + F.col("m")).over(Window.partitionBy("key", "kind").orderBy("i"))
    return written(each.withColumn("e", end).where("ok").select("key", "kind", (F.col("e") - F.col("m")).alias("s"), "e"), "parts")


def _reported(parts: DataFrame) -> DataFrame:
    """Spans (key, kind, s, e) -> the weak ones to report: not on a base span, and beside complementary parts."""
    base, so_far = F.col("kind") < 3, (Window.unboundedPreceding, 0)  # running frames: one step a row
    before = F.max(F.when(base, F.col("e"))).over(Window.partitionBy("key").orderBy("s").rangeBetween(*so_far))
    after = F.min(F.when(base, F.col("s"))).over(Window.partitionBy("key").orderBy(F.desc("s")).rangeBetween(*so_far))
    on_base = F.coalesce(F.col("_before") > F.col("s"), F.lit(False)) | F.coalesce(F.col("_after") < F.col("e"), F.lit(False))
    free = parts.withColumns({"_before": before, "_after": after}).where(base | ~on_base)
    # class 0 identifiers, 1 values, 2 endpoints
    of = F.element_at(F.array(*[F.lit(x) for x in (1, 0, 1, 0, 1, 2)]), F.col("kind") + 1)
    free = free.select("key", "kind", "s", "e", of.alias("class"), F.floor(F.col("s") / SCOPE).alias("bin"))
    edges = [f(F.when(F.col("class") == c, F.col("s"))).alias(f"{n}{c}") for c in range(3) for n, f in (("lo", F.min), ("hi", F.max))]
    bins = free.groupBy(F.col("key").alias("_k"), F.col("bin").alias("_b")).agg(*edges)
    weak = free.where(~base).withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    met = weak.join(bins, (F.col("key") == F.col("_k")) & (F.col("near") == F.col("_b")))
    # within a bin a class's starts lie between lo and hi: the nearer edge decides
    close = [F.coalesce((F.col(f"hi{c}") >= F.col("s") - SCOPE) & (F.col(f"lo{c}") <= F.col("s") + SCOPE), F.lit(False)) for c in range(3)]
    seen = met.groupBy("key", "kind", "s", "e", "class").agg(*[F.max(x).alias(f"has{c}") for c, x in enumerate(close)])
    linked = F.when(F.col("class") == 0, F.col("has1")).when(F.col("class") == 1, F.col("has0") | F.col("has2")).otherwise(F.col("has0") & F.col("has1"))
    return seen.where(linked).select("key", "kind", "s", "e")


def found_spans(rows: DataFrame) -> DataFrame:
    """rows of ``matches`` -> key, kind, s, e of every span, base or reported."""
    parts = _parts(rows)
    return parts.where("kind < 3").unionByName(_reported(parts))


def _told(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted structs."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row.  Texts are read once and not shuffled."""
    rows = written(matches(docs, ["doc_id"]), "matches")
    each = found_spans(rows).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e"))).alias("x"))
    base = F.filter("x", lambda x: x["kind"] < 3)
    told = written(each.select(F.col("key").alias("_key"), F.sha2(_told(base), 256).alias("_base"), _told(F.col("x")).alias("_spans"), (F.size("x") - F.size(base)).cast("long").alias("_linked")), "told")
    counts = [F.size(F.filter(n, lambda x: x["ok"])).cast("long").alias(f"n_{n}") for n in KINDS[:3]]
    got = lookup_join(rows.select("doc_id", "key", *counts), told, "key", "_key")
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.coalesce("_base", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("_spans", F.lit("")).alias("spans"), F.coalesce("_linked", F.lit(0).cast("long")).alias("n_linked"))


def _kept(text: Column, gaps: Column, mask: str) -> Column:
    """The text's pieces between spans, joined by the mask.  Pieces are cut from chunks, so that none is searched for from the text's start."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        first, last = F.element_at(chunks, i + 1), F.element_at(chunks, j + 1)
        at = (a - i * CHUNK + 1).cast("int")
        apart = F.concat(F.substring(first, at, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substring(last, F.lit(1), (b - j * CHUNK).cast("int")))
        return F.when(a >= b, "").when(i == j, F.substring(first, at, (b - a).cast("int"))).otherwise(apart)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    size = F.length(text).cast("long")
    # a one-element array, so that chunks and length are computed once a text
    held = F.array(F.struct(chunks.alias("c"), size.alias("n")))
    return F.transform(held, lambda h: F.array_join(F.transform(gaps, lambda g: piece(h["c"], g["a"], F.coalesce(g["b"], h["n"]))), mask))[0]


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span (base or reported) replaced by mask, overlapping ones by one; n_chars follows.  Same columns.

    Patterns are run once; texts are then read again and met with their cuts by the hash of the text.
    """
    cols = docs.columns
    spans = found_spans(written(matches(docs, []).where("key IS NOT NULL"), "matches"))
    before = F.max("e").over(Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_f", F.when(F.col("s") < before, 0).otherwise(1))
    island = F.sum("_f").over(Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    cuts = fresh.withColumn("_i", island).groupBy("key", "_i").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    each = cuts.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("x"))
    none = F.lit(None).cast("long")
    starts, ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("x", lambda x: x["e"])), F.concat(F.transform("x", lambda x: x["s"]), F.array(none))
    gaps = written(each.select("_key", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("_gaps")), "gaps")
    text = text_of(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_all"), F.sha2(text, 256).alias("key"))
    got = lookup_join(rows, gaps, "key", "_key")
    old, cut = F.col("_all.text").cast("string"), F.col("_gaps").isNotNull()
    got = got.withColumn("_clean", F.when(cut, _kept(old, F.col("_gaps"), mask)).otherwise(old))
    new = {"text": F.col("_clean")}
    if "n_chars" in cols:
        new["n_chars"] = F.when(cut, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_all.n_chars"))
    return got.select(*[(new[c] if c in new else F.col("_all")[c]).alias(c) for c in cols])
