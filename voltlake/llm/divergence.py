"""Source divergence audit: how far the sources of a language differ, and by which terms.

Two passes over the texts.  The first counts each term's documents exactly and keeps a language's terms of ``MIN_DOCS``
documents and more.  The second recounts occurrences with Aho-Corasick automata of the kept terms, each key padded with
its delimiters: a text is one line of words with one space before, between and behind them, so a key ends where a word
does and neighbouring matches share a space.  The most frequent terms, as many as the bounds ``HEAD_TERMS`` and
``HEAD_BYTES`` allow, make the automaton that every worker holds.  Words outside it are dealt, as lines again, to blocks
of the remaining kept terms, each block with an automaton of its own; the lines stream past it.

Pairs come from sparse postings (a term's groups that have it).  A group without the term has the same p for all such
terms, so a pair's sum over all kept terms is: each side's terms against the other's p of absence (from a histogram of
p a group), a correction for terms of both sides (from the postings), and the rest times one number.

Defined results: null text, lang and source are ''; a group without terms has count 0 everywhere; where a language keeps
no term its pairs have the value 0; equal values are ranked by the item's UTF-8 bytes; repeated rows count each; a very
long text is one row; an empty table gives an empty result; other columns are not read.  All arithmetic is on integers.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import give_back, lookup_join, text_of, with_index, written

#: Documents of its language that a kept term is in, and ranks that the part ``term`` gives.
MIN_DOCS, TOP = 3, 200
#: Terms, and bytes of them, in the automaton that every worker holds; terms of a block of the others.
HEAD_TERMS, HEAD_BYTES, BLOCK_TERMS = 20_000, 4 << 20, 20_000
#: Counts that a task gathers before it passes them on, and pairs it works on at once.
HELD, PAIRS = 600_000, 1_000_000
#: Rows of an Arrow batch that goes back to Spark.
SENT = 65_536
SCALE = 1_000_000_000
#: Bytes to bytes: letters and all above ASCII stay, capitals are lowered, the others part terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long"
SCANNED = f"{COUNTS}, block int, line string"
MET = "a long, b long, value long, n long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text_of(docs).cast("binary").alias("text"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")))


def _batch(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _counted(schema: pa.Schema, counts: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
    """Rows of the counts by (lang, source), column by column; clears them.  Columns of the schema beyond those of COUNTS are null."""
    keys = [(*g, len(c)) for g, c in counts.items() if c]
    if not keys:
        return
    each = np.repeat(np.arange(len(keys)), [k[2] for k in keys])
    terms = pa.array(t for c in counts.values() for t in c)
    terms = terms if terms.type == pa.string() else terms.cast(pa.string())
    columns = [*(pa.array([k[x] for k in keys], pa.string()).take(pa.array(each)) for x in (0, 1)), terms, pa.array((n for c in counts.values() for n in c.values()), pa.int64())]
    counts.clear()
    columns += [pa.nulls(len(each), f.type) for f in list(schema)[4:]]
    whole = pa.RecordBatch.from_arrays(columns, schema=schema)
    for at in range(0, len(each), SENT):
        yield whole.slice(at, SENT)


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


_COUNTS = _schema(("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()))
_SCANNED = _schema(*((f.name, f.type) for f in _COUNTS), ("block", pa.int32()), ("line", pa.string()))
_MET = _schema(*((c, pa.int64()) for c in ("a", "b", "value", "n")))


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents a term (source null), and each group once a task (term null)."""
    groups: set[tuple] = set()
    docs: dict[tuple, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, source, text in _rows(batch):
            groups.add((lang, source))
            docs[lang, None].update(set(terms_of(text)))
        if sum(map(len, docs.values())) > HELD:
            yield from _counted(_COUNTS, docs)
    yield from _counted(_COUNTS, docs)
    if groups:
        yield _batch(_COUNTS, [g[0] for g in groups], [g[1] for g in groups], [None] * len(groups), [0] * len(groups))
    give_back()


_FOUND = itemgetter(1)


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(f" {t} ", t)
    a.make_automaton()
    return a


def _add_matches(counts: Counter, a: ahocorasick.Automaton, words: list[bytes]) -> None:
    counts.update(map(_FOUND, a.iter(f" {b' '.join(words).decode('utf-8', 'replace')} ")))


_automata: dict[int, dict[str, tuple]] = {}


def _scan(head: Broadcast, blocks: int):
    """Occurrences of the head's terms; the other words as lines, one a batch, group and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if head.value["id"] not in _automata:  # workers are used again: one automaton a language and vocabulary
            _automata.clear()
            _automata[head.value["id"]] = {lang: (automaton(terms), {t.encode() for t in terms}) for lang, terms in head.value["terms"].items()}
        known = _automata[head.value["id"]]
        counts: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            rest: dict[tuple, list] = defaultdict(list)
            for lang, source, text in _rows(batch):
                words = terms_of(text)
                a, inside = known.get(lang, (None, frozenset()))
                if a is not None:
                    _add_matches(counts[lang, source], a, words)
                if blocks:
                    for w in [w for w in words if w not in inside]:
                        rest[lang, source, zlib.crc32(w) % blocks].append(w)
            if rest:
                keys = list(rest)
                none = [None] * len(keys)
                yield _batch(_SCANNED, [k[0] for k in keys], [k[1] for k in keys], none, none, [k[2] for k in keys], [b" ".join(rest[k]).decode("utf-8", "replace") for k in keys])
            if sum(map(len, counts.values())) > HELD:
                yield from _counted(_SCANNED, counts)
        yield from _counted(_SCANNED, counts)
        give_back()

    return run


def _scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, a block's terms (source null) before its lines: occurrences of the block's terms."""
    at, terms, automata = None, defaultdict(list), {}
    counts: dict[tuple, Counter] = defaultdict(Counter)
    for batch in batches:
        for block, lang, source, line in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "source", "line"))):
            if block != at:
                at, terms, automata = block, defaultdict(list), {}
            if source is None:
                terms[lang].append(line)
            elif lang in terms:
                if lang not in automata:
                    automata[lang] = automaton(terms[lang])
                _add_matches(counts[lang, source], automata[lang], [line.encode()])
        if sum(map(len, counts.values())) > HELD:
            yield from _counted(_COUNTS, counts)
    yield from _counted(_COUNTS, counts)
    give_back()


def occurrences(docs: DataFrame, min_docs: int = MIN_DOCS, head_terms: int = HEAD_TERMS, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents -> all groups (lang, source), kept terms (lang, term) and counts above 0 (lang, source, term, n)."""
    texts = _texts(docs)
    found = texts.mapInArrow(_document_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    found = written(found.where(F.col("term").isNull() | (F.col("n") >= min_docs)), "terms")
    groups, kept = found.where("term is null").select("lang", "source"), found.where("term is not null")
    # bit lengths of the document counts, largest first: a few dozen rows, whatever the vocabulary
    kept = kept.withColumn("bits", F.length(F.bin("n")))
    sizes = sorted(kept.groupBy("bits").agg(F.count(F.lit(1)), F.sum(F.octet_length("term") + F.octet_length("lang") + 2)).collect(), reverse=True)
    cut, n, size = 65, 0, 0
    for bits, more, more_bytes in sizes:
        if n + more > head_terms or size + more_bytes > HEAD_BYTES:
            break
        cut, n, size = bits, n + more, size + more_bytes
    left = sum(more for bits, more, _ in sizes if bits < cut)
    blocks = -(-left // block_terms)
    head: dict[str, list] = defaultdict(list)
    for lang, term in kept.where(F.col("bits") >= cut).select("lang", "term").toLocalIterator() if n else ():  # HEAD_TERMS rows at most
        head[lang].append(term)
    held = docs.sparkSession.sparkContext.broadcast({"id": str(found.inputFiles()[:1]), "terms": dict(head)})
    counts = texts.mapInArrow(_scan(held, blocks), SCANNED)
    if blocks:
        counts = written(counts, "scanned")
        lines = counts.where("block is not null").select("block", "lang", "source", "line")
        terms = kept.where(F.col("bits") < cut).select((F.crc32("term") % blocks).cast("int").alias("block"), "lang", F.lit(None).cast("string").alias("source"), F.col("term").alias("line"))
        dealt = terms.unionByName(lines).repartition(blocks, "block").sortWithinPartitions("block", F.col("source").isNotNull())
        counts = counts.where("block is null").select("lang", "source", "term", "n").unionByName(dealt.mapInArrow(_scan_blocks, COUNTS))
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return groups, kept.select("lang", "term"), written(counts, "counts")


def _p(n: str, total: str) -> F.Column:
    """1 + floor(SCALE (n + 1) / total): in longs, and where the product needs more digits in decimals."""
    return F.expr(f"1 + CASE WHEN {n} < 9000000000 THEN ((cast({n} as long) + 1) * {SCALE}) div {total} ELSE ((cast({n} as decimal(20, 0)) + 1) * {SCALE}) div cast({total} as decimal(20, 0)) END")


def _f(p: F.Column, q: F.Column) -> F.Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two groups that share terms: how many, and what the sums over each side's terms miss of them."""
    for batch in batches:
        groups = batch.column("groups")
        k = np.diff(groups.offsets.to_numpy())
        flat = groups.flatten()
        gid, p, absent = (flat.field(c).to_numpy() for c in ("gid", "p", "absent"))
        first = np.repeat(np.cumsum(k) - k, k)
        width = np.repeat(k, k).astype(np.int64)
        ends = np.cumsum(width)
        at = 0
        while at < len(gid):
            upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
            w = width[at:upto]
            a = np.repeat(np.arange(at, upto), w)
            b = np.repeat(first[at:upto], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
            a, b = a[a != b], b[a != b]
            if len(a):
                f = lambda x, y: (x - y) ** 2 // y
                value = f(p[a], p[b]) - f(p[a], absent[b]) - f(absent[a], p[b])
                order = np.lexsort((gid[b], gid[a]))
                ga, gb = gid[a][order], gid[b][order]
                new = np.flatnonzero(np.r_[True, (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])])
                sums, n = np.add.reduceat(value[order], new), np.diff(np.r_[new, len(ga)])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ga[new], gb[new], sums, n)], schema=_MET)
            at = upto
    give_back()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, head_terms: int = HEAD_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """documents -> lang, source, part (pair, term), item, value, rank.

    The result has a row for each two sources of a language, as asked; beside that, work follows the postings.
    """
    groups, kept, counts = occurrences(docs, min_docs, head_terms, block_terms)
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total"])
    groups = groups.withColumn("size", F.col("total") + F.col("v")).withColumn("absent", F.when(F.col("v") > 0, _p("0", "size")))
    groups = written(with_index(groups, "lang", "source").withColumnRenamed("_index", "gid"), "groups")
    languages = written(groups.groupBy("lang").agg((F.sum("total") + F.max("v")).alias("lang_size")), "languages")
    key = F.struct("lang", "source").alias("key")
    counted = lookup_join(counts.select(key, "term", "n"), groups.select(key.alias("group_key"), "gid", "size", "absent"), "key", "group_key")
    counted = counted.select(F.col("key.lang").alias("lang"), "term", "n", "gid", _p("n", "size").alias("p"), "absent")
    postings = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("gid", "p", "absent")).alias("groups"))
    postings = lookup_join(postings, languages.withColumnRenamed("lang", "of_lang"), "lang", "of_lang")
    postings = written(postings.select("term", _p("n", "lang_size").alias("q"), "groups"), "postings")
    return _pairs(groups, postings).unionByName(_terms(groups, postings, top))


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    met = postings.select("groups").mapInArrow(_meetings, MET).groupBy("a", "b").agg(F.sum("value").alias("met_value"), F.sum("n").alias("met"))
    seen = postings.select(F.explode("groups").alias("g")).groupBy("g.gid", "g.p").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("gid").agg(F.collect_list(F.struct("p", "n")).alias("seen"), F.sum("n").alias("terms"))
    side = groups.join(seen, "gid", "left").fillna(0, ["terms"])
    a = side.select("lang", F.col("gid").alias("a"), "source", "v", F.col("absent").alias("absent_a"), F.col("seen").alias("seen_a"), F.col("terms").alias("terms_a"))
    b = side.select("lang", F.col("gid").alias("b"), F.col("source").alias("item"), F.col("absent").alias("absent_b"), F.col("seen").alias("seen_b"), F.col("terms").alias("terms_b"))
    both = a.join(b, "lang").where("a != b").join(met, ["a", "b"], "left").fillna(0, ["met", "met_value"])  # the rows of the result
    zero = F.lit(0).cast("long")
    of_a = F.coalesce(F.aggregate("seen_a", zero, lambda s, x: s + x["n"] * _f(x["p"], F.col("absent_b"))), zero)
    of_b = F.coalesce(F.aggregate("seen_b", zero, lambda s, x: s + x["n"] * _f(F.col("absent_a"), x["p"])), zero)
    neither = (F.col("v") - F.col("terms_a") - F.col("terms_b") + F.col("met")) * _f(F.col("absent_a"), F.col("absent_b"))
    value = F.when(F.col("v") > 0, of_a + of_b + F.col("met_value") + neither).otherwise(zero)
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(groups: DataFrame, postings: DataFrame, top: int) -> DataFrame:
    over = postings.select("term", "q", F.explode("groups").alias("g")).where("g.p > q")
    over = over.select(F.col("g.gid").alias("gid"), F.col("term").alias("item"), _f(F.col("g.p"), F.col("q")).alias("value"))
    # ranks up to a bound: Spark keeps each task's best of a group before it shuffles
    best = over.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    named = lookup_join(best, groups.select(F.col("gid").alias("of_gid"), "lang", "source"), "gid", "of_gid")
    return named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


#: The same in SQL, over all kept terms of every group.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
k AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
gp AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ((coalesce(c.n, 0) + 1)::HUGEINT * 1000000000) // (coalesce(t.total, 0) + v.v)::HUGEINT AS p
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
lp AS (SELECT lang, term, 1 + ((sum(n) + 1)::HUGEINT * 1000000000) // (any_value(s.total) + any_value(v.v))::HUGEINT AS q
    FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) s USING (lang) GROUP BY lang, term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM gp a JOIN gp b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
