"""Removal of long repeated byte strings, by column-wise construction of sorted suffixes over many documents.

Two lengths are looked for together: strings of LENGTH bytes, which are removed, and strings of PASSAGE bytes, from which
repeated passages of PASSAGE_WORDS words or more are reported (they stay in the text).

Every string of PASSAGE bytes has an anchor: its smallest KGRAM-byte hash, the leftmost of equal ones.  Equal strings
have equal anchors at equal places, so only strings around a common anchor need be compared, aligned at it.  The
consecutive strings of one anchor, with what follows them up to LENGTH, are a stretch; most stretches have no partner,
or only equal ones, and their hashes settle them.  The rest are compared column by column: each round inserts one symbol
of every stretch (from the right), keeps the stretches ordered by their suffixes (the collection's Burrows-Wheeler order
at that column) and updates the common prefix of neighbours from the last round's.  As strings can only meet at the same
column, an order a column is all that is kept of the transform; a task reads sorted shuffle files once, in sequence, and
holds one batch of anchors.  A string is repeated if its common prefix with a neighbour reaches its length.

An anchor with more than HOT different stretches is not gathered.  Its strings are split by where the anchor lies in
them, into SPLITS ranges, and by the symbols beside the anchor that all strings of a range have: equal strings agree on
both.  Only a group that is still too large (different stretches that share about seven eighths of a string) is settled
by counting the hashes of its strings.

Defined results: a null text is empty; texts shorter than PASSAGE lose nothing and have no passages; a very long text
is taken PIECE strings at a time; repeated rows count as so many documents, so their strings are repeated (and all of
them lose these); equal doc_ids with different texts are different documents; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import HOT_KEYS, HOT_ROWS, give_back, hot_keys, lookup_join, text_of, written

LENGTH, PASSAGE, PASSAGE_WORDS, KGRAM = 400, 300, 50, 32
#: Strings that can share an anchor, columns of an aligned stretch, stretches compared together, gathered at most, and ranges a hot anchor is split into.
REACH = PASSAGE - KGRAM + 1
COLUMNS, BATCH, HOT, SPLITS = REACH - 1 + LENGTH, 8192, 20_000, 8
#: Strings of a document taken at a time; a longer document's stretches are cut there.
PIECE = 1 << 20
_BITS = np.uint64(24)
_MASK = np.uint64((1 << 64) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & (1 << 64) - 1, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Hasher:
    """Hashes of all k-byte strings of a buffer, from running sums modulo 2**64."""

    def __init__(self, k: int, longest: int, seed: int = 11):
        self.k = k
        self.of_byte = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.down, self.up = _powers(pow(int(_STEP), -1, 1 << 64), longest + 1), _powers(int(_STEP), longest + 1)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.k + 1
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.down[: len(data)], out=run[1:])
        h = (run[self.k :] - run[: -self.k]) * self.up[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(27)
        return h


def anchors(h: np.ndarray) -> np.ndarray:
    """For each start of REACH hashes the place of the smallest (by its upper bits), the leftmost of equal ones."""
    n = len(h)
    keyed = (h >> _BITS << _BITS) | np.arange(n, dtype=np.uint64)
    table = np.full(-(-n // REACH) * REACH, _MASK)
    table[:n] = keyed
    table = table.reshape(-1, REACH)
    before = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - REACH + 1
    return (np.minimum(behind[:m], before[REACH - 1 : REACH - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def stretches(raw: bytes, hasher: Hasher) -> Iterator[tuple[int, ...]]:
    """anchor hash, content hash, start, strings, anchor's offset, bytes, end (exclusive, of the last string of PASSAGE bytes), times; stretches that repeat at once are one."""
    for a in range(0, len(raw) - PASSAGE + 1, PIECE):
        h = hasher(np.frombuffer(raw[a : a + PIECE + PASSAGE - 1], np.uint8))
        at = anchors(h)
        cut = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1, [len(at)]])
        anchor = h[at[cut[:-1]]].view(np.int64).tolist()
        off = (at[cut[:-1]] - cut[:-1]).tolist()
        cut = cut.tolist()
        last: dict[tuple[int, int], list] = {}
        for k, (p, q) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            held = raw[a + p : a + q - 1 + LENGTH]
            content = int.from_bytes(hashlib.blake2b(held, digest_size=8, salt=off[k].to_bytes(4, "little")).digest(), "little", signed=True)
            row = last.get((anchor[k], content))
            if row and a + p <= row[6]:
                row[6], row[7] = a + q - 1 + PASSAGE, row[7] + 1
            else:
                if row:
                    yield tuple(row)
                last[anchor[k], content] = [anchor[k], content, a + p, q - p, off[k], len(held), a + q - 1 + PASSAGE, 1]
        yield from map(tuple, last.values())


_FOUND_SQL = "doc long, uid long, anchor long, content long, start long, strings int, off int, size int, stop long, times long"


def _shape(sql: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in map(str.split, sql.split(", "))])


_FOUND = _shape(_FOUND_SQL)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(KGRAM, PIECE + PASSAGE)
    for batch in batches:
        rows: list[tuple] = []
        for doc, uid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(doc, uid, *s) for s in stretches(text.encode(), hasher)]
            if len(rows) > 50_000:
                yield _batch(rows, _FOUND)
                rows = []
        yield _batch(rows, _FOUND)
    give_back()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema.types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


#: group: the anchor, or a part of it; at: the place in the stretch of its first string here.
_STRETCH_SQL = "group long, anchor long, content long, at int, off int, strings int, bytes binary"
_STRETCH = _shape(_STRETCH_SQL)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted stretches) -> the stretches' bytes.  A stretch that repeated rows ask for again is sent once a task."""
    sent: set[tuple[int, int]] = set()
    for batch in batches:
        rows = []
        for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for w in wanted:
                if (key := (w["anchor"], w["content"])) not in sent:
                    sent.add(key)
                    rows.append((w["anchor"], *key, 0, w["off"], w["strings"], raw[w["start"] : w["start"] + w["size"]]))
        if len(sent) > 500_000:
            sent.clear()
        yield _batch(rows, _STRETCH)
    give_back()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of hot anchors -> parts by the range that the anchor's offset lies in, grouped by the symbols that all strings of a range share."""
    width = -(-REACH // SPLITS)
    for batch in batches:
        rows = []
        for _, anchor, content, at, off, strings, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for low in range(0, REACH, width):  # string k has the anchor at off - k
                first, last = max(off - low - width + 1, 0), min(off - low, strings - 1)
                if first <= last:
                    shared = raw[max(off - low, 0) : off - low - width + 1 + PASSAGE]
                    group = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=low.to_bytes(4, "little")).digest(), "little", signed=True)
                    rows.append((group, anchor, content, at + first, off - first, last - first + 1, raw[first : last + LENGTH]))
        yield _batch(rows, _STRETCH)
    give_back()


def aligned_repeats(groups: np.ndarray, rows: list[bytes], offs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of each row equal a string of another row of its group at the same column, of PASSAGE and of LENGTH bytes: rows by REACH columns.

    groups is sorted.  Column REACH - 1 is where the anchor begins.
    """
    n = len(rows)
    cells = np.full((n, COLUMNS), 256, np.uint16)  # 256: no byte here, equal to nothing
    for k, (row, off) in enumerate(zip(rows, offs, strict=True)):
        cells[k, REACH - 1 - off : REACH - 1 - off + len(row)] = np.frombuffer(row, np.uint8)
    cells = np.ascontiguousarray(cells.T)
    base = np.cumsum(np.concatenate([[0], np.diff(groups) != 0])).astype(np.int64) * 512
    order, until = np.arange(n), np.full(n + 1, COLUMNS)  # until[k]: where row order[k] parts from the row before it
    same_group = np.diff(base, prepend=-512) == 0
    until[:n][~same_group] = 0
    hit, wide = np.zeros((REACH, n), bool), np.zeros((REACH, n), bool)
    for j in range(COLUMNS - 1, -1, -1):
        symbol = cells[j][order]
        key = base + symbol
        to = np.argsort(key, kind="stable")
        symbol = symbol[to]
        k = np.nonzero((key[to][1:] == key[to][:-1]) & (symbol[1:] < 256))[0] + 1
        new = np.full(n + 1, j)
        a, b = to[k - 1], to[k]
        next_ = b == a + 1
        new[k[next_]] = until[b[next_]]
        if not next_.all():  # rows that were apart part where the first of those between them did
            far = ~next_
            new[k[far]] = np.minimum.reduceat(until, np.stack([a[far] + 1, b[far] + 1], axis=1).ravel())[::2]
        order, until = order[to], new
        if j < REACH:
            for flags, length in ((hit, PASSAGE), (wide, LENGTH)):
                k = np.nonzero(until[:n] >= j + length)[0]
                flags[j, order[k]] = True
                flags[j, order[k - 1]] = True
    return hit.T, wide.T


_RUNS_SQL = "anchor long, content long, first int, last int, wide boolean"
_RUNS = _shape(_RUNS_SQL)


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    yield from zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist(), strict=True)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by group -> runs of repeated strings (first, last, from the stretch's start).  Holds whole groups, BATCH rows and the last group's at a time."""

    def runs(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        both = aligned_repeats(np.array([r[0] for r in rows]), [r[6] for r in rows], [r[4] for r in rows])
        for wide, hits in enumerate(both):
            for (_, anchor, content, at, off, strings, _), hit in zip(rows, hits, strict=True):
                left = REACH - 1 - off
                out += [(anchor, content, at + a, at + b, bool(wide)) for a, b in _runs(hit[left : left + strings])]
        return _batch(out, _RUNS)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:4] == held[-1][:4]:
                continue  # the same stretch sent by another task
            if len(held) >= BATCH and row[0] != held[-1][0]:
                yield runs(held)
                held = []
            held.append(row)
    if held:
        yield runs(held)


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of hot groups -> a row for each string: its place in the stretch and hash."""
    shape = _shape("group long, anchor long, content long, at int, wide boolean, hash binary")
    for batch in batches:
        for group, anchor, content, at, _, strings, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = [(k, n) for n in (PASSAGE, LENGTH) for k in range(strings) if k + n <= len(raw)]
            yield _batch([(group, anchor, content, at + k, n == LENGTH, hashlib.blake2b(raw[k : k + n], digest_size=16).digest()) for k, n in ends], shape)


def _hot_runs(hot: DataFrame) -> DataFrame:
    each = hot.dropDuplicates(["group", "anchor", "content", "at"]).mapInArrow(_string_hashes, "group long, anchor long, content long, at int, wide boolean, hash binary")
    each = written(each.withColumn("id", F.struct("group", "wide", "hash")), "strings")
    often = each.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = lookup_join(each, written(often, "often"), "id", "_id", "inner")
    return met.select("anchor", "content", F.col("at").alias("first"), F.col("at").alias("last"), "wide")


def _large(groups: DataFrame) -> DataFrame:
    """The groups of more than HOT different stretches.  They are few: each stands for so many rows."""
    return written(groups.groupBy(F.col("group").alias("_hot")).agg(F.count(F.lit(1)).alias("_k")).where(f"_k > {HOT}").select("_hot"), "hot")


def _compared(asked: DataFrame, hot: DataFrame) -> DataFrame:
    """Stretches -> runs: hot anchors split first, what stays hot counted."""

    def parted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        on = F.col("group") == F.col("_hot")
        return rows.join(keys, on, "left_anti"), rows.join(keys, on, "left_semi")

    def column_wise(rows: DataFrame) -> DataFrame:
        return rows.repartition("group").sortWithinPartitions("group", "anchor", "content", "at").mapInArrow(_compare, _RUNS_SQL)

    if hot.isEmpty():
        return column_wise(asked)
    few, many = parted(written(asked, "asked"), hot)
    parts = written(many.dropDuplicates(["anchor", "content"]).mapInArrow(_split, _STRETCH_SQL), "parts")
    still = _large(parts)
    if still.isEmpty():
        return column_wise(few).union(column_wise(parts))
    cool, counted = parted(parts, still)
    return column_wise(few).union(column_wise(cool)).union(_hot_runs(counted))


def _hot_of(table: DataFrame, key: str, n: str) -> DataFrame:
    return table.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n)).limit(HOT_KEYS).select(F.col(key).alias("hot"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents -> (rows: doc_id, id, text; spans: _id and an array of intervals s, e, wide (of LENGTH, else of PASSAGE); hot ids)."""
    text = text_of(docs)
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc"), F.xxhash64("doc_id", text).alias("uid"))
    rows = docs.select("doc_id", key.alias("id"), text.alias("text"))
    long_ = rows.where(F.octet_length("text") >= PASSAGE)
    found = written(long_.select("id.doc", "id.uid", "text").mapInArrow(_find, _FOUND_SQL), "stretches")
    per = found.groupBy(F.col("anchor").alias("_anchor")).agg(F.sum("times").alias("_n"), (F.min("content") != F.max("content")).alias("mixed")).where("_n > 1")
    per = written(per, "anchors")
    shared = lookup_join(found, per, "anchor", "_anchor", "inner", _hot_of(per, "_anchor", "_n")).drop("_n")
    shared = written(shared.withColumn("kind", F.xxhash64("anchor", "content")), "shared")
    # a stretch that occurs again is repeated as a whole, wherever it occurs; its last string of LENGTH bytes ends where it ends
    all_of = F.array(F.struct(F.col("start").alias("s"), F.col("stop").alias("e"), F.lit(False).alias("wide")), F.when(F.col("size") >= LENGTH, F.struct(F.col("start").alias("s"), (F.col("stop") - F.col("strings") + 1 - PASSAGE + F.col("size")).alias("e"), F.lit(True).alias("wide"))))
    whole = shared.where("not mixed").select("doc", "uid", all_of.alias("x"))
    mixed = shared.where("mixed")
    kinds = mixed.groupBy("kind", "anchor", "content").agg(F.sum("times").alias("n"), F.min(F.struct("doc", "uid", "start", "strings", "off", "size")).alias("one"))
    kinds = written(kinds.select("kind", "anchor", "content", "n", "one.*"), "kinds")
    hot_ids = hot_keys(rows, "id")
    wanted = kinds.groupBy(F.struct("doc", "uid").alias("_id")).agg(F.collect_list(F.struct("anchor", "content", "start", "strings", "off", "size")).alias("wanted"))
    asked = lookup_join(long_, wanted, "id", "_id", "inner", hot_ids).select("text", "wanted").mapInArrow(_fetch, _STRETCH_SQL)
    runs = _compared(asked, _large(kinds.select(F.col("anchor").alias("group"))))
    runs = runs.groupBy(F.xxhash64("anchor", "content").alias("_kind")).agg(F.collect_set(F.struct("first", "last", "wide")).alias("runs"))
    none = F.array().cast("array<struct<first:int,last:int,wide:boolean>>")
    verdict = kinds.join(runs, F.col("kind") == F.col("_kind"), "left").where("n > 1 or runs is not null")
    verdict = written(verdict.select(F.col("kind").alias("_kind"), "n", F.coalesce("runs", none).alias("runs")), "verdicts")
    met = lookup_join(mixed, verdict, "kind", "_kind", "inner", _hot_of(verdict, "_kind", "n"))
    part = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("s"), (F.col("start") + r["last"] + F.when(r["wide"], LENGTH).otherwise(PASSAGE)).alias("e"), r["wide"].alias("wide")))
    some = met.select("doc", "uid", F.when(F.col("n") > 1, all_of).otherwise(part).alias("x"))
    # repeated rows have the same intervals: as a set they are one document's, however many rows there are
    each = whole.union(some).select("doc", "uid", F.explode("x").alias("x")).where("x is not null")
    spans = written(each.groupBy(F.struct("doc", "uid").alias("_id")).agg(F.collect_set("x").alias("spans")), "spans")
    return rows, spans, hot_ids


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _whole_words(raw: bytes, s: int, e: int) -> int:
    """Words that lie in [s, e) from end to end."""
    inside = raw[s:e]
    n = len(inside.split())
    cut_first = s > 0 and not raw[s - 1 : s].isspace() and not inside[:1].isspace()
    cut_last = e < len(raw) and not raw[e : e + 1].isspace() and not inside[-1:].isspace()
    return max(n - cut_first - cut_last, 0)


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages for each row; with_text also ``kept``, the bytes that remain.

    n_passages counts the repeated runs (of PASSAGE bytes at least) that hold PASSAGE_WORDS whole words or more.
    """
    sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_text
    shape = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), *([("kept", pa.binary())] if with_text else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, gone = text.encode(), _merged([x for x in spans or () if x["wide"]])
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                passages = sum(_whole_words(raw, s, e) >= PASSAGE_WORDS for s, e in _merged([x for x in spans or () if not x["wide"]]))
                out.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), passages, *([kept] if with_text else [])))
            yield _batch(out, shape)

    rows, spans, hot = repeated_spans(docs)
    met = lookup_join(rows, spans, "id", "_id", "left", hot)
    return met.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(cut, sql)
