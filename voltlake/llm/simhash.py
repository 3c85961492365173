"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has 64 bits, so two that differ in at most 3 agree on 3 of 6 blocks at least: 20 tables of block
triples hold every linked pair in a common bucket.  Only different fingerprints enter.  Buckets of one row are left
out; the rest are stored as vertical bit planes, a block of rows at a time, and the distances of a block's rows are
counted together in carry-save bitwise counters.  A row is dropped from a block once all its lanes exceed the radius.
A bucket sends each linked row's smallest partner only, so its output is linear; components are found by
alternating star contraction, each round written to the shared folder.

A bucket of more than HOT rows is dealt again by quarters of its other 32 bits (two linked rows agree on one of the
four), so no bucket need fit one task before that.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; a very
long text is one row, hashed in slices; of
repeated rows each gets the same component; null doc_ids count for no component's smallest id (null if it has no
other); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType

from voltlake.llm import common
from voltlake.llm.common import drop_written, give_back, lookup_join, text_of, written

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Widths of the six blocks from the lowest bit; rows of a bit-sliced block; rows from which a bucket is dealt again.
WIDTHS, BLOCK, HOT = (11, 11, 11, 11, 10, 10), 1024, 8192
_FULL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def fingerprint(text: str) -> int:
    """The unsigned fingerprint: bit b is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at the six ASCII white-space characters
    n = len(words)
    if not n:
        return 0
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, n)
    h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def text_fingerprint(texts: pd.Series) -> pd.Series:
    found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
    give_back()
    return pd.Series(found)


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """64 planes by words of 64 rows: bit r of word w of plane b is bit b of row 64 w + r."""
    padded = np.zeros(-(-len(rows) // 64) * 64, np.uint64)
    padded[: len(rows)] = rows
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_radius(queries: np.ndarray, planes: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) of all lanes within RADIUS of a query.  A query with no more than ``alone`` lanes left is dropped early."""
    lanes = planes.shape[1]
    live, one, two, over = np.arange(len(queries)), *(np.zeros((len(queries), lanes), np.uint64) for _ in range(3))
    for b in range(64):
        differ = planes[b][None, :] ^ np.where(queries[live] >> np.uint64(b) & np.uint64(1), _FULL, np.uint64(0))[:, None]
        carry = one & differ  # one + two * 2 counts to 3; a fourth difference sets over
        one ^= differ
        over |= two & carry
        two ^= carry
        if b % 8 == 7:
            left = np.bitwise_count(~over).sum(axis=1) > alone
            if not left.all():
                live, one, two, over = live[left], one[left], two[left], over[left]
            if not len(live):
                break
    near = np.unpackbits((~over).view(np.uint8).reshape(len(live), -1), axis=1, bitorder="little") if len(live) else np.zeros((0, 0), np.uint8)
    q, lane = np.nonzero(near)
    return live[q], lane


def lower_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same bucket; bucket is sorted.  Each block is compared with itself and, within a bucket, with later ones."""
    found_a, found_b = [], []
    blocks = [(k, min(k + BLOCK, len(rows))) for k in range(0, len(rows), BLOCK)]
    planes = [bit_planes(rows[a:b]) for a, b in blocks]
    for i, (a, b) in enumerate(blocks):
        for j in range(i, len(blocks)):
            c, d = blocks[j]
            if j > i and bucket[c] != bucket[b - 1]:
                break
            q, lane = within_radius(rows[a:b], planes[j], int(i == j))
            ok = lane < d - c
            x, y = a + q[ok], c + lane[ok]
            ok = (x < y) & (bucket[x] == bucket[y])
            found_a.append(x[ok])
            found_b.append(y[ok])
    return np.concatenate(found_a), np.concatenate(found_b)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, fp) sorted by bucket -> (fp, its smallest partner).  Holds the rows of one bucket, or of one batch, at a time."""
    names = ["fp", "to"]

    def links(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        a, b = _linked(bucket, rows)
        label = lower_labels(len(rows), a, b)
        at = np.nonzero(label != np.arange(len(rows)))[0]
        return pa.RecordBatch.from_arrays([pa.array(rows[at].view(np.int64)), pa.array(rows[label[at]].view(np.int64))], names=names)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        bucket, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(bucket):
            continue
        cut = int(np.searchsorted(bucket == bucket[-1], True))  # rows before the last bucket, which may go on
        if held and (cut or held[-1][0][-1] != bucket[0]):
            first = int((bucket == held[-1][0][-1]).sum()) if held[-1][0][-1] == bucket[0] else 0
            held.append((bucket[:first], rows[:first]))
            yield links(*map(np.concatenate, zip(*held, strict=True)))
            held, bucket, rows = [], bucket[first:], rows[first:]
            cut = max(cut - first, 0)
        if cut:
            yield links(bucket[:cut], rows[:cut])
        held.append((bucket[cut:], rows[cut:]))
    if held:
        yield links(*map(np.concatenate, zip(*held, strict=True)))


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _table_keys(fp: Column) -> list[Column]:
    """The 20 bucket numbers of a fingerprint: its table above the bits of that table's three blocks."""
    at = np.cumsum([0, *WIDTHS]).tolist()
    keys = []
    for t, blocks in enumerate(combinations(range(6), 3)):
        key = F.lit(t).cast("long")
        for i in blocks:
            key = F.shiftleft(key, WIDTHS[i]) + _bits(fp, at[i], WIDTHS[i])
        keys.append(key)
    return keys


def _split_keys(fp: Column, bucket: Column) -> Column:
    """Numbers of the four sub-buckets by a quarter of the bits that the bucket's table leaves out; else fp's bucket itself."""
    at, cases = np.cumsum([0, *WIDTHS]).tolist(), F.lit(None)
    for t, blocks in enumerate(combinations(range(6), 3)):
        bits = [at[i] + k for i in range(6) if i not in blocks for k in range(WIDTHS[i])]
        quarters = []
        for q in range(4):
            value = F.lit(q).cast("long")
            for b in bits[q * len(bits) // 4 : (q + 1) * len(bits) // 4]:
                value = F.shiftleft(value, 1) + _bits(fp, b, 1)
            quarters.append(F.xxhash64(bucket, value))
        cases = F.when(F.col("_table") == t, F.array(*quarters)).otherwise(cases) if t else F.when(F.col("_table") == t, F.array(*quarters))
    return cases


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Different fingerprints (fp) -> links (fp, to) that connect all of them within RADIUS."""
    rows = fps.select("fp", F.posexplode(F.array(*_table_keys(F.col("fp")))).alias("_table", "bucket"))
    hot = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {HOT}").select(F.col("bucket").alias("_hot")), "hot")
    if not hot.isEmpty():
        marked = lookup_join(rows, hot.withColumn("_is", F.lit(True)), "bucket", "_hot")
        split = F.when(F.col("_is"), _split_keys(F.col("fp"), F.col("bucket"))).otherwise(F.array("bucket"))
        rows = marked.select("fp", F.explode(split).alias("bucket"))
    shared = rows.select("bucket", "fp", F.count(F.lit(1)).over(Window.partitionBy("bucket")).alias("_n")).where("_n > 1")
    return shared.select("bucket", "fp").mapInArrow(_bucket_links, "fp long, to long").distinct()


def star_components(links: DataFrame) -> DataFrame:
    """links (fp, to) -> (fp, root) for every linked fingerprint but the roots, by large-star and small-star in turn."""
    edges, before = written(links.where("fp <> to"), "links"), None

    def lowest(rows: DataFrame, low: Column) -> DataFrame:
        """rows (u, v) with m, the lowest of each u; a hub of many links is dealt over tasks."""
        m = rows.groupBy(F.col("u").alias("_u")).agg(low.alias("m"), F.count(F.lit(1)).alias("_n"))
        if (m.agg(F.max("_n")).first()[0] or 0) <= common.HOT_ROWS:
            return rows.join(m, F.col("u") == F.col("_u")).drop("_u", "_n")
        return lookup_join(rows, written(m.drop("_n"), "lowest"), "u", "_u", "inner")

    while True:
        both = edges.select(F.col("fp").alias("u"), F.col("to").alias("v")).union(edges.select(F.col("to").alias("u"), F.col("fp").alias("v")))
        large = lowest(both, F.least(F.min("v"), F.first("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = lowest(down, F.min("v"))
        old, edges = edges, written(joined.select(F.explode(F.array(F.struct(F.col("v").alias("fp"), F.col("m").alias("to")), F.struct(F.col("u").alias("fp"), F.col("m").alias("to")))).alias("x")).select("x.*").where("fp <> to").distinct(), "links")
        drop_written(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("fp", "to").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select("fp", F.col("to").alias("root"))
        before = now


def components(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp) -> one row a fingerprint: _fp, _root (its component's smallest fingerprint), component_id."""
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    roots = star_components(fingerprint_links(fps)).withColumnRenamed("fp", "_linked")
    rooted = lookup_join(fps, roots, "fp", "_linked").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "roots")
    ids = written(rooted.groupBy(F.col("root").alias("_of")).agg(F.min("low").alias("component_id")), "ids")
    return lookup_join(rooted, ids, "root", "_of", "inner").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, fingerprint (hex), component_id for each row.  Texts are read once and not shuffled."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_fingerprint(text_of(docs)).alias("fp")), "fingerprints")
    got = lookup_join(rows, written(components(rows), "components"), "fp", "_fp")
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, same columns: the one of the smallest doc_id (of several rows of it, the smallest text hash, once).

    Keepers are found on narrow rows; texts are read again and met with the keepers' keys.  As keepers are as many as
    documents, these aren't broadcast at any size: documents are shuffled once, and the rows of a very common one are dealt.
    """
    text = text_of(docs)
    key = F.xxhash64("doc_id", text)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text_fingerprint(text).alias("fp")), "fingerprints")
    comps = written(components(rows), "components")
    of = lookup_join(rows, comps, "fp", "_fp")
    first = of.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_k"))
    keep = first.select(F.col("_k.doc_id").alias("_doc"), F.col("_k.key").alias("_key"))
    times = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_times"))
    keep = written(keep.join(times, keep["_doc"].eqNullSafe(times["doc_id"]) & (keep["_key"] == times["key"])).select("_doc", "_key", "_times"), "keepers")
    keep = keep.select(F.struct(F.col("_doc").alias("doc"), F.col("_key").alias("key")).alias("_id"), "_times")
    all_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.struct(F.col("doc_id").cast("long").alias("doc"), key.alias("key")).alias("id"))
    hot = written(keep.where(F.col("_times") > common.HOT_ROWS).orderBy(F.desc("_times")).limit(common.HOT_KEYS).select("_id"), "hot")
    met = lookup_join(all_, keep, "id", "_id", "inner", hot, may_broadcast=False)
    out = [F.col("_all")[c].alias(c) for c in docs.columns]
    once = met.where("_times = 1").select(*out)
    if keep.where("_times > 1").isEmpty():
        return once
    return once.union(met.where("_times > 1").groupBy("id").agg(F.first("_all").alias("_all")).select(*out))
