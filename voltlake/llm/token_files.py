"""Token ids in ORC files, in ascending document order.

Documents are dealt by ranges of doc_id, sorted, encoded and written as ORC: ids are run-length encoded integers,
stripes can be read in parallel, row indexes and Bloom filters on doc_id let a reader skip stripes and row groups.
Each row also keeps the range it lies in and the ids before it there, so that a document's place among all ids
needs only one sum a range, read from those three narrow columns.

Defined results: a null or empty text is its end id alone; a very long text is one row and is encoded by itself; null doc_ids come first; rows that share a doc_id are
ordered by their text's hash (repeated rows: any order, as they can't be told apart), and many of them are dealt
over several ranges; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.llm.common import give_back, text_of
from voltlake.llm.tokens import encoder, slices

SCHEMA = "doc_id long, part int, before_in_part long, n_tokens long, ids array<int>"
_SHAPE = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: No codec: run-length encoding packs ids into their 16 bits already, and a fast codec gains little on that.
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "none"}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes every text, appends end_id and writes the files below path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, counts = enc.encode(texts[a:b])
                own = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).view(np.int32)
                counts = counts + 1
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(own))
                cols = [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(before + ends - counts), pa.array(counts), lists]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(cols, schema=_SHAPE)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.spark_partition_id()]
    ranged = rows.withColumns({"_hash": order[1], "_from": order[2]}).repartitionByRange("doc_id", "_hash", "_from").sortWithinPartitions("doc_id", "_hash")
    ranged.select("doc_id", "text").mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids, stripes and row groups without them are skipped by index and Bloom filter."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, computed from the files."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "before_in_part", "n_tokens", "ids_crc32"])

    files = read_token_files(spark, path)
    parts = files.groupBy("part").agg(F.max(F.col("before_in_part") + F.col("n_tokens")).alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))  # a row a range
    rows = files.select("doc_id", "part", "before_in_part", "ids").mapInArrow(sums, "doc_id long, part int, before_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("_before") + F.col("before_in_part")).alias("start"), "n_tokens", "ids_crc32")
