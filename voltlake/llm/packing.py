"""Packing by power-of-two decomposition.

Each document's ids (with the end id) are cut into pieces whose lengths are powers of two, the longest first, and
each piece is a sequence: pieces of one length form a bucket, so a batch holds sequences of one length, no sequence
crosses documents, and nothing is padded.  Rows stay where they are; there is no shuffle.

A sequence's id holds its bucket, its task and its place there, so ids differ and need no counting over all rows.

Defined results: a null or empty text is its end id alone (one piece of length 1); a very long text is encoded by
itself, as a whole, and cut into as many pieces as it needs; repeated rows are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm.common import give_back, text_of
from voltlake.llm.tokens import encoder, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
#: Where a sequence id's parts begin: bucket above task above place.
_BUCKET_BIT, _TASK_BIT = 59, 35


def piece_lengths(n: int, most: int) -> list[int]:
    """n as powers of two of at most ``most``, descending."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, max_length: int = 2048, with_ids: bool = False) -> DataFrame:
    """documents -> a row for each piece; with_ids also ``ids``, the piece's token ids.  max_length is a power of two."""
    if max_length & (max_length - 1) or not 1 <= max_length <= 1 << 15:
        raise ValueError("max_length must be a power of two up to 32768")
    types = dict(doc_id=pa.int64(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), doc_tokens=pa.int64(), sequence_id=pa.int64(), offset=pa.int64(), bucket=pa.int32())
    shape = pa.schema([*types.items(), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, placed = encoder(tokenizer), TaskContext.get().partitionId(), [0] * 16
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, counts = enc.encode(texts[a:b])
                rows, held, at = [], [], 0
                for doc, n in zip(doc_ids[a:b], counts, strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at, start = at + n, 0
                    for size in piece_lengths(len(own), max_length):
                        k = size.bit_length() - 1
                        seq = k << _BUCKET_BIT | task << _TASK_BIT | placed[k]
                        placed[k] += 1
                        rows.append((doc, start, size, zlib.crc32(own[start : start + size]), len(own), seq, 0, k))
                        start += size
                    held.append(own)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=False)]
                if with_ids:
                    ends = np.cumsum([0] + [r[2] for r in rows]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=shape)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(pack, SCHEMA + ", ids array<int>" * with_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, a folder a bucket: a reader of one folder gets sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length: one folder is read, the others are pruned."""
    return spark.read.parquet(path).where(F.col("bucket") == length.bit_length() - 1)
