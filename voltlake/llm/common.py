"""Helpers that the operators share: shared storage, size-checked joins, a distributed row index."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of whole rows, up to which a side of a join counts as small enough to broadcast (one aggregate checks both first).
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 4 << 20
#: Rows from which a key counts as hot, hot keys looked at (the largest; any other has a smaller share), and copies of a lookup row that share a hot key's rows.
HOT_ROWS, HOT_KEYS, SALTS = 20_000, 1000, 16
#: Bytes of an Arrow batch: texts may be long, and a worker holds a batch several times over.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: dict[str, object] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a folder of this machine in local mode, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/voltlake-shared"
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed by ``clear``, at the latest when the driver's Python ends."""
    path = f"{shared_root(spark)}/voltlake-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@atexit.register
def clear() -> None:
    """Removes all tables written so far: for a driver that lives on, once the results that read them are done with."""
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table through the file system that Spark uses for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back.  Cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column (in any case) is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table from ``written`` that nothing will read again."""
    for path in [p for p in _written if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in df.inputFiles()[:1])]:
        drop_path(df.sparkSession, path)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, null as empty.  Where the session sets no bound for the bytes of an Arrow batch, BATCH_BYTES is set: it changes no result."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: workers live on, idle, beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how much a value takes: its own bytes for strings, all elements of arrays, 8 for a number."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StringType | T.BinaryType | T.ArrayType | T.StructType | T.MapType):
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(8), lambda n, x: n + _bytes(x, inner).cast("int"))
        return 8 * F.greatest(F.size(c), F.lit(0)) + 8
    if isinstance(kind, T.MapType):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
    return F.lit(8)


def small(df: DataFrame) -> bool:
    """Whether df's rows and their bytes, all columns counted, are within the bounds for a broadcast (one aggregate; nothing else moves)."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of more than HOT_ROWS rows, the HOT_KEYS largest of them: one column, ``hot``."""
    n = rows.groupBy(F.col(key).alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    return written(n.orderBy(F.desc("n")).limit(HOT_KEYS).select("hot"), "hot")


def lookup_join(rows: DataFrame, table: DataFrame, key: str, table_key: str, how: str = "left", hot: DataFrame | None = None, may_broadcast: bool = True) -> DataFrame:
    """Join of rows with a table that has one row a key at most; null keys match null.

    The table is broadcast where its checked size allows it.  Beyond that both are shuffled by key, and the rows of hot
    keys are dealt over SALTS copies of their table row by the partition they come from (equal rows too), so that a key
    with a third of all rows doesn't land in one task.  hot: what ``hot_keys`` gives for rows, where it is known already.  may_broadcast: False where the table grows with the rows.
    """
    met = rows[key].eqNullSafe(table[table_key])
    if may_broadcast and small(table):
        return rows.join(F.broadcast(table), met, how).drop(table[table_key])
    table = table if may_broadcast else table.hint("merge")  # Spark would broadcast by its own threshold
    taken = rows.columns + table.columns
    hot_key, salt, other = free_name(taken, "hot_key"), free_name(taken, "salt"), free_name(taken, "salt_of")
    hot = hot_keys(rows, key) if hot is None else hot
    if hot.isEmpty():
        return rows.join(table, met, how).drop(table[table_key])
    hot = hot.select(F.col(hot.columns[0]).alias(hot_key), F.lit(True).alias(salt))
    dealt = rows.join(F.broadcast(hot), rows[key].eqNullSafe(hot[hot_key]), "left").drop(hot_key)  # HOT_KEYS rows at most
    dealt = dealt.withColumn(salt, F.when(F.col(salt), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0))
    copies = table.join(F.broadcast(hot.withColumnRenamed(salt, other)), table[table_key].eqNullSafe(F.col(hot_key)), "left").drop(hot_key)
    copies = copies.withColumn(other, F.explode(F.when(F.col(other), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    copies = copies if may_broadcast else copies.hint("merge")
    on = dealt[key].eqNullSafe(copies[table_key]) & (F.col(salt) == F.col(other))
    return dealt.join(copies, on, how).drop(copies[table_key]).drop(salt, other)


def with_index(df: DataFrame, *order: str) -> DataFrame:
    """df with ``_index``: the row's place (from 0) in the order of the columns given, nulls last.

    Ranges are sorted each on its own and written; only one count a range meets in one place.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    part = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = part.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1)
    return within.join(F.broadcast(before), "_part").withColumn("_index", F.col("_before") + F.col("_row")).drop("_part", "_before", "_row")
