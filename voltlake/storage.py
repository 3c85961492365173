"""Tables and folders that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir.  Where that is unset: a folder of this machine in local mode, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/voltlake-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: dict[str, SparkSession] = {}


@atexit.register
def clear() -> None:
    """Removes what ``written`` has left, once the results that read it are done with; at the latest when the driver's Python ends."""
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.pop(path, None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    _written[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
