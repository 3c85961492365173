"""Streaming forms: chunks, frames, rates, sessions and refractory onsets over an event stream (user_id, ts, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.storage import shared_folder  # noqa: F401

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The events file, or the files below path, as a stream in the session's time zone."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", p.getName()), str(p.getParent())
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def chunks(events: DataFrame, size: str = "60 seconds", hop: str | None = None, late: str = LATE) -> DataFrame:
    """Count, sum and mean a user and window: tumbling chunks, or overlapping frames with a hop."""
    w = F.window("ts", size, hop) if hop else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total", "mean")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def refractory(events: DataFrame, gap_seconds: float, late: str = LATE) -> DataFrame:
    """Onsets that are the gap or more after the last kept one of their user; the last kept time is the state."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = pd.concat([b["ts"] for b in batches]).sort_values()
        out = []
        for ts in times:
            at = ts.timestamp()
            if last is None or at - last >= gap_seconds:
                out.append(ts)
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ts": pd.Series(out, dtype="datetime64[ns]")})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(keep, "user_id long, ts timestamp", "last double", "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what is there into Parquet, exactly once by batch."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drains what is there in complete mode; the table below path is the last batch's result."""

    def replace(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
