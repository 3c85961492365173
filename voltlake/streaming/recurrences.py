"""Recursive filters over streams, and an append-only log that a replayed batch can't write twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltlake.operators.recursive import System

STATE = "s array<double>, us array<long>, seq array<long>, x array<double>"


def filtered(stream: DataFrame, system: System, late: str = "10 minutes", idle: str | None = None, key: str = "user_id") -> DataFrame:
    """stream (key, ts, seq, x) -> (key, ts, seq, y): each key's samples through the system in order of ts and seq, from rest.

    Samples wait until the watermark has reached them, so they may come in any order within ``late``; then they are
    filtered from the state that the ones before left and sent on in order (one that comes within the watermark's own
    millisecond, but after it, is taken as it comes).  What comes later than that is dropped, as
    Spark drops late rows.  idle: a key of which nothing has come for that long (in event time) is forgotten and starts
    from rest.  The state is the filter's numbers and the samples that wait.
    """
    gap = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1e6)
    kind = stream.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, us, seq, x = (np.asarray(v) for v in state.get) if state.exists else (np.zeros(system.size), *(np.zeros(0, t) for t in (np.int64, np.int64, float)))
        new = [b for b in batches if len(b)] if not state.hasTimedOut else []
        if new:
            rows = pd.concat(new)
            us, seq, x = np.r_[us, rows["_us"].to_numpy(np.int64)], np.r_[seq, rows["seq"].to_numpy(np.int64)], np.r_[x, rows["x"].to_numpy(float)]
        mark = state.getCurrentWatermarkMs() * 1000 + 999  # the watermark counts whole milliseconds
        order = np.lexsort((seq, us))
        us, seq, x = us[order], seq[order], x[order]
        n = int(np.searchsorted(us, mark, "right"))
        if n:
            y, s = system.run(x[:n], s)
            yield pd.DataFrame({key: [name[0]] * n, "us": us[:n], "seq": seq[:n], "y": y})
        us, seq, x = us[n:], seq[n:], x[n:]
        if state.hasTimedOut and not len(us) and gap is not None:
            state.remove()
            return
        state.update((s.tolist(), us.tolist(), seq.tolist(), x.tolist()))
        due = int(us[0]) // 1000 if len(us) else None if gap is None else (mark + gap) // 1000
        if due is not None:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("_us"), F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"))
    out = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, us long, seq long, y double", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("us").alias("ts"), "seq", "y")


def once_a_batch(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: a batch has a folder of its own, which it writes whole, so that a replay leaves the same rows once."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumns({"run": F.lit(run), "batch": F.lit(batch).cast("long")}).write.mode("overwrite").parquet(f"{path}/log/{batch:012d}")

    return write


def append_log(stream: DataFrame, path: str, run: str) -> None:
    """Drains the stream's rows (errors, or what was done to what) into the log below path, each once, also after a restart."""
    q = stream.writeStream.foreachBatch(once_a_batch(path, run)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()


def read_log(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log/*")


def errors_of(events: DataFrame) -> DataFrame:
    """Events of type error as log rows: what it concerns, its kind, when, a message."""
    return events.where(F.col("event_type") == "error").select(F.concat(F.lit("user-"), "user_id").alias("subject"), F.lit("event").alias("kind"), F.unix_micros("ts").alias("us"), F.concat(F.lit("event "), "event_id", F.lit(" value "), F.round("value", 2)).alias("message"))
