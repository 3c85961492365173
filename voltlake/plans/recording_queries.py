"""Recordings that Spark writes from the events, read back by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.plans.testbed import query, sig1
from voltlake.sources import signal_files as S
from voltlake.storage import shared_folder

#: The files' physical range and rate.
LOW, HIGH, RATE = -1000.0, 1000.0, 100.0


@query(f"SELECT recording, t, round((least(greatest(floor((x - {LOW}) / {HIGH - LOW} * 65535 + 0.5), 0), 65535)) / 65535 * {HIGH - LOW} + {LOW}, 6) AS x, {RATE}::DOUBLE AS rate FROM sig1")
def edf_ranges(spark, d):
    """One EDF file a recording in the shared folder, then all of them as one table."""
    folder = shared_folder(spark, "edf")
    S.write_edf(sig1(spark, d).withColumn("channel", F.lit("value")), folder, RATE, LOW, HIGH).write.format("noop").mode("overwrite").save()
    got = S.read_signals(spark, folder)
    return got.select(F.regexp_extract("file", r"recording-(-?\d+)\.edf$", 1).cast("long").alias("recording"), "t", F.round("x", 6).alias("x"), "rate")
