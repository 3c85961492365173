"""The streaming forms, drained over the events table: what they leave equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.operators.recursive import System
from voltlake.plans.testbed import query
from voltlake.streaming import recurrences as R
from voltlake.streaming import windows as S


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 1 day, ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_chunks(spark, d):
    out, cp = S.shared_folder(spark, "chunks"), S.shared_folder(spark, "chunks-state")
    S.run_to_latest(S.chunks(S.read_events(spark, f"{d}/events.parquet"), "1 day"), out, cp)
    return spark.read.parquet(out).select("user_id", F.unix_micros("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, epoch_us(w.s) AS start, count(*) AS n FROM events e JOIN (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2040-01-01', INTERVAL 12 hour)) AS s) w ON e.ts >= w.s AND e.ts < w.s + INTERVAL 1 day GROUP BY ALL")
def stream_frames(spark, d):
    out, cp = S.shared_folder(spark, "frames"), S.shared_folder(spark, "frames-state")
    S.run_to_latest(S.chunks(S.read_events(spark, f"{d}/events.parquet"), "1 day", "12 hours"), out, cp)
    return spark.read.parquet(out).select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT user_id, min(us) AS start, count(*) AS n FROM (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g")
def stream_sessions(spark, d):
    out, cp = S.shared_folder(spark, "sessions"), S.shared_folder(spark, "sessions-state")
    S.run_to_latest(S.sessions(S.read_events(spark, f"{d}/events.parquet"), "12 hours"), out, cp)
    return spark.read.parquet(out).select("user_id", F.unix_micros("start").alias("start"), "n")


@query()
def stream_refractory(spark, d):
    out, cp = S.shared_folder(spark, "onsets"), S.shared_folder(spark, "onsets-state")
    S.run_to_table(S.refractory(S.read_events(spark, f"{d}/events.parquet"), 86400.0), out, cp)
    return spark.read.parquet(out)


@query(
    "SELECT recording AS user_id, event_id AS seq, round(y, 6) AS y FROM ahead JOIN k USING (recording, t)",
    r="SELECT exp(-1 / 5.0) AS r",
    k="SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_id FROM events",
    ahead="SELECT recording, t, (1 - r) * x AS y FROM sig1, r WHERE t = 0 UNION ALL SELECT a.recording, s.t, (1 - r) * s.x + r * a.y FROM r, ahead a JOIN sig1 s ON s.recording = a.recording AND s.t = a.t + 1",
)
def stream_recurrence(spark, d):
    """A smoother over each user's events as they come."""
    out, cp = S.shared_folder(spark, "smooth"), S.shared_folder(spark, "smooth-state")
    events = S.read_events(spark, f"{d}/events.parquet").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("value").alias("x"))
    S.run_to_table(R.filtered(events, System.of_rc(0.05, 100.0), "0 seconds"), out, cp)
    return spark.read.parquet(out).select("user_id", "seq", F.round("y", 6).alias("y"))


@query("SELECT 'user-' || user_id AS subject, epoch_us(ts) AS us, 'event ' || event_id AS message FROM events WHERE event_type = 'error'")
def stream_error_log(spark, d):
    """Errors appended batch by batch."""
    path = S.shared_folder(spark, "errors")
    R.append_log(R.errors_of(S.read_events(spark, f"{d}/events.parquet")), path, "r1")
    return R.read_log(spark, path).select("subject", "us", F.regexp_extract("message", r"^(event \d+) ", 1).alias("message"))
