"""The supplied tables as registry, signal and marker relations, in DataFrame and in SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Relations that oracle SQL may name: each is put before a query that mentions it.
RELATIONS = {
    "sig1": "SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x FROM events",
    "sign": "SELECT user_id AS recording, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value AS x, "
    "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS contact FROM events",
    "mark": "SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_id, "
    "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS code, event_type AS kind, epoch_us(ts) / 1e6 AS sec FROM events",
    "pub": "SELECT c_mktsegment AS dataset_id, o_custkey AS subject, o_orderpriority AS task, o_orderstatus AS protocol_id, "
    "c_mktsegment || '|' || o_custkey || '|' || o_orderkey AS record_id, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey",
    "priv": "SELECT c_mktsegment || '|' || o_custkey || '|' || o_orderkey AS record_id, 'returned' AS exclude_reason FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "rview": "SELECT pub.*, priv.record_id IS NOT NULL AS excluded, coalesce(exclude_reason, '') AS exclude_reason FROM pub LEFT JOIN priv USING (record_id)",
}
_NEEDS = {"rview": ("pub", "priv", "rview")}


def oracle(sql: str, **own: str) -> str:
    """sql with the relations that it (or its own ones) names put before it."""
    text = " ".join([sql, *own.values()])
    names: list[str] = []
    for n in RELATIONS:
        if n in text.split() or f"{n}," in text or f"{n})" in text or f"{n}." in text:
            names += [x for x in _NEEDS.get(n, (n,)) if x not in names]
    parts = [f"{n} AS ({RELATIONS[n]})" for n in names] + [f"{n} AS ({s})" for n, s in own.items()]
    return (f"WITH {'RECURSIVE ' * ('UNION ALL' in text)}{', '.join(parts)} " if parts else "") + sql


def query(sql: str | None = None, **own: str) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle(sql, **own)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(kind: str = "event_type"):
    order = {"click": 1, "error": 2, "purchase": 3, "signup": 4}
    c = F.lit(5)
    for k, v in order.items():
        c = F.when(F.col(kind) == k, v).otherwise(c)
    return c


def sig1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, t, x: one series a user."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("recording"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("value").alias("x"))


def sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, t, x, contact: one channel an event type."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("value").alias("x"), code_of().alias("contact"))


def mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, t, event_id, code, kind, sec: the events as markers."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("recording"), (F.row_number().over(w) - 1).cast("long").alias("t"), "event_id", code_of().alias("code"), F.col("event_type").alias("kind"), sec.alias("sec"))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, t, x, y: each event's code (x, the stimulus) and value (y, the response)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("recording"), (F.row_number().over(w) - 1).cast("long").alias("t"), code_of().cast("double").alias("x"), F.col("value").alias("y"))


def pub(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rid = F.concat_ws("|", "c_mktsegment", "o_custkey", "o_orderkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("dataset_id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("protocol_id"), rid.alias("record_id"), "o_orderkey", "o_orderdate")


def priv(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    p = pub(spark, sf_dir)
    return p.join(back, p["o_orderkey"] == back["l_orderkey"], "left_semi").select("record_id", F.lit("returned").alias("exclude_reason"))
