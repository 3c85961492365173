"""Findings of round 3: exact rounding of percentiles, and steps whose work must not pile up in one task."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from voltlake.plans.catalog import ORACLE, QUERIES

ZERO = datetime.datetime(2024, 1, 1)


def events_of(spark, folder, values):
    """An events table of a value list a user; its path."""
    rows = [(1000 * u + k, u, ZERO + datetime.timedelta(seconds=k), "click", v) for u, vs in values.items() for k, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(ORACLE[name]).fetchall()


def test_midpoint_threshold_half_way_between_roundings(spark, tmp_path):
    """Midpoints of 56.95, 52.85, 31.55 and 49.65, where the last bit decides; a user without values, one value, ties, nulls."""
    values = {1: [50.03, 97.31, 41.28, 74.74, 16.06], 2: [30.96, 32.58, 75.6, 69.68, 59.12], 3: [12.98, 51.55, 29.1, 19.1, 38.28], 4: [17.44, 92.52, 54.86, 7.58, 78.66], 5: [None, None], 6: [3.25], 7: [1.0, 1.0, None, 2.0]}
    d = events_of(spark, tmp_path, values)
    got = {r.recording: r.threshold for r in QUERIES["midpoint_threshold"](spark, d).collect()}
    assert got == dict(by_sql("midpoint_threshold", d, "events")) and set(got) == set(values)


def test_metric_by_name_ranks_values_not_rows(spark, tmp_path):
    """Ties, prices that are null (ranked last, as in SQL), a null flag, and rows that repeat, over several ranges."""
    rows = [(k % 50, "AN"[k % 2], float(1 + k * k % 7), None if k % 11 == 0 else 100.0 * (k * 37 % 23)) for k in range(400)] + [(1, "R", 5.0, 700.0)] * 3 + [(1, "R", 6.0, 100.0)] + [(1, None, 2.0, 1.0), (1, None, 3.0, 2.0)]
    spark.createDataFrame(rows, "l_orderkey int, l_returnflag string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.l_returnflag, r.metric): r.score for r in QUERIES["metric_by_name"](spark, str(tmp_path)).collect()}
    want = {(f, m): s for f, m, s in by_sql("metric_by_name", tmp_path, "lineitem")}
    assert set(got) == set(want)
    for k in [(f, m) for f in ("A", "N", "R", None) for m in ("pearson", "spearman", "r2")]:
        assert got[k] == pytest.approx(want[k], abs=1e-6), k
    assert got["R", "spearman"] == -1.0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def trains(spark, many):
    return spark.createDataFrame([(k, float(7 * i + (i * i * (k + 3)) % 5)) for k in many for i in range(40)], "k long, onset double")


def test_delays_are_found_once_and_not_as_rows_of_pairs(spark, tmp_path):
    values = {u: [float(k) for k in range(30)] for u in (1, 2, 41)}
    d = events_of(spark, tmp_path, values)
    plan = plan_of(QUERIES["constant_delay"](spark, d))
    assert plan.count("MapInPandas") == 1 and "Generate" not in plan


def test_robust_mean_of_arrays(spark):
    from voltlake.operators import series

    lists = {1: [1.0, 1.5, 2.0, 90.0], 2: [3.0, 3.0, 3.0, 8.0], 3: [4.0], 4: [None], 5: [1.0, 2.0, 4.0, 7.0, 11.0, None]}
    df = spark.createDataFrame([(k, v) for k, vs in lists.items() for v in vs], "k int, v double")
    want = {r.k: r.robust_mean for r in series.robust_mean(df, ["k"], "v").collect()}
    got = df.groupBy("k").agg(F.collect_list("v").alias("vs")).select("k", series.robust_mean_of("vs").alias("m"))
    assert {r.k: r.m for r in got.collect()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_dialogue_pairs_no_onsets_of_aligned_trains(spark, monkeypatch):
    from voltlake.operators import alignment, composites

    asked, real = [], alignment.onset_delays
    monkeypatch.setattr(alignment, "onset_delays", lambda ref, raw, key: (asked.extend(r.k for r in ref.select(key).distinct().collect()), real(ref, raw, key))[1])
    ref = trains(spark, range(4))
    raw = ref.where("k <> 2 or onset < 20").withColumn("onset", F.col("onset") + 5.0)  # too few intervals for a window
    dur = spark.createDataFrame([(k, 900.0) for k in range(4)], "k long, duration double")
    got = {r.k: (round(r.delay, 6), r.rmse is None) for r in composites.dialogue_events(ref, raw, dur, "k").collect()}
    assert asked == [2] and got == {k: (5.0, k == 2) for k in range(4)}


def test_nearest_contacts_deal_what_places_meet(spark, monkeypatch):
    """The join that each place's neighbours come from is dealt by the number of places, not by the bytes before it."""
    from voltlake.operators import channels as C

    monkeypatch.setattr(C, "TASK_PLACES", 50, raising=False)
    points = [(1, k, (k * 37 % 101) / 10, (k * 53 % 211) / 10, (k * 71 % 307) / 10) for k in range(400)]
    df = C.nearest_contacts(spark.createDataFrame(points, "group int, id int, x double, y double, z double"), 3)
    assert "9), REPARTITION_BY_NUM" in plan_of(df)
    got = {(r.id, r["rank"]): (r.other, round(r.distance, 9)) for r in df.collect()}
    for _, i, *a in points:
        near = sorted((sum((p - q) ** 2 for p, q in zip(a, b)) ** 0.5, j) for _, j, *b in points if j != i)[:3]
        assert [got[i, n + 1] for n in range(3)] == [(j, round(s, 9)) for s, j in near]


def test_sums_of_many_folds_are_taken_at_once(spark):
    """Batches of many folds give the sums that a backend with steps of its own gives fold by fold."""
    from voltlake.operators import model_runs as Z

    rows = spark.createDataFrame([(k % 150, [float(k % 7), float(k * k % 11)], [float(k % 13)], 1.0 + k % 3) for k in range(900)], "fold long, lagged array<double>, y array<double>, w double").coalesce(1)
    origin = Z.origin_of(rows)

    class Own(Z.Ridge):
        def accumulate(self, x, y, w):
            return super().accumulate(x, y, w)

    got, want = ({r.fold: r for r in Z.sums_by(rows, ["fold"], b, origin).collect()} for b in (Z.backend_of("ridge"), Own()))
    assert set(got) == set(want) and len(got) == 150
    for k, r in want.items():
        for c in ("n", "sx", "sy", "xx", "xy", "yy"):
            assert got[k][c] == pytest.approx(r[c]), (k, c)
    assert Z.MANY_VALUES > 2 * 3 * 900  # so the first went at once
