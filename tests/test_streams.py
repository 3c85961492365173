"""Streamed recurrences equal the batch filter over shuffled files and after restarts; the log holds each row once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators.recursive import System, butterworth
from voltlake.streaming import recurrences as R
from voltlake.streaming import windows as S

START = 1_700_000_000


def rows_of(seed=1):
    """Two users, seconds apart, some at the same time."""
    rng = np.random.default_rng(seed)
    return [(u, START + int(t), k + 1000 * u, float(v)) for u, n in ((1, 400), (2, 250)) for k, (t, v) in enumerate(zip(np.sort(rng.integers(0, 600, n)), rng.normal(size=n)))]


def put(spark, part, folder, k):
    df = spark.createDataFrame(part, "user_id long, s long, seq long, x double").select("user_id", F.timestamp_seconds("s").alias("ts"), "seq", "x")
    df.coalesce(1).write.mode("append").parquet(str(folder / f"{k:03d}"))


def stream(spark, folder):
    schema = "user_id long, ts timestamp, seq long, x double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def want(rows, system):
    out = {}
    for u in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2]))
        out.update(zip(((u, r[2]) for r in mine), system.run(np.array([r[3] for r in mine]))[0]))
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_shuffled_files_equal_batch(spark, tmp_path, restart):
    system = System.of_sections(butterworth(3, 0.05, 1.0))
    rows = rows_of()
    deal = {}
    rng = np.random.default_rng(3)
    for r in rows:  # a row comes up to 60 seconds late
        deal.setdefault((r[1] - START + int(rng.integers(0, 60))) // 110, []).append(r)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for k in sorted(deal):
        put(spark, [deal[k][j] for j in rng.permutation(len(deal[k]))], tmp_path / "in", k)
        if restart:  # the query ends and goes on from its checkpoint
            S.run_to_table(R.filtered(stream(spark, tmp_path / "in"), system, "240 seconds"), out, cp)
    put(spark, [(9, START + 100_000, 1, 0.0)], tmp_path / "in", 99)  # time goes on
    S.run_to_table(R.filtered(stream(spark, tmp_path / "in"), system, "240 seconds"), out, cp)
    got = {(r.user_id, r.seq): r.y for r in spark.read.parquet(out).where("user_id < 9").collect()}
    expected = want(rows, system)
    assert set(got) == set(expected)
    np.testing.assert_allclose([got[k] for k in expected], list(expected.values()), atol=1e-12)


def test_idle_keys_start_again(spark, tmp_path):
    system = System.of_rc(10.0, 1.0)
    early, later = [(1, START + k, k, 1.0) for k in range(20)], [(1, START + 5000 + k, 100 + k, 1.0) for k in range(5)]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for k, part in enumerate((early, [(2, START + 2000, 0, 0.0)], [(2, START + 4000, 1, 0.0)], later, [(2, START + 9000, 2, 0.0)])):
        put(spark, part, tmp_path / "in", k)
        S.run_to_table(R.filtered(stream(spark, tmp_path / "in"), system, "10 seconds", idle="600 seconds"), out, cp)
    got = {r.seq: r.y for r in spark.read.parquet(out).where("user_id = 1").collect()}
    fresh = system.run(np.ones(20))[0]
    np.testing.assert_allclose([got[k] for k in range(20)], fresh)
    np.testing.assert_allclose([got[100 + k] for k in range(5)], fresh[:5])


def test_log_holds_each_row_once(spark, tmp_path):
    path = str(tmp_path / "log")
    write = R.once_a_batch(path, "a")
    one = spark.createDataFrame([("s", 1), ("t", 2)], "subject string, us long")
    for batch in (0, 1, 1, 0):  # batches 1 and 0 are replayed
        write(one, batch)
    assert sorted((r.subject, r.batch) for r in R.read_log(spark, path).collect()) == [("s", 0), ("s", 1), ("t", 0), ("t", 1)]


def test_log_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "log")
    events = lambda: stream(spark, tmp_path / "in").select(F.col("user_id").alias("subject"), "seq")
    put(spark, [(1, START, k, 0.0) for k in range(5)], tmp_path / "in", 0)
    R.append_log(events(), path, "a")
    R.append_log(events(), path, "a")
    commits = sorted((tmp_path / "log" / "progress" / "commits").glob("[0-9]*"))
    commits[-1].unlink()  # as if the driver had died between the write and its note
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    put(spark, [(1, START, k, 0.0) for k in range(5, 9)], tmp_path / "in", 1)
    R.append_log(events(), path, "b")
    got = R.read_log(spark, path).collect()
    assert sorted(r.seq for r in got) == list(range(9))
