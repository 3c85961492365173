"""Delay queries and operators against brute force, over every recording."""

import datetime

import numpy as np
import pytest

from voltlake.operators import alignment, series
from voltlake.plans.catalog import QUERIES


def train(seed, n):
    return np.cumsum(np.random.default_rng(seed).uniform(1, 9, n)).round(3)


def brute_windows(ref, raw, limit=0.05):
    """{(reference start, raw start): (delay, rmse)} of trains of onsets, as the reference searches."""
    a, b = np.diff(ref), np.diff(raw)
    n = min(12, len(a), len(b))
    out = {}
    if n < 5:
        return out
    for i in range(min(30, len(a) - n) + 1):
        for j in range(min(30, len(b) - n) + 1):
            rmse = np.sqrt(np.mean((a[i : i + n] - b[j : j + n]) ** 2))
            if rmse <= limit:
                out[i, j] = (raw[j] - ref[i], rmse)
    return out


def onsets(spark, trains):
    return spark.createDataFrame([(k, float(v)) for k, on in trains.items() for v in on], "k long, onset double")


def test_windows_equal_brute_force(spark):
    ref = {k: train(k, n) for k, n in {1: 80, 2: 43, 3: 9, 4: 6, 5: 5, 60: 50}.items()}
    raw = {k: v + 12.86 for k, v in ref.items()} | {2: np.delete(ref[2], 3) + 1.0, 60: ref[60][30:] + 2.0}
    got = alignment.window_delays(*(series.intervals(onsets(spark, t), ["k"], "onset") for t in (ref, raw)), "k").collect()
    want = {(k, i, j): v for k in ref for (i, j), v in brute_windows(ref[k], raw[k]).items()}
    assert {(r.k, r.ref_start, r.raw_start) for r in got} == set(want) and {(60, 30, 0), (1, 30, 30)} <= set(want)
    assert all((r.delay, r.rmse) == pytest.approx(want[r.k, r.ref_start, r.raw_start], abs=1e-6) for r in got)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Recordings below and above 40, long and short."""
    d, zero = str(tmp_path_factory.mktemp("events")), datetime.datetime(2024, 1, 1)
    trains = {u: train(u, n) for u, n in {3: 60, 39: 7, 40: 60, 41: 20, 900: 45, 1499: 6}.items()}
    rows = [(1000 * u + k, u, zero + datetime.timedelta(seconds=float(v)), "click", float(k)) for u, on in trains.items() for k, v in enumerate(on)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return d, trains


def test_delay_queries_take_every_recording(spark, events):
    d, trains = events
    got = QUERIES["window_match_delay"](spark, d).collect()
    assert {(r.recording, r.ref_start, r.raw_start) for r in got} == {(u, i, j) for u, on in trains.items() for i, j in brute_windows(on, on + 12.86)}
    for name, column in (("constant_delay", "robust_mean"), ("best_delay", "delay")):
        assert {r.recording: r[column] for r in QUERIES[name](spark, d).collect()} == dict.fromkeys(trains, pytest.approx(12.86))
    assert {r.recording: (r.onset, r.hits) for r in QUERIES["dialogue_events"](spark, d).collect()} == {u: (pytest.approx(16.86), len(on) - 1) for u, on in trains.items()}


def test_trains_without_a_close_window(spark):
    """Missing and extra triggers, jitter and few intervals: each still gets its row, as the reference's fallbacks give it."""
    from voltlake.operators import composites

    exact = train(7, 60)
    jitter = np.where(np.arange(60) % 2, 0.08, -0.08)
    holes = np.delete(exact, np.arange(4, 60, 5))  # every window of 12 has holes
    extra = np.sort(np.concatenate([exact, exact[2::4] + 0.7]))
    raws = {1: exact + 5.0, 2: exact + jitter / 2 + 5.0, 3: holes + 5.0, 4: extra + 5.0, 5: exact[:4] + 5.0, 6: exact[:2] + 5.0}
    refs = {k: exact for k in raws} | {5: exact[:4], 6: exact[:2]}
    best = {k: min((r for _, r in brute_windows(refs[k], raws[k], 1e9).values()), default=None) for k in raws}
    assert 0.05 < best[2] <= 0.25 < min(best[3], best[4]) and best[5] is None  # window, 5 x window, onsets, onsets, too few
    dur = spark.createDataFrame([(k, 400.0) for k in raws], "k long, duration double")
    got = {r.k: r for r in composites.dialogue_events(onsets(spark, refs), onsets(spark, raws), dur, "k").collect()}
    assert set(got) == set(raws)
    for k in (1, 3, 4, 5, 6):
        assert got[k].delay == pytest.approx(5.0, abs=1e-6)
    assert got[2].delay == pytest.approx(5.0, abs=0.2) and got[2].rmse == pytest.approx(best[2])
    assert [k for k in raws if got[k].rmse is None] == [3, 4, 5, 6]
    cand = onsets(spark, raws).selectExpr("k", "'S 1' as description", "onset")
    told = {r.k: r for r in composites.story_events(cand, onsets(spark, refs), dur, "k").collect()}
    assert set(told) == {1, 2} and told[2].rmse == pytest.approx(best[2])  # no onset pairs in the story task's rule
