"""Operators against formulas and numpy on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.functions import scalars as S
from voltlake.operators import alignment, channels, encoding, filters, pipelines, registry, series, spectral


def signal(spark, xs, channel=None):
    if channel is None:
        return spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(xs)], "recording long, t long, x double")
    return spark.createDataFrame([(1, c, k, t, float(x)) for k, (c, col) in enumerate(xs.items(), 1) for t, x in enumerate(col)], "recording long, channel string, contact int, t long, x double")


def values(df, order="t", col="x"):
    return [r[col] for r in df.orderBy(order).collect()]


def test_registry(spark):
    public = spark.createDataFrame([(" a|1 ",), ("b|1",), ("c|1",), ("d|1",)], "record_id string")
    private = spark.createDataFrame([("a|1", "x", 1), ("a|1 ", " ", 2), ("b|1", "NA", 1), ("", "y", 1), (None, "z", 1)], "record_id string, exclude_reason string, n int")
    got = {r.record_id.strip(): (r.excluded, r.exclude_reason) for r in registry.overlay(public, private, order=["n"]).collect()}
    assert got == {"a|1": (False, ""), "b|1": (True, "NA"), "c|1": (False, ""), "d|1": (False, "")}


def test_lookup_once_fails_on_missing(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no single key 2"):
        registry.lookup_once(left, right, "k", "v").collect()


def test_build_public(spark):
    acq = spark.createDataFrame([("D", "s1", "ses1", "a1", "naming", "F", "2000-02-29", "2020-02-28"), ("D", "s1", "ses9", "a2", "naming", "F", "bad", "2020-01-01")], "dataset_id string, subject string, session string, acquisition_id string, task string, sex string, birth_date string, date string")
    prot = spark.createDataFrame([("p1", ["ses1", "ses2"]), ("p2", ["ses1"])], "protocol_id string, sessions array<string>")
    got = {r.record_id: r.age for r in registry.build_public(acq, prot).collect()}
    assert got == {"D|s1|ses1|a1|p1": "19", "D|s1|ses1|a1|p2": "19", "D|s1|ses9|a2|none": ""}


def test_record_id_rejects_the_delimiter(spark):
    df = spark.createDataFrame([("a|b", "c")], "x string, y string")
    with pytest.raises(Exception, match="delimiter"):
        df.select(S.record_id(F.col("x"), F.col("y"))).collect()


def test_issue_exit_codes(spark):
    found = spark.createDataFrame([("warning",)], "level string")
    assert [registry.exit_code(found, s).first().exit_code for s in (False, True)] == [2, 3] and registry.exit_code(found.limit(0)).first().exit_code == 0


def test_rereference(spark):
    xs = {"A1": [1, 2], "A2": [4, 8], "A3": [2, 0], "STI": [9, 9]}
    s = signal(spark, xs, True).withColumn("pool", F.col("channel") != "STI")
    car = channels.common_average(s, pool="pool")
    assert car.where("pool").groupBy("t").agg(F.round(F.sum("x"), 9).alias("s")).where("s <> 0").isEmpty() and values(car.where("channel = 'STI'")) == [9.0, 9.0]
    b = channels.bipolar(s.where("pool"))
    assert {r.channel for r in b.collect()} == {"A1-A2", "A2-A3"} and values(b.where("channel = 'A1-A2'")) == [-3.0, -6.0]
    lap = channels.laplacian(s.where("pool"))
    assert values(lap.where("channel = 'A2'")) == [2.5, 7.0] and values(lap.where("channel = 'A1'")) == [1.0, 2.0]
    edges = spark.createDataFrame([("A1", "A2"), ("A2", "A1"), ("A2", "A3")], "channel string, neighbour string")
    g = channels.graph_laplacian(s.where("pool"), edges)
    assert values(g.where("channel = 'A1'")) == [-3.0, -6.0] and values(g.where("channel = 'A3'")) == [2.0, 0.0]


def test_moving_average_and_difference(spark):
    x = [1.0, 5.0, 2.0, 8.0, 3.0]
    s = signal(spark, x)
    w = series.by()
    for width in (3, 4):
        want = np.convolve(x, np.ones(width) / width, mode="same")
        assert np.allclose(values(s.withColumn("x", series.moving_average(F.col("x"), w, width))), want)
    assert values(s.withColumn("x", series.difference(F.col("x"), w, 10.0))) == [0.0, 40.0, -30.0, 60.0, -50.0]


def test_refractory_depends_on_kept_ones(spark):
    on = spark.createDataFrame([(1, float(v)) for v in (0, 6, 9, 11, 19, 21, 40)], "recording long, sec double")
    assert [r.sec for r in series.refractory(on, 10).orderBy("sec").collect()] == [0.0, 11.0, 21.0, 40.0]


def test_interpolate_and_force_length(spark):
    s = spark.createDataFrame([(1, 2, 10.0), (1, 6, 30.0)], "recording long, t long, x double")
    grid = spark.createDataFrame([(1, t) for t in range(9)], "recording long, t long")
    assert values(series.interpolate(s, grid)) == np.interp(range(9), [2, 6], [10, 30]).tolist()
    assert values(series.force_length(s, 4)) == [0.0, 0.0, 10.0, 0.0]


def test_greedy_matching_is_one_to_one(spark):
    a = spark.createDataFrame([(1, v) for v in (0.0, 0.1, 5.0)], "k long, onset double")
    b = spark.createDataFrame([(1, v) for v in (0.05, 5.2, 9.0)], "k long, onset double")
    assert sorted((r.onset_a, r.onset_b) for r in alignment.greedy_matches(a, b, "k", "onset", 0.3).collect()) == [(0.0, 0.05), (5.0, 5.2)]


def test_delay_of_a_shifted_train(spark):
    on = [4, 7.5, 11, 16, 22, 29]
    ref = series.intervals(spark.createDataFrame([(1, float(v)) for v in on], "k long, onset double"), ["k"], "onset")
    raw = series.intervals(spark.createDataFrame([(1, v + 12.86) for v in on], "k long, onset double"), ["k"], "onset")
    cand = alignment.window_delays(ref, raw, "k", 3)
    got = alignment.best_delay(cand, ref, raw, "k", 0.05).first()
    assert got.hits == 5 and got.delay == pytest.approx(12.86)
    assert series.robust_mean(cand.select("k", "delay"), ["k"], "delay").first().robust_mean == pytest.approx(12.86)


def test_rising_edges(spark):
    x = np.zeros(1000)
    x[100:105] = x[108:112] = x[400:405] = 1
    edges = series.rising_edges(signal(spark, x), F.lit(0.5)).select("recording", (F.col("t") / 1000).alias("sec"))
    assert [r.sec for r in series.refractory(edges, 0.1).orderBy("sec").collect()] == [0.1, 0.4]


def test_encoding_model_recovers_its_kernel(spark):
    kernel = [0.0, 0.6, 1.0, -0.4]
    rows = encoding.lagged(encoding.simulated(spark, 4, 3000, kernel), [0, 1, 2, 3]).withColumn("y", F.array("y")).withColumn("fold", F.col("recording"))
    model = encoding.ridge(encoding.gram(rows), [1e-3]).first()
    assert np.allclose(model.coef, kernel, atol=0.03)
    x, y = np.array([r.lagged for r in rows.select("lagged").collect()]), np.array([r.y[0] for r in rows.select("y").collect()])
    g = encoding.gram(rows).first()
    assert np.allclose(np.array(g.xx).reshape(4, 4), x.T @ x) and np.allclose(g.xy, x.T @ y)
    best = encoding.best_alpha(encoding.cross_validate(rows.select("fold", "lagged", "y"), [1e-3, 1e5])).first()
    assert best.alpha == 1e-3 and best.score > 0.9


def test_purge_removes_neighbours(spark):
    seg = spark.createDataFrame([(1, 0, 10, 0), (1, 10, 20, 1), (1, 24, 30, 2)], "recording long, start long, stop long, own long")
    train = seg.withColumn("fold", F.lit(1).cast("long")).where("own <> 1")
    test = seg.where("own = 1").withColumn("fold", F.col("own"))
    assert [r.start for r in encoding.purge(train, test, 3).collect()] == [24] and encoding.purge(train, test, 5).isEmpty()


def test_stft_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=64)
    p = spectral.stft_power(spectral.frames(signal(spark, x), 16, 8), 16, 100.0).toPandas().pivot(index="frame", columns="bin", values="power").to_numpy()
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    want = np.array([np.abs(np.fft.rfft(x[a : a + 16] * w)) ** 2 for a in range(0, 49, 8)])
    assert np.allclose(p, want)
    assert values(spectral.reflect_padded(signal(spark, x), 5)) == np.pad(x, 5, mode="reflect").tolist()


def test_filters():
    rate, t = 200.0, np.arange(2000) / 200.0
    tone = lambda f: np.sin(2 * np.pi * f * t)
    mid = slice(300, 1700)
    assert np.std(filters.highpass(tone(0.2) + tone(30), 5.0, rate, 401)[mid] - tone(30)[mid]) < 0.05
    assert np.std(filters.zero_phase(tone(2) + tone(60), filters.butterworth(4, 10, rate))[mid] - tone(2)[mid]) < 0.02
    assert abs(filters.envelope((1 + 0.5 * tone(1)) * tone(40))[mid] - (1 + 0.5 * tone(1))[mid]).max() < 0.01
    assert len(filters.resample(tone(3), 128, rate)) == 1280 and np.std(filters.resample(tone(3), 128, rate)[100:-100] - np.sin(2 * np.pi * 3 * np.arange(1280) / 128)[100:-100]) < 0.01
    assert np.std(filters.fft_resample(tone(3), 100, rate) - np.sin(2 * np.pi * 3 * np.arange(1000) / 100)) < 0.01
    h, n = filters.butterworth(4, 10, rate), 512
    gain = lambda f: abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for z in [np.exp(-2j * np.pi * f / rate)] for b0, b1, b2, a1, a2 in h]))
    assert gain(0) == pytest.approx(1) and gain(10) == pytest.approx(2**-0.5) and gain(80) < 1e-3 and n


def test_notch_and_line_removal(spark):
    t = np.arange(600)
    line, slow = np.sin(2 * np.pi * 10 * t / 100), np.sin(2 * np.pi * 1 * t / 100)
    before, after = signal(spark, line + slow), spectral.notch(signal(spark, line + slow), [10.0], 100.0, 200)
    power = lambda s: spectral.line_power(s, 10.0, 100.0).first().line_power
    assert power(after) < 1e-6 * power(before)
    s = signal(spark, {"A": line + slow, "B": 0.5 * line + np.cos(2 * np.pi * 2 * t / 100)}, True)
    clean = filters.remove_line(s, 10.0, 100.0, 600)
    assert spectral.line_power(clean.where("channel = 'A'"), 10.0, 100.0).first().line_power < 0.05 * power(before)


def test_envelope_features(spark):
    t = np.arange(1000) / 100.0
    s = signal(spark, (1 + 0.8 * np.sin(2 * np.pi * 0.5 * t)) * np.sin(2 * np.pi * 20 * t))
    for out in (filters.hilbert_envelope(s, 100.0, 100.0, cut=5.0), filters.rectified_envelope(s, 100.0, 3.0, 100.0)):
        assert np.corrcoef(values(out), 1 + 0.8 * np.sin(2 * np.pi * 0.5 * t))[0, 1] > 0.95
    bands = filters.band_envelopes(s, [(5, 10), (15, 25)], 100.0, 5.0)
    mean = {r.band: r.m for r in bands.groupBy("band").agg(F.avg("x").alias("m")).collect()}
    assert mean[1] > 5 * mean[0]
    with pytest.raises(ValueError):
        filters.register_feature("loudness", filters.loudness)


def test_error_policies(spark):
    s = signal(spark, [1.0, 2.0])
    blocks = [("double", lambda d: d.withColumn("x", F.col("x") * 2)), ("broken", lambda d: d.select("nothing")), ("add", lambda d: d.withColumn("x", F.col("x") + 1))]
    log = pipelines.ErrorLog("collect")
    out, done = pipelines.run_blocks(s, blocks, log)
    assert values(out) == [3.0, 5.0] and [n for _, n in done] == ["double", "add"] and log.table(spark).count() == 1
    assert pipelines.provenance(spark, done, {"rate": "100"}).count() == 2
    with pytest.raises(Exception):
        pipelines.run_blocks(s, blocks)
    assert pipelines.choose_view(["car", "original"], "bip") == ("car", "view bip is not available, car is used")
    assert pipelines.choose_view(["bipolar", "car", "original"]) == ("original", None) == pipelines.choose_view(["bipolar", "original"], "  ")
    for name, view in {"avg": "car", "LAPP": "laplacian", "Car-By-Shaft": "car", "car_global": "car", "car_by_shaft": "car", " BIP ": "bipolar", "wm": "wm_ref", "original": "original"}.items():
        assert pipelines.choose_view(["bipolar", "laplacian", "wm_ref", "car", "original"], name) == (view, None)
    assert pipelines.choose_view(["laplacian", "car"]) == ("laplacian", "view original is not available, laplacian is used")


def test_mel_bands_are_never_empty():
    """Bands narrower than a bin keep one; wide ones are triangles of equal area."""
    for n_fft, bands in ((256, 64), (512, 80), (1024, 40)):
        w = spectral.mel_weights(n_fft, 16000.0, bands)
        assert {b for b, _, _ in w} == set(range(bands)) and all(0 <= k <= n_fft // 2 and v > 0 for _, k, v in w)
    last = [v for b, _, v in spectral.mel_weights(4096, 16000.0, 40) if b == 39]
    assert sum(last) * 16000 / 4096 == pytest.approx(1, rel=0.02)


def test_several_models_need_a_key(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "lagged array<double>")
    models = spark.createDataFrame([([1.0, 1.0], [0.5]), ([9.0, 9.0], [0.0])], "coef array<double>, intercept array<double>")
    assert encoding.predict(rows, models.limit(1)).first().predicted == [3.5]
    with pytest.raises(Exception, match="several models"):
        encoding.predict(rows, models).collect()


def test_gram_over_batches_and_keys(spark):
    """Sums are the same whatever the batches, with more keys than a task holds at a time."""
    x = np.random.default_rng(1).normal(size=(3000, 3))
    df = spark.createDataFrame([(k % 200 if k % 200 else None, v[:2].tolist(), [float(v[2])]) for k, v in enumerate(x)], "fold int, lagged array<double>, y array<double>")
    got = {r.fold: r for r in encoding.gram(df, ["fold"]).collect()}
    assert len(got) == 200
    for f in (None, 1, 199):
        own = x[(f or 0) :: 200]
        assert got[f].n == 15 and np.allclose(np.reshape(got[f].xx, (2, 2)), own[:, :2].T @ own[:, :2]) and np.allclose(got[f].xy, own[:, :2].T @ own[:, 2])


def test_intake(spark):
    from voltlake.operators import intake

    a = spark.createDataFrame([("x/sub-1_run-02.vhdr",), ("x/run-10.tsv",), ("x/none.tsv",)], "path string")
    assert [r.run for r in intake.run_ids([a, a.where("path like '%10%'")]).collect()] == ["02", "10"]
    c = spark.createDataFrame([(1, "a/b/c.wav"), (1, "z.wav"), (1, "b.wav")], "k int, path string")
    assert tuple(intake.shortest_path(c, ["k"]).first()) == (1, "b.wav", 3)
    v = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 4)], "k int, v string, o int")
    assert intake.ordered_distinct(v, ["k"], "v", ["o"]).first()["values"] == ["b", "a", None]
    t = spark.createDataFrame([(" Sound ", "dog"), ("sound", None), ("Picture", " "), ("sound recording", "x"), ("Fixation Cross", None)], "e string, n string")
    assert [r[0] for r in t.select(intake.trial_type(F.col("e"), F.col("n"))).collect()] == ["dog", "stimulus", "picture", "response_audio", "fixation_cross"]
    mono = intake.downmix(signal(spark, {"A": [1, 3], "B": [3, 5]}, True))
    assert values(mono) == [2.0, 4.0] and values(intake.downmix(mono)) == [2.0, 4.0]
    for bad in (lambda: intake.time_axis(F.col("t"), 0), lambda: intake.time_axis(F.col("t"), 1, "min"), lambda: intake.event_issues(a, {}, "path"), lambda: intake.score_by("auc", a, [], "y", "p"), lambda: intake.downmix(signal(spark, {"A": [1]}, True), how="max")):
        with pytest.raises(ValueError):
            bad()
    r = spark.createDataFrame([(1, 100.0, 5), (2, 0.0, 5), (3, None, 0)], "recording int, rate double, samples int")
    assert sorted((x.recording, x.code) for x in intake.recording_issues(r).collect()) == [(2, "rate"), (3, "no_samples"), (3, "rate")]
    assert intake.column_hints(r.withColumn("Birth_Date", F.lit(1)), ["birth", "name"]) == ["Birth_Date"]


def test_scalars(spark):
    df = spark.createDataFrame([("S 31", "r_31 174183", "A12", "x10", "sub-01_task-naming_run-02.vhdr")], "m string, b string, c string, n string, f string")
    r = df.select(S.marker_code(F.col("m")).alias("m"), S.behaviour_code(F.col("b")).alias("b"), S.shaft_and_contact(F.col("c")).alias("c"), S.natural_key(F.col("n")).alias("n"), S.entity_token(F.col("f"), "run").alias("run"), S.strip_suffixes(F.col("f")).alias("stem"), S.to_sample(F.lit(1.5), 100.0, 3).alias("s")).first()
    assert r.m == 31 and tuple(r.b) == (31, "174183") and tuple(r.c) == ("A", 12) and r.n == "x000000000010" and r.run == "02" and r.stem == "sub-01_task-naming_run-02" and r.s == 153
    assert S.rate_ratio(128, 200) == (16, 25) and S.harmonics(50, 160) == [50, 100, 150] and S.lag_samples(-0.02, 0.02, 100, True) == [-2, -1, 1, 2]


def test_composites(spark):
    from voltlake.operators import composites

    on = [4, 7.5, 11, 16, 22, 29]
    ref = spark.createDataFrame([(1, float(v)) for v in on], "k long, onset double")
    raw = spark.createDataFrame([(1, v + 12.86) for v in on], "k long, onset double")
    dur = spark.createDataFrame([(1, 100.0)], "k long, duration double")
    got = composites.dialogue_events(ref, raw, dur, "k").first()
    assert got.onset == pytest.approx(16.86) and got.duration == pytest.approx(100 - 16.86)
    cand = raw.withColumn("description", F.lit("S 11")).unionByName(spark.createDataFrame([(1, float(v), "S 9") for v in (2, 5, 9, 14, 20, 27)], "k long, onset double, description string"))
    got = composites.story_events(cand, ref, dur, "k").first()
    assert got.description == "S 11" and got.hits >= 5 and got.onset == pytest.approx(15.86)
    rows = encoding.simulated(spark, 3, 1000, [0.5, 1.0]).select("recording", "t", F.array("x").alias("x"), F.array("y").alias("y"))
    m = composites.EncodingModel((0, 1), (0.1, 1e5))
    assert m.select_alpha(rows, F.col("recording")).first().alpha == 0.1 and m.score(rows, m.fit_auto(rows, F.col("recording"))).first().r > 0.9


def test_naming_trials(spark):
    from voltlake.operators import composites

    marks = [(1, 0, 78, 100), (1, 1, 100, 200), (1, 2, 126, 300), (1, 3, 78, 400), (1, 4, 126, 600)]
    markers = spark.createDataFrame(marks, "recording long, t long, code int, sample long")
    log = spark.createDataFrame([(1, 3 * k + j, kind, n) for k, n in enumerate("ab") for j, kind in enumerate(("recording", "picture", "isi"))], "recording long, t long, kind string, name string")
    seq, cat = spark.createDataFrame([(1, 1, 101), (1, 2, 31)], "recording long, position int, trigger int"), spark.createDataFrame([("a", 1), ("b", 2)], "name string, id int")
    got = composites.naming_events(markers, log, seq, cat).orderBy("onset").collect()
    assert [(r.ordinal, r.trial_type, round(r.onset, 3), r.expected) for r in got] == [(1, "recording", 0.1, True), (1, "picture", 0.2, True), (1, "isi", 0.3, True), (2, "recording", 0.4, False), (2, "picture", 0.5, False), (2, "isi", 0.6, False)]
    short = log.where("name = 'a'")
    with pytest.raises(Exception, match="differ in length"):
        composites.naming_events(markers, short, seq, cat).collect()


def test_derivative_modes(spark):
    s = signal(spark, 3.0 * np.arange(200))
    assert values(filters.derivative(s, "none", 10.0)) == (3.0 * np.arange(200)).tolist()
    for mode, k in (("diff", 1), ("absdiff", 1), ("hr", 1), ("hr", 4), ("hr_absdiff", 4)):
        assert np.allclose(values(filters.derivative(s, mode, 10.0, k))[50:150], 30.0, rtol=0.02)
    with pytest.raises(ValueError):
        filters.derivative(s, "other", 10.0)


def test_selection(spark):
    from voltlake.operators import selection

    a, b = spark.createDataFrame([(1, "p")], "k int, v string"), spark.createDataFrame([(1, "f"), (2, "f")], "k int, v string")
    assert sorted(tuple(r) for r in selection.with_fallback(a, b, ["k"]).collect()) == [(1, "p"), (2, "f")]
    docs = spark.createDataFrame([(1, [("sub-001",), ("bad",), ("sub-001",), (None,)])], "id int, items array<struct<key:string>>")
    assert [(r.pos, r.code) for r in selection.nested_faults(docs, "id", "items", "key", r"^sub-\d{3}$").orderBy("pos").collect()] == [(1, "pattern"), (2, "repeated"), (3, "pattern")]
    k = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "coef double")
    assert selection.kernel_faults(k).first().faults == 2
    df = spark.createDataFrame([("A'1", float("nan"), 5.0)], "name string, v double, p double")
    r = df.select(selection.threshold(F.col("v"), 1.0).alias("t"), selection.in_hemisphere(F.col("name"), "left").alias("l"), selection.roi_label(F.col("name"), F.col("p")).alias("roi")).first()
    assert (r.t, r.l, r.roi) == (False, True, "none")
    assert selection.aliased(df, {"label": ["NAME"], "z": ["q"]}).first().asDict() == {"label": "A'1", "z": None}
    long_ = spark.range(1).select(selection.compact(F.sequence(F.lit(1), F.lit(60)).cast("array<string>"), 3, 2).alias("c")).first().c
    assert long_ == ["1", "2", "3", "... 55 more ...", "59", "60"]
