"""Units, single runs, adapters and writers on small listings."""

import json

import pytest

from voltlake.operators import discovery as S


def listing(spark, **roots):
    return spark.createDataFrame([(r, p) for r, paths in roots.items() for p in paths], "root string, path string")


def test_numbered_units_share_the_folder(spark):
    files = listing(spark, a=["two.vhdr", "one.edf", "deep/three.vhdr", "behavior/x.log", "behavior/y.log", "notes.txt"], b=["notes.txt"])
    layout = S.LAYOUTS["phoneme"]
    units = S.find_units(files, layout)
    assert sorted((r.root, r.run or "", r.signal or "", r.n_behaviour, r.notes) for r in units.collect()) == [("a", "01", "one.edf", 2, "notes.txt"), ("a", "02", "two.vhdr", 2, "notes.txt"), ("b", "", "", 0, "notes.txt")]
    assert [(r.root, r.run, r.part, r.found) for r in S.unit_issues(units, layout).collect()] == [("b", None, "signal", 0)]


def test_conversation_without_audio_is_an_issue(spark):
    files = listing(spark, a=["conversation_1.vhdr", "conversation_1.wav", "conversation_2.vhdr", "conversation_2.asf", "conversation_9.wav"])
    layout = S.LAYOUTS["conversation"]
    assert [(r.run, r.part, r.found) for r in S.unit_issues(S.find_units(files, layout), layout).collect()] == [("2", "audio", 0)]


def test_no_files_no_units(spark):
    for layout in S.LAYOUTS.values():
        assert S.find_units(listing(spark), layout).count() == 0


def test_several_runs_fail(spark):
    files = listing(spark, a=["x", "x"], b=["y"])
    assert sorted(map(tuple, S.one_run(files, ["root"]).collect())) == [("a", "x"), ("b", "y")]
    with pytest.raises(Exception, match="several runs match: a"):
        S.one_run(listing(spark, a=["x", "z"]), ["root"]).collect()


def test_adapters(spark):
    assert S.adapter_of(" TASK-naming").layout is S.LAYOUTS["naming"]
    with pytest.raises(ValueError, match="unknown task"):
        S.adapter_of("other")
    S.add_adapter(S.Adapter("mine", S.LAYOUTS["story"], prepare=lambda e: e.where("code = 1")))
    try:
        events = spark.createDataFrame([(1,), (2,)], "code int")
        assert S.adapter_of("mine").prepare(events).count() == 1
    finally:
        del S.ADAPTERS["mine"]


def test_scores_by_the_first_key_there_is(spark):
    e = spark.createDataFrame([("A1", "c1"), ("A2", "c2")], "name string, channel string")
    by = lambda s: {r.name: r.score for r in S.align_scores(e, s, "r", ["i"]).collect()}
    assert by(spark.createDataFrame([("A1", "A2", 1.0, 0), ("A1", "A2", 2.0, 1)], "electrode string, name string, r double, i int")) == {"A1": 2.0, "A2": None}
    assert by(spark.createDataFrame([("c2", 3.0, 0)], "channel string, r double, i int")) == {"A1": None, "A2": 3.0}
    assert by(spark.createDataFrame([(3.0, 0)], "r double, i int")) == {"A1": None, "A2": None}


def test_channel_modes(spark):
    audio = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 4.0)], "recording int, t int, channel int, x double")
    assert [S.audio_channels(audio, m, own=1).first().x for m in ("mean", "self", "other")] == [3.0, 4.0, 2.0]
    assert S.audio_channels(audio, "all").count() == 2
    with pytest.raises(ValueError, match="unknown channel mode"):
        S.audio_channels(audio, "both")


def test_writers_round_trip(spark, tmp_path):
    signal = spark.createDataFrame([("1", "2", "x", "01", t, float(t)) for t in range(5)], "sub string, ses string, task string, run string, t long, x double")
    S.write_recording(signal, f"{tmp_path}/raw")
    assert sorted(r.t for r in spark.read.parquet(f"{tmp_path}/raw").where("run = '01'").collect()) == list(range(5))
    S.write_json_rows(spark.createDataFrame([("a", [1.5, 2.0], None)], "name string, shifts array<double>, note string"), f"{tmp_path}/report")
    assert json.loads(spark.read.text(f"{tmp_path}/report").first().value) == {"name": "a", "shifts": [1.5, 2.0], "note": None}
    with pytest.raises(ValueError, match="needs tables"):
        S.assemble({})


def test_log_trials_are_strict(spark):
    from voltlake.operators import alignment as A

    log = "recording int, t int, event_type string, code string, ms long"
    good = [(1, 0, "Picture", "start", 0), (1, 1, "Sound Recording", "Mic_Rec", 5), (1, 2, "Picture", "dog.bmp", 7), (1, 3, "Picture", "isi", 9), (1, 4, "Response", "3", 11), (1, 5, "Picture", "pause", 12)]
    rows = spark.createDataFrame(good, log)
    assert [tuple(r) for r in A.log_trials(rows).collect()] == [(1, 1, 5, 7, 9, "dog.bmp", None)]
    assert {(r.trial_type, r.ms, r.marker) for r in A.log_extras(rows).collect()} == {("button_press", 11, 3), ("pause_onset", 12, 100), ("run_start", 0, None)}
    for spoilt, why in ((good[:3], "incomplete"), (good[:2] + [good[4], good[3]], "no picture"), ([*good[:3], (1, 3, "Picture", "pause", 9)], "no isi"), ([good[1], (1, 2, None, None, 7), good[3]], "no picture")):
        spoilt = spark.createDataFrame(spoilt, log)
        assert [r.fault for r in A.log_trials(spoilt, strict=False).collect()] == [why]
        with pytest.raises(Exception, match=why):
            A.log_trials(spoilt).collect()
    assert A.log_trials(rows.limit(0)).collect() == []


def test_public_registry_rows(spark):
    from voltlake.operators import registry as R

    rows = [(1, "d|sub-001|ses-1|a|none", "d", "sub-001", "ses-1", "a", None), (2, "d|sub-001|ses-1|a|none", "d", "sub-001", "ses-1", "a", " "), (3, None, "d", "x", None, "a", "p"), (4, " ", "", "", "ses_1", "", ""), (5, "d|sub-001|ses-1|a|q", "d", "sub-001", "ses-1", "a", "p"), (6, "free", "d", None, "ses-1", "a", "p")]
    df = spark.createDataFrame(rows, "i int, record_id string, dataset_id string, subject string, session string, acquisition_id string, protocol_id string")
    want = [(2, "error", "record_id_repeated"), (3, "error", "record_id_missing"), (3, "error", "subject_pattern"), (4, "error", "record_id_missing"), (4, "warning", "session_pattern"), (5, "error", "record_id_mismatch")]
    assert sorted(map(tuple, R.public_issues(df, "i").collect())) == want
    assert R.public_issues(df.limit(0), "i").collect() == []
