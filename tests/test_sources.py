"""Readers, writers and streams on small files."""

import wave

import numpy as np
from pyspark.sql import functions as F

from voltlake.sources import recordings, tabular
from voltlake.streaming import windows

SF = "/root/testdata/sf0.001"


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b", "x y", 2)], "k string, v string, n int")
    tabular.write_tsv(df, str(tmp_path / "t.tsv"), ["k", "v", "n"], ["k"])
    got = tabular.read_tsv(spark, str(tmp_path / "t.tsv"), ["k", "v", "n"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", "", "1"), ("b", "x y", "2")]
    bad = tmp_path / "bad.tsv"
    bad.write_text("k\tv\na\t1\nb\nc\t2\n")
    rows, issues = tabular.read_tsv_checked(spark, str(bad), ["k", "v"])
    assert rows.count() == 2 and [r.line_no for r in issues.collect()] == [3]
    assert tabular.read_or_empty(spark, str(tmp_path / "none.parquet"), "k string").columns == ["k"]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", "1")], "k string, v string")
    for end in ("csv", "tsv", "parquet", "orc", "jsonl"):
        tabular.write_table(df, str(tmp_path / f"t.{end}"))
        assert tabular.read_table(spark, str(tmp_path / f"t.{end}")).select("k", "v").collect() == df.collect()
    (tmp_path / "d.yaml").write_text("a: 1\nb: [x, y]\n")
    assert tabular.read_documents(spark, str(tmp_path / "d.yaml"), "a int, b array<string>").first().doc.b == ["x", "y"]


def test_markers_and_logs(spark, tmp_path):
    (tmp_path / "m.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S  1,1000,1,0\nMk3=Response,R 9,x,1,0\nMk4=Stimulus,S111,2500,1,0\n")
    got = recordings.read_markers(spark, str(tmp_path / "m.vmrk")).orderBy("index").collect()
    assert [(r["index"], r["sample"], r.code) for r in got] == [(1, 1, None), (2, 1000, 1), (4, 2500, 111)]
    (tmp_path / "l.log").write_text("Scenario\nx\nSubject\tTrial\tEvent Type\tCode\tTime\ns1\t1\tPicture\tisi\t520\ns1\t2\tSound\t31 17\ns1\t3\tSound\t99\t700\n")
    assert [r.time for r in recordings.read_log(spark, str(tmp_path / "l.log")).orderBy("line_no").collect()] == [520, 700]
    (tmp_path / "e.tsv").write_text("name\tx\ty\tz\nA1\t1\t2\t3\nA2\tn/a\t2\t3\nA1\t4\t5\t6\n")
    assert [tuple(r) for r in recordings.read_electrodes(spark, str(tmp_path / "e.tsv")).collect()] == [("A1", 4.0, 5.0, 6.0)]
    (tmp_path / "c.csv").write_text("code,name\n31,a\nx,b\n31,c\n")
    assert [tuple(r) for r in recordings.read_code_map(spark, str(tmp_path / "c.csv")).collect()] == [(31, "c")]


def test_wav_and_recording(spark, tmp_path):
    x = (np.sin(np.arange(50)) * 30000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.stack([x, -x], axis=1).tobytes())
    got = recordings.read_wav(spark, str(tmp_path / "a.wav"))
    assert [r.x for r in got.where("channel = '0'").orderBy("t").collect()] == (x / 32768).tolist() and got.first().rate == 8000
    (tmp_path / "r.vhdr").write_text("[Common Infos]\nSamplingInterval=1000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=A1,,0.5\nCh2=A2,,2\n")
    np.stack([x, x], axis=1).tofile(tmp_path / "r.eeg")
    got = recordings.read_recording(spark, str(tmp_path / "r.vhdr"))
    assert [r.x for r in got.where("channel = 'A2'").orderBy("t").collect()] == (x * 2.0).tolist() and got.first().rate == 1000


def test_textgrid_and_listing(spark, tmp_path):
    (tmp_path / "g.TextGrid").write_text('File type = "ooTextFile"\nitem []:\n item [1]:\n  class = "IntervalTier"\n  name = "words"\n  intervals [1]:\n   xmin = 0\n   xmax = 1.5\n   text = "hi"\n  intervals [2]:\n   xmin = 1.5\n   xmax = 2\n   text = ""\n item [2]:\n  class = "TextTier"\n  name = "clicks"\n  points [1]:\n   number = 0.7\n   mark = "c"\n')
    got = recordings.read_textgrid(spark, str(tmp_path / "g.TextGrid")).orderBy("tier", "start").collect()
    assert [(r.tier, r.start, r.end, r.label) for r in got] == [("clicks", 0.7, 0.7, "c"), ("words", 0.0, 1.5, "hi"), ("words", 1.5, 2.0, "")]
    for n in ("a10.txt", "a9.txt", "a1.txt"):
        (tmp_path / n).write_text("x")
    files = recordings.list_files(spark, str(tmp_path / "*.txt"))
    assert [r.name for r in files.orderBy("place").collect()] == ["a1.txt", "a9.txt", "a10.txt"]
    runs = spark.createDataFrame([("x/r1.edf", "ieeg"), ("x/r1.vhdr", "ieeg"), ("x/r1.vhdr", "eeg"), ("x/r2.fif", "eeg")], "path string, datatype string")
    assert sorted(r.path for r in recordings.discover_runs(runs, [".vhdr", ".edf", ".fif"], ["ieeg", "eeg"]).collect()) == ["x/r1.vhdr", "x/r2.fif"]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(src)
    out = windows.chunks(windows.read_events(spark, src), "1 day", late="1000 days")
    windows.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0  # nothing is older than the watermark yet
    q = windows.chunks(windows.read_events(spark, src), "1 day").writeStream.outputMode("complete").format("memory").queryName("chunks").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.chunks(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    key = lambda d: sorted((r.user_id, r.start, r.n, round(r.total, 6)) for r in d.collect())
    assert key(spark.table("chunks")) == key(batch)


def test_stream_refractory_keeps_state_over_batches(spark, tmp_path):
    from voltlake.operators import series

    src = str(tmp_path / "events")
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(src)
    windows.run_to_table(windows.refractory(windows.read_events(spark, src, 100), 86400.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.user_id, r.ts.timestamp()) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    on = ev.select(F.col("user_id").alias("recording"), (F.unix_micros("ts") / 1e6).alias("sec"))
    want = sorted((r.recording, r.sec) for r in series.refractory(on, 86400.0).collect())
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, want, strict=True))


def test_written_tables_are_cleared(spark):
    from pathlib import Path

    from voltlake import storage

    df = storage.written(spark.range(5), "five")
    files = [Path(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles()]
    assert df.count() == 5 and all(f.exists() for f in files)
    storage.clear()
    assert not any(f.exists() for f in files)
