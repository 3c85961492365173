"""The byte-range source on written files: formats, splits, filters, and which bytes are read."""

import struct
import wave

import numpy as np
import pytest

from voltlake.sources import signal_files as S


def edf(path, samples, records, names=None, stated=None):
    """Signals of ``samples[k]`` samples a record (an annotation signal last), physical range -100 to 300, records of 2 s."""
    rng, n = np.random.default_rng(1), len(samples)
    names = names or [f"E{k}" for k in range(n)]
    data = [rng.integers(-32768, 32768, (records, s)).astype("<i2") for s in samples]
    head = S.edf_header([*names, "EDF Annotations"], records if stated is None else stated, 2.0, [*samples, 3], -100, 300)
    with open(path, "wb") as f:
        f.write(head)
        for r in range(records):
            for d in data:
                f.write(d[r].tobytes())
            f.write(b"+0\x14\x14\x00\x00")
    return {c: (d.ravel().astype(float) + 32768) / 65535 * 400 - 100 for c, d in zip(names, data)}


def of(df):
    out = {}
    for r in df.collect():
        key = (r["file"].rsplit("/", 1)[1], r["channel"])
        assert r["t"] not in out.setdefault(key, {})
        out[key][r["t"]] = (r["x"], r["rate"])
    return out


def equal(got, want, rate):
    assert sorted(got) == list(range(min(got), min(got) + len(got)))
    np.testing.assert_allclose([got[t][0] for t in sorted(got)], want[min(got) : max(got) + 1], atol=1e-9)
    assert {v[1] for v in got.values()} == {rate}


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_edf(spark, tmp_path, split):
    want = edf(tmp_path / "a.edf", [10, 40, 1], 23)
    edf(tmp_path / "open.edf", [5], 7, ["A"], stated=-1)
    got = of(S.read_signals(spark, str(tmp_path), split_bytes=split))
    assert set(got) == {("a.edf", "E0"), ("a.edf", "E1"), ("a.edf", "E2"), ("open.edf", "A")} and len(got["open.edf", "A"]) == 35
    for c, n in (("E0", 10), ("E1", 40), ("E2", 1)):
        assert len(got["a.edf", c]) == 23 * n
        equal(got["a.edf", c], want[c], n / 2)
    some = of(S.read_signals(spark, str(tmp_path / "a.edf"), channels=["E1", "E2"], start=13, stop=500, split_bytes=split))
    assert {k: (min(v), max(v)) for k, v in some.items()} == {("a.edf", "E1"): (13, 499), ("a.edf", "E2"): (13, 22)}
    equal(some["a.edf", "E1"], want["E1"], 20)


@pytest.mark.parametrize("push", ["true", "false"])
def test_filters_are_pushed(spark, tmp_path, push):
    want = edf(tmp_path / "a.edf", [10, 40], 30)
    edf(tmp_path / "b.edf", [10, 40], 30)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
    try:
        df = S.read_signals(spark, str(tmp_path), split_bytes=200)
        got = of(df.where("channel = 'E1' AND t >= 100 AND t < 190 AND t != 150"))
        assert {k: len(v) for k, v in got.items()} == {("a.edf", "E1"): 89, ("b.edf", "E1"): 89}
        assert [got["a.edf", "E1"][t][0] for t in (100, 189)] == pytest.approx([want["E1"][100], want["E1"][189]])
        assert df.where("t = 5 AND channel IN ('E0', 'x')").count() == 2 and df.where("channel = 'none'").count() == 0 and df.where("t > 5 AND t <= 5").count() == 0
        one = df.where(df["file"] == f"{tmp_path}/a.edf")
        assert one.select("file").distinct().count() == 1 and one.count() == 1500
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_asked_bytes_are_read(tmp_path, monkeypatch):
    """In this process: the bytes that ranges ask for."""
    edf(tmp_path / "a.edf", [100, 100, 800], 50)
    read = []

    def counted(lay, channels, first, last, read_at):
        def at(n, a):
            read.append(n)
            return read_at(n, a)

        return samples(lay, channels, first, last, at)

    samples = S.samples_of
    monkeypatch.setattr(S, "samples_of", counted)
    for options, most in (({}, 50 * 2006), ({"channels": "E0"}, 50 * 200), ({"channels": "E0", "start": "1000", "stop": "1200"}, 400), ({"start": "1000", "stop": "1050"}, 11 * 2006)):
        read.clear()
        r = S.SignalReader({"path": str(tmp_path), "split_bytes": "5000", **options}, ["t", "x"])
        n = sum(b.num_rows for p in r.partitions() for b in r.read(p))
        assert n and sum(read) <= most and max(read) <= 5000
    r = S.PushedReader({"path": str(tmp_path)}, ["t", "x"])
    list(r.pushFilters([S.EqualTo(("channel",), "E0"), S.GreaterThan(("t",), 999), S.LessThanOrEqual(("t",), 1199)]))
    read.clear()
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 200 and sum(read) == 400


def test_wav(spark, tmp_path):
    rng = np.random.default_rng(2)
    for width, kind in ((1, np.uint8), (2, "<i2"), (4, "<i4")):
        x = rng.integers(np.iinfo(kind).min, np.iinfo(kind).max, (301, 2)).astype(kind)
        with wave.open(str(tmp_path / f"w{width}.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(width), w.setframerate(8000)
            w.writeframes(x.tobytes())
        got = of(S.read_signals(spark, str(tmp_path / f"w{width}.wav"), split_bytes=150))
        scaled = (x.astype(float) - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
        for c in (0, 1):
            assert len(got[f"w{width}.wav", str(c)]) == 301
            equal(got[f"w{width}.wav", str(c)], scaled[:, c], 8000)
    y = rng.integers(-(2**23), 2**23, 50)
    raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in y)
    z = rng.normal(size=(20, 1)).astype("<f4")
    for name, body, form in (("three", raw, (1, 1, 44100, 132300, 3, 24)), ("float", z.tobytes(), (3, 1, 44100, 176400, 4, 32))):
        chunks = b"fmt " + struct.pack("<IHHIIHH", 16, *form) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)
    equal(of(S.read_signals(spark, str(tmp_path / "three.wav")))["three.wav", "0"], y / 2.0**23, 44100)
    equal(of(S.read_signals(spark, str(tmp_path / "float.wav")))["float.wav", "0"], z[:, 0].astype(float), 44100)
    (tmp_path / "bad.wav").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no WAV"):
        S.read_signals(spark, str(tmp_path / "bad.wav")).count()


@pytest.mark.parametrize("vectorised", [False, True])
@pytest.mark.parametrize("kind", ["INT_16", "INT_32", "IEEE_FLOAT_32"])
def test_brainvision(spark, tmp_path, vectorised, kind):
    x = (np.random.default_rng(3).normal(size=(211, 3)) * 1000).astype({"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}[kind])
    (x.T.copy() if vectorised else x).tofile(tmp_path / "data.eeg")
    head = f"[Common Infos]\r\nDataFile=data.eeg\r\nDataOrientation={'VECTORIZED' if vectorised else 'MULTIPLEXED'}\r\nSamplingInterval=2000\r\n[Binary Infos]\r\nBinaryFormat={kind}\r\n[Channel Infos]\r\nCh1=A1,,0.5,\xb5V\r\nCh2=B\\1C,,\r\nCh3=C3,ref,2\r\n"
    (tmp_path / "r.vhdr").write_bytes(head.encode("latin-1"))
    got = of(S.read_signals(spark, str(tmp_path), split_bytes=300))
    for k, (c, gain) in enumerate((("A1", 0.5), ("B,C", 1.0), ("C3", 2.0))):
        assert len(got["r.vhdr", c]) == 211
        equal(got["r.vhdr", c], x[:, k].astype(float) * gain, 500)
    some = of(S.read_signals(spark, str(tmp_path / "r.vhdr"), channels=["C3"], start=200, split_bytes=300))
    equal(some["r.vhdr", "C3"], x[:, 2] * 2.0, 500)


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: many ranges, and its last samples are read alone."""
    n = 3 << 30
    with open(tmp_path / "big.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 1000, 2000, 2, 16) + b"data" + struct.pack("<I", n))
        f.seek(44 + n - 20)
        f.write(np.arange(1, 11).astype("<i2").tobytes())
    whole = S.read_signals(spark, str(tmp_path / "big.wav"))
    assert whole.rdd.getNumPartitions() == 48
    end = S.read_signals(spark, str(tmp_path / "big.wav"), start=n // 2 - 12).orderBy("t").collect()
    assert [r.x * 32768 for r in end] == [0, 0, *range(1, 11)] and end[-1].t == n // 2 - 1


def test_columns_empty_and_written(spark, tmp_path):
    rows = [(r, c, t, float(t * t - 3 * r)) for r in (1, 2) for c in ("a", "b") for t in range(20 * r)]
    S.write_edf(spark.createDataFrame(rows, "recording int, channel string, t long, x double"), str(tmp_path / "out"), 10.0, -100.0, 2000.0).count()
    got = of(S.read_signals(spark, str(tmp_path / "out")))
    assert set(got) == {(f"recording-{r}.edf", c) for r in (1, 2) for c in ("a", "b")}
    for r, c, t, x in rows:
        assert abs(got[f"recording-{r}.edf", c][t][0] - x) <= 2100 / 65535 / 2 + 1e-9
    assert S.read_signals(spark, str(tmp_path / "out"), columns=["t", "x"]).columns == ["t", "x"]
    assert S.read_signals(spark, str(tmp_path / "out"), columns=["x"]).count() == len(rows)
    (tmp_path / "none").mkdir()
    assert S.read_signals(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="missing"):
        S.read_signals(spark, str(tmp_path / "missing")).count()
