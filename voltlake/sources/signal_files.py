"""Binary recordings (BrainVision, EDF, WAV) as a Spark data source that reads byte ranges.

``spark.read.format("signal_files")`` gives file, channel, t, x, rate.  A file is cut into ranges of ``split_bytes``, so
one long file is read by many tasks and a task holds one piece of its range.  Filters on file, channel and t (pushed
down where ``spark.sql.python.filterPushdown.enabled`` and the option push are on, or given as the options channels,
start and stop, which always work) decide which bytes are read: time bounds cut the range; a channel's own bytes alone are read where the
format keeps them together (EDF records, vectorised BrainVision), multiplexed frames are read whole and the channel is
picked out.  Only the columns of a given schema are made.

Headers are read where the ranges are planned; paths are opened by pyarrow's file systems, on the driver and by tasks.
"""

from __future__ import annotations

import posixpath
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voltlake.operators.blocks import types_of

SCHEMA = "file string, channel string, t long, x double, rate double"
ENDS = (".vhdr", ".edf", ".wav")
#: Bytes of a range, bytes that opening a file counts for, and samples of an Arrow batch.
SPLIT_BYTES, OPEN_BYTES, BATCH = 64 << 20, 1 << 20, 1 << 16


@dataclass
class Channel:
    """One channel: its name, scale and place within a unit (a frame or record)."""

    name: str
    gain: float
    offset: float
    place: int  # bytes from the unit's start; of the file's data where it is vectorised
    samples: int  # in a unit


@dataclass
class Layout:
    """Where a file's samples lie: units (frames or records) of fixed size from a first byte on."""

    path: str
    first: int
    unit: int
    units: int
    kind: str  # numpy's name of a sample, or i3 for three bytes
    rate: float  # units a second
    channels: list[Channel] = field(default_factory=list)
    vectorised: bool = False
    together: bool = False  # a unit keeps a channel's samples together, so that the others can be passed over

    @property
    def width(self) -> int:
        return 3 if self.kind == "i3" else np.dtype(self.kind).itemsize


def opened(path: str) -> tuple[fs.FileSystem, str]:
    path = f"/{path[5:].lstrip('/')}" if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files below a folder (or the file itself) with a known suffix."""
    system, at = opened(path)
    info = system.get_file_info(at)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(scheme + f.path for f in files if f.type == fs.FileType.File and f.path.lower().endswith(ENDS))


def layout(path: str) -> Layout:
    low = path.lower()
    return edf_layout(path) if low.endswith(".edf") else wav_layout(path) if low.endswith(".wav") else brainvision_layout(path)


def _head(path: str, n: int, at: int = 0) -> tuple[bytes, int]:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        return f.read_at(min(n, max(f.size() - at, 0)), at), f.size()


def edf_layout(path: str) -> Layout:
    """A fixed header of 256 bytes and 256 a signal, all text; then records of each signal's 16-bit samples in turn.

    Annotation signals give no samples.  A count of records that is -1 (not closed) or too large comes from the file's size.
    """
    head, size = _head(path, 256)
    n = int(head[252:256])
    text = _head(path, 256 * n, 256)[0].decode("latin-1")

    def column(at: int, width: int) -> list[str]:
        return [text[n * at + width * k : n * at + width * (k + 1)].strip() for k in range(n)]

    names, low, high, bottom, top, samples = column(0, 16), column(104, 8), column(112, 8), column(120, 8), column(128, 8), column(216, 8)
    first, duration = int(head[184:192]), float(head[244:252])
    unit = 2 * sum(map(int, samples))
    units = (size - first) // unit if unit else 0
    stated = int(head[236:244])
    units, channels, place = min(units, stated) if stated >= 0 else units, [], 0
    for k in range(n):
        if not names[k].startswith("EDF Annotations"):
            gain = (float(high[k]) - float(low[k])) / (int(top[k]) - int(bottom[k]))
            channels.append(Channel(names[k], gain, float(low[k]) - gain * int(bottom[k]), place, int(samples[k])))
        place += 2 * int(samples[k])
    return Layout(path, first, unit, units, "<i2", 1 / duration if duration else 1.0, channels, together=True)


def wav_layout(path: str) -> Layout:
    """RIFF or RF64: the chunk that gives the format, then the one that holds the samples; whole numbers are scaled to [-1, 1)."""
    head, size = _head(path, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError(f"{path} is no WAV file")
    at, form = 12, None
    while at + 8 <= size:
        chunk, _ = _head(path, 40, at)
        name, length = chunk[:4], struct.unpack("<I", chunk[4:8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", chunk[8:24])
            code = struct.unpack("<H", chunk[32:34])[0] if form[0] == 0xFFFE else form[0]
        elif name == b"data":
            break
        at += 8 + length + length % 2
    if form is None or at + 8 > size:
        raise ValueError(f"{path} has no format or no samples")
    _, n, rate, _, unit, bits = form
    kinds = {(1, 8): ("u1", 1 / 128, -1.0), (1, 16): ("<i2", 2.0**-15, 0.0), (1, 24): ("i3", 2.0**-23, 0.0), (1, 32): ("<i4", 2.0**-31, 0.0), (3, 32): ("<f4", 1.0, 0.0), (3, 64): ("<f8", 1.0, 0.0)}
    if (code, bits) not in kinds:
        raise ValueError(f"{path}: format {code} of {bits} bits")
    kind, gain, offset = kinds[code, bits]
    held = size - at - 8 if length == 0xFFFFFFFF else min(length, size - at - 8)
    return Layout(path, at + 8, unit, held // unit, kind, float(rate), [Channel(str(c), gain, offset, c * bits // 8, 1) for c in range(n)])


def brainvision_layout(path: str) -> Layout:
    """The text header names the file of the samples, their form and each channel's resolution (1 where it is left out)."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        raw = f.read()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    value = dict(re.findall(r"(?m)^(\w+)=(.*?)\r?$", text))
    kind = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}[value.get("BinaryFormat", "INT_16").strip()]
    width = np.dtype(kind).itemsize
    stem = posixpath.splitext(posixpath.basename(path))[0]
    data = value.get("DataFile", f"{stem}.eeg").strip().replace("$b", stem)
    data = posixpath.join(posixpath.dirname(path), data)
    rows = sorted((int(k[2:]), v.split(",")) for k, v in value.items() if re.fullmatch(r"Ch\d+", k) and "," in v)
    size, n = _head(data, 0)[1], len(rows)
    vectorised = value.get("DataOrientation", "MULTIPLEXED").strip().upper() == "VECTORIZED"
    units = size // (width * n) if n else 0
    gains = [float(p[2]) if len(p) > 2 and p[2].strip() else 1.0 for _, p in rows]
    channels = [Channel(p[0].replace(r"\1", ","), g, 0.0, k * width * (units if vectorised else 1), 1) for k, ((_, p), g) in enumerate(zip(rows, gains))]
    return Layout(data, 0, width if vectorised else width * n, units, kind, 1e6 / float(value["SamplingInterval"]), channels, vectorised)


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    if kind != "i3":
        return np.frombuffer(raw, kind).astype(float)
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(float) - 0x800000


def samples_of(lay: Layout, channels: Sequence[Channel], first: int, last: int, read_at: Callable[[int, int], bytes]) -> Iterator[tuple[Channel, int, np.ndarray]]:
    """(channel, place of its first sample, values) of the units from first to last, some units at a time.  read_at(n, at) gives bytes."""
    step = max(BATCH // max((c.samples for c in lay.channels), default=1), 1)
    for a in range(first, last, step):
        b = min(a + step, last)
        if lay.vectorised:
            parts = {c.place: read_at((b - a) * lay.width, lay.first + c.place + a * lay.width) for c in channels}
        elif lay.together and len(channels) < len(lay.channels):
            parts = {c.place: b"".join(read_at(c.samples * lay.width, lay.first + u * lay.unit + c.place) for u in range(a, b)) for c in channels}
        else:
            grid = np.frombuffer(read_at((b - a) * lay.unit, lay.first + a * lay.unit), np.uint8).reshape(b - a, lay.unit)
            parts = {c.place: grid[:, c.place : c.place + c.samples * lay.width].tobytes() for c in channels}
        for c in channels:
            yield c, a * c.samples, _numbers(parts[c.place], lay.kind) * c.gain + c.offset


@dataclass
class Range:
    """Units from first to last of a file."""

    file: str
    layout: Layout
    channels: list[Channel]
    first: int
    last: int
    size: int  # bytes


class Ranges(InputPartition):
    """A task's ranges: one of a long file, or several short files."""

    def __init__(self, ranges: list[Range]):
        super().__init__(None)
        self.ranges = ranges


class SignalReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.split, self.columns = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), columns
        self.channels = set(options["channels"].split("\n")) if options.get("channels") else None
        self.files: set[str] | None = None
        self.start, self.stop = int(options.get("start", 0)), int(options["stop"]) if options.get("stop") else None

    def partitions(self) -> list[Ranges]:
        files = [f for f in listed(self.path) if self.files is None or f in self.files]
        with ThreadPoolExecutor(16) as pool:
            layouts = list(pool.map(layout, files))
        out = []
        for file, lay in zip(files, layouts):
            picked = [c for c in lay.channels if self.channels is None or c.name in self.channels]
            most, least = max((c.samples for c in picked), default=0), min((c.samples for c in picked), default=0)
            if not least:
                picked, least = [c for c in picked if c.samples], min((c.samples for c in picked if c.samples), default=1)
            if not picked:
                continue
            # the units that hold samples from start to before stop, of the channel with the most (fewest) in a unit
            first = min(max(self.start, 0) // most, lay.units)
            last = lay.units if self.stop is None else min(lay.units, max(-(-self.stop // least), first))
            size = lay.unit * (len(lay.channels) if lay.vectorised else 1)
            step = max(self.split // max(size, 1), 1)
            out += [Range(file, lay, picked, a, min(a + step, last), size * (min(a + step, last) - a)) for a in range(first, last, step)]
        packed, held = [Ranges([])], 0
        for r in out:
            weight = max(r.size, OPEN_BYTES)
            if packed[-1].ranges and held + weight > self.split:
                packed.append(Ranges([]))
                held = 0
            packed[-1].ranges.append(r)
            held += weight
        return packed

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from self._read(r)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, name = opened(partition.layout.path)
        kinds = {"file": pa.string(), "channel": pa.string(), "t": pa.int64(), "x": pa.float64(), "rate": pa.float64()}
        with system.open_input_file(name) as f:
            for c, at, x in samples_of(partition.layout, partition.channels, partition.first, partition.last, f.read_at):
                t = np.arange(at, at + len(x))
                keep = (t >= self.start) & (t < (self.stop if self.stop is not None else at + len(x)))
                t, x = t[keep], x[keep]
                for k in range(0, len(t), BATCH):
                    n = min(BATCH, len(t) - k)
                    made = {"file": [partition.file] * n, "channel": [c.name] * n, "t": t[k : k + n], "x": x[k : k + n], "rate": np.full(n, partition.layout.rate * c.samples)}
                    yield pa.RecordBatch.from_arrays([pa.array(made[o], kinds[o]) for o in self.columns], names=self.columns)


class PushedReader(SignalReader):
    """With filters pushed down; Spark refuses it where the setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows what is read; Spark still applies all of them."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name in ("channel", "file") and isinstance(f, EqualTo | In):
                found, own = set(f.value if isinstance(f, In) else [f.value]), "channels" if name == "channel" else "files"
                setattr(self, own, found if getattr(self, own) is None else getattr(self, own) & found)
            elif name == "t" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.value is not None:
                v = int(f.value)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.start = max(self.start, v + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    stop = v + (not isinstance(f, LessThan))
                    self.stop = stop if self.stop is None else min(self.stop, stop)
            yield f


class SignalFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signal_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SignalReader:
        push = str(self.options.get("push", "false")).lower() == "true"
        return (PushedReader if push else SignalReader)(dict(self.options), schema.names)


def read_signals(spark: SparkSession, path: str, channels: Sequence[str] | None = None, start: int | None = None, stop: int | None = None, columns: Sequence[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, channel, t, x, rate (or the columns asked for) of a recording or of all below a folder, t from start to before stop."""
    spark.dataSource.register(SignalFiles)
    reader = spark.read.format("signal_files").option("split_bytes", split_bytes).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, v in (("channels", "\n".join(channels) if channels else None), ("start", start), ("stop", stop)):
        reader = reader if v is None else reader.option(name, v)
    if columns:
        kinds = dict(f.split() for f in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def edf_header(names: Sequence[str], records: int, duration: float, samples: Sequence[int], low: float, high: float) -> bytes:
    """A header for signals that share one physical range."""

    def text(v: object, width: int) -> bytes:
        s = str(v)
        if len(s) > width:
            raise ValueError(f"{s} has more than {width} characters")
        return s.ljust(width).encode("ascii", "replace")

    n = len(names)
    head = b"".join(text(v, w) for v, w in (("0", 8), ("", 80), ("", 80), ("01.01.00", 8), ("00.00.00", 8), (256 * (n + 1), 8), ("", 44), (records, 8), (f"{duration:g}", 8), (n, 4)))
    columns = ((names, 16), ([""] * n, 80), (["uV"] * n, 8), ([f"{low:g}"] * n, 8), ([f"{high:g}"] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), (samples, 8), ([""] * n, 32))
    return head + b"".join(text(v, width) for values, width in columns for v in values)


def write_edf(signal: DataFrame, folder: str, rate: float, low: float, high: float, key: str = "recording") -> DataFrame:
    """signal (key, channel, t from 0, x) -> (key, file): one EDF file a recording, its values rounded to 65,536 steps from low to high.

    Channels of a recording are of one length; a record holds one sample of each.  A task holds one recording as 16-bit
    numbers.  A rerun writes the same files.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="t", columns="channel", values="x")
        if grid.isna().any(axis=None):
            raise ValueError(f"channels of {pdf[key].iloc[0]} differ in length")
        steps = np.clip(np.round((grid.to_numpy() - low) / (high - low) * 65535), 0, 65535) - 32768
        file = posixpath.join(folder, f"{key}-{pdf[key].iloc[0]}.edf")
        system, name = opened(file)
        system.create_dir(posixpath.dirname(name), recursive=True)
        with system.open_output_stream(name) as out:
            out.write(edf_header([str(c) for c in grid.columns], len(grid), 1 / rate, [1] * grid.shape[1], low, high))
            out.write(steps.astype("<i2").tobytes())
        return pd.DataFrame({key: pdf[key].iloc[:1], "file": [file]})

    return signal.select(key, F.col("channel").cast("string").alias("channel"), "t", "x").groupBy(key).applyInPandas(write, f"{types_of(signal, [key])}, file string")
