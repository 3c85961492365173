"""Markers, logs, recordings and audio."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.functions.scalars import marker_code, natural_key
from voltlake.sources.tabular import numbered_lines

SIGNAL = "file string, channel string, t long, x double, rate double"


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Mk lines: index, kind, description, sample, size, channel, code (the number behind S)."""
    fits = numbered_lines(spark, path).where(F.rlike("line", F.lit(r"^Mk\d+=")))
    body = F.split(F.regexp_replace("line", r"^Mk\d+=", ""), ",")
    out = fits.select("file", F.regexp_extract("line", r"^Mk(\d+)=", 1).cast("int").alias("index"), body.alias("_b"))
    num = lambda k: F.try_element_at("_b", F.lit(k + 1)).try_cast("int")
    out = out.select("file", "index", F.col("_b")[0].alias("kind"), F.try_element_at("_b", F.lit(2)).alias("description"), num(2).alias("sample"), num(3).alias("size"), num(4).alias("channel"))
    return out.where("sample is not null").withColumn("code", marker_code(F.col("description")))


def read_log(spark: SparkSession, path: str, header: str = "Event Type") -> DataFrame:
    """Tab-separated log rows behind the first line that holds the header's name: line_no, subject, trial, event_type, code, time.

    Short rows are padded; rows whose time is no whole number are left out.
    """
    lines = numbered_lines(spark, path)
    first = lines.where(F.contains("line", F.lit(header))).groupBy("file").agg(F.min("line_no").alias("_h"))
    rows = lines.join(first, "file").where("line_no > _h").withColumn("_p", F.split("line", "\t"))
    at = lambda k: F.trim(F.coalesce(F.try_element_at("_p", F.lit(k)), F.lit("")))
    out = rows.select("file", "line_no", at(1).alias("subject"), at(2).try_cast("int").alias("trial"), at(3).alias("event_type"), at(4).alias("code"), at(5).try_cast("long").alias("time"))
    return out.where("time is not null")


def read_electrodes(spark: SparkSession, path: str) -> DataFrame:
    """name, x, y, z in numbers: rows that don't parse are left out, the last row of a name wins."""
    lines = numbered_lines(spark, path).withColumn("_p", F.split("line", "\t"))
    num = lambda k: F.try_element_at("_p", F.lit(k)).try_cast("double")
    rows = lines.where("line_no > 1").select(F.col("_p")[0].alias("name"), num(2).alias("x"), num(3).alias("y"), num(4).alias("z"), "line_no").where("x is not null and y is not null and z is not null")
    return rows.groupBy("name").agg(F.max_by(F.struct("x", "y", "z"), "line_no").alias("p")).select("name", "p.*")


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """code, event_name of a CSV: rows without a whole-number code are left out, the last row of a code wins."""
    rows = numbered_lines(spark, path).where("line_no > 1").withColumn("_p", F.split("line", ","))
    rows = rows.select(F.trim(F.col("_p")[0]).try_cast("int").alias("code"), F.trim(F.try_element_at("_p", F.lit(2))).alias("event_name"), "line_no").where("code is not null")
    return rows.groupBy("code").agg(F.max_by("event_name", "line_no").alias("event_name"))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """PCM samples of each file, scaled to [-1, 1): one file's bytes are decoded by the task that reads them."""

    def decode(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                with wave.open(io.BytesIO(r.content)) as w:
                    width, n, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    raw = w.readframes(w.getnframes())
                kind = {1: np.uint8, 2: "<i2", 4: "<i4"}.get(width)
                if kind is None:
                    raise ValueError(f"{width} bytes a sample")
                x = np.frombuffer(raw, kind).astype(float).reshape(-1, n)
                x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
                for c in range(n):
                    yield pd.DataFrame({"file": r.path, "channel": str(c), "t": np.arange(len(x)), "x": x[:, c], "rate": float(rate)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SIGNAL)


def read_recording(spark: SparkSession, header_path: str) -> DataFrame:
    """Multiplexed int16 or float32 recordings: .vhdr headers beside their .eeg files, joined by stem.  Scaled by each channel's resolution."""
    lines = numbered_lines(spark, header_path).withColumn("stem", F.regexp_replace("file", r"\.vhdr$", ""))
    key = lambda k: F.max(F.when(F.startswith("line", F.lit(f"{k}=")), F.substring("line", len(k) + 2, 200)))
    heads = lines.groupBy("stem").agg(key("SamplingInterval").cast("double").alias("interval"), key("BinaryFormat").alias("form"),
        F.array_sort(F.collect_list(F.when(F.rlike("line", F.lit(r"^Ch\d+=")), F.struct(F.regexp_extract("line", r"^Ch(\d+)=", 1).cast("int").alias("i"), F.split(F.regexp_replace("line", r"^Ch\d+=", ""), ",").alias("p"))))).alias("chans"))
    data = spark.read.format("binaryFile").load(header_path.replace(".vhdr", ".eeg")).select(F.regexp_replace("path", r"\.eeg$", "").alias("_stem"), "content")
    norm = lambda c: F.regexp_replace(c, "^file:/+", "/")
    met = heads.join(data, norm(F.col("stem")) == norm(F.col("_stem")))

    def decode(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                chans = [c["p"] for c in r.chans]
                x = np.frombuffer(r.content, "<f4" if "FLOAT" in (r.form or "") else "<i2").reshape(-1, len(chans)).astype(float)
                for k, p in enumerate(chans):
                    scale = float(p[2]) if len(p) > 2 and p[2] else 1.0
                    yield pd.DataFrame({"file": r.stem, "channel": p[0], "t": np.arange(len(x)), "x": x[:, k] * scale, "rate": 1e6 / r.interval})

    return met.select("stem", "interval", "form", "chans", "content").mapInPandas(decode, SIGNAL)


def list_files(spark: SparkSession, path: str, natural: bool = True) -> DataFrame:
    """path, length and name of each file with its place in natural (or plain) order within its folder."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"^(.*)/", 1).alias("folder"))
    order = natural_key(F.col("name")) if natural else F.col("name")
    return f.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(order)))


def discover_runs(files: DataFrame, extensions: list[str], kinds: list[str]) -> DataFrame:
    """files (path, datatype) -> each run's preferred file: datatypes in order, then extensions in order."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    got = files.withColumns({"run_stem": F.regexp_replace(name, r"\.[^.]+$", ""), "extension": F.regexp_extract(name, r"(\.[^.]+)$", 1)})
    rank = lambda c, order: F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c))
    got = got.withColumns({"_k": rank("datatype", kinds), "_e": rank("extension", extensions)}).where("_k > 0 and _e > 0")
    return got.groupBy("run_stem").agg(F.min_by("path", F.struct("_k", "_e", "path")).alias("path"))


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    """Intervals and points of long-form tier files: file, tier, kind, start, end, label."""
    lines = numbered_lines(spark, path).withColumn("line", F.trim("line"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = lambda key: F.when(F.rlike("line", F.lit(f"^{key} =")), F.regexp_extract("line", r'= "?(.*?)"?\s*$', 1))
    got = lines.select("file", "line_no", F.last(text("name"), True).over(w).alias("tier"), F.last(text("class"), True).over(w).alias("kind"),
        F.sum(F.rlike("line", F.lit(r"^(intervals|points) \[\d+\]")).cast("int")).over(w).alias("item"), text("xmin").alias("a"), text("xmax").alias("b"), text("(number|time)").alias("p"), text("(text|mark)").alias("label"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    items = got.where("item > 0").groupBy("file", "item").agg(*[first(c) for c in ("tier", "kind", "a", "b", "p", "label")])
    items = items.where("label is not null")
    return items.select("file", "tier", "kind", F.coalesce("a", "p").try_cast("double").alias("start"), F.coalesce("b", "p").try_cast("double").alias("end"), "label")
