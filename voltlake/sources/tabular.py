"""Tables, sidecars and documents: readers that type nothing by guess, and their writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = "\t") -> DataFrame:
    """All columns as text, missing values as the empty string.  A missing file fails the query."""
    r = spark.read.option("sep", sep).option("header", True).option("quote", "")
    df = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path) if columns else r.csv(path)
    return df.na.fill("")


def read_tsv_checked(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): lines that don't have the expected number of fields become issues with their line number (the header is 1)."""
    lines = numbered_lines(spark, path)
    parts = F.split("line", "\t")
    body = lines.where("line_no > 1 and trim(line) <> ''").withColumn("_p", parts)
    rows = body.where(F.size("_p") == len(columns)).select("line_no", *[F.col("_p")[k].alias(c) for k, c in enumerate(columns)])
    issues = body.where(F.size("_p") != len(columns)).select("line_no", F.lit("error").alias("level"), F.lit("field_count").alias("code"))
    return rows, issues


def numbered_lines(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """line_no (from 1), line of each file: split on the executor that reads the file, so the order is the file's own.

    With a charset (such as ISO-8859-1 for old headers) bytes are decoded by it; the source is never rewritten.
    """
    if charset:
        whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", charset).alias("value"))
    else:
        whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON lines, CSV or TSV by suffix."""
    p = path.rstrip("/").lower()
    if p.endswith((".csv", ".tsv")):
        return spark.read.option("header", True).option("sep", "\t" if p.endswith("tsv") else ",").csv(path)
    for end, form in ((".orc", "orc"), (".json", "json"), (".jsonl", "json")):
        if p.endswith(end):
            return spark.read.format(form).load(path)
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """The table, or one without rows where no path is set or nothing is there."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return read_table(spark, path)
    return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str, schema: str, form: str = "yaml") -> DataFrame:
    """YAML or JSON documents, one a file, parsed to the schema; a document that isn't a mapping is null."""

    @F.pandas_udf(T.StringType())
    def to_json(text: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            if form == "json":
                return t
            import yaml

            v = yaml.safe_load(t)
            return json.dumps(v, default=str) if isinstance(v, dict) else None

        return text.map(one)

    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("file"), F.from_json(to_json("value"), schema).alias("doc"))


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """The columns in the order given as text, nulls empty, one file."""
    out = df.orderBy(*order) if order else df
    out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    p = path.rstrip("/").lower()
    if p.endswith((".csv", ".tsv")):
        df.write.mode("overwrite").option("header", True).option("sep", "\t" if p.endswith("tsv") else ",").csv(path)
    else:
        df.write.mode("overwrite").format("orc" if p.endswith(".orc") else "json" if p.endswith((".json", ".jsonl")) else "parquet").save(path)


def write_views(signal: DataFrame, path: str) -> None:
    """A signal by view and recording: a reader of one view reads its folders only."""
    signal.repartition("view", "recording").sortWithinPartitions("view", "recording", "channel", "t").write.mode("overwrite").partitionBy("view", "recording").parquet(path)


def sidecar_json(df: DataFrame, *maps: str) -> Column:
    """The maps merged (later ones win) without nulls, as JSON."""
    return F.to_json(F.map_filter(F.map_concat(*[F.col(m) for m in maps]), lambda k, v: v.isNotNull()))


def number_distinct(df: DataFrame, name: str, number: str = "id") -> DataFrame:
    """Each different value once, numbered from 1 in order (a catalogue: small, one row a value)."""
    return df.select(name).where(F.col(name).isNotNull()).distinct().withColumn(number, F.row_number().over(Window.orderBy(name)))


def neighbour(files: DataFrame, stem: str, candidates: dict[str, int]) -> DataFrame:
    """Of each stem's files (stem, suffix) the one of the candidate suffix with the lowest rank."""
    rank = F.lit(None).cast("int")
    for suffix, r in candidates.items():
        rank = F.when(F.col("suffix") == suffix, r).otherwise(rank)
    return files.withColumn("_r", rank).where("_r is not null").groupBy(stem).agg(F.min_by("suffix", "_r").alias("suffix"))
