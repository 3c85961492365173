"""From file listings to units of work: task layouts, single runs, derived names, manifests, checks of documents, and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.channels import common_average
from voltlake.operators.permutations import rotations
from voltlake.operators.registry import issues


@dataclass(frozen=True)
class Part:
    """One kind of file of a unit: a pattern on the path (group 1, if it has one, is the run) and how many a unit may have."""

    pattern: str
    least: int = 1
    most: int | None = 1
    has_run: bool = False


@dataclass(frozen=True)
class Layout:
    """What a task's source folder holds.  Units are told by the main part: by its run, by its place among the folder's main files (numbered), or one a folder."""

    main: str
    parts: dict[str, Part]
    numbered: bool = False


#: Layouts by task.
LAYOUTS = {
    "conversation": Layout("signal", {"signal": Part(r"(?:^|/)conversation_([^/]*)\.vhdr$", has_run=True), "audio": Part(r"(?:^|/)conversation_([^/]*)\.wav$", has_run=True), "video": Part(r"(?:^|/)conversation_([^/]*)\.asf$", 0, has_run=True)}),
    "phoneme": Layout("signal", {"signal": Part(r"^[^/]*\.(?:vhdr|edf)$"), "behaviour": Part(r"^behavior/", 0, None), "stimuli": Part(r"^stimuli/", 0, None), "notes": Part(r"^notes\.txt$", 0)}, numbered=True),
    "naming": Layout("signal", {"signal": Part(r"\.vhdr$"), "markers": Part(r"\.vmrk$"), "log": Part(r"(?:^|/)seq_[^/]*/[^/]*\.log$")}),
    "story": Layout("signal", {"signal": Part(r"\.vhdr$")}),
}


def find_units(files: DataFrame, layout: Layout, root: str = "root", path: str = "path") -> DataFrame:
    """files (root, path below it) -> root, run, and for each part its first path by name and ``n_<part>``.

    A folder whose files hold no main part keeps one row, with a null run.  Where units are numbered or one a folder,
    the parts that name no run belong to every unit of the folder.
    """
    found = None
    for name, part in layout.parts.items():
        run = F.regexp_extract(path, part.pattern, 1) if part.has_run else F.lit(None).cast("string")
        rows = files.where(F.rlike(F.col(path), F.lit(part.pattern))).select(root, F.lit(name).alias("part"), run.alias("run"), path)
        found = rows if found is None else found.unionByName(rows)
    main = found.where(F.col("part") == layout.main)
    by_run = layout.parts[layout.main].has_run
    if by_run:
        units = main.select(root, "run").distinct()
    elif layout.numbered:
        ordered = main.groupBy(root).agg(F.array_sort(F.collect_set(path)).alias("_all"))  # the main files of one folder
        units = ordered.select(root, F.posexplode("_all").alias("_i", "_main")).select(root, F.lpad((F.col("_i") + 1).cast("string"), 2, "0").alias("run"), "_main")
    else:
        units = main.select(root, F.lit("01").alias("run")).distinct()
    units = files.select(root).distinct().join(units, root, "left")
    keys = [root, "run"] if by_run else [root]
    counts = []
    for name in layout.parts:
        is_part = F.col("part") == name
        counts += [F.min(F.when(is_part, F.col(path))).alias(name), F.count_if(is_part).alias(f"n_{name}")]
    met = units.join(found.groupBy(*keys).agg(*counts), keys, "left").fillna(0, [f"n_{name}" for name in layout.parts])
    if layout.numbered:
        met = met.withColumns({layout.main: F.col("_main"), f"n_{layout.main}": F.when(F.col("_main").isNull(), 0).otherwise(1).cast("long")}).drop("_main")
    return met


def unit_issues(units: DataFrame, layout: Layout, key: Sequence[str] = ("root", "run")) -> DataFrame:
    """key, part, found: the parts of which a unit has fewer or more files than its layout allows."""
    wrong = []
    for name, part in layout.parts.items():
        n = F.col(f"n_{name}")
        bad = (n < part.least) | (n > part.most) if part.most is not None else n < part.least
        wrong.append(F.when(bad, F.struct(F.lit(name).alias("part"), n.alias("found"))))
    return units.select(*key, F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("_w")).select(*key, "_w.part", "_w.found")


@dataclass(frozen=True)
class Adapter:
    """How a task is read: its layout, and callables that load a unit's signal, prepare its events, and act after writing."""

    task: str
    layout: Layout
    load: Callable[..., DataFrame] | None = None
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda events: events)
    after: Callable[[DataFrame], None] = field(default=lambda written: None)


ADAPTERS: dict[str, Adapter] = {task: Adapter(task, layout) for task, layout in LAYOUTS.items()}


def add_adapter(adapter: Adapter) -> None:
    ADAPTERS[adapter.task] = adapter


def adapter_of(task: str) -> Adapter:
    """The adapter by name, in any case and with or without ``task-``."""
    name = task.strip().lower().removeprefix("task-")
    if name not in ADAPTERS:
        raise ValueError(f"unknown task {task}, known are {sorted(ADAPTERS)}")
    return ADAPTERS[name]


def one_run(listing: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """keys, path: the single file of each; several different ones fail the query."""
    many = F.countDistinct(path)
    one = F.when(many > 1, F.raise_error(F.concat(F.lit("several runs match: "), F.concat_ws("/", *[F.first(F.col(k).cast("string")) for k in keys]))).cast("string")).otherwise(F.min(path))
    return listing.where(F.col(path).isNotNull()).groupBy(*keys).agg(one.alias(path))


def electrodes_path(root: Column, subject: Column, session: Column) -> Column:
    """Where a subject's electrode table lies; without a session its folder and name part are left out."""
    sub = F.concat(F.lit("sub-"), F.regexp_replace(subject, "^sub-", ""))
    ses = F.when(F.coalesce(session, F.lit("")) != "", F.concat(F.lit("ses-"), F.regexp_replace(session, "^ses-", "")))
    return F.concat_ws("/", root, sub, ses, F.lit("ieeg"), F.concat(F.concat_ws("_", sub, ses), F.lit("_electrodes.tsv")))


def behaviour_kind(path: Column) -> Column:
    """The kind of a behaviour file by its suffix, in any case."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(suffix == ".wav", "response_audio").when(suffix == ".log", "presentation_log").when(suffix.isin(".sce", ".pcl", ".exp"), "presentation_script").otherwise("behavior_aux")


def stimulus_lookup(rows: DataFrame, stimulus: str, number: str, order: Sequence[str]) -> DataFrame:
    """The first row of each stimulus, in the order of the catalogue's numbers."""
    first = rows.groupBy(stimulus).agg(F.min_by(number, F.struct(*order)).alias(number), F.count(F.lit(1)).alias("uses"))
    return first.orderBy(number, stimulus)


def trigger_id(subject: Column, run: Column, known: dict[tuple[str, str], int]) -> Column:
    """The trigger number of a subject's run from a constant table; null where there is none."""
    if not known:
        return F.lit(None).cast("int")
    table = F.create_map(*[F.lit(x) for (s, r), n in known.items() for x in (f"{s}/{r}", n)])
    return table[F.concat_ws("/", subject, run)]


def subject_issues(documents: DataFrame, allowed: dict[str, Sequence[str]], file_stem: str = "stem", medication: int = 3) -> DataFrame:
    """documents (subject, stem, birth_date, date, acquisition_id, medication, ...): columns outside their domain, dates that
    don't parse or are in the wrong order, repeated acquisitions, medication outside 0-3, and a file named after another subject."""
    many = F.count(F.lit(1)).over(Window.partitionBy("subject", "acquisition_id"))
    born, at = (F.try_to_timestamp(c, F.lit("yyyy-MM-dd")) for c in ("birth_date", "date"))
    checks = {f"{c}_domain": ("error", ~F.col(c).isin(list(values))) for c, values in allowed.items()}
    checks |= {"birth_date": ("error", born.isNull()), "date": ("error", at.isNull()), "date_order": ("error", F.coalesce(at < born, F.lit(False)))}
    checks |= {"acquisition_repeated": ("error", F.col("_many") > 1), "medication": ("error", ~F.col("medication").between(0, medication)), "file_name": ("error", F.col(file_stem) != F.col("subject"))}
    return issues(documents.withColumn("_many", many), "subject", checks)


def align_scores(electrodes: DataFrame, scores: DataFrame, score: str, order: Sequence[str]) -> DataFrame:
    """Electrodes with their score, null where there is none: by ``electrode``, else ``name``, else ``channel``; of a repeated key the last row in order."""
    key = next(((a, b) for a, b in (("name", "electrode"), ("name", "name"), ("channel", "channel")) if b in scores.columns and a in electrodes.columns), None)
    if key is None:
        return electrodes.withColumn("score", F.lit(None).cast("double"))
    last = scores.groupBy(F.col(key[1]).cast("string").alias("_key")).agg(F.max_by(F.col(score).cast("double"), F.struct(*order)).alias("score"))
    return electrodes.join(last, F.col(key[0]).cast("string") == F.col("_key"), "left").drop("_key")


def label_drift(rows: DataFrame, bucket: str, label: str) -> DataFrame:
    """bucket, label, n, share of the bucket, rank in it, and how the share differs from that of the bucket before which has the label."""
    n = rows.groupBy(bucket, label).agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(bucket)))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc("n"), label))
    return share.withColumns({"rank": rank, "drift": F.col("share") - F.lag("share").over(Window.partitionBy(label).orderBy(bucket))})


def rotated_null(rows: DataFrame, keys: Sequence[str], y: str, predicted: str, shifts: Sequence[int]) -> DataFrame:
    """rows (keys, t from 0 without holes): the observed correlation, the mean of those after rotating the prediction by each
    shift, and the share of rotations that reach the observed one (within 1e-12, as sums run in any order).  All shifts come from one transform."""
    names = list(keys)
    each = rotations(rows, names, y, predicted)
    wanted = F.array(*[F.lit(s).cast("long") for s in shifts])
    times = F.size(F.filter(wanted, lambda s: F.pmod(s, F.col("n")) == F.col("shift")))
    each = each.withColumn("_times", times).where((F.col("_times") > 0) | (F.col("shift") == 0))
    out = each.groupBy(*names).agg(F.max(F.when(F.col("shift") == 0, F.col("r"))).alias("observed"), (F.sum(F.col("r") * F.col("_times")) / F.sum("_times")).alias("null_mean"), F.collect_list(F.struct("r", "_times")).alias("_null"))
    reached = F.aggregate(F.filter("_null", lambda v: v["r"] >= F.col("observed") - 1e-12), F.lit(0), lambda n, v: n + v["_times"])
    return out.withColumn("reached", reached / len(shifts)).drop("_null")


def with_grouped_fallback(signal: DataFrame, group: str, pool: str | None = None) -> DataFrame:
    """Common average by group; channels without a group take the average over all of the pool."""
    whole = common_average(signal.withColumn("_own", F.col("x")), (), pool).withColumnRenamed("x", "_all").withColumnRenamed("_own", "x")
    return common_average(whole, (group,), pool).withColumn("x", F.when(F.col(group).isNull(), F.col("_all")).otherwise(F.col("x"))).drop("_all")


def bipolar_midpoints(contacts: DataFrame, shaft: Sequence[str] = ("shaft",)) -> DataFrame:
    """contacts (channel, contact, shaft, x, y, z): the pairs of neighbours with their midpoint, beside the contacts themselves."""
    a, b = contacts.alias("a"), contacts.alias("b")
    on = F.col("b.contact") == F.col("a.contact") + 1
    for s in shaft:
        on = on & (F.col(f"a.{s}") == F.col(f"b.{s}"))
    middle = [((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(c) for c in "xyz"]
    pairs = a.join(b, on).select(*[F.col(f"a.{s}").alias(s) for s in shaft], F.concat_ws("-", "a.channel", "b.channel").alias("channel"), *middle)
    return contacts.select(*shaft, "channel", *"xyz").unionByName(pairs)


def audio_channels(audio: DataFrame, mode: str, own: int = 0, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Two-speaker audio (keys, t, channel from 0, x) by mode: the mean, the speaker's own channel, the other one, or all."""
    if mode == "mean":
        return audio.groupBy(*keys, "t").agg(F.avg("x").alias("x"))
    if mode == "all":
        return audio.select(*keys, "t", "channel", "x")
    if mode not in ("self", "other"):
        raise ValueError(f"unknown channel mode {mode}")
    return audio.where(F.col("channel") == (own if mode == "self" else 1 - own)).select(*keys, "t", "x")


def write_recording(signal: DataFrame, path: str, parts: Sequence[str] = ("sub", "ses", "task", "run")) -> None:
    """The signal as Parquet in a folder a run."""
    signal.repartition(*parts).sortWithinPartitions(*parts, "t").write.partitionBy(*parts).mode("overwrite").parquet(path)


def write_json_rows(report: DataFrame, path: str) -> None:
    """A report's rows, arrays and all, as lines of JSON."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def assemble(tables: dict[str, DataFrame]) -> DataFrame:
    """section, place, row (JSON): the named tables of a report under one another, in the order given."""
    out = None
    for k, (name, df) in enumerate(tables.items()):
        part = df.select(F.lit(name).alias("section"), F.lit(k).alias("place"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a report needs tables")
    return out
