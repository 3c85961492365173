"""Whole tasks composed of the operators: event tables of the four task kinds, view sets, model selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators import alignment, channels, encoding, series
from voltlake.storage import written


def dialogue_events(reference: DataFrame, raw: DataFrame, durations: DataFrame, key: str, width: int | None = None, tolerance: float = 0.05, lead_in: float = 4.0, length: float = 240.0) -> DataFrame:
    """One conversation a key: starts lead_in after the trigger train's delay (not before 0), lasts length, within the file.

    reference and raw: key, onset; durations: key, duration.  Trains that no interval window aligns (missing or extra
    triggers, few intervals) are aligned by onset pairs; their rmse is null.
    """
    ref, own = (series.intervals(d, [key], "onset") for d in (reference, raw))
    fit = written(alignment.nearest_windows(ref, own, key, width, tolerance), "windows")
    rest = ref.join(fit.select(key).distinct(), key, "left_anti")  # onsets of aligned trains aren't paired
    found = fit.unionByName(alignment.onset_delays(rest, own, key))
    best = alignment.best_delay(found, ref, own, key, tolerance)
    start = F.greatest(F.col("delay") + lead_in, F.lit(0.0))
    out = best.join(durations, key).withColumn("onset", start)
    return out.withColumn("stop", F.least(F.col("onset") + length, F.col("duration"))).withColumn("length", F.greatest(F.col("stop") - F.col("onset"), F.lit(0.0))).select(key, "onset", F.col("length").alias("duration"), "delay", "hits", "rmse")


def story_events(candidates: DataFrame, reference: DataFrame, durations: DataFrame, key: str, tolerance: float = 0.05, offset: float = 3.0, width: int | None = None) -> DataFrame:
    """Of several marker descriptions (key, description, onset) the one that fits the reference train best; the story starts offset after its delay."""
    kept = candidates.withColumn("_id", F.concat_ws("\u0001", F.col(key).cast("string"), "description"))
    ids = kept.select("_id", key, "description").distinct()
    ref = reference.join(ids, key).select("_id", "onset")
    raw = kept.select("_id", "onset")
    a, b = (series.intervals(d, ["_id"], "onset") for d in (ref, raw))
    n = raw.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    best = alignment.best_delay(alignment.nearest_windows(a, b, "_id", width, tolerance), a, b, "_id", tolerance).join(ids, "_id").join(n, "_id")
    top = best.groupBy(key).agg(F.max_by(F.struct("description", "delay", "hits", "rmse"), F.struct("hits", -F.col("rmse"), "n")).alias("b")).select(key, "b.*")
    out = top.join(durations, key).withColumn("onset", F.greatest(F.col("delay") + offset, F.lit(0.0)))
    return out.select(key, "description", "hits", "rmse", "onset", F.greatest(F.col("duration") - F.col("onset"), F.lit(0.0)).alias("duration"))


def naming_events(markers: DataFrame, log: DataFrame, sequence: DataFrame, catalogue: DataFrame, key: str = "recording", rate: float = 1000.0, start: int = 78, stop: int = 126, skip: Sequence[int] = (98,)) -> DataFrame:
    """Three rows a trial: recording, picture and isi onsets in seconds, with the stimulus and whether the marker was the expected one.

    markers: key, t (order), code, sample; log: key, t, kind, name; sequence: key, position, trigger; catalogue: name, id.
    A missing picture onset is interpolated between recording and isi by the log's times.
    """
    found = alignment.forward_pattern(markers, start, stop, skip, (key,))
    sample = markers.select(key, F.col("t").alias("_t"), (F.col("sample") / rate).alias("_s"))
    at = lambda df, t, n: df.join(sample.withColumnsRenamed({"_t": t, "_s": n}), [key, t], "left")
    found = at(at(at(found, "start_t", "rec"), "code_t", "pic"), "stop_t", "isi")
    trials = alignment.triplets(log, [key], "t", "kind", ["recording", "picture", "isi"]).join(catalogue, "name", "left")
    met = alignment.zip_by_order(found, trials.select(key, F.col("t").alias("log_t"), "at1", "at2", "name", F.col("id").alias("stimulus_id")), [key], ["start_t"], ["log_t"])
    met = met.join(sequence.withColumnRenamed("position", "ordinal"), [key, "ordinal"], "left")
    share = (F.col("at1") - F.col("log_t")) / F.nullif((F.col("at2") - F.col("log_t")).cast("double"), F.lit(0.0))
    pic = F.coalesce("pic", F.col("rec") + (F.col("isi") - F.col("rec")) * share)
    met = met.withColumns({"pic": pic, "expected": F.col("code").eqNullSafe(F.col("trigger") - 1)})
    return alignment.event_rows(met, {"recording": F.col("rec"), "picture": F.col("pic"), "isi": F.col("isi")}, [key, "ordinal", "name", "stimulus_id", "expected"])


def phoneme_events(blocks: DataFrame, log: DataFrame, codes: DataFrame, fallback: DataFrame, rate: float) -> DataFrame:
    """Log rows at their block's offset; the markers themselves (fallback: onset, name) where no block was found."""
    aligned = alignment.block_onsets(blocks, log, codes, rate).select("onset", "name", F.lit("log").alias("origin"))
    any_ = aligned.agg((F.count(F.lit(1)) > 0).alias("_any"))
    own = fallback.select("onset", "name", F.lit("markers").alias("origin")).join(F.broadcast(any_)).where("not _any").drop("_any")  # one row
    return aligned.unionByName(own)


def rereferenced_views(signal: DataFrame, shaft: Sequence[str] = (), reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """original, car, bipolar, laplacian and, with a map, wm_ref."""
    out = {"original": signal, "car": channels.common_average(signal, shaft), "bipolar": channels.bipolar(signal, shaft), "laplacian": channels.laplacian(signal, shaft)}
    if reference is not None:
        out["wm_ref"] = channels.mapped_reference(signal, reference)
    return out


def with_neighbours(contacts: DataFrame, coordinates: DataFrame, k: int = 4, radius: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contacts with coordinates, contacts without, neighbour edges)."""
    placed = contacts.join(coordinates, "channel")
    points = placed.select(F.col("recording").alias("group"), F.col("channel").alias("id"), "x", "y", "z")
    return placed, contacts.join(coordinates, "channel", "left_anti"), channels.nearest_contacts(points, k, radius)


@dataclass(frozen=True)
class EncodingModel:
    """Lagged ridge regression: rows are (recording, t, x array, y array)."""

    lags: tuple[int, ...]
    alphas: tuple[float, ...] = (1.0,)

    def design(self, rows: DataFrame) -> DataFrame:
        return encoding.lagged(rows, self.lags)

    def check_segments(self, segments: DataFrame) -> DataFrame:
        """Segments with why they are too short: error at twice the longest lag or less, warning below eight times."""
        most = max(abs(k) for k in self.lags)
        n = F.col("stop") - F.col("start")
        return segments.withColumn("level", F.when(n <= 2 * most, "error").when(n < 8 * most, "warning"))

    def select_alpha(self, rows: DataFrame, fold: Column) -> DataFrame:
        """The alpha of the best mean held-out correlation."""
        return encoding.best_alpha(encoding.cross_validate(self.design(rows).withColumn("fold", fold).select("fold", "lagged", "y"), self.alphas))

    def fit(self, rows: DataFrame, alpha: float) -> DataFrame:
        return encoding.ridge(encoding.gram(self.design(rows)), [alpha])

    def fit_auto(self, rows: DataFrame, fold: Column) -> DataFrame:
        """Fit on all rows with the alpha that cross-validation selects, shared by all outputs (one number reaches the driver)."""
        return self.fit(rows, self.select_alpha(rows, fold).first().alpha)

    def predict(self, rows: DataFrame, model: DataFrame) -> DataFrame:
        return encoding.predict(self.design(rows), model)

    def score(self, rows: DataFrame, model: DataFrame) -> DataFrame:
        """Pearson and R2 of each output."""
        p = self.predict(rows, model).select(F.posexplode(F.arrays_zip("y", "predicted")).alias("output", "p")).select("output", "p.y", "p.predicted")
        return p.groupBy("output").agg(encoding.pearson("y", "predicted").alias("r"), encoding.r2("y", "predicted").alias("r2"))

    def save(self, model: DataFrame, path: str) -> None:
        model.withColumn("lags", F.array(*[F.lit(k) for k in self.lags])).write.mode("overwrite").parquet(path)


def trial_average(signal: DataFrame, events: DataFrame, before: int, after: int, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Mean over trials at each sample around the events (recording, at): (keys, lag, x, n)."""
    spread = events.select("recording", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("lag"), "at").select("recording", (F.col("at") + F.col("lag")).alias("t"), "lag")
    return signal.join(spread, ["recording", "t"]).groupBy(*keys, "lag").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))


def peaks(average: DataFrame, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Peak amplitude and its lag, with the rank of the channel within its recording."""
    p = average.groupBy(*keys).agg(F.max("x").alias("amplitude"), F.max_by("lag", F.struct(F.col("x"), -F.col("lag"))).alias("latency"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("amplitude"), *keys)))


def stable_channels(scores: DataFrame, k: int, spread: float) -> DataFrame:
    """scores (channel, fold, score): the k channels of the best mean whose folds differ by no more than spread."""
    s = scores.groupBy("channel").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).where(F.col("sd") <= spread)
    return s.orderBy(F.desc("mean"), "channel").limit(k)
