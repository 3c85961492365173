"""Selection, report and composite queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.operators import composites as C
from voltlake.operators import pipelines
from voltlake.operators import selection as L
from voltlake.plans.testbed import coded, mark, query, sig1, sign, table


@query("SELECT event_id, coalesce(value >= 50 AND NOT isnan(value), false) AS ge, coalesce(value < 10, false) AS lt FROM events")
def threshold_mask(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", L.threshold(F.col("value"), 50.0, "ge").alias("ge"), L.threshold(F.col("value"), 10.0, "lt").alias("lt"))


@query("SELECT p_partkey, p_name LIKE '%''%' AS left_side, CASE WHEN p_size >= 10 AND p_type <> 'Unknown' THEN p_type ELSE 'none' END AS roi FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]')")
def roi_filter(spark, d):
    p = table(spark, d, "part").where(F.rlike("p_brand", F.lit("^Brand#[1-3]")))
    return p.select("p_partkey", L.in_hemisphere(F.col("p_name"), "left").alias("left_side"), L.roi_label(F.col("p_type"), F.col("p_size")).alias("roi"))


@query("SELECT doc_id, try_cast(regexp_extract(text, '([0-9.]+)', 1) AS DOUBLE) AS v FROM documents WHERE try_cast(regexp_extract(text, '([0-9.]+)', 1) AS DOUBLE) IS NOT NULL")
def finite_numbers(spark, d):
    return L.finite(table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "([0-9.]+)", 1).alias("v")), ["v"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events WHERE event_type NOT IN ('error')")
def rename_and_drop(spark, d):
    return L.rename_values(L.drop_channels(table(spark, d, "events").select("event_id", "event_type"), ["error"], "event_type"), "event_type", {"click": "tap", "view": "look", "ghost": "x"})


@query("SELECT user_id, b AS begin, min(epoch_us(ts)) AS stop FROM events JOIN (SELECT user_id, min(epoch_us(ts)) AS b FROM events WHERE event_type = 'click' GROUP BY user_id) f USING (user_id) WHERE event_type = 'purchase' AND epoch_us(ts) > b GROUP BY user_id, b")
def conversation_bounds(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("onset"))
    return L.conversation_bounds(e, ["user_id"], "click", "purchase")


@query("SELECT user_id AS recording, event_type AS description, count(*) AS n FROM events WHERE event_type NOT LIKE 'err%' GROUP BY ALL HAVING count(*) >= 2")
def candidate_descriptions(spark, d):
    m = mark(spark, d).withColumn("description", F.when(F.col("kind") == "error", "Bad error").otherwise(F.col("kind")))
    return L.candidate_descriptions(m)


@query("SELECT doc_id, score AS keyword_score FROM (SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 1.0::DOUBLE ELSE 0 END) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 4")
def keyword_top(spark, d):
    return L.keyword_top(table(spark, d, "documents"), "text", {"license": 2.0, "token": 1.0}, 4, ["doc_id"]).select("doc_id", "keyword_score")


@query("SELECT recording, round((quantile_cont(x, 0.05) + quantile_cont(x, 0.95)) / 2, 1) AS threshold FROM sig1 GROUP BY recording")
def midpoint_threshold(spark, d):
    return L.midpoint_threshold(sig1(spark, d)).withColumn("threshold", F.round(F.col("threshold") * 10) / 10)  # as SQL rounds: the double times ten, not its digits


@query("SELECT round(greatest(quantile_cont(abs(value), 0.75), 0.1), 4) AS threshold FROM events")
def meaningful_threshold(spark, d):
    return L.meaningful_threshold(table(spark, d, "events"), "value").withColumn("threshold", F.round("threshold", 4))


@query("SELECT recording, t, round(CASE WHEN max(x) OVER p > min(x) OVER p THEN 1 + (x - min(x) OVER p) * 4 / (max(x) OVER p - min(x) OVER p) ELSE 3 END, 6) AS size FROM sig1 WINDOW p AS (PARTITION BY recording)")
def marker_sizes(spark, d):
    return sig1(spark, d).select("recording", "t", F.round(L.min_max(F.col("x"), 1.0, 5.0, ["recording"]), 6).alias("size"))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 5) AS cx, round(avg(embedding[2]::DOUBLE), 5) AS cy, round(avg(embedding[3]::DOUBLE), 5) AS cz, round(greatest(max(embedding[1]::DOUBLE) - min(embedding[1]::DOUBLE), max(embedding[2]::DOUBLE) - min(embedding[2]::DOUBLE), max(embedding[3]::DOUBLE) - min(embedding[3]::DOUBLE)), 5) AS extent FROM embeddings GROUP BY label")
def scene_extent(spark, d):
    e = table(spark, d, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return L.scene(e, ["label"]).select("label", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "cz", "extent")])


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings")
def metres_auto(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    mm = e.withColumns({"x": F.col("x") * 1000, "y": F.col("y") * 1000})
    return L.in_metres(mm, ["x", "y"]).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT recording, channel, lag, round(avg(x), 5) AS x, count(*) AS n FROM (SELECT s.recording, s.channel, l.k AS lag, s.x FROM sign s JOIN (SELECT recording, t AS at FROM sign WHERE channel = 'click' AND t % 5 = 0) e ON e.recording = s.recording JOIN (SELECT unnest([-1, 0, 1]) AS k) l ON s.t = e.at + l.k) GROUP BY ALL")
def trial_average(spark, d):
    s = sign(spark, d)
    ev = s.where("channel = 'click' and t % 5 = 0").select("recording", F.col("t").alias("at"))
    return C.trial_average(s, ev, 1, 2).withColumn("x", F.round("x", 5))


@query("SELECT recording, channel, round(max(x), 5) AS amplitude, min(lag) FILTER (x = top) AS latency FROM (SELECT recording, channel, t AS lag, x, max(x) OVER (PARTITION BY recording, channel) AS top FROM sign) GROUP BY ALL")
def peak_latency(spark, d):
    a = sign(spark, d).select("recording", "channel", F.col("t").alias("lag"), "x")
    return C.peaks(a).select("recording", "channel", F.round("amplitude", 5).alias("amplitude"), "latency")


@query("SELECT event_type AS channel, round(avg(score), 4) AS mean FROM (SELECT event_type, user_id % 3 AS fold, avg(value) AS score FROM events GROUP BY ALL) GROUP BY event_type HAVING stddev_pop(score) <= 10 ORDER BY avg(score) DESC, 1 LIMIT 3")
def stable_channels(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("channel"), (F.col("user_id") % 3).alias("fold")).agg(F.avg("value").alias("score"))
    return C.stable_channels(s, 3, 10.0).select("channel", F.round("mean", 4).alias("mean"))


@query("SELECT 'bipolar' AS view, count(*) AS n FROM sign a JOIN sign b ON a.recording = b.recording AND a.t = b.t AND b.contact = a.contact + 1 UNION ALL SELECT v, (SELECT count(*) FROM sign) FROM (VALUES ('original'), ('car'), ('laplacian'), ('wm_ref')) x(v)")
def view_set(spark, d):
    ref = spark.createDataFrame([("click", "view")], "channel string, ref string")
    return pipelines.stack_views(C.rereferenced_views(sign(spark, d), reference=ref)).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


@query()
def naming_events(spark, d):
    """Markers and log made of the events: click opens a trial, purchase closes it, what lies between is the picture."""
    m = mark(spark, d).withColumn("sample", F.col("t") * 100)
    found = m.where("code in (1, 2, 3)").select("recording", "t", F.when(F.col("code") == 1, 78).when(F.col("code") == 3, 126).otherwise(100).alias("code"), "sample")
    from voltlake.operators import alignment

    trials = alignment.forward_pattern(found, 78, 126, [98])
    w = trials.select("recording", F.posexplode(F.array(F.lit("recording"), F.lit("picture"), F.lit("isi"))).alias("i", "kind"), "start_t")
    log = w.select("recording", (F.col("start_t") * 3 + F.col("i")).alias("t"), "kind", F.concat(F.lit("p"), F.col("start_t") % 4).alias("name"))
    seq = trials.select("recording", F.row_number().over(Window.partitionBy("recording").orderBy("start_t")).alias("position"), F.lit(101).alias("trigger"))
    cat = spark.createDataFrame([(f"p{k}", k + 1) for k in range(4)], "name string, id int")
    return C.naming_events(found, log, seq, cat)


@query()
def dialogue_events(spark, d):
    on = mark(spark, d).select("recording", F.col("sec").alias("onset"))
    low = on.groupBy("recording").agg(F.min("onset").alias("m"))
    ref = on.join(low, "recording").select("recording", (F.col("onset") - F.col("m")).alias("onset"))
    raw = ref.select("recording", (F.col("onset") + 12.86).alias("onset"))
    dur = low.select("recording", F.lit(1e7).alias("duration"))
    return C.dialogue_events(ref, raw, dur, "recording").select("recording", F.round("onset", 3).alias("onset"), F.round("duration", 3).alias("duration"), "hits")


@query()
def encoding_model(spark, d):
    rows = coded(spark, d).select("recording", "t", F.array("x").alias("x"), F.array("y").alias("y"))
    m = C.EncodingModel((0, 1, 2), (0.1, 1e4))
    return m.score(rows, m.fit_auto(rows, F.col("recording") % 4)).select("output", F.round("r", 4).alias("r"), F.round("r2", 4).alias("r2"))


