"""Signal, alignment, model and spectral queries over the events tables as long signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.operators import alignment as A
from voltlake.operators import audio as Y
from voltlake.operators import channels as C
from voltlake.operators import encoding as E
from voltlake.operators import filters as D
from voltlake.operators import fourier as U
from voltlake.operators import model_runs as Z
from voltlake.operators import recursive as R
from voltlake.operators import series as X
from voltlake.operators import spectral as P
from voltlake.plans.testbed import coded, mark, query, sig1, sign, table

DP = "(PARTITION BY recording ORDER BY t)"


def w1():
    return X.by(("recording",))


def all1():
    return Window.partitionBy("recording")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"SELECT recording, t, round(coalesce((x - lag(x) OVER {DP}) * 100, 0), 6) AS d, round(abs(coalesce(x - lag(x) OVER {DP}, 0)), 6) AS a FROM sig1")
def difference_scaled(spark, d):
    return sig1(spark, d).select("recording", "t", F.round(X.difference(F.col("x"), w1(), 100.0), 6).alias("d"), F.round(X.difference(F.col("x"), w1(), absolute=True), 6).alias("a"))


@query("SELECT recording, onset, next - onset AS gap FROM (SELECT recording, epoch_us(e.ts) AS onset, lead(epoch_us(e.ts)) OVER (PARTITION BY recording ORDER BY epoch_us(e.ts)) AS next FROM (SELECT user_id AS recording, ts FROM events) e) WHERE next IS NOT NULL")
def inter_event_intervals(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("recording"), F.unix_micros(F.col("ts").cast("timestamp")).alias("onset"))
    return X.intervals(e, ["recording"], "onset").withColumnRenamed("interval", "gap")


@query("SELECT event_type, quantile_cont(gap, 0.5) / 1e6 AS median_gap, count(*) AS n FROM (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY event_type")
def interval_distribution(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("gap", us - F.lag(us).over(w)).where("gap is not null")
    return e.groupBy("event_type").agg((F.median("gap") / 1e6).alias("median_gap"), F.count(F.lit(1)).alias("n"))


@query("SELECT recording, t, round(sum(x) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS x FROM sig1")
def moving_average_zero_pad(spark, d):
    return sig1(spark, d).select("recording", "t", F.round(X.moving_average(F.col("x"), w1(), 5), 6).alias("x"))


@query("SELECT recording, t, round((x - avg(x) OVER p) / stddev_pop(x) OVER p, 6) AS z FROM sig1 WINDOW p AS (PARTITION BY recording)")
def zscore_population(spark, d):
    return sig1(spark, d).select("recording", "t", F.round(X.zscore(F.col("x"), ["recording"]), 6).alias("z"))


@query("SELECT recording, channel, t, round(x - avg(x) OVER (PARTITION BY recording, t), 6) AS x FROM sign")
def common_average_global(spark, d):
    return rounded(C.common_average(sign(spark, d)), "x").drop("contact")


@query("SELECT recording, channel, t, round(x - avg(x) OVER (PARTITION BY recording, t, contact > 2), 6) AS x FROM sign")
def common_average_grouped(spark, d):
    return rounded(C.common_average(sign(spark, d).withColumn("shaft", F.col("contact") > 2), ["shaft"]), "x").select("recording", "channel", "t", "x")


@query("SELECT a.recording, a.channel || '-' || b.channel AS channel, a.t, round(a.x - b.x, 6) AS x FROM sign a JOIN sign b ON a.recording = b.recording AND a.t = b.t AND b.contact = a.contact + 1")
def bipolar_pairs(spark, d):
    return rounded(C.bipolar(sign(spark, d)), "x")


@query("SELECT recording, channel, t, round(coalesce(x - (lag(x) OVER w + lead(x) OVER w) / 2, x), 6) AS x FROM sign WINDOW w AS (PARTITION BY recording, t ORDER BY contact)")
def laplacian_1d(spark, d):
    return rounded(C.laplacian(sign(spark, d)), "x").drop("contact")


_EDGES = [("click", "error"), ("error", "click"), ("error", "purchase"), ("purchase", "signup"), ("view", "click"), ("view", "signup")]
_EDGE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + ") e(channel, neighbour)"


@query("SELECT recording, channel, t, round(x - coalesce((SELECT avg(o.x) FROM sign o JOIN edges e ON e.neighbour = o.channel WHERE e.channel = s.channel AND o.recording = s.recording AND o.t = s.t), 0), 6) AS x FROM sign s", edges=_EDGE_SQL)
def laplacian_graph(spark, d):
    return rounded(C.graph_laplacian(sign(spark, d), spark.createDataFrame(_EDGES, "channel string, neighbour string")), "x").select("recording", "channel", "t", "x")


@query("SELECT s.recording, s.channel, s.t, round(s.x - coalesce(r.x, 0), 6) AS x FROM sign s LEFT JOIN sign r ON r.channel = 'view' AND s.channel IN ('click', 'error') AND r.recording = s.recording AND r.t = s.t")
def white_matter_reference(spark, d):
    return rounded(C.mapped_reference(sign(spark, d), spark.createDataFrame([("click", "view"), ("error", "view")], "channel string, ref string")), "x").select("recording", "channel", "t", "x")


@query("SELECT recording, channel, t, round(x - coalesce(avg(CASE WHEN channel IN ('view', 'signup') THEN x END) OVER (PARTITION BY recording, t), 0), 6) AS x FROM sign")
def listed_reference(spark, d):
    return rounded(C.list_reference(sign(spark, d), ["view", "signup"]), "x").drop("contact")


@query("SELECT id, other, round(distance, 6) AS distance, rank FROM (SELECT a.vec_id AS id, b.vec_id AS other, a.label, sqrt(pow(a.embedding[1]::DOUBLE - b.embedding[1], 2) + pow(a.embedding[2]::DOUBLE - b.embedding[2], 2) + pow(a.embedding[3]::DOUBLE - b.embedding[3], 2)) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(pow(a.embedding[1]::DOUBLE - b.embedding[1], 2) + pow(a.embedding[2]::DOUBLE - b.embedding[2], 2) + pow(a.embedding[3]::DOUBLE - b.embedding[3], 2)), b.vec_id)::INTEGER AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 3")
def knn_neighbours(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return rounded(C.nearest_contacts(e, 3), "distance").drop("group")


@query(
    "SELECT id, other, round(distance, 6) AS distance, rank FROM (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), b.id)::INTEGER AS rank FROM cloud a JOIN cloud b ON a.id <> b.id) WHERE rank <= 5",
    cloud="SELECT vec_id AS id, floor(embedding[1]::DOUBLE * 20) / 20 AS x, embedding[2]::DOUBLE AS y, floor(embedding[3]::DOUBLE * 5) / 5 AS z FROM embeddings",
)
def knn_whole_cloud(spark, d):
    """All points are one group, many of them on the faces of grid cells."""
    x, y, z = (F.col("embedding")[k].cast("double") for k in range(3))
    e = table(spark, d, "embeddings").select(F.lit(1).alias("group"), F.col("vec_id").alias("id"), (F.floor(x * 20) / 20).alias("x"), y.alias("y"), (F.floor(z * 5) / 5).alias("z"))
    return rounded(C.nearest_contacts(e, 5), "distance").drop("group")


@query("SELECT a.vec_id AS id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND sqrt(pow(a.embedding[1]::DOUBLE - b.embedding[1], 2) + pow(a.embedding[2]::DOUBLE - b.embedding[2], 2) + pow(a.embedding[3]::DOUBLE - b.embedding[3], 2)) <= 0.05")
def radius_neighbours(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return C.nearest_contacts(e, 1 << 30, radius=0.05).select("id", "other")


_CQ = "SELECT recording, channel, var_pop(x) AS variance, count(*) AS n FROM sign GROUP BY recording, channel"


@query("SELECT q.recording, channel, round(variance, 2) AS variance, n, round(log10(greatest(variance, 1e-12)), 6) AS log_variance, variance <= 1e-12 AS is_flat, (log10(greatest(variance, 1e-12)) < lo - 6 * greatest(hi - lo, 1e-12) OR log10(greatest(variance, 1e-12)) > hi + 6 * greatest(hi - lo, 1e-12)) AS is_outlier FROM cq q JOIN (SELECT recording, quantile_cont(log10(greatest(variance, 1e-12)), 0.25) AS lo, quantile_cont(log10(greatest(variance, 1e-12)), 0.75) AS hi FROM cq GROUP BY recording) b ON q.recording = b.recording", cq=_CQ)
def channel_quality(spark, d):
    q = C.channel_quality(sign(spark, d))
    return rounded(rounded(q, "variance", digits=2), "log_variance").select("recording", "channel", "variance", "n", "log_variance", "is_flat", "is_outlier")


@query("SELECT recording, count(DISTINCT channel) AS channels, (max(t) + 1) / 100.0::DOUBLE AS duration FROM sign GROUP BY recording")
def view_summary(spark, d):
    return C.view_summary(sign(spark, d), 100.0)


@query("SELECT recording, channel, round(var_pop(x), 4) AS variance FROM sign GROUP BY ALL ORDER BY var_pop(x) DESC, recording, channel LIMIT 12")
def topk_variance(spark, d):
    return rounded(C.top_variance(sign(spark, d)), "variance", digits=4)


@query("SELECT c AS channel, c IN (SELECT event_type FROM events) AS present FROM (VALUES ('click'), ('ghost'), ('view')) v(c)")
def bad_channels(spark, d):
    listed = spark.createDataFrame([("click", "bad"), ("ghost", " BAD"), ("view", "Bad "), ("error", "good")], "channel string, status string")
    have, not_there = C.bad_channels(sign(spark, d), listed)
    return have.withColumn("present", F.lit(True)).unionByName(not_there.withColumn("present", F.lit(False)))


@query("SELECT user_id, list_sort(list_distinct(list_concat(list(DISTINCT event_type), ['click', 'zz'])))::VARCHAR AS bad FROM events WHERE value > 50 GROUP BY user_id")
def channel_bad_union(spark, d):
    got = table(spark, d, "events").where("value > 50").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    both = F.array_sort(F.array_union("s", F.array(F.lit("click"), F.lit("zz"))))
    return got.select("user_id", F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")).alias("bad"))


_MED = "SELECT recording, median(x) AS m FROM sig1 GROUP BY recording"
_DEV = "SELECT s.recording, x, m, abs(x - m) AS a FROM sig1 s JOIN med USING (recording)"
_MAD = "SELECT recording, median(a) AS mad FROM dev GROUP BY recording"


@query("SELECT recording, round(CASE WHEN any_value(mad) > 0 THEN avg(CASE WHEN 0.6745 * a / mad < 3.5 THEN x END) ELSE any_value(m) END, 10) AS robust_mean FROM dev JOIN mads USING (recording) GROUP BY recording", med=_MED, dev=_DEV, mads=_MAD)
def robust_mean_mad(spark, d):
    return rounded(X.robust_mean(sig1(spark, d), ["recording"], "x"), "robust_mean", digits=10)


@query(f"SELECT recording, t FROM (SELECT recording, t, x, lag(x) OVER {DP} AS p FROM sig1) WHERE x > 40 AND NOT coalesce(p > 40, false)")
def rising_edges(spark, d):
    return X.rising_edges(sig1(spark, d), F.lit(40.0)).select("recording", "t")


@query("SELECT recording, v, (SELECT 1) AS one FROM r", r="SELECT recording, min(t) AS v FROM sig1 WHERE x > 20 GROUP BY recording UNION ALL SELECT r.recording, (SELECT min(s.t) FROM sig1 s WHERE s.recording = r.recording AND s.x > 20 AND s.t >= r.v + 7) FROM r WHERE EXISTS (SELECT 1 FROM sig1 s WHERE s.recording = r.recording AND s.x > 20 AND s.t >= r.v + 7)")
def refractory_onsets(spark, d):
    got = X.refractory(sig1(spark, d).where("x > 20"), 7, onset="t")
    return got.select("recording", F.col("t").alias("v"), F.lit(1).alias("one"))


@query(f"SELECT recording, t, t1 FROM (SELECT recording, t, kind, lead(t) OVER {DP} AS t1, lead(kind) OVER {DP} AS k1 FROM mark) WHERE kind = 'click' AND k1 = 'view'")
def marker_triplets(spark, d):
    return A.triplets(mark(spark, d), ["recording"], "t", "kind", ["click", "view"]).select("recording", "t", F.col("at1").alias("t1"))


@query("SELECT a.recording, a.t AS start_t, a.stop_t, (SELECT arg_max(m.code, m.t) FROM mark m WHERE m.recording = a.recording AND m.t > a.t AND m.t < a.stop_t AND m.code NOT IN (1, 3, 5))::DOUBLE AS code FROM (SELECT recording, t, code, min(CASE WHEN code = 3 THEN t END) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop_t FROM mark) a WHERE code = 1 AND stop_t IS NOT NULL")
def forward_pattern(spark, d):
    return A.forward_pattern(mark(spark, d), 1, 3, [5]).select("recording", "start_t", "stop_t", F.col("code").cast("double").alias("code"))


@query("SELECT a.recording, a.n AS ordinal, a.t AS ta, b.t AS tb FROM (SELECT recording, t, row_number() OVER (PARTITION BY recording ORDER BY t)::INTEGER AS n FROM mark WHERE code = 1) a JOIN (SELECT recording, t, row_number() OVER (PARTITION BY recording ORDER BY t)::INTEGER AS n FROM mark WHERE code = 2) b ON a.recording = b.recording AND a.n = b.n")
def ordinal_zip_join(spark, d):
    m = mark(spark, d)
    return A.zip_by_order(m.where("code = 1").select("recording", F.col("t").alias("ta")), m.where("code = 2").select("recording", F.col("t").alias("tb")), ["recording"], ["ta"], ["tb"], strict=False).select("recording", "ordinal", "ta", "tb")


_REF = "SELECT recording, t, x FROM sig1 WHERE t % 2 = 0"
_TGT = "SELECT recording, t, x FROM sig1 WHERE t % 2 = 1"


@query("SELECT recording, ref, target FROM (SELECT r.recording, r.t AS ref, g.t AS target, abs(g.x - r.x) AS d, row_number() OVER (PARTITION BY r.recording, r.t ORDER BY abs(g.x - r.x), g.t) AS n FROM reft r JOIN tgt g ON r.recording = g.recording) WHERE n = 1 AND d <= 5", reft=_REF, tgt=_TGT)
def nearest_interval(spark, d):
    s = sig1(spark, d).select("recording", F.col("t").alias("i"), "x")
    return A.nearest_value(s.where("i % 2 = 0"), s.where("i % 2 = 1"), "recording", "x", 5.0).select("recording", "ref", "target")


def _intervals(spark, d):
    m = mark(spark, d)
    on = m.select("recording", F.col("sec").alias("onset"))
    return X.intervals(on, ["recording"], "onset")


@query()
def window_match_delay(spark, d):
    iv = _intervals(spark, d)
    raw = iv.withColumn("onset", F.col("onset") + 12.86)
    return rounded(A.window_delays(iv, raw, "recording"), "delay", "rmse", digits=3)


@query()
def constant_delay(spark, d):
    return rounded(A.constant_delay(window_match_delay(spark, d), "recording"), "robust_mean", digits=3)


@query()
def best_delay(spark, d):
    iv = _intervals(spark, d)
    raw = iv.withColumn("onset", F.col("onset") + 12.86)
    return rounded(A.best_delay(A.window_delays(iv, raw, "recording"), iv, raw, "recording", 0.05), "delay", "rmse", digits=3)


@query()
def greedy_onset_matches(spark, d):
    m = mark(spark, d).select("recording", F.col("sec").alias("onset"), "t")
    return A.greedy_matches(m.where("t % 2 = 0"), m.where("t % 2 = 1"), "recording", "onset", 3600.0)


_TIERS = "SELECT user_id, event_id, epoch_us(ts) AS s0, epoch_us(ts) + (value * 1e9)::BIGINT AS e0 FROM events"
_WINS = "SELECT user_id, (epoch_us(min(ts)) // 86400000000) * 86400000000 + k * 432000000000 AS ws, (epoch_us(min(ts)) // 86400000000) * 86400000000 + (k + 1) * 432000000000 AS we FROM events, range(6) r(k) GROUP BY user_id, k"


def _windows(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("m"))
    day = F.floor(F.col("m") / 86400000000) * 86400000000
    k = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("w_start", day + F.col("k") * 432000000000)
    return k.select("user_id", "w_start", (F.col("w_start") + 432000000000).alias("w_end"))


@query("SELECT t.event_id, w.ws, greatest(s0, ws) - ws AS s, least(e0, we) - ws AS e FROM tiers t JOIN wins w USING (user_id) WHERE s0 < we AND e0 > ws AND least(e0, we) > greatest(s0, ws)", tiers=_TIERS, wins=_WINS)
def interval_overlap_clip(spark, d):
    s0 = F.unix_micros(F.col("ts").cast("timestamp"))
    t = table(spark, d, "events").select("user_id", "event_id", s0.alias("start"), (s0 + F.round(F.col("value") * 1e9).cast("long")).alias("end"))
    return A.overlap(t, _windows(spark, d), "user_id").select("event_id", F.col("w_start").alias("ws"), "s", "e")


@query("SELECT t.event_id, w.ws, s0 - ws AS shifted FROM tiers t JOIN wins w USING (user_id) WHERE s0 BETWEEN ws AND we", tiers=_TIERS, wins=_WINS)
def point_in_interval(spark, d):
    p = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return A.points_in(p, _windows(spark, d), "user_id").select("event_id", F.col("w_start").alias("ws"), "shifted")


@query("SELECT event_id, round(greatest(b.sample - 1, 0) / 1000.0 + e.value, 6) AS onset, n_name AS name FROM events e JOIN (SELECT user_id, min(event_id) AS sample FROM events GROUP BY user_id) b ON b.user_id = e.user_id LEFT JOIN nation ON n_nationkey = e.event_id % 40")
def block_offset_onsets(spark, d):
    e = table(spark, d, "events")
    markers = e.groupBy(F.col("user_id").alias("part")).agg(F.min("event_id").alias("sample"))
    log = e.select(F.col("user_id").alias("part"), (F.col("value") * 1000).alias("ms"), (F.col("event_id") % 40).cast("int").alias("code"), "event_id")
    codes = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return rounded(A.block_onsets(markers, log, codes, 1000.0), "onset").select("event_id", "onset", "name")


@query("SELECT event_id, 'recording' AS trial_type, 1 AS value, round(value, 6) AS onset FROM events UNION ALL SELECT event_id, 'picture', 2, round(value + 0.5, 6) FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'isi', 3, round(value + 2, 6) FROM events")
def unpivot_event_rows(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("value").alias("v"), "event_type")
    kinds = {"recording": F.round(F.col("v"), 6), "picture": F.when(F.col("event_type") == "view", F.round(F.col("v") + 0.5, 6)), "isi": F.round(F.col("v") + 2, 6)}
    return A.event_rows(t, kinds, ["event_id"])


@query("SELECT user_id AS recording, coalesce(bool_and(ok), true) AS monotonic FROM (SELECT user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= value AS ok FROM events) GROUP BY user_id")
def monotonic_check(spark, d):
    return A.is_monotonic(sig1(spark, d), ["recording"], ["t"], "x")


@query("SELECT recording, min(t) AS t FROM (SELECT coalesce(a.recording, b.recording) AS recording, coalesce(a.t, b.t) AS t FROM (SELECT recording, t, code FROM mark WHERE recording % 2 = 0) a FULL JOIN (SELECT recording - 1 AS recording, t, code FROM mark WHERE recording % 2 = 1) b ON a.recording = b.recording AND a.t = b.t WHERE a.code IS DISTINCT FROM b.code) GROUP BY recording")
def first_divergence(spark, d):
    m = mark(spark, d).select("recording", "t", "code")
    return A.first_divergence(m.where("recording % 2 = 0"), m.where("recording % 2 = 1").withColumn("recording", F.col("recording") - 1), ["recording"], "t", "code").select("recording", "t")


@query("SELECT recording, t, x FROM sig1 WHERE t <= (SELECT min(m) FROM (SELECT max(t) AS m FROM sig1 GROUP BY recording))")
def common_length_crop(spark, d):
    return X.common_length(sig1(spark, d))


@query("SELECT a.recording, a.t - 5 AS t, a.x AS xa, b.x AS xb FROM (SELECT * FROM sign WHERE channel = 'click') a JOIN (SELECT * FROM sign WHERE channel = 'view') b ON a.recording = b.recording AND a.t - 5 = b.t - 2 WHERE a.t >= 5 AND b.t >= 2")
def align_by_start(spark, d):
    s = sign(spark, d)
    starts = s.select("recording").distinct().withColumns({"start_a": F.lit(5).cast("long"), "start_b": F.lit(2).cast("long")})
    return X.align_by_start(s.where("channel = 'click'"), s.where("channel = 'view'"), starts)


@query("SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def running_offset_manifest(spark, d):
    return X.running_offset(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", ["doc_id"], ["source"]).select("doc_id", "start")


_N = "SELECT recording, max(t) + 1 AS n FROM sig1 GROUP BY recording"
_SEG = "SELECT recording, n, k AS seg, k * 20 AS start, least(k * 20 + 20, n) AS stop FROM nn, range(200) r(k) WHERE k < ceil(n / 20)"


@query("SELECT recording, seg, start, stop FROM segs", nn=_N, segs=_SEG)
def segments(spark, d):
    return X.segments(sig1(spark, d), 20)


@query("SELECT recording, seg, (row_number() OVER w - 1) % 3 AS round_robin, least(floor((row_number() OVER w - 1) * 3 / count(*) OVER (PARTITION BY recording)), 2)::BIGINT AS blocked, ntile(3) OVER w - 1 AS contiguous FROM segs WINDOW w AS (PARTITION BY recording ORDER BY seg)", nn=_N, segs=_SEG)
def fold_assignments(spark, d):
    w = Window.partitionBy("recording").orderBy("seg")
    return X.segments(sig1(spark, d), 20).select("recording", "seg", *[X.fold_of(r, 3, w, all1()).alias(r) for r in ("round_robin", "blocked", "contiguous")])


@query("SELECT recording, k AS block, (n * k // 10) AS start, (n * (k + 1) // 10) AS stop FROM nn, range(10) r(k)", nn=_N)
def time_blocks(spark, d):
    return X.time_blocks(sig1(spark, d), 10)


_FOLDS = "SELECT recording, start, stop, (row_number() OVER (PARTITION BY recording ORDER BY seg) - 1) % 3 AS own FROM segs"


@query("SELECT a.recording, f.k AS fold, a.start FROM folds a, range(3) f(k) WHERE a.own <> f.k AND NOT EXISTS (SELECT 1 FROM folds b WHERE b.recording = a.recording AND b.own = f.k AND NOT (a.stop + 5 <= b.start OR b.stop + 5 <= a.start))", nn=_N, segs=_SEG, folds=_FOLDS)
def purged_folds(spark, d):
    w = Window.partitionBy("recording").orderBy("seg")
    s = X.segments(sig1(spark, d), 20).withColumn("own", X.fold_of("round_robin", 3, w, all1()))
    train = s.withColumn("fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).where("fold <> own")
    return E.purge(train, s.withColumn("fold", F.col("own")), 5).select("recording", "fold", "start")


@query("SELECT s.recording, s.t FROM sig1 s WHERE s.t < 20 - 3 OR s.t > 39 + 3")
def gap_mask(spark, d):
    s = sig1(spark, d)
    test = s.where("t >= 20 and t < 40").select("recording", "t", F.lit(1).alias("fold"))
    # recordings shorter than the test block keep what lies before it
    return E.gap_mask(s, test.groupBy("recording", "fold").agg(F.lit(20).cast("long").alias("t")).unionByName(test.groupBy("recording", "fold").agg(F.lit(39).cast("long").alias("t"))), 3).select("recording", "t")


@query(f"SELECT recording, t, round(x, 6) AS l0, round(lag(x) OVER {DP}, 6) AS l1, round(lag(x, 2) OVER {DP}, 6) AS l2 FROM sig1 QUALIFY lag(t, 2) OVER {DP} IS NOT NULL")
def lagged_design(spark, d):
    return E.lagged(sig1(spark, d), [0, 1, 2]).select("recording", "t", *[F.round(F.col("lagged")[k], 6).alias(f"l{k}") for k in range(3)])


def _pairs(spark, d):
    return E.lagged(sig1(spark, d), [0, 1]).withColumn("y", F.array(F.col("x") * 2 + F.col("lagged")[1]))


_LAG = f"SELECT recording, t, x, lag(x) OVER {DP} AS l, x * 2 + lag(x) OVER {DP} AS y FROM sig1"


@query("SELECT recording, count(*)::DOUBLE AS n, round(sum(x * x), 4) AS xx00, round(sum(x * l), 4) AS xx01, round(sum(l * l), 4) AS xx11, round(sum(l * y), 4) AS xy1 FROM lagp WHERE l IS NOT NULL GROUP BY recording", lagp=_LAG)
def gram_matrix(spark, d):
    g = E.gram(_pairs(spark, d), ["recording"])
    return g.select("recording", "n", *[F.round(c, 4).alias(n) for n, c in (("xx00", F.col("xx")[0]), ("xx01", F.col("xx")[1]), ("xx11", F.col("xx")[3]), ("xy1", F.col("xy")[1]))])


_RS = "SELECT recording, covar_pop(x, x) * count(*) + 0.5 AS a, covar_pop(x, l) * count(*) AS b, covar_pop(l, l) * count(*) + 0.5 AS c, covar_pop(x, y) * count(*) AS p, covar_pop(l, y) * count(*) AS q, avg(x) AS mx, avg(l) AS ml, avg(y) AS my FROM lagp WHERE l IS NOT NULL GROUP BY recording"


@query("SELECT recording, round((c * p - b * q) / (a * c - b * b), 6) AS w0, round((a * q - b * p) / (a * c - b * b), 6) AS w1, round(my - mx * (c * p - b * q) / (a * c - b * b) - ml * (a * q - b * p) / (a * c - b * b), 4) AS intercept FROM rs", lagp=_LAG, rs=_RS)
def ridge_two_lag(spark, d):
    m = E.ridge(E.gram(_pairs(spark, d), ["recording"]), [0.5], ["recording"])
    return m.select("recording", F.round(F.col("coef")[0], 6).alias("w0"), F.round(F.col("coef")[1], 6).alias("w1"), F.round(F.col("intercept")[0], 4).alias("intercept"))


@query(f"SELECT recording, t, round(0.5 * x + 0.25 * coalesce(lag(x) OVER {DP}, 0) - 0.1 * coalesce(lead(x) OVER {DP}, 0) + 1, 6) AS yhat FROM sig1")
def kernel_predict(spark, d):
    return rounded(E.kernel_predict(sig1(spark, d), {0: 0.5, 1: 0.25, -1: -0.1}, intercept=1.0), "yhat")


@query("SELECT recording, round(coalesce(corr(x, l), 0), 5) AS r, round(1 - sum(pow(x - l, 2)) / (var_pop(x) * count(x)), 5) AS r2 FROM lagp WHERE l IS NOT NULL GROUP BY recording", lagp=_LAG)
def pearson_r2(spark, d):
    p = _pairs(spark, d).select("recording", "x", F.col("lagged")[1].alias("l"))
    return p.groupBy("recording").agg(F.round(E.pearson("x", "l"), 5).alias("r"), F.round(E.r2("x", "l"), 5).alias("r2"))


@query("SELECT recording, round(corr(ra, rb), 5) AS rho FROM (SELECT recording, rank() OVER (PARTITION BY recording ORDER BY x) + (count(*) OVER (PARTITION BY recording, x) - 1) / 2 AS ra, rank() OVER (PARTITION BY recording ORDER BY l) + (count(*) OVER (PARTITION BY recording, l) - 1) / 2 AS rb FROM lagp WHERE l IS NOT NULL) GROUP BY recording", lagp=_LAG)
def spearman(spark, d):
    p = _pairs(spark, d).select("recording", "x", F.col("lagged")[1].alias("l"))
    r = p.select("recording", X.average_rank(F.col("x"), ["recording"]).alias("ra"), X.average_rank(F.col("l"), ["recording"]).alias("rb"))
    return r.groupBy("recording").agg(F.round(E.pearson("ra", "rb"), 5).alias("rho"))


@query("SELECT event_type, round(sum(value * event_id) / sum(event_id), 4) AS score FROM events GROUP BY event_type")
def weighted_score(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(E.weighted_score("value", "event_id"), 4).alias("score"))


@query("SELECT user_id, arg_max(alpha, score) AS alpha FROM (SELECT user_id, event_id % 4 AS alpha, avg(value) AS score FROM events GROUP BY ALL) GROUP BY user_id")
def best_alpha(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("alpha"), F.col("value").alias("score"))
    return E.best_alpha(e, ["user_id"]).select("user_id", "alpha")


@query()
def encoding_cross_validation(spark, d):
    """Values from the codes of the last events: folds by recording, one Gram pass, scores for each penalty."""
    rows = E.lagged(coded(spark, d), [0, 1, 2, 3, 4]).withColumn("y", F.array("y")).withColumn("fold", F.col("recording") % 4)
    return E.cross_validate(rows.select("fold", "lagged", "y"), [0.01, 1.0, 100.0]).select("fold", "alpha", F.round("score", 4).alias("score"))


@query(
    "SELECT recording AS fold, 1.0::DOUBLE AS alpha, round(coalesce(CASE WHEN abs(b) * sxx > 0 AND syy > 0 AND b * b * sxx > 1e-12 * n THEN sign(b) * sxy / sqrt(sxx * syy) END, 0), 5) + 0.0 AS pearson, "
    "round(coalesce(CASE WHEN syy > 0 THEN 1 - (syy - 2 * b * sxy + b * b * sxx + n * pow(my - c - b * mx, 2)) / syy END, 0), 5) + 0.0 AS r2 FROM m",
    z="SELECT user_id AS recording, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS x, value AS y FROM events",
    o="SELECT recording, count(*) AS n, avg(x) AS mx, avg(y) AS my, count(*) * var_pop(x) AS sxx, count(*) * var_pop(y) AS syy, count(*) * covar_pop(x, y) AS sxy, sum(x) AS tx, sum(y) AS ty, sum(x * x) AS txx, sum(x * y) AS txy FROM z GROUP BY recording",
    a="SELECT sum(n) AS n, sum(tx) AS tx, sum(ty) AS ty, sum(txx) AS txx, sum(txy) AS txy FROM o",
    m="SELECT o.*, ((a.txy - o.txy) - (a.tx - o.tx) * (a.ty - o.ty) / (a.n - o.n)) / ((a.txx - o.txx) - pow(a.tx - o.tx, 2) / (a.n - o.n) + 1) AS b, "
    "(a.ty - o.ty) / (a.n - o.n) - ((a.txy - o.txy) - (a.tx - o.tx) * (a.ty - o.ty) / (a.n - o.n)) / ((a.txx - o.txx) - pow(a.tx - o.tx, 2) / (a.n - o.n) + 1) * (a.tx - o.tx) / (a.n - o.n) AS c FROM o, a",
)
def leave_one_run_out(spark, d):
    """Each recording scored by the model of all others: values from the codes at the same sample."""
    rows = coded(spark, d).select(F.col("recording").alias("fold"), F.lit(0).alias("segment"), F.array("x").alias("lagged"), F.array("y").alias("y"))
    got = Z.left_out(rows, [1.0])
    return got.select("fold", "alpha", (F.round("pearson", 5) + 0.0).alias("pearson"), (F.round("r2", 5) + 0.0).alias("r2"))


@query()
def lasso_cross_validation(spark, d):
    """Folds by recording, sparse coefficients: the medians over outputs (the value and its square root) of held-out scores."""
    rows = E.lagged(coded(spark, d), [0, 1, 2]).withColumns({"y": F.array("y", F.sqrt(F.abs("y"))), "fold": F.col("recording") % 4, "segment": F.col("recording")})
    got = Z.over_outputs(Z.left_out(rows.select("fold", "segment", "lagged", "y"), [1.0, 1000.0], "lasso"), "median", "r2")
    return got.select("fold", "alpha", F.round("score", 5).alias("score"))


@query("SELECT recording, round((pow(sum(x * sin(2 * pi() * 10 * t / 100)), 2) + pow(sum(x * cos(2 * pi() * 10 * t / 100)), 2)) / count(*), 4) AS line_power FROM sig1 GROUP BY recording")
def line_power(spark, d):
    return rounded(P.line_power(sig1(spark, d), 10.0, 100.0), "line_power", digits=4)


_FR = "SELECT s.recording, f.k AS frame, s.t - f.k * 8 AS k, s.x FROM sig1 s JOIN nn n ON n.recording = s.recording JOIN range(0, 400) f(k) ON s.t >= f.k * 8 AND s.t < f.k * 8 + 16 AND f.k * 8 + 16 <= n.n"
_PW = "SELECT recording, frame, b AS bin, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 16)) * cos(2 * pi() * b * k / 16)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 16)) * sin(2 * pi() * b * k / 16)), 2) AS power FROM fr, range(9) bb(b) GROUP BY recording, frame, b"


def _power(spark, d):
    return P.stft_power(P.frames(sig1(spark, d), 16, 8), 16, 100.0)


@query("SELECT recording, frame, bin::INTEGER AS bin, round(power, 3) AS power FROM pw WHERE bin BETWEEN 1 AND 7", nn=_N, fr=_FR, pw=_PW)
def stft_power(spark, d):
    return rounded(_power(spark, d).where("bin between 1 and 7"), "power", digits=3).select("recording", "frame", "bin", "power")


@query("SELECT recording, bin::INTEGER AS bin, round(10 * log10(greatest(avg(power), 1e-30)), 3) AS db FROM pw GROUP BY recording, bin HAVING avg(power) > 1e-6", nn=_N, fr=_FR, pw=_PW)
def welch_db(spark, d):
    return rounded(P.welch_db(P.frames(sig1(spark, d), 16, 8), 16, 100.0), "db", digits=3).where("db > -60").select("recording", "bin", "db")


_MEL = P.mel_weights(16, 100.0, 3)
_MELT = "SELECT * FROM (VALUES " + ", ".join(f"({b}, {k}, {w!r}::DOUBLE)" for b, k, w in _MEL) + ") m(band, k, w)"
_MP = "SELECT recording, frame, band, sum(power * w) AS power FROM pw JOIN melt ON melt.k = bin GROUP BY recording, frame, band"


@query("SELECT recording, frame, band, round(power, 3) AS power FROM mp", nn=_N, fr=_FR, pw=_PW, melt=_MELT, mp=_MP)
def mel_power(spark, d):
    return rounded(P.weighted_bands(_power(spark, d), _MEL), "power", digits=3).select("recording", "frame", "band", "power")


@query("SELECT recording, frame, c::INTEGER AS coef, round(sum(ln(greatest(power, 1e-10)) * sqrt(CASE WHEN c = 0 THEN 1 ELSE 2 END / 3.0::DOUBLE) * cos(pi() * c * (band + 0.5) / 3)), 4) AS value FROM mp, range(2) cc(c) GROUP BY recording, frame, c", nn=_N, fr=_FR, pw=_PW, melt=_MELT, mp=_MP)
def mfcc(spark, d):
    n = len({b for b, _, _ in _MEL})
    return rounded(P.cepstra(P.weighted_bands(_power(spark, d), _MEL), n, 2), "value", digits=4).select("recording", "frame", "coef", "value")


@query("SELECT recording, t, round((coalesce(lead(x) OVER w, l) - coalesce(lag(x) OVER w, f) + 2 * (coalesce(lead(x, 2) OVER w, l) - coalesce(lag(x, 2) OVER w, f))) / 10, 6) AS delta FROM (SELECT *, arg_min(x, t) OVER (PARTITION BY recording) AS f, arg_max(x, t) OVER (PARTITION BY recording) AS l FROM sig1) WINDOW w AS (PARTITION BY recording ORDER BY t)")
def mfcc_delta(spark, d):
    whole = w1().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sig1(spark, d).select("recording", "t", F.round(X.delta(F.col("x"), w1(), whole), 6).alias("delta"))


_TAPS = P.gammatone_taps(12.0, 100.0, 5)


@query("SELECT recording, t, round(" + " + ".join(f"coalesce(lag(x, {k}) OVER {DP}, 0) * ({h!r}::DOUBLE)" for k, h in enumerate(_TAPS)) + ", 5) AS x FROM sig1")
def fir_gammatone(spark, d):
    return rounded(P.convolve(sig1(spark, d), _TAPS), "x", digits=5)


@query("SELECT recording, k AS t, coalesce(x, 0.0::DOUBLE) AS x FROM (SELECT DISTINCT recording FROM sig1) CROSS JOIN range(70) r(k) LEFT JOIN sig1 USING (recording) WHERE false UNION ALL SELECT n.recording, r.k, coalesce((SELECT s.x FROM sig1 s WHERE s.recording = n.recording AND s.t = r.k), 0) FROM nn n, range(70) r(k)", nn=_N)
def force_length(spark, d):
    return X.force_length(sig1(spark, d), 70)


@query("SELECT recording, t, x FROM sig1 WHERE t % 4 = 0")
def decimate(spark, d):
    return sig1(spark, d).where("t % 4 = 0")


@query("SELECT recording, t, round(CASE WHEN t % 4 = 0 OR nx IS NULL THEN px ELSE px + (nx - px) * (t % 4) / 4 END, 6) AS x FROM (SELECT s.recording, s.t, (SELECT k.x FROM sig1 k WHERE k.recording = s.recording AND k.t = s.t - s.t % 4) AS px, (SELECT k.x FROM sig1 k WHERE k.recording = s.recording AND k.t = s.t - s.t % 4 + 4) AS nx FROM sig1 s)")
def interpolate_grid(spark, d):
    s = sig1(spark, d)
    return rounded(X.interpolate(s.where("t % 4 = 0"), s), "x")


@query("SELECT recording, t + 3 AS t, x FROM sig1 UNION ALL SELECT recording, k, 0.0 FROM nn, range(3) r(k)", nn=_N)
def pad_start(spark, d):
    return X.pad_start(sig1(spark, d), 3)


@query("SELECT recording, t, round(x * pow(10, -1.0::DOUBLE / 20) / max(abs(x)) OVER (PARTITION BY recording), 6) AS x FROM sig1")
def peak_normalised(spark, d):
    return rounded(D.peak_normalised(sig1(spark, d)), "x")


@query("SELECT vec_id, list_max(embedding)::DOUBLE AS top, len(embedding)::INTEGER AS n FROM embeddings")
def probability_max(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("top"), F.size("embedding").alias("n"))


@query("SELECT vec_id, i::INTEGER AS i, embedding[i + 1]::DOUBLE AS p FROM embeddings, range(len(embedding)) r(i)")
def atlas_explode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "p")).withColumn("p", F.col("p").cast("double"))


@query("SELECT e.vec_id, l.quality::DOUBLE AS quality FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id")
def score_align_left(spark, d):
    e, s = table(spark, d, "embeddings"), table(spark, d, "labels")
    return e.join(s, e["vec_id"] == s["doc_id"], "left").select("vec_id", F.col("quality").cast("double").alias("quality"))


@query("SELECT doc_id, regexp_extract(text, '([0-9]+)', 1) AS number, regexp_extract(text, '^(\\S+)', 1) AS first FROM documents")
def log_line_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"([0-9]+)", 1).alias("number"), F.regexp_extract("text", r"^(\S+)", 1).alias("first"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) WHERE r = 1")
def first_turn(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return c.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("m")).select("conv_id", "m.*")


# ---- rows only: recurrences and whole-series transforms; tests compare them with numpy


#: A recurrence over all recordings at once: step k takes the k-th sample of each.
_LENGTH = "SELECT recording, max(t) AS last FROM sig1 GROUP BY recording"


@query(
    "SELECT recording, t, round(y, 6) AS x FROM back",
    r="SELECT exp(-1 / 5.0) AS r",
    n=_LENGTH,
    ahead="SELECT recording, t, (1 - r) * x AS y FROM sig1, r WHERE t = 0 UNION ALL SELECT a.recording, s.t, (1 - r) * s.x + r * a.y FROM r, ahead a JOIN sig1 s ON s.recording = a.recording AND s.t = a.t + 1",
    back="SELECT a.recording, a.t, (1 - r) * a.y AS y FROM r, ahead a JOIN n ON n.recording = a.recording AND a.t = n.last UNION ALL SELECT b.recording, a.t, (1 - r) * a.y + r * b.y FROM r, back b JOIN ahead a ON a.recording = b.recording AND a.t = b.t - 1",
)
def rc_smooth(spark, d):
    return rounded(R.rc_smoothed(sig1(spark, d), 0.05, 100.0), "x")


# 9 samples beyond each end, then y = b x - b x(-2) - a1 y(-1) - a2 y(-2) from the steady state of the end's value (z1 = z2 = -b x)
_STEP = "b * {x} + {f}.z1 AS y, -a1 * (b * {x} + {f}.z1) + {f}.z2 AS z1, -b * {x} - a2 * (b * {x} + {f}.z1) AS z2"
_FIRST = "b * {x} - b * {x} AS y, -a1 * (b * {x} - b * {x}) - b * {x} AS z1, -b * {x} - a2 * (b * {x} - b * {x}) AS z2"


@query(
    "SELECT recording, t, round(y, 6) AS x FROM back JOIN n USING (recording) WHERE t BETWEEN 0 AND last UNION SELECT recording, t, round(x, 6) AS x FROM sig1 JOIN n USING (recording) WHERE last = 0",
    w="SELECT tan(pi() * 5 / 100) AS w1, tan(pi() * 20 / 100) AS w2",
    k="SELECT (w2 - w1) / (1 + w2 - w1 + w1 * w2) AS b, 2 * (w1 * w2 - 1) / (1 + w2 - w1 + w1 * w2) AS a1, (1 - w2 + w1 + w1 * w2) / (1 + w2 - w1 + w1 * w2) AS a2 FROM w",
    n=_LENGTH,
    wide="SELECT recording, t, x FROM sig1 UNION SELECT s.recording, -s.t, 2 * e.x - s.x FROM sig1 s JOIN sig1 e ON e.recording = s.recording AND e.t = 0 AND s.t BETWEEN 1 AND 9 "
    "UNION SELECT s.recording, 2 * last - s.t, 2 * e.x - s.x FROM sig1 s JOIN n ON n.recording = s.recording JOIN sig1 e ON e.recording = s.recording AND e.t = last AND s.t BETWEEN last - 9 AND last - 1",
    ahead=f"SELECT v.recording, v.t, {_FIRST.format(x='v.x')} FROM k, wide v JOIN n ON n.recording = v.recording AND last > 0 AND v.t = -least(9, last) UNION ALL SELECT v.recording, v.t, {_STEP.format(x='v.x', f='f')} FROM k, ahead f JOIN wide v ON v.recording = f.recording AND v.t = f.t + 1",
    back=f"SELECT v.recording, v.t, {_FIRST.format(x='v.y')} FROM k, ahead v JOIN n ON n.recording = v.recording AND v.t = last + least(9, last) UNION ALL SELECT v.recording, v.t, {_STEP.format(x='v.y', f='f')} FROM k, back f JOIN ahead v ON v.recording = f.recording AND v.t = f.t - 1",
)
def band_pass_first_order(spark, d):
    """Forward and backward Butterworth band-pass of 5 to 20 Hz, one section."""
    return rounded(R.band_passed(sig1(spark, d), 5.0, 20.0, 100.0, 1), "x")


@query()
def band_pass(spark, d):
    """The same of order 4, as envelopes of bands use it."""
    return rounded(R.band_passed(sig1(spark, d), 8.0, 30.0, 100.0, 4), "x")


@query()
def hilbert_envelope(spark, d):
    return rounded(D.hilbert_envelope(sig1(spark, d), 100.0, 50.0, cut=10.0), "x")


@query()
def rectified_envelope(spark, d):
    return rounded(D.rectified_envelope(sig1(spark, d), 100.0, 10.0, 50.0), "x")


@query()
def gamma_envelope(spark, d):
    return rounded(D.gamma_envelope(sign(spark, d), 10.0, 40.0, 100.0, smooth=5), "x")


@query()
def highpass(spark, d):
    return rounded(D.per_block(sig1(spark, d), lambda x: D.highpass(x, 1.0, 100.0), 101), "x")


@query()
def minimum_phase_highpass(spark, d):
    """High-pass of 1 Hz whose taps have their energy first: nothing is seen before it happens."""
    return rounded(D.fir_filtered(sig1(spark, d), D.highpass_taps(1.0, 100.0), "minimum"), "x")


@query()
def resample(spark, d):
    return rounded(D.resampled(sig1(spark, d), 64.0, 100.0), "x")


@query()
def fft_resample(spark, d):
    return rounded(U.fourier_resampled(sig1(spark, d), 50.0, 100.0), "x")


@query()
def channel_envelopes(spark, d):
    """Two channels a recording (codes 1 and 2 of the events, by sample), their envelopes and that of their mean."""
    two = sign(spark, d).where("contact <= 2").select("recording", (F.col("contact") - 1).alias("channel"), "t", "x")
    full = two.where("channel = 1").select("recording").distinct()
    return rounded(D.channel_envelopes(two.join(full, "recording"), "all", 100.0, 50.0, 8.0), "x")


@query(
    "SELECT s.recording, s.t, round(sum(r.x * CASE WHEN (s.t - r.t) % 2 = 0 THEN 0 WHEN n % 2 = 0 THEN 2 * cos(pi() * (s.t - r.t) / n) / sin(pi() * (s.t - r.t) / n) / n ELSE (cos(pi() * (s.t - r.t) / n) + 1) / sin(pi() * (s.t - r.t) / n) / n END "
    "+ r.x * CASE WHEN n % 2 = 1 AND s.t <> r.t AND (s.t - r.t) % 2 = 0 THEN (cos(pi() * (s.t - r.t) / n) - 1) / sin(pi() * (s.t - r.t) / n) / n ELSE 0 END), 6) + 0.0 AS x FROM sig1 s JOIN sig1 r ON r.recording = s.recording JOIN m ON m.recording = s.recording GROUP BY s.recording, s.t",
    m="SELECT recording, count(*) AS n FROM sig1 GROUP BY recording",
)
def analytic_part(spark, d):
    """The imaginary part of the analytic signal; in SQL the sum with its kernel, a cotangent."""
    return U.analytic_rows(sig1(spark, d)).select("recording", "t", (F.round("im", 6) + 0.0).alias("x"))


@query()
def cochleogram(spark, d):
    return rounded(D.band_envelopes(sig1(spark, d), P.erb_bands(2, 40)[:6] or [(2.0, 40.0)], 100.0, 8.0), "x")


@query()
def midbrain(spark, d):
    return rounded(D.modulations(cochleogram(spark, d), [2.0, 4.0], [0.5], 100.0), "x")


@query()
def varnet_envelope(spark, d):
    return rounded(P.combine_bands(cochleogram(spark, d), "rms"), "x")


@query()
def loudness(spark, d):
    return rounded(D.loudness(sig1(spark, d), 100.0, 32, 16), "x")


@query()
def specific_loudness(spark, d):
    """The signed sum of Bark bands at 40 samples a second."""
    return rounded(Y.specific_loudness(sig1(spark, d), 100.0, 40.0), "x")


@query()
def envelope_feature(spark, d):
    """The broadband envelope on a grid of 32 samples, its absolute differences."""
    return rounded(Y.envelope_feature(sig1(spark, d), "broadband", 100.0, 50.0, 32, change="absdiff"), "x")


@query(
    "SELECT recording, frame, bin, bin * 100.0::DOUBLE / 16 AS freq, round((pow(sum(x * w * cos(2 * pi() * bin * k / 16)), 2) + pow(sum(x * w * sin(2 * pi() * bin * k / 16)), 2)) / 64, 4) + 0.0 AS value "
    "FROM (SELECT recording, frame, t + 8 - 8 * frame AS k, x, 0.5 - 0.5 * cos(2 * pi() * (t + 8 - 8 * frame) / 16) AS w FROM f) f, b GROUP BY recording, frame, bin",
    b="SELECT unnest(range(9))::INTEGER AS bin",
    n=_LENGTH,
    f="SELECT s.recording, t, x, j.frame FROM sig1 s JOIN n ON n.recording = s.recording, (SELECT unnest(range(2)) AS back) o, LATERAL (SELECT (t + 8) // 8 - back AS frame) j WHERE j.frame BETWEEN 0 AND (last + 1) // 8",
)
def spectrogram(spark, d):
    """All bins of frames of 16 samples, half of them overlapping, zeros beyond the ends."""
    got = Y.spectrogram(sig1(spark, d), 16, 8, 100.0, boundary="zeros")
    return got.withColumn("value", F.round("value", 4) + 0.0)


@query()
def intensity(spark, d):
    return rounded(D.intensity_db(sig1(spark, d), 100.0, 9), "x")


@query()
def notch(spark, d):
    return rounded(P.notch(sig1(spark, d), [10.0, 20.0], 100.0, 64), "x")


@query()
def line_removal(spark, d):
    return rounded(D.remove_line(sign(spark, d), 10.0, 100.0, 50), "x")
