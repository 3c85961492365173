"""Queries of the discovery operators and of held-out scores by time folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.operators import alignment as A
from voltlake.operators import discovery as S
from voltlake.operators import encoding as E
from voltlake.operators import permutations as P
from voltlake.operators import registry as R
from voltlake.plans.testbed import coded, mark, query, sign, table

_CODED = "SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END::DOUBLE AS x, value AS y, count(*) OVER (PARTITION BY user_id) AS n FROM events"
_FOLDED = "SELECT recording, t, x, o AS output, CASE o WHEN 0 THEN y ELSE 40 * x + y END AS y, CASE WHEN (t * 5) // n < 4 THEN (t * 5) // n // 2 ELSE 2 END AS fold FROM codes, range(2) r(o)"
_SPAN = "SELECT recording, fold AS f, min(t) - 2 AS lo, max(t) + 2 AS hi FROM folded GROUP BY ALL"
_FIT = (
    "SELECT k.f AS fold, a.alpha, r.output, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + a.alpha) AS w, avg(x) AS mx, avg(y) AS my FROM folded r CROSS JOIN range(3) k(f) "
    "CROSS JOIN (VALUES (0.5::DOUBLE), (500.0::DOUBLE)) a(alpha) LEFT JOIN span s ON s.recording = r.recording AND s.f = k.f WHERE r.fold <> k.f AND NOT coalesce(r.t BETWEEN s.lo AND s.hi, false) GROUP BY k.f, a.alpha, r.output"
)
_EACH = "SELECT fold, alpha, output, corr(x * w + my - mx * w, y) AS r, 1 - sum(pow(y - x * w - my + mx * w, 2)) / (var_pop(y) * count(*)) AS r2 FROM folded JOIN fit USING (fold, output) GROUP BY fold, alpha, output"
_BEST = "SELECT output, alpha FROM (SELECT output, alpha, row_number() OVER (PARTITION BY output ORDER BY avg(r2) DESC, alpha) AS k FROM each GROUP BY output, alpha) WHERE k = 1"


@query("SELECT fold, output, alpha, round(r, 6) AS r, round(r2, 6) AS r2 FROM each JOIN best USING (output, alpha)", codes=_CODED, folded=_FOLDED, span=_SPAN, fit=_FIT, each=_EACH, best=_BEST)
def time_fold_scores(spark, d):
    rows = E.time_folds(coded(spark, d), 3, 5).select("recording", "t", "fold", F.array("x").alias("lagged"), F.array(F.col("y"), 40 * F.col("x") + F.col("y")).alias("y"))
    scores = E.fold_scores(rows, [0.5, 500.0], E.near_rows(rows, 2))
    return E.best_alpha_by_output(scores).select("fold", "output", "alpha", F.round("pearson", 6).alias("r"), F.round("r2", 6).alias("r2"))


_FILES = "SELECT user_id AS root, event_id % 4 AS run, CASE event_type WHEN 'click' THEN 'signal' WHEN 'view' THEN 'audio' WHEN 'error' THEN 'video' END AS part FROM events"
_UNITS = "SELECT r.root, u.run FROM (SELECT DISTINCT root FROM files) r LEFT JOIN (SELECT DISTINCT root, run FROM files WHERE part = 'signal') u ON r.root = u.root"


def _ending(kinds: dict[str, str], other: str):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit(other))


@query(
    "SELECT u.root, u.run::VARCHAR AS run, CASE WHEN count_if(part = 'signal') > 0 THEN 'conversation_' || u.run || '.vhdr' END AS signal, count_if(part = 'signal')::BIGINT AS n_signal, CASE WHEN count_if(part = 'audio') > 0 THEN 'conversation_' || u.run || '.wav' END AS audio, "
    "count_if(part = 'audio')::BIGINT AS n_audio, CASE WHEN count_if(part = 'video') > 0 THEN 'conversation_' || u.run || '.asf' END AS video, count_if(part = 'video')::BIGINT AS n_video FROM units u LEFT JOIN files f ON f.root = u.root AND f.run = u.run GROUP BY u.root, u.run",
    files=_FILES, units=_UNITS,
)
def conversation_units(spark, d):
    run = (F.col("event_id") % 4).cast("string")
    files = table(spark, d, "events").select(F.col("user_id").alias("root"), F.concat(F.lit("conversation_"), run, _ending({"click": ".vhdr", "view": ".wav", "error": ".asf"}, ".txt")).alias("path"))
    return S.find_units(files, S.adapter_of("task-Conversation").layout)


@query(
    "SELECT root, CASE WHEN s > 0 THEN '01' END AS run, part, found FROM (SELECT root, s, unnest(['signal', 'markers', 'log']) AS part, unnest([s, m, l]) AS found FROM n) WHERE found <> 1",
    n="SELECT user_id AS root, count_if(event_type = 'click')::BIGINT AS s, count_if(event_type = 'view')::BIGINT AS m, count_if(event_type = 'error')::BIGINT AS l FROM events GROUP BY user_id",
)
def naming_unit_issues(spark, d):
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("seq_1/"), "event_id")).otherwise(F.col("event_id").cast("string"))
    files = table(spark, d, "events").select(F.col("user_id").alias("root"), F.concat(name, _ending({"click": ".vhdr", "view": ".vmrk", "error": ".log"}, ".txt")).alias("path"))
    layout = S.adapter_of("naming").layout
    return S.unit_issues(S.find_units(files, layout), layout)


@query("SELECT DISTINCT l_orderkey, 'run-' || l_orderkey AS path FROM lineitem")
def single_run(spark, d):
    return S.one_run(table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("run-"), "l_orderkey").alias("path")), ["l_orderkey"])


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'data/sub-' || c_custkey || '/ieeg/sub-' || c_custkey || '_electrodes.tsv' ELSE 'data/sub-' || c_custkey || '/ses-' || c_nationkey || '/ieeg/sub-' || c_custkey || '_ses-' || c_nationkey || '_electrodes.tsv' END AS path FROM customer")
def electrode_paths(spark, d):
    session = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("ses-"), "c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", S.electrodes_path(F.lit("data"), F.col("c_custkey").cast("string"), session).alias("path"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'response_audio' WHEN 'view' THEN 'presentation_log' WHEN 'purchase' THEN 'behavior_aux' ELSE 'presentation_script' END AS kind FROM events")
def behaviour_manifest(spark, d):
    path = F.concat(F.lit("run.1/"), "event_id", _ending({"click": ".WAV", "view": ".log", "error": ".pcl", "signup": ".old.sce"}, ""))
    return table(spark, d, "events").select("event_id", S.behaviour_kind(path).alias("kind"))


@query("SELECT p_brand, arg_min(p_size, p_partkey) AS p_size, count(*) AS uses FROM part GROUP BY p_brand")
def first_use_lookup(spark, d):
    return S.stimulus_lookup(table(spark, d, "part"), "p_brand", "p_size", ["p_partkey"])


@query("SELECT event_id, CASE WHEN user_id % 3 = 1 THEN 21 + event_id % 2 WHEN user_id % 3 = 2 AND event_id % 2 = 0 THEN 30 ELSE -1 END::INTEGER AS trigger FROM events")
def trigger_numbers(spark, d):
    known = {("1", "0"): 21, ("1", "1"): 22, ("2", "0"): 30}
    part = lambda c, n: (F.col(c) % n).cast("string")
    return table(spark, d, "events").select("event_id", F.coalesce(S.trigger_id(part("user_id", 3), part("event_id", 2), known), F.lit(-1)).alias("trigger"))


_DOCS = "SELECT o_custkey AS subject, o_orderkey % 11 = 0 AS stray, o_orderkey % 7 = 0 AS unborn, o_orderkey % 13 = 0 AS early, o_orderkey % 5 AS medication, o_orderstatus, count(*) OVER (PARTITION BY o_custkey, o_orderkey % 3) AS many FROM orders"


@query(
    "SELECT subject, 'error' AS level, code FROM (SELECT subject, unnest(['sex_domain', 'birth_date', 'date_order', 'acquisition_repeated', 'medication', 'file_name']) AS code, "
    "unnest([o_orderstatus NOT IN ('F', 'O'), unborn, early AND NOT unborn, many > 1, medication > 3, stray]) AS bad FROM docs) WHERE bad",
    docs=_DOCS,
)
def subject_documents(spark, d):
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("subject"), F.when(k % 11 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("stem"), F.when(k % 7 == 0, "1970-13-40").otherwise("1970-01-01").alias("birth_date"),
        F.when(k % 13 == 0, "1960-02-03").otherwise("1999-02-03").alias("date"), (k % 3).alias("acquisition_id"), (k % 5).alias("medication"), F.col("o_orderstatus").alias("sex"),
    )
    return S.subject_issues(docs, {"sex": ("F", "O")}).withColumn("subject", F.col("subject").cast("long"))


@query("SELECT p_partkey, s.score FROM part LEFT JOIN (SELECT 'Brand#' || user_id AS name, arg_max(value, event_id) AS score FROM events GROUP BY user_id) s ON s.name = p_brand")
def score_on_contacts(spark, d):
    scores = table(spark, d, "events").select(F.concat(F.lit("Brand#"), "user_id").alias("electrode"), "value", "event_id")
    return S.align_scores(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name")), scores, "value", ["event_id"]).select("p_partkey", "score")


@query(
    "SELECT user_id, event_type, n, round(share, 6) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank, round(share - lag(share) OVER (PARTITION BY event_type ORDER BY user_id), 6) AS drift FROM shares",
    shares="SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)",
)
def vocabulary_drift(spark, d):
    return S.label_drift(table(spark, d, "events"), "user_id", "event_type").withColumns({"share": F.round("share", 6), "drift": F.round("drift", 6)})


_TURNS = "SELECT a.recording, s.shift, corr(a.y, b.x) AS c FROM codes a CROSS JOIN (VALUES (0), (1), (2), (3)) s(shift) JOIN codes b ON b.recording = a.recording AND (b.t + s.shift) % b.n = a.t GROUP BY ALL"
_RS = "SELECT recording, shift, CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END AS r FROM turned"


@query(
    "SELECT o.recording, round(o.r, 6) AS observed, round(avg(m.r), 6) AS null_mean, count_if(m.r >= o.r - 1e-12) / 3.0::DOUBLE AS reached FROM rs o JOIN rs m ON m.recording = o.recording AND o.shift = 0 AND m.shift > 0 GROUP BY o.recording, o.r",
    codes=_CODED, turned=_TURNS, rs=_RS,
)
def rotated_scores(spark, d):
    return S.rotated_null(coded(spark, d), ["recording"], "y", "x", [1, 2, 3]).withColumns({"observed": F.round("observed", 6), "null_mean": F.round("null_mean", 6)})


_ALL_TURNS = "SELECT a.recording, (a.t - b.t + a.n) % a.n AS shift, a.n, corr(a.y, b.x) AS c FROM codes a JOIN codes b ON b.recording = a.recording GROUP BY ALL"
_ALL_RS = "SELECT recording, shift, n, CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END AS r FROM turned"


@query(
    "SELECT o.recording, o.n, round(o.r, 6) AS observed, round(avg(m.r), 6) AS null_mean, round(stddev_pop(m.r), 6) AS null_sd, avg(CASE WHEN m.r >= o.r - 1e-9 THEN 1.0::DOUBLE WHEN m.r IS NOT NULL THEN 0 END) AS reached FROM rs o LEFT JOIN rs m ON m.recording = o.recording AND m.shift > 0 WHERE o.shift = 0 GROUP BY o.recording, o.n, o.r",
    codes=_CODED, turned=_ALL_TURNS, rs=_ALL_RS,
)
def every_rotation(spark, d):
    got = P.all_rotations_null(coded(spark, d), ["recording"], "y", "x")
    return got.withColumns({c: F.round(c, 6) + 0.0 for c in ("observed", "null_mean", "null_sd")})


@query()
def permuted_scores(spark, d):
    """A thousand permutations of each series.  Drawn numbers have no SQL; tests hold them to a brute force's distribution."""
    return P.permuted_null(coded(spark, d), ["recording"], "y", "x", times=1000, seed=7)


@query("SELECT recording, channel, t, round(x - CASE WHEN contact = 5 THEN avg(x) OVER (PARTITION BY recording, t) ELSE avg(x) OVER (PARTITION BY recording, t, contact > 2, contact = 5) END, 6) AS x FROM sign")
def average_with_fallback(spark, d):
    shaft = F.when(F.col("contact") <= 2, "a").when(F.col("contact") <= 4, "b")
    return S.with_grouped_fallback(sign(spark, d).withColumn("shaft", shaft), "shaft").select("recording", "channel", "t", F.round("x", 6).alias("x"))


_CONTACTS = "SELECT c_custkey // 8 AS shaft, c_custkey % 8 AS contact, c_name AS channel, c_acctbal AS x, c_nationkey::DOUBLE AS y, c_custkey::DOUBLE AS z FROM customer"


@query("SELECT shaft, channel, x, y, z FROM contacts UNION ALL SELECT a.shaft, a.channel || '-' || b.channel, (a.x + b.x) / 2, (a.y + b.y) / 2, (a.z + b.z) / 2 FROM contacts a JOIN contacts b ON a.shaft = b.shaft AND b.contact = a.contact + 1", contacts=_CONTACTS)
def pair_midpoints(spark, d):
    c = table(spark, d, "customer")
    points = c.select(F.floor(F.col("c_custkey") / 8).alias("shaft"), (F.col("c_custkey") % 8).alias("contact"), F.col("c_name").alias("channel"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.col("c_custkey").cast("double").alias("z"))
    return S.bipolar_midpoints(points)


@query("SELECT recording, t, x FROM sign WHERE contact % 2 = 0")
def other_speaker(spark, d):
    return S.audio_channels(sign(spark, d).withColumn("channel", F.col("contact") % 2), "other", own=1)


@query("SELECT 'regions' AS section, 0 AS place, count(*) AS n FROM region UNION ALL SELECT 'nations', 1, count(*) FROM nation")
def report_sections(spark, d):
    made = S.assemble({"regions": table(spark, d, "region"), "nations": table(spark, d, "nation")})
    return made.groupBy("section", "place").agg(F.count("row").alias("n"))


_PUBLIC = (
    "SELECT o_orderkey, o_orderpriority AS dataset_id, CASE o_orderkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 's' || o_custkey ELSE 'sub-' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') END AS subject, CASE o_orderkey % 8 WHEN 0 THEN 'x' ELSE 'ses-' || o_orderstatus END AS session, "
    "(o_custkey % 40)::VARCHAR AS acquisition_id, CASE WHEN o_orderkey % 3 = 0 THEN 'p' ELSE '' END AS protocol_id FROM orders"
)
_WITH_ID = "SELECT *, CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE dataset_id || '|' || subject || '|' || session || '|' || acquisition_id || '|' || CASE WHEN protocol_id = '' THEN 'none' ELSE protocol_id END END AS record_id FROM public"
_PUBLIC_ISSUES = (
    "SELECT o_orderkey, unnest(['error', 'warning', 'error', 'error', 'error']) AS level, unnest(['subject_pattern', 'session_pattern', 'record_id_missing', 'record_id_repeated', 'record_id_mismatch']) AS code, unnest([trim(subject) <> '' AND NOT regexp_matches(subject, '^sub-\\d{3}$'), NOT regexp_matches(session, '^ses-[A-Za-z0-9]+$'), record_id = '', "
    "record_id <> '' AND row_number() OVER (PARTITION BY record_id ORDER BY o_orderkey) > 1, record_id = 'other' AND trim(subject) <> '']) AS bad FROM withid"
)


@query("SELECT o_orderkey, level, code FROM found WHERE bad", public=_PUBLIC, withid=_WITH_ID, found=_PUBLIC_ISSUES)
def public_registry_issues(spark, d):
    key = F.col("o_orderkey")
    subject = F.when(key % 9 == 0, " ").when(key % 9 == 1, F.concat(F.lit("s"), "o_custkey")).otherwise(F.concat(F.lit("sub-"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, F.lit("0"))))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("dataset_id"), subject.alias("subject"), F.when(key % 8 == 0, "x").otherwise(F.concat(F.lit("ses-"), "o_orderstatus")).alias("session"),
        (F.col("o_custkey") % 40).cast("string").alias("acquisition_id"), F.when(key % 3 == 0, "p").otherwise("").alias("protocol_id"),
    )
    made = F.concat_ws("|", "dataset_id", "subject", "session", "acquisition_id", F.when(F.col("protocol_id") == "", "none").otherwise(F.col("protocol_id")))
    return R.public_issues(rows.withColumn("record_id", F.when(key % 13 == 0, "").when(key % 13 == 1, "other").otherwise(made)), "o_orderkey")


_LOG = "SELECT recording, t, CASE kind WHEN 'click' THEN 'Sound Recording' WHEN 'signup' THEN 'Response' ELSE 'Picture' END AS event_type, CASE kind WHEN 'click' THEN 'Mic_Rec' WHEN 'view' THEN t || '.bmp' WHEN 'error' THEN 'isi' WHEN 'purchase' THEN 'pause' ELSE '7' END AS code, t * 10 AS ms FROM mark"
_AHEAD = "SELECT *, lead(code, 1) OVER w AS c1, lead(code, 2) OVER w AS c2, lead(ms, 1) OVER w AS m1, lead(ms, 2) OVER w AS m2 FROM log WINDOW w AS (PARTITION BY recording ORDER BY t)"


def _log(spark, d):
    kind, t = F.col("kind"), F.col("t").cast("string")
    code = F.when(kind == "click", "Mic_Rec").when(kind == "view", F.concat(t, F.lit(".bmp"))).when(kind == "error", "isi").when(kind == "purchase", "pause").otherwise("7")
    return mark(spark, d).select("recording", "t", F.when(kind == "click", "Sound Recording").when(kind == "signup", "Response").otherwise("Picture").alias("event_type"), code.alias("code"), (F.col("t") * 10).alias("ms"))


@query("SELECT recording, t, ms AS recording_ms, coalesce(m1, -1) AS picture_ms, coalesce(m2, -1) AS isi_ms, coalesce(c1, '') AS stimulus, CASE WHEN c2 IS NULL THEN 'incomplete' WHEN c1 NOT LIKE '%.bmp' THEN 'no picture' WHEN c2 <> 'isi' THEN 'no isi' ELSE '' END AS fault FROM ahead WHERE code = 'Mic_Rec'", log=_LOG, ahead=_AHEAD)
def log_trial_faults(spark, d):
    return A.log_trials(_log(spark, d), strict=False).fillna("", ["fault", "stimulus"]).fillna(-1, ["picture_ms", "isi_ms"])


@query("SELECT recording, CASE code WHEN 'pause' THEN 'pause_onset' ELSE 'button_press' END AS trial_type, ms, CASE code WHEN 'pause' THEN 100 ELSE code::INTEGER END AS marker FROM log WHERE code IN ('pause', '7')", log=_LOG)
def log_extra_rows(spark, d):
    return A.log_extras(_log(spark, d))
