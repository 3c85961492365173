"""Registry queries: overlay, availability, selection, validation, identifiers and the specified inventory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.functions import scalars as S
from voltlake.operators import registry as R
from voltlake.plans.testbed import priv, pub, query, table


def view(spark: SparkSession, d: str) -> DataFrame:
    return R.overlay(pub(spark, d), priv(spark, d))


COLS = "dataset_id, subject, task, protocol_id, record_id, excluded, exclude_reason"


@query(f"SELECT {COLS} FROM rview")
def registry_view(spark, d):
    return view(spark, d).select(*COLS.split(", "))


@query("SELECT dataset_id, task, protocol_id, count(*) AS total_records, count_if(excluded)::BIGINT AS excluded_records, count_if(NOT excluded)::BIGINT AS usable_records, printf('%.4f', count_if(NOT excluded) / count(*)) AS usable_fraction FROM rview GROUP BY ALL ORDER BY 1, 2, 3")
def availability_index(spark, d):
    return R.availability_index(view(spark, d)).orderBy("dataset_id", "task", "protocol_id")


@query("SELECT count(*) AS total, count_if(excluded)::BIGINT AS excluded, count_if(NOT excluded)::BIGINT AS usable FROM rview")
def registry_counts(spark, d):
    return R.counts(view(spark, d))


@query("SELECT record_id, subject FROM rview WHERE task = '1-URGENT' AND NOT excluded")
def registry_list_runs(spark, d):
    return R.list_runs(view(spark, d), task="1-URGENT", usable_only=True).select("record_id", "subject")


@query("SELECT DISTINCT task FROM pub WHERE subject = 7 AND task IS NOT NULL ORDER BY 1")
def available_tasks(spark, d):
    return R.tasks_of(pub(spark, d), 7).orderBy("task")


@query("SELECT subject FROM rview WHERE NOT excluded AND task IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY subject HAVING count(DISTINCT task) = 3")
def subjects_with_all_tasks(spark, d):
    return R.subjects_with_tasks(view(spark, d), ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("SELECT o_orderkey, concat_ws('|', o_orderpriority, o_orderstatus, o_custkey::VARCHAR, o_orderkey::VARCHAR, 'none') AS rid FROM orders")
def record_id_make(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.record_id(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderkey"), S.or_none(F.lit(" "))).alias("rid"))


@query("SELECT o_orderkey, split_part(record_id, '|', 1) AS dataset, split_part(record_id, '|', 2) AS subject, split_part(record_id, '|', 3) AS acquisition FROM pub")
def record_id_parse(spark, d):
    return pub(spark, d).select("o_orderkey", S.record_parts(F.col("record_id"), ["dataset", "subject", "acquisition"]).alias("p")).select("o_orderkey", "p.*")


@query("SELECT o_orderkey, (year(DATE '2020-02-29') - year(o_orderdate) - CASE WHEN 229 < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END)::BIGINT AS years FROM orders WHERE o_orderdate::DATE <= DATE '2020-02-29'")
def completed_years(spark, d):
    birth = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", S.completed_years(birth, F.lit("2020-02-29").cast("date")).alias("years")).where(F.col("years").isNotNull())


@query("SELECT o_orderkey, try_strptime(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END, '%Y-%m-%d')::DATE::VARCHAR AS day FROM orders")
def iso_date_parse(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return table(spark, d, "orders").select("o_orderkey", S.iso_date(text).cast("string").alias("day"))


@query("SELECT c_custkey, coalesce(p.pid, 'none') AS protocol_id FROM customer LEFT JOIN (SELECT DISTINCT 'P' || n_regionkey AS pid, n_nationkey FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'Q', n_nationkey FROM nation WHERE n_nationkey % 2 = 0) p ON n_nationkey = c_nationkey")
def protocol_fanout(spark, d):
    n = table(spark, d, "nation")
    a = n.where("n_regionkey < 3").groupBy(F.concat(F.lit("P"), "n_regionkey").alias("protocol_id")).agg(F.collect_list("n_nationkey").alias("sessions"))
    b = n.where("n_nationkey % 2 = 0").agg(F.collect_list("n_nationkey").alias("sessions")).select(F.lit("Q").alias("protocol_id"), "sessions")
    return R.fan_out(table(spark, d, "customer").select("c_custkey", "c_nationkey"), a.unionByName(b), "c_nationkey", "sessions", "protocol_id").select("c_custkey", "protocol_id")


@query("SELECT c_mktsegment AS subject, o_orderpriority AS task, 'unknown' AS qc_status FROM orders JOIN customer ON o_custkey = c_custkey")
def public_sanitize(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("private_id"), F.col("o_orderpriority").alias("task"), F.col("o_totalprice").alias("secret"))
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("private_id"), F.col("c_mktsegment").alias("subject"))
    return R.sanitize(o, ids, "private_id", "subject", ["subject", "task", "qc_status"], ["good", "bad", "unknown"])


_FAULTS = "SELECT record_id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'sub-' || lpad(subject::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN 5 ELSE 3 END, '0') END AS subject, o_orderkey FROM pub"


@query("SELECT record_id, 'error' AS level, 'subject_pattern' AS code FROM faults WHERE NOT regexp_matches(subject, '^sub-\\d{3}$') UNION ALL SELECT record_id, 'error', 'subject_blank' FROM faults WHERE trim(subject) = '' UNION ALL SELECT record_id, 'warning', 'odd_key' FROM faults WHERE o_orderkey % 11 = 0", faults=_FAULTS)
def validation_issues(spark, d):
    bad = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("sub-"), F.lpad(F.col("subject").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, 5).otherwise(3), F.lit("0"))))
    f = pub(spark, d).select("record_id", bad.alias("subject"), "o_orderkey")
    return R.issues(f, "record_id", {"subject_pattern": ("error", ~F.rlike("subject", F.lit(r"^sub-\d{3}$"))), "subject_blank": ("error", F.trim("subject") == ""), "odd_key": ("warning", F.col("o_orderkey") % 11 == 0)})


@query("SELECT level, count(*) AS n FROM (SELECT 'error' AS level FROM faults WHERE NOT regexp_matches(subject, '^sub-\\d{3}$') UNION ALL SELECT 'error' FROM faults WHERE trim(subject) = '' UNION ALL SELECT 'warning' FROM faults WHERE o_orderkey % 11 = 0) GROUP BY level", faults=_FAULTS)
def validation_counts(spark, d):
    return validation_issues(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r > 1")
def duplicate_keys(spark, d):
    li = table(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    return R.repeated(li, "key", ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus IS NULL OR o_orderstatus IN ('F', 'O')) AND NOT coalesce(o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED'), false)")
def include_exclude_filter(spark, d):
    return R.include_exclude(table(spark, d, "orders"), {"o_orderstatus": ["F", "O"]}, {"o_orderpriority": ["5-LOW", "4-NOT SPECIFIED"]}).select("o_orderkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, ts, event_id) AS r FROM events) WHERE r = 1")
def preference_pick(spark, d):
    return R.preferred(table(spark, d, "events"), ["user_id"], "event_type", ["purchase", "signup", "click"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_present(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_missing(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45")
def lookup_required(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.lookup_once(li, table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey", "s_name", "supplier").drop("l_suppkey")


@query("SELECT event_id, coalesce(e.v, l.v) AS found FROM events LEFT JOIN (SELECT n_regionkey::VARCHAR AS part, n_nationkey AS k, min(n_name) AS v FROM nation WHERE n_regionkey > 0 GROUP BY ALL) e ON e.part = (user_id % 5)::VARCHAR AND e.k = user_id % 25 LEFT JOIN (SELECT n_nationkey AS k, min(n_name) AS v FROM nation WHERE n_regionkey = 0 GROUP BY ALL) l ON l.k = user_id % 25")
def fallback_lookup(spark, d):
    n = table(spark, d, "nation").select(F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).otherwise("").alias("part"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("found"))
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).cast("string").alias("part"), (F.col("user_id") % 25).alias("k"))
    return R.lookup_fallback(e, n, "part", "k", "found").select("event_id", "found")


@query("SELECT n_name, regexp_replace('sub-' || n_name, '^sub-', '') AS bare, 'sub-' || n_name || '_task-' || n_nationkey || '_ieeg' AS name, n_nationkey::VARCHAR AS task FROM nation")
def entity_names(spark, d):
    n = table(spark, d, "nation")
    name = S.entity_name(F.col("n_name"), F.lit(None).cast("string"), F.col("n_nationkey").cast("string"), F.lit(None).cast("string"), "ieeg")
    return n.select("n_name", S.strip_prefix(F.concat(F.lit("sub-"), "n_name"), "sub-").alias("bare"), name.alias("name")).withColumn("task", S.entity_token(F.col("name"), "task"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '(\\.[^.]+)+$', '') AS stem FROM pages")
def name_tokens(spark, d):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), S.strip_suffixes(host).alias("stem"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || p_partkey), '([0-9]+)', '000000000000\\1', 'g'), '0+([0-9]{12})$', '\\1') AS key FROM part")
def natural_sort_key(spark, d):
    return table(spark, d, "part").select("p_partkey", S.natural_key(F.concat("p_name", "p_partkey")).alias("key"))


@query("SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, round(24.7 * (4.37 * p_retailprice / 1000 + 1), 3) AS erb, round(21.4 * log10(4.37 * p_retailprice / 1000 + 1), 6) AS erb_rate, round(13 * atan(0.00076 * p_retailprice) + 3.5 * atan(pow(p_retailprice / 7500, 2)), 6) AS bark, round(700 * (pow(10, p_size / 2595) - 1), 6) AS hz, round(pow(10, p_size / 10), 4) AS power, p_size / 1000 AS metres FROM part")
def unit_functions(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(S.erb_width(p), 3).alias("erb"), *[F.round(f(p), 6).alias(n) for n, f in (("mel", S.hz_to_mel), ("erb_rate", S.hz_to_erb_rate), ("bark", S.hz_to_bark))], F.round(S.mel_to_hz(F.col("p_size")), 6).alias("hz"), F.round(S.db_to_power(F.col("p_size")), 4).alias("power"), S.to_metres(F.col("p_size"), "mm").alias("metres"))


@query("SELECT p_brand, regexp_extract(replace(p_brand, '#', ''), '^([A-Za-z]+)', 1) AS shaft, regexp_extract(p_brand, '([0-9]+)$', 1)::INTEGER AS contact FROM part")
def shaft_contact(spark, d):
    c = S.shaft_and_contact(F.regexp_replace("p_brand", "#", ""))
    return table(spark, d, "part").select("p_brand", c["shaft"].alias("shaft"), c["contact"].alias("contact"))


# ---- specified inventory and report aggregates


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def inventory_rollup(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'error')::BIGINT AS error, count_if(event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY user_id")
def coverage_matrix(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).count().na.fill(0)


@query("SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS ext, count(*) AS n FROM pages GROUP BY ALL")
def format_breakdown(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT task, round(avg(CASE WHEN has_f THEN 1.0 ELSE 0.0 END), 6) AS with_companion, count(*) AS n FROM (SELECT o_orderpriority AS task, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_f FROM orders) GROUP BY task")
def companion_consistency(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(1.0))
    return table(spark, d, "orders").join(li, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("task")).agg(F.round(F.avg(F.coalesce("has", F.lit(0.0))), 6).alias("with_companion"), F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_by_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT source, round(avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS completeness, count_if(l.doc_id IS NULL)::BIGINT AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source ORDER BY missing DESC, source LIMIT 10")
def top_missing(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("has", F.lit(1.0)), "doc_id", "left")
    return j.groupBy("source").agg(F.round(F.avg(F.coalesce("has", F.lit(0.0))), 6).alias("completeness"), F.count_if(F.col("has").isNull()).alias("missing")).orderBy(F.desc("missing"), "source").limit(10)


@query("SELECT o_orderpriority AS task, round(quantile_cont(o_totalprice, 0.25), 3) AS q1, round(quantile_cont(o_totalprice, 0.5), 3) AS q2, round(quantile_cont(o_totalprice, 0.75), 3) AS q3 FROM orders GROUP BY ALL", )
def duration_quartiles(spark, d):
    q = F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(q.alias("q")).select("task", *[F.round(F.col("q")[k], 3).alias(f"q{k + 1}") for k in range(3)])


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def session_timelines(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT day::VARCHAR AS day, n, sum(n) OVER (ORDER BY day)::BIGINT AS running FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL)")
def cumulative_coverage(spark, d):
    per = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))  # one row a day
    return per.withColumn("running", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))).withColumn("day", F.col("day").cast("string"))


@query("SELECT recording, round(regr_slope(sec - off, t), 3) AS slope FROM (SELECT *, min(sec) OVER (PARTITION BY recording) AS off FROM mark) GROUP BY recording")
def drift_slope(spark, d):
    from voltlake.plans.testbed import mark

    m = mark(spark, d)
    low = m.groupBy("recording").agg(F.min("sec").alias("off"))
    return m.join(low, "recording").groupBy("recording").agg(F.round(F.regr_slope(F.col("sec") - F.col("off"), F.col("t").cast("double")), 3).alias("slope"))


@query("SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, epoch_us(ts) - epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS gap FROM events) WHERE gap > 86400000000")
def within_run_gaps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").withColumn("gap", us - F.max(us).over(w)).where("gap > 86400000000").select("user_id", "event_id", "gap")


@query("SELECT user_id, count(*) AS islands, sum(e - s)::BIGINT AS covered FROM (SELECT user_id, isl, min(s) AS s, max(e) AS e FROM (SELECT user_id, s, e, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 43200000000 AS e FROM events))) GROUP BY user_id, isl) GROUP BY user_id")
def annotation_coverage(spark, d):
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", s.alias("s"), (s + F.lit(43200000000)).alias("e"))
    w = Window.partitionBy("user_id").orderBy("s", "e")
    fresh = F.when(F.col("s") <= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    isl = e.withColumn("f", fresh).withColumn("isl", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy("user_id", "isl").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("user_id").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col("e") - F.col("s")).alias("covered"))


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_density(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 day")["start"].alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(count(value) / count(*), 6) AS filled, count_if(json_extract_string(props, '$.k') IS NOT NULL)::BIGINT AS with_key FROM events GROUP BY event_type")
def column_completeness(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.count("value") / F.count(F.lit(1)), 6).alias("filled"), F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("with_key"))


@query("SELECT source, count(*) AS n, round(sum(count(*)) OVER (ORDER BY count(*) DESC, source ROWS UNBOUNDED PRECEDING) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def pareto_causes(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))  # a row a cause
    w = Window.orderBy(F.desc("n"), "source").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("share", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate OR l_shipdate > o_orderdate + INTERVAL 90 DAY")
def out_of_bounds(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.where((F.col("l_shipdate") < F.col("o_orderdate")) | (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS in_orders, coalesce(b.n, 0) AS in_lines FROM (SELECT o_custkey % 100 AS k, count(*) AS n FROM orders GROUP BY ALL) a FULL JOIN (SELECT l_suppkey % 120 AS k, count(*) AS n FROM lineitem GROUP BY ALL) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def sidecar_mismatch(spark, d):
    a = table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("k")).agg(F.count(F.lit(1)).alias("in_orders"))
    b = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 120).alias("k")).agg(F.count(F.lit(1)).alias("in_lines"))
    return a.join(b, "k", "full").where(~F.col("in_orders").eqNullSafe(F.col("in_lines"))).na.fill(0)


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, mode(event_type ORDER BY event_type) IS NOT NULL AS has_mode FROM events GROUP BY user_id")
def rate_consistency(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.mode("event_type").isNotNull().alias("has_mode"))


@query("SELECT a.u AS u, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM (SELECT user_id AS u, list(DISTINCT event_type) AS s FROM events WHERE event_id % 2 = 0 GROUP BY ALL) a JOIN (SELECT user_id AS u, list(DISTINCT event_type) AS s FROM events WHERE event_id % 2 = 1 GROUP BY ALL) b ON a.u = b.u")
def channel_stability(spark, d):
    e = table(spark, d, "events")
    a, b = (e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("u")).agg(F.collect_set("event_type").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return a.join(b, "u").select("u", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query("SELECT user_id, event_id, epoch_us(ts) - epoch_us(p) AS d FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE epoch_us(ts) - epoch_us(p) < 600000000")
def near_duplicates_in_time(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("d", us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("d < 600000000").select("user_id", "event_id", "d")


@query("SELECT label_rank, event_type, n FROM (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INTEGER AS label_rank FROM events GROUP BY event_type)")
def label_long_tail(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))  # a row a label
    return n.withColumn("label_rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))


@query("SELECT a.k AS a, b.k AS b, count(*) AS n FROM (SELECT DISTINCT user_id, ts::DATE AS d, event_type AS k FROM events) a JOIN (SELECT DISTINCT user_id, ts::DATE AS d, event_type AS k FROM events) b ON a.user_id = b.user_id AND a.d = b.d AND a.k < b.k GROUP BY ALL")
def label_cooccurrence(spark, d):
    one = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sort_array(F.collect_set("event_type")).alias("s"))  # five kinds at most
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return one.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE round(l_extendedprice * 100) % 5 <> 0")
def boundary_quantisation(spark, d):
    return table(spark, d, "lineitem").where(F.round(F.col("l_extendedprice") * 100) % 5 != 0).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS qe, round(corr(l_discount, l_tax), 6) AS dt, round(var_pop(l_quantity), 4) AS vq FROM lineitem")
def predictor_collinearity(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("qe"), F.round(F.corr("l_discount", "l_tax"), 6).alias("dt"), F.round(F.var_pop("l_quantity"), 4).alias("vq"))


@query("SELECT dataset_id, CASE WHEN count_if(NOT excluded) / count(*) >= 0.7 THEN 'OK' WHEN count_if(NOT excluded) / count(*) >= 0.3 THEN 'WARN' ELSE 'FAIL' END AS gate FROM rview GROUP BY dataset_id")
def report_gates(spark, d):
    f = F.count_if(~F.col("excluded")) / F.count(F.lit(1))
    return view(spark, d).groupBy("dataset_id").agg(F.when(f >= 0.7, "OK").when(f >= 0.3, "WARN").otherwise("FAIL").alias("gate"))


@query("SELECT event_type AS task, count(*) AS runs, round(sum(value) / 60, 3) AS minutes, round(sum(CASE WHEN value > 10 THEN value ELSE 0 END) / 60, 3) AS usable_minutes FROM events GROUP BY event_type")
def minutes_per_task(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("task")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("value") / 60, 3).alias("minutes"), F.round(F.sum(F.when(F.col("value") > 10, F.col("value")).otherwise(0.0)) / 60, 3).alias("usable_minutes"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def extra_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.event_id, (SELECT max(o.o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate = (SELECT max(o2.o_orderdate) FROM orders o2 WHERE o2.o_custkey = e.user_id AND o2.o_orderdate <= e.ts)) AS asof_order FROM events e")
def extra_asof(spark, d):
    """The last order at or before each event, by one sorted pass over the union of both."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("at", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    return o.unionByName(e).withColumn("asof_order", F.last("o", True).over(w)).where("side = 1").select("event_id", "asof_order")
