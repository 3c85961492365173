"""Queries of the intake operators: discovery, checks, small maps, and the reports on files and modalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.operators import intake as I
from voltlake.operators import series as X
from voltlake.plans.testbed import mark, query, sig1, sign, table

_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query("SELECT o_orderstatus AS status, lpad((o_orderkey % 37)::VARCHAR, 2, '0') AS run FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL ORDER BY ALL")
def run_discovery(spark, d):
    name = F.concat(F.lit("sub-1/ieeg/sub-1_task-x_"), F.when(F.col("o_orderkey") % 3 == 0, "acq-").otherwise("run-"), F.lpad((F.col("o_orderkey") % 37).cast("string"), 2, "0"), F.lit("_ieeg.vhdr"))
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), name.alias("path"))
    return I.run_ids([o, o.where("status = 'F'")], ["status"])


@query(f"SELECT host, arg_min(url, length(url) * 1000000 + r) AS url, count(*) AS candidates FROM (SELECT url, {_HOST} AS host, row_number() OVER (ORDER BY url COLLATE \"C\") AS r FROM pages) GROUP BY host")
def shortest_candidate(spark, d):
    p = table(spark, d, "pages").select("url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return I.shortest_path(p, ["host"], "url")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first_id, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL) GROUP BY user_id")
def distinct_in_order(spark, d):
    return I.ordered_distinct(table(spark, d, "events"), ["user_id"], "event_type", ["event_id"]).select("user_id", F.array_join("values", ",").alias("kinds"))


@query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'steel')")
def task_names(spark, d):
    return table(spark, d, "part").where(I.is_task_name(F.col("p_name"), ["red", "steel"])).select("p_partkey")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'stimulus' ELSE 'u' || user_id END WHEN 'view' THEN CASE WHEN user_id % 3 = 0 THEN 'picture' ELSE 'u' || user_id END WHEN 'error' THEN 'response_audio' WHEN 'signup' THEN 'button_response' ELSE 'a_purchase' END AS trial_type, CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN substr('ABCDE', (event_id % 7)::INTEGER, 1) END AS part FROM events")
def behaviour_types(spark, d):
    e = table(spark, d, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", " Sound", "view", "Picture", "error", "sound recording", "signup", "RESPONSE", "purchase", "A purchase")]), F.col("event_type"))
    name = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), "user_id"))
    return e.select("event_id", I.trial_type(kind, name).alias("trial_type"), I.part_letter(F.col("event_id") % 7).alias("part"))


@query("SELECT doc_id, upper(nullif(regexp_extract(source, '([a-z])[0-9]*$', 1), '')) AS part FROM documents")
def part_from_name(spark, d):
    return table(spark, d, "documents").select("doc_id", I.part_of_name(F.col("source"), "([a-z])[0-9]*$").alias("part"))


@query("SELECT recording, t, t * 0.01::DOUBLE * 1000.0::DOUBLE AS ms FROM sig1")
def milliseconds(spark, d):
    return sig1(spark, d).select("recording", "t", I.time_axis(F.col("t"), 0.01, "ms").alias("ms"))


@query("SELECT recording, t, round(avg(x), 6) AS x FROM sign GROUP BY recording, t")
def downmix_mean(spark, d):
    return I.downmix(sign(spark, d)).withColumn("x", F.round("x", 6))


@query("SELECT recording, 'error' AS level, 'rate' AS code FROM r WHERE NOT rate > 0 UNION ALL SELECT recording, 'error', 'no_samples' FROM r WHERE NOT samples > 0", r="SELECT user_id AS recording, user_id % 4 AS rate, count_if(event_type = 'click') AS samples FROM events GROUP BY user_id")
def raw_sanity(spark, d):
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("recording")).agg(F.count_if(F.col("event_type") == "click").alias("samples"))
    return I.recording_issues(r.withColumn("rate", F.col("recording") % 4))


@query("SELECT event_id, 'error' AS level, 'code' AS code FROM mark WHERE code NOT IN (1, 2, 4) UNION ALL SELECT event_id, 'error', 'sample' FROM mark WHERE t - 3 < 0")
def event_matrix_issues(spark, d):
    m = mark(spark, d).select("event_id", (F.col("t") - 3).alias("sample"), "code")
    return I.event_issues(m, {"a": 1, "b": 2, "c": 4}, "event_id")


@query("SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def missing_report_inputs(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_brand", "name")
    return I.missing_inputs(p.select("name").distinct(), p.where("p_size > 48").select("name"))


@query("SELECT l_returnflag, median(l_quantity) AS median_offset, round(avg(abs(l_tax - l_discount)), 8) AS mean_error, bool_and(l_tax < l_discount) AS all_match, count_if(NOT l_tax < l_discount)::BIGINT AS mismatches FROM lineitem GROUP BY l_returnflag")
def alignment_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_tax") - F.col("l_discount")).alias("error"), (F.col("l_tax") < F.col("l_discount")).alias("ok"))
    return I.match_summary(li, ["l_returnflag"], "l_quantity", "error", "ok").withColumn("mean_error", F.round("mean_error", 8))


_RANKS = "SELECT l_returnflag, l_quantity AS y, l_extendedprice AS p, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS ry, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS rp FROM lineitem"


@query("SELECT l_returnflag, 'pearson' AS metric, round(corr(y, p), 6) AS score FROM ranks GROUP BY ALL UNION ALL SELECT l_returnflag, 'spearman', round(corr(ry, rp), 6) FROM ranks GROUP BY ALL UNION ALL SELECT l_returnflag, 'r2', round(1 - sum(pow(y - p / 1000, 2)) / (var_pop(y) * count(*)), 6) FROM ranks GROUP BY ALL", ranks=_RANKS)
def metric_by_name(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("p"))
    out = None
    for name in ("pearson", "spearman", "r2"):
        part = I.score_by(name, li, ["l_returnflag"], "y", "p").select("l_returnflag", F.lit(name).alias("metric"), F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT a.user_id, b.lo - a.lo AS \"offset\", (b.hi - b.lo) - (a.hi - a.lo) AS longer FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'", spans="SELECT user_id, event_type, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL")
def modality_offsets(spark, d):
    return I.silent_gaps(table(spark, d, "events"), "user_id", "event_id", ("click", "view"), "event_type")


@query("SELECT source, count(*) AS files, count_if(text IS NOT NULL AND length(trim(text)) = 0)::BIGINT AS empty, count_if(text IS NULL)::BIGINT AS absent FROM documents GROUP BY source")
def present_but_empty(spark, d):
    blank = F.col("text").isNotNull() & (F.length(F.trim("text")) == 0)
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(blank).alias("empty"), F.count_if(F.col("text").isNull()).alias("absent"))


@query("SELECT doc_id, bytes, round(bytes / n_chars, 6) AS bytes_per_char FROM (SELECT *, quantile_cont(bytes, 0.25) OVER (PARTITION BY lang) AS lo, quantile_cont(bytes, 0.75) OVER (PARTITION BY lang) AS hi FROM (SELECT doc_id, lang, n_chars, octet_length(encode(text)) AS bytes FROM documents)) WHERE bytes < lo - 6 * greatest(hi - lo, 1e-12) OR bytes > hi + 6 * greatest(hi - lo, 1e-12)")
def size_outliers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.octet_length("text").cast("long").alias("bytes"))
    return X.outliers(docs, ["lang"], "bytes").where("is_outlier").select("doc_id", "bytes", F.round(F.col("bytes") / F.col("n_chars"), 6).alias("bytes_per_char"))


_MAIL, _PHONE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[+][0-9][0-9 -]{8,}[0-9]"


@query(f"SELECT source, count_if(regexp_matches(text, '{_MAIL}'))::BIGINT AS mails, count_if(regexp_matches(text, '{_PHONE}'))::BIGINT AS phones FROM documents GROUP BY source")
def sensitive_leakage(spark, d):
    has = lambda p: F.count_if(F.rlike("text", F.lit(p)))
    return table(spark, d, "documents").groupBy("source").agg(has(_MAIL).alias("mails"), has(_PHONE).alias("phones"))
