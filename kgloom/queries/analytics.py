"""Operational analytics over events, orders and documents."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import analytics as A
from kgloom.registry import query

STATUS = F.when
EV_STATUS = "CASE WHEN event_type = 'error' THEN 'UNANSWERED' WHEN event_type = 'purchase' THEN 'SUCCESS' ELSE 'OTHER' END"


def status():
    return F.when(F.col("event_type") == "error", "UNANSWERED").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("OTHER")


@query("a05_conditional_counts", f"SELECT count(*) AS total, count(*) FILTER ({EV_STATUS} = 'SUCCESS') AS answered, count(*) FILTER ({EV_STATUS} = 'UNANSWERED') AS unanswered, round(coalesce(avg(value / 500), 0), 6) AS avg_confidence FROM events")
def a05(spark, sf):
    return A.conditional_counts(table(spark, sf, "events"), status(), F.col("value") / 500)


@query("a06_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1 ORDER BY 1 LIMIT 30")
def a06(spark, sf):
    return A.daily_counts(table(spark, sf, "events"), "ts")


@query("a07_histogram5", "SELECT b::INT AS bucket, count(e.x) AS count FROM range(5) t(b) LEFT JOIN (SELECT least(floor(l_discount * 10 * 5), 4)::INT AS x FROM lineitem) e ON e.x = b GROUP BY 1")
def a07(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), F.col("l_discount") * 10)


@query("a08_ops_kpis_p95", "SELECT count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, count(*) FILTER (value <= 60) AS within, round(100.0 * count(*) FILTER (value <= 60) / count(*), 2) AS slo_pct FROM events")
def a08(spark, sf):
    v = F.col("value")
    within = F.count_if(v <= 60)
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.avg(v), 6).alias("mean_ms"), F.round(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95_ms"), within.alias("within"), F.round(F.lit(100.0) * within / F.count(F.lit(1)), 2).alias("slo_pct"))


@query("a09_daily_ratios", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value) / coalesce(nullif(sum(user_id % 3), 0), 1), 6) AS per_chunk FROM events GROUP BY 1")
def a09(spark, sf):
    ratio = F.try_divide(F.sum("value"), F.coalesce(F.nullif(F.sum(F.col("user_id") % 3), F.lit(0)), F.lit(1)).cast("double"))
    return table(spark, sf, "events").groupBy(A.day("ts").alias("day")).agg(F.round(ratio, 6).alias("per_chunk"))


@query("a10_tokens_by_category", "SELECT event_type AS category, sum(user_id)::BIGINT AS tokens FROM events GROUP BY 1")
def a10(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("category")).agg(F.sum("user_id").alias("tokens"))


@query("a10_tokens_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, sum(user_id)::BIGINT AS tokens FROM events GROUP BY 1")
def a10_day(spark, sf):
    return table(spark, sf, "events").groupBy(A.day("ts").alias("day")).agg(F.sum("user_id").alias("tokens"))


@query("a11_cost_by_category", "SELECT o_orderpriority AS category, round(sum(o_custkey) / 1e6 * 0.15 + sum(o_orderkey) / 1e6 * 0.60, 4) AS cost_usd FROM orders GROUP BY 1")
def a11(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(A.cost(F.sum("o_custkey"), F.sum("o_orderkey")).alias("cost_usd"))


@query("a12_capacity_projection", "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT round(avg(n), 2) AS per_day, round(avg(n) * 30 * 1.15, 2) AS next_month, round(avg(n) * 30 * 1.15 * 1.15 * 1.15, 2) AS next_quarter FROM d")
def a12(spark, sf):
    d = table(spark, sf, "events").groupBy(A.day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    g = F.lit(A.GROWTH)
    return d.agg(F.round(F.avg("n"), 2).alias("per_day"), F.round(F.avg("n") * 30 * g, 2).alias("next_month"), F.round(F.avg("n") * 30 * g * g * g, 2).alias("next_quarter"))


@query("a13_health_status", "SELECT user_id, CASE WHEN f > 0.10 * n THEN 'CRITICAL' WHEN f > 0 OR r > 0.20 OR b > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error' AND value > 150) AS f, (count(*) FILTER (event_type = 'view'))::DOUBLE / count(*) AS r, count(*) FILTER (value > 300) AS b FROM events GROUP BY 1)")
def a13(spark, sf):
    n = F.count(F.lit(1))
    g = table(spark, sf, "events").groupBy("user_id").agg(n.alias("n"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("f"), (F.count_if(F.col("event_type") == "view") / n).alias("r"), F.count_if(F.col("value") > 300).alias("b"))
    return g.select("user_id", A.health(F.col("n"), F.col("f"), F.col("r"), F.col("b")).alias("status"))


@query("a14_baseline_drift", "WITH b AS (SELECT lang, avg(n_chars / 100.0) AS base, count(*) AS docs FROM documents WHERE n_chars > 0 GROUP BY 1 HAVING count(*) >= 20) SELECT d.doc_id, round((d.n_chars / 100.0 - b.base) / b.base, 6) AS deviation FROM documents d JOIN b USING (lang) WHERE (d.n_chars / 100.0 - b.base) / b.base < -0.5")
def a14(spark, sf):
    docs = table(spark, sf, "documents")
    density = F.col("n_chars") / 100.0
    base = docs.where("n_chars > 0").groupBy("lang").agg(F.avg(density).alias("base"), F.count(F.lit(1)).alias("docs")).where("docs >= 20")
    off = (density - F.col("base")) / F.col("base")
    return docs.join(base, "lang").where(off < -0.5).select("doc_id", F.round(off, 6).alias("deviation"))


@query("a15_dashboard_accuracy", "SELECT round(100.0 * count(*) FILTER (event_type = 'purchase') / count(*), 2) AS accuracy_pct, round(avg(value / 500), 4) AS confidence FROM events")
def a15(spark, sf):
    return table(spark, sf, "events").agg(F.round(F.lit(100.0) * F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1)), 2).alias("accuracy_pct"), F.round(F.avg(F.col("value") / 500), 4).alias("confidence"))


@query("a16_first_seen_by_source", "SELECT trim(event_type) AS source, min(ts) AS first_seen FROM events WHERE trim(event_type) <> '' GROUP BY 1")
def a16(spark, sf):
    return table(spark, sf, "events").where(F.trim("event_type") != "").groupBy(F.trim("event_type").alias("source")).agg(F.min("ts").alias("first_seen"))


@query("a18_distinct_pairs", "SELECT DISTINCT p_brand, p_type FROM part")
def a18(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("a19_collect_lists", "SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1")
def a19(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",").alias("members"))


@query("a20_set_precision_recall", "WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 1000), t AS (SELECT doc_id FROM labels WHERE quality = 1), s AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM p JOIN t USING (doc_id)) AS hit) SELECT CASE WHEN np = 0 OR nt = 0 THEN 0 ELSE round(hit::DOUBLE / np, 6) END AS precision, CASE WHEN np = 0 OR nt = 0 THEN 0 ELSE round(hit::DOUBLE / nt, 6) END AS recall, CASE WHEN np = 0 OR nt = 0 OR hit = 0 THEN 0 ELSE round(2.0 * hit / (np + nt), 6) END AS f1 FROM s")
def a20(spark, sf):
    p = table(spark, sf, "documents").where("n_chars > 1000").select("doc_id").withColumn("p", F.lit(1))
    t = table(spark, sf, "labels").where("quality = 1").select("doc_id").withColumn("t", F.lit(1))
    s = p.join(t, "doc_id", "full").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("np"), F.coalesce(F.sum("t"), F.lit(0)).alias("nt"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("hit"))
    some = (F.col("np") > 0) & (F.col("nt") > 0)
    return s.select(F.when(some, F.round(F.col("hit") / F.col("np"), 6)).otherwise(0.0).alias("precision"), F.when(some, F.round(F.col("hit") / F.col("nt"), 6)).otherwise(0.0).alias("recall"), F.when(some & (F.col("hit") > 0), F.round(F.lit(2.0) * F.col("hit") / (F.col("np") + F.col("nt")), 6)).otherwise(0.0).alias("f1"))


@query("a21_recall_at_k", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk, o_orderstatus = 'F' AS good FROM orders) SELECT o_custkey, CASE WHEN count(*) FILTER (good) = 0 THEN 1.0 ELSE round(count(*) FILTER (good AND rk <= 5)::DOUBLE / count(*) FILTER (good), 6) END AS recall FROM r GROUP BY 1")
def a21(spark, sf):
    from pyspark.sql import Window

    ranked = table(spark, sf, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rk"), (F.col("o_orderstatus") == "F").alias("good"))
    good = F.count_if("good")
    return ranked.groupBy("o_custkey").agg(F.when(good == 0, 1.0).otherwise(F.round(F.try_divide(F.count_if(F.col("good") & (F.col("rk") <= 5)), good), 6)).alias("recall"))


@query("a22_rag_health", "SELECT round(avg(value), 2) AS avg_ms, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 2) AS hit_rate, round(100.0 * count(*) FILTER (value > 250) / count(*), 2) AS timeout_rate, count(*) AS queries FROM events")
def a22(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "events").agg(F.round(F.avg("value"), 2).alias("avg_ms"), F.round(F.lit(100.0) * F.count_if(F.col("event_type") == "view") / n, 2).alias("hit_rate"), F.round(F.lit(100.0) * F.count_if(F.col("value") > 250) / n, 2).alias("timeout_rate"), n.alias("queries"))


@query("a23_integrity_score", "WITH s AS (SELECT doc_id, CASE WHEN n_chars = 0 THEN 0 ELSE greatest(0, 100 - CASE WHEN sim < 0.85 THEN 25 WHEN sim < 0.95 THEN 10 ELSE 0 END - CASE WHEN ret < 0.8 THEN 20 ELSE 0 END - least(30, floor(loss * 30)::INT)) END::INT AS score FROM (SELECT doc_id, n_chars, (n_chars % 50 + 50) / 100.0::DOUBLE AS sim, (n_chars % 7) / 7.0::DOUBLE AS ret, (n_chars % 11) / 10.0::DOUBLE AS loss FROM documents)) SELECT doc_id, score, CASE WHEN score >= 95 THEN 'EXCELLENT' WHEN score >= 80 THEN 'GOOD' WHEN score >= 60 THEN 'DEGRADED' ELSE 'FAILED' END AS band FROM s")
def a23(spark, sf):
    n = F.col("n_chars")
    d = table(spark, sf, "documents").select("doc_id", A.integrity((n % 50 + 50) / F.lit(100.0), (n % 7) / F.lit(7.0), (n % 11) / F.lit(10.0), n).alias("score"))
    return d.select("doc_id", "score", A.band(F.col("score")).alias("band"))


@query("a25_alert_rules", "WITH r AS (SELECT user_id, avg((event_type = 'error')::INT) AS fb, avg((event_type = 'view')::INT) AS rt, avg((event_type = 'click')::INT) AS rp, avg(value) / 60 - 1 AS dr FROM events GROUP BY 1) SELECT user_id, 'fallback_rate' AS rule, 'CRITICAL' AS severity FROM r WHERE fb > 0.05 UNION ALL SELECT user_id, 'retry_rate', 'WARNING' FROM r WHERE rt > 0.10 UNION ALL SELECT user_id, 'repair_rate', 'WARNING' FROM r WHERE rp > 0.20 UNION ALL SELECT user_id, 'baseline_drift', 'WARNING' FROM r WHERE dr < -0.5")
def a25(spark, sf):
    rate = lambda t: F.avg((F.col("event_type") == t).cast("int"))
    r = table(spark, sf, "events").groupBy("user_id").agg(rate("error").alias("fb"), rate("view").alias("rt"), rate("click").alias("rp"), (F.avg("value") / 60 - 1).alias("dr"))
    return r.select("user_id", F.explode(A.alerts(F.col("fb"), F.col("rt"), F.col("rp"), F.col("dr"))).alias("a")).select("user_id", "a.rule", "a.severity")


@query("a27_count_by_filter", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def a27(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'P' and o_totalprice > 100000").agg(F.count(F.lit(1)).alias("n"))


@query("a28_other_users_of_file", "SELECT a.doc_id, count(b.doc_id) AS others FROM documents a LEFT JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id AND b.n_chars > 0 GROUP BY 1")
def a28(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file"), (F.col("n_chars") > 0).alias("active"))
    # counts by file first, so that a file with many users is one row in the join
    by = d.groupBy("file").agg(F.count_if("active").alias("users"))
    return d.join(by, "file", "left").select("doc_id", (F.col("users") - F.col("active").cast("int")).alias("others"))
