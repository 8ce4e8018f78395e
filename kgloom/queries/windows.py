"""Per-key order: neighbours, latest rows, running budgets, top-k and paging."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.registry import query


@query("x01_next_edges", "SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL")
def x01(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn")).where("next_turn is not null")


@query("x02_latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def x02(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return o.select("o_custkey", "m.o_orderkey", "m.o_totalprice")


@query("x03_first_per_value", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_size DESC, p_partkey) = 1")
def x03(spark, sf):
    p = table(spark, sf, "part").groupBy("p_name").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_size", -F.col("p_partkey"))).alias("p_partkey"))
    return p.select("p_name", "p_partkey")


@query("x04_last_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 3")
def x04(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return table(spark, sf, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 3").select("conv_id", "turn", "role")


@query("x05_position", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position FROM conversations")
def x05(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("x08_token_budget", "WITH t AS (SELECT conv_id, turn, role, length(text) // 4 AS tokens, text FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT conv_id, turn, role, used::BIGINT AS used FROM r WHERE used <= 300")
def x08(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, sf, "conversations").withColumn("tokens", F.floor(F.length("text") / 4))
    return t.withColumn("used", F.sum("tokens").over(w)).where("used <= 300").select("conv_id", "turn", "role", "used")


@query("x09_recency_score", "SELECT conv_id, turn, round(1 - 0.01 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) - 1), 4)::DOUBLE AS score FROM conversations")
def x09(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(1 - F.lit(0.01) * (F.row_number().over(w) - 1), 4).alias("score"))


@query("x10_survivor", "SELECT c_nationkey, c_custkey FROM (SELECT c.*, coalesce(n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY 2 * 3 + 3 * n + length(c_name) DESC, c_custkey) = 1")
def x10(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    score = F.lit(6) + 3 * F.coalesce("n", F.lit(0)) + F.length("c_name")
    return c.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct(score, -F.col("c_custkey"))).alias("c_custkey"))


@query("t06_pagination", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 60")
def t06(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(60).limit(30).select("o_orderkey", "o_orderdate")


@query("t08_recent_ten", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10")
def t08(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "ts")


@query("t09_nulls_last", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS LAST, c_custkey LIMIT 1400")
def t09(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal")).orderBy(F.col("bal").desc_nulls_last(), "c_custkey").limit(1400)


@query("t10_list_guard", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY 1, 2, 3 LIMIT 1000")
def t10(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(min(5000, 1000))


@query("m05_feedback_weights", "SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN event_type IN ('purchase', 'click') THEN 0.1::DOUBLE ELSE -0.1 END ORDER BY ts, event_id)), lambda a, d: least(2.0::DOUBLE, greatest(0.1::DOUBLE, a + d))), 6) AS weight FROM events GROUP BY 1")
def m05(spark, sf):
    """Weights move by 0.1 and are clamped at every event, so the order counts. A run of clamped steps is
    again a shift with a lower and an upper bound: an hour's events become one such step first, and the
    hours of a user are few, so no list grows with the events of a busy user."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("purchase", "click"), 0.1).otherwise(-0.1).alias("d"))
    low, high = F.lit(0.1), F.lit(2.0)
    step = lambda a, x: F.struct((a["shift"] + x["d"]).alias("shift"), F.least(high, F.greatest(low, a["low"] + x["d"])).alias("low"), F.least(high, F.greatest(low, a["high"] + x["d"])).alias("high"))
    hours = e.groupBy("user_id", F.date_trunc("hour", F.col("ts")).alias("hour")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "d"))).alias("s"))
    hours = hours.select("user_id", "hour", F.aggregate("s", F.struct(F.lit(0.0).alias("shift"), low.alias("low"), high.alias("high")), step).alias("f"))
    users = hours.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("hour", "f"))).alias("h"))
    weight = F.aggregate("h", F.lit(1.0), lambda w, x: F.least(x["f"]["high"], F.greatest(x["f"]["low"], w + x["f"]["shift"])))
    return users.select("user_id", F.round(weight, 6).alias("weight"))
