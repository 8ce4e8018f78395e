"""Joins, set operations and table maintenance."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import graph as G
from kgloom.registry import query
from kgloom.sources import sinks


@query("j01_chunk_parent", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j01(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("j02_source_coalesce", "SELECT s_suppkey, coalesce(nullif(n_name, 'NATION_1'), s_name) AS origin FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j02(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce(F.nullif("n_name", F.lit("NATION_1")), "s_name").alias("origin"))


@query("j03_orders_three_way", "SELECT o_orderkey, c_name, p_name, round(p_retailprice * l_quantity, 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
def j03(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 45")
    j = li.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("o_orderkey", "c_name", "p_name", F.round(F.col("p_retailprice") * F.col("l_quantity"), 2).alias("total"))


@query("s12_order_text", "SELECT o_orderkey, 'Order ' || o_orderkey || ' by ' || c_name || ' (' || o_orderstatus || ')' AS chunk FROM orders JOIN customer ON o_custkey = c_custkey")
def s12(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.format_string("Order %d by %s (%s)", "o_orderkey", "c_name", "o_orderstatus").alias("chunk"))


@query("j04_edge_endpoints", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j04(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    l = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("j05_mentions", "SELECT l_partkey AS entity, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS chunks FROM lineitem GROUP BY 1")
def j05b(spark, sf):
    return orders_of_parts(table(spark, sf, "lineitem"))


def orders_of_parts(lineitem):
    return lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))), ",").alias("chunks"))


@query("j06_path_join", "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey")
def j06(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "c_custkey")


@query("j07_anti_floating", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j07(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j15_category_baseline", "SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_type), 4) AS off FROM part")
def j15(spark, sf):
    p = table(spark, sf, "part")
    return p.join(p.groupBy("p_type").agg(F.avg("p_retailprice").alias("base")), "p_type").select("p_partkey", F.round(F.col("p_retailprice") - F.col("base"), 4).alias("off"))


@query("j16_latest_enrichment", "SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def j16(spark, sf):
    latest = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return table(spark, sf, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("m.o_orderkey").alias("last_order"))


@query("j17_neighbourhood", "SELECT DISTINCT node, id FROM (SELECT 's' || l_suppkey AS node, 'p' || l_partkey AS id FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)")
def j17b(spark, sf):
    """What is one edge away from each supplier, in either direction: parts that point at it, and its nation."""
    s, l = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    named = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edges = l.select(named("p", "l_partkey").alias("src"), named("s", "l_suppkey").alias("dst")).union(s.select(named("s", "s_suppkey"), named("n", "s_nationkey")))
    return G.neighbours(edges, s.select(named("s", "s_suppkey").alias("id")))


@query("j18_session_page", "SELECT conv_id, turn, count(*) OVER () AS total FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 20 OFFSET 20")
def j18(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("conv_id", "turn").offset(20).limit(20).crossJoin(F.broadcast(total))  # one row


@query("j19_optional_path", "SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def j19(spark, sf):
    c = table(spark, sf, "customer")
    return c.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("c_custkey", "o_orderkey", "l_linenumber")


@query("j20_agent_search_page", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_name ILIKE '%1%' OR n_name ILIKE '%1%' OR r_name ILIKE '%1%' ORDER BY s_suppkey LIMIT 25 OFFSET 5")
def j20(spark, sf):
    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.where(F.col("s_name").ilike("%1%") | F.col("n_name").ilike("%1%") | F.col("r_name").ilike("%1%")).orderBy("s_suppkey").offset(5).limit(25).select("s_suppkey", "n_name", "r_name")


@query("j21_folder_files", "SELECT source AS folder, doc_id FROM documents WHERE n_chars >= 2000")
def j21(spark, sf):
    d = table(spark, sf, "documents")
    folders = d.select(F.col("source").alias("folder")).distinct()
    return d.where("n_chars >= 2000").join(folders, F.col("source") == F.col("folder")).select("folder", "doc_id")


@query("a26_count_subquery", "SELECT count(*) AS total FROM (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name ILIKE '%1%')")
def a26(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation").where(F.col("n_name").ilike("%1%")), F.col("s_nationkey") == F.col("n_nationkey")).agg(F.count(F.lit(1)).alias("total"))


@query("u01_union_distinct", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT * FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY 1 LIMIT 500)")
def u01(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey").orderBy("c_custkey").limit(500)).distinct()


@query("u03_subjects_and_objects", "SELECT o_custkey AS id FROM orders UNION SELECT l_partkey FROM lineitem")
def u03(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, sf, "lineitem").select("l_partkey")).distinct()


@query("u05_set_difference", "SELECT p_partkey AS id FROM part EXCEPT SELECT o_custkey FROM orders")
def u05(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("u07_label_union", "SELECT n_regionkey, string_agg(DISTINCT n_name[1:8], ',' ORDER BY n_name[1:8]) AS labels FROM nation GROUP BY 1")
def u07(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.substring("n_name", 1, 8)))))), ",").alias("labels"))


@query("u08_id_dedupe", "SELECT DISTINCT user_id FROM events")
def u08(spark, sf):
    return table(spark, sf, "events").select("user_id").dropDuplicates()


@query("s21_upsert_latest", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def s21(spark, sf):
    e = table(spark, sf, "events")
    return sinks.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("s22_merge_nodes", "SELECT coalesce(a.c_custkey, b.o_custkey) AS id, coalesce(a.c_name, 'Customer ' || b.o_custkey) AS name, a.c_custkey IS NULL AS created FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT DISTINCT o_custkey FROM orders) b ON a.c_custkey = b.o_custkey")
def s22(spark, sf):
    have = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("name", F.concat(F.lit("Customer "), F.col("id")))
    return sinks.merged(have, new, ["id"], ["name"])


@query("s23_edge_sink", "SELECT count(*) AS created, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS merged FROM lineitem")
def s23(spark, sf):
    e = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return e.agg(F.count(F.lit(1)).alias("created")).crossJoin(sinks.idempotent(e, ["l_partkey", "l_suppkey"]).agg(F.count(F.lit(1)).alias("merged")))  # two single rows


@query("s24_purge_and_load", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey + 1000000, 'P' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def s24(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    new = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), F.lit("P").alias("o_orderstatus"))
    return sinks.replaced(o, new, "o_orderstatus")


@query("s25_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_orderkey IS NOT NULL")
def s25(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sinks.without(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("s19_new_objects", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id < d.doc_id AND o.source = d.source AND o.text = d.text)")
def s19(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return d.groupBy("source", "sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
