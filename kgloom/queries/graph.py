"""Graph expansion, reduction, merging and relational-to-graph mapping."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import graph as G
from kgloom.operators import retrieval as R
from kgloom.registry import query
from kgloom.sources.readers import kept


def once(text, pattern):
    """The lower-cased matches of a text, each once, so that repeats don't reach a shuffle."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def customer_nation(spark, sf):
    """Edges order -> customer -> nation with ids in ranges of their own."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 10_000_000).alias("dst"))
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 10_000_000).alias("src"), (F.col("c_nationkey") + 20_000_000).cast("long").alias("dst"))
    return o.union(c)


EDGES = "SELECT o_orderkey AS src, o_custkey + 10000000 AS dst FROM orders UNION ALL SELECT c_custkey + 10000000, c_nationkey + 20000000 FROM customer"
EXPAND = f"WITH RECURSIVE e AS ({EDGES}), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r(id, depth) AS (SELECT id, 0 FROM (VALUES (1::BIGINT), (2), (3)) t(id) UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON r.id = b.src WHERE r.depth < 2) SELECT id, min(depth)::INT AS depth FROM r GROUP BY 1"


@query("g01_khop_expand", EXPAND)
def g01(spark, sf):
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return G.expand(customer_nation(spark, sf), seeds, 2)


@query("g02_graph_score", f"SELECT id, CASE WHEN depth = 0 THEN 1.0::DOUBLE ELSE greatest(0.3, 1 - 0.25 * depth)::DOUBLE END AS score FROM ({EXPAND})")
def g02(spark, sf):
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return G.expand(customer_nation(spark, sf), seeds, 2).select("id", R.graph_score(F.col("depth")).alias("score"))


@query("g07_next_edges", "SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + n AS dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE n IS NOT NULL")
def g07(spark, sf):
    from pyspark.sql import Window

    t = table(spark, sf, "conversations").select("conv_id", "turn").distinct().withColumn("n", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.col("n")).alias("dst"))


@query("g08_mentions_edges", "SELECT DISTINCT doc_id, lower(w) AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{4,10}')) AS w FROM documents)")
def g08(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(once("text", "[A-Z]{4,10}")).alias("entity"))
    return d.distinct()


@query("g05_entity_mentions", "SELECT entity, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS chunks FROM (SELECT DISTINCT doc_id, lower(w) AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{6,10}')) AS w FROM documents)) GROUP BY 1")
def g05b(spark, sf):
    return mentions(table(spark, sf, "documents"))


def mentions(documents):
    d = documents.select("doc_id", F.explode(once("text", "[A-Z]{6,10}")).alias("entity"))
    g = d.distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("doc_id")).alias("c"))
    return g.select("entity", "n", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("chunks"))


def part_supplier(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("rel"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.col("l_extendedprice").cast("string")).alias("ord"))


@query("g09_edge_dedup", "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS rel, first(l_tax ORDER BY lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber || '-' || l_extendedprice) FILTER (l_tax > 0.04) AS tax FROM lineitem GROUP BY 1, 2, 3")
def g09(spark, sf):
    return G.without_duplicates(part_supplier(spark, sf), ["tax"], "ord")


@query("g09_edge_dedup_collapsed", "SELECT l_partkey AS src, l_suppkey AS dst, first(l_tax ORDER BY lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber || '-' || l_extendedprice) FILTER (l_tax > 0.04) AS tax FROM lineitem GROUP BY 1, 2")
def g09b(spark, sf):
    """Edges of all types between two nodes become one."""
    return G.without_duplicates(part_supplier(spark, sf), ["tax"], "ord", keep_rel=False)


ORDER_EDGES = "SELECT DISTINCT src::BIGINT AS src, dst::BIGINT AS dst, rel FROM (WITH p AS (SELECT o_orderkey AS o, c_custkey + 1000000000000 AS c, n_nationkey + 2000000000000 AS n, n_regionkey + 3000000000000 AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT l_orderkey AS o, l_partkey + 4000000000000 AS p, l_suppkey + 5000000000000 AS u FROM lineitem) SELECT o AS src, c AS dst, 'LOCATED' AS rel FROM p UNION ALL SELECT o, n, 'LOCATED' FROM p UNION ALL SELECT o, r, 'LOCATED' FROM p UNION ALL SELECT c, n, 'LOCATED' FROM p UNION ALL SELECT c, r, 'LOCATED' FROM p UNION ALL SELECT n, r, 'LOCATED' FROM p UNION ALL SELECT o, p, 'SUPPLIED' FROM s UNION ALL SELECT o, u, 'SUPPLIED' FROM s UNION ALL SELECT p, u, 'SUPPLIED' FROM s)"


def order_edges(spark, sf):
    """Edges of all orders with ids in ranges of their own: order, customer, nation and region LOCATED, order, part and supplier SUPPLIED."""
    at = lambda c, n: (F.col(c) + n * 10**12).cast("long")
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    order, customer, nation, region = at("o_orderkey", 0), at("c_custkey", 1), at("n_nationkey", 2), at("n_regionkey", 3)
    part, supplier = at("l_partkey", 4), at("l_suppkey", 5)
    located = ((order, customer), (order, nation), (order, region), (customer, nation), (customer, region), (nation, region))
    supplied = ((order, part), (order, supplier), (part, supplier))

    def each(rows, ends, rel):
        """All edges of a row from one scan."""
        return rows.select(F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in ends])).alias("e")).select("e.src", "e.dst", F.lit(rel).alias("rel"))

    line = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return each(placed, located, "LOCATED").union(each(line, supplied, "SUPPLIED")).distinct()


@query("g10_transitive_reduction", f"WITH e AS ({ORDER_EDGES}), h AS (SELECT * FROM e WHERE src <> dst), starts AS (SELECT DISTINCT rel, src FROM h), a AS (SELECT h.* FROM h SEMI JOIN starts s ON s.rel = h.rel AND s.src = h.dst), two AS (SELECT DISTINCT a.rel, a.src AS u, g.dst AS v FROM h g JOIN a ON a.rel = g.rel AND a.src = g.src SEMI JOIN h b ON b.rel = a.rel AND b.src = a.dst AND b.dst = g.dst), three AS (SELECT DISTINCT g.rel, g.src AS u, g.dst AS v FROM h g JOIN a ON a.rel = g.rel AND a.src = g.src AND a.dst <> g.dst JOIN a m ON m.rel = a.rel AND m.src = a.dst AND m.dst NOT IN (g.src, g.dst) SEMI JOIN h c ON c.rel = m.rel AND c.src = m.dst AND c.dst = g.dst), gone AS (SELECT * FROM two UNION SELECT * FROM three) SELECT src, dst, rel FROM e ANTI JOIN gone ON gone.rel = e.rel AND u = src AND v = dst")
def g10b(spark, sf):
    return G.reduced(kept(order_edges(spark, sf), "edges"), written=True).select("src", "dst", "rel")


MERGED = """
WITH RECURSIVE plan AS (SELECT c_custkey::BIGINT AS dup, c_custkey::BIGINT // 3 AS keep, -c_custkey::BIGINT AS tm FROM customer WHERE c_custkey % 3 = 1 AND c_custkey > 3 AND c_custkey // 3 IN (SELECT c_custkey FROM customer)),
chain AS (SELECT dup, keep, [tm] AS path FROM plan UNION ALL SELECT chain.dup, plan.keep, list_prepend(plan.tm, chain.path) FROM chain JOIN plan ON plan.dup = chain.keep),
fin AS (SELECT dup, keep, path FROM chain WHERE keep NOT IN (SELECT dup FROM plan)),
"""
MERGED_NODES = MERGED + """
n AS (SELECT coalesce(keep, c_custkey)::BIGINT AS id, coalesce(path, []) AS path, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, CASE WHEN c_nationkey % 2 = 1 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 2 = 0 THEN ['C' || c_custkey, 'any'] ELSE [] END AS aliases, c_mktsegment AS label FROM customer LEFT JOIN fin ON dup = c_custkey),
heard AS (SELECT id, item, min({'p': path, 'i': i}) AS place FROM (SELECT id, path, unnest(list_prepend(name, aliases)) AS item, generate_subscripts(list_prepend(name, aliases), 1) AS i FROM n WHERE len(path) > 0) GROUP BY ALL),
own AS (SELECT id, name, aliases FROM n WHERE len(path) = 0),
more AS (SELECT own.id, string_agg(item, ',' ORDER BY place) AS names FROM own JOIN heard ON heard.id = own.id WHERE NOT list_contains(list_prepend(own.name, own.aliases), item) GROUP BY 1),
g AS (SELECT id, count(*) - 1 AS merged, first(segment ORDER BY path) FILTER (segment IS NOT NULL) AS segment, first(balance ORDER BY path) FILTER (balance IS NOT NULL) AS balance, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM n GROUP BY id)
SELECT g.id, own.name, segment, balance, concat_ws(',', nullif(array_to_string(own.aliases, ','), ''), names) AS aliases, labels FROM g JOIN own ON own.id = g.id LEFT JOIN more ON more.id = g.id"""
MERGED_EDGES = MERGED + """
e AS (SELECT o_custkey::BIGINT AS src, 1000000000 + o_orderkey % 50 AS dst, o_orderpriority AS rel, min(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS price FROM orders GROUP BY ALL)
SELECT coalesce(keep, src)::BIGINT AS src, dst::BIGINT AS dst, rel, count(*) AS edges, first(price ORDER BY coalesce(path, []), e.src) FILTER (price IS NOT NULL) AS price FROM e LEFT JOIN fin ON dup = src GROUP BY ALL"""


def thirds(spark, sf):
    """Customers, what they ordered, and merges in chains: every third one goes into the one with a third of its number."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    nodes = c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_nationkey") % 2 == 1, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("C"), "c_custkey"), F.lit("any"))).alias("aliases"), F.array("c_mktsegment").alias("labels"))
    edges = o.groupBy(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") % 50 + 10**9).cast("long").alias("dst"), F.col("o_orderpriority").alias("rel")).agg(F.min(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("price"))
    third = F.floor(F.col("id") / 3).cast("long")
    plan = nodes.where("id % 3 = 1 AND id > 3").select(F.col("id").alias("dup"), third.alias("keep"), (-F.col("id")).alias("at")).join(nodes.select(F.col("id").alias("keep")), "keep", "left_semi")
    return G.merge_nodes(nodes, edges, plan, ["segment", "balance"], ["price"])


@query("g11_merged_nodes", MERGED_NODES)
def g11_nodes(spark, sf):
    return thirds(spark, sf)[0].withColumn("aliases", F.array_join("aliases", ",")).withColumn("labels", F.array_join("labels", ","))


@query("g11_merged_edges", MERGED_EDGES)
def g11_edges(spark, sf):
    return thirds(spark, sf)[1]


@query("g11_node_merge", f"WITH m AS (SELECT p_partkey + 4000000000000 AS dup, min(p_partkey + 4000000000000) OVER (PARTITION BY lower(p_name)) AS keep FROM part), e AS (SELECT coalesce(a.keep, src)::BIGINT AS s, coalesce(b.keep, dst)::BIGINT AS d, src, dst, rel FROM ({ORDER_EDGES}) LEFT JOIN m a ON a.dup = src LEFT JOIN m b ON b.dup = dst) SELECT DISTINCT s AS src, d AS dst, rel FROM e WHERE s <> d OR src = dst")
def g11b(spark, sf):
    """Parts of one name become the one with the smallest id."""
    p = table(spark, sf, "part").select(F.lower("p_name").alias("name"), (F.col("p_partkey") + 4 * 10**12).alias("dup"))
    canonical = p.join(p.groupBy("name").agg(F.min("dup").alias("keep")), "name").where("dup <> keep").select("dup", "keep").distinct()
    return G.merged(order_edges(spark, sf), canonical).select("src", "dst", "rel").distinct()


@query("g14_neighbourhood", f"WITH e AS ({EDGES}), s AS (SELECT s_suppkey + 10000000 AS id FROM supplier) SELECT DISTINCT id AS node, dst AS id FROM s JOIN (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) ON id = src")
def g14(spark, sf):
    """One hop around several nodes at once."""
    return G.neighbours(customer_nation(spark, sf), some_customers(spark, sf))


def some_customers(spark, sf):
    """The nodes of the customers whose number is a supplier's, too."""
    return table(spark, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).cast("long").alias("id"))


@query("u02_union_of_neighbourhoods", f"WITH e AS ({EDGES}), s AS (SELECT s_suppkey + 10000000 AS id FROM supplier) SELECT DISTINCT dst AS id FROM s JOIN e ON id = src UNION SELECT DISTINCT src FROM s JOIN e ON id = dst")
def u02(spark, sf):
    """What leads out of the nodes and what leads into them, each once."""
    return G.neighbours(customer_nation(spark, sf), some_customers(spark, sf)).select("id").distinct()


@query("j08_frontier_chunks", f"WITH e AS ({EDGES}), s AS (SELECT s_suppkey + 10000000 AS id FROM supplier), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT dst FROM b JOIN s ON src = id) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def j08(spark, sf):
    """Orders one undirected edge away from the frontier that weren't visited before."""
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    return G.frontier_rows(customer_nation(spark, sf), some_customers(spark, sf), o.where("o_orderstatus = 'P'").select("id"), o.select("id", "o_totalprice"))


@query("g15_relational_to_graph", "SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'IN_NATION' AS rel FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY' FROM orders WHERE o_custkey IS NOT NULL")
def g15(spark, sf):
    def edges(name, pk, fk, to, rel):
        return table(spark, sf, name).where(F.col(fk).isNotNull()).select(F.concat_ws(":", F.lit(name), F.col(pk).cast("string")).alias("src"), F.concat_ws(":", F.lit(to), F.col(fk).cast("string")).alias("dst"), F.lit(rel).alias("rel"))

    return edges("customer", "c_custkey", "c_nationkey", "nation", "IN_NATION").union(edges("orders", "o_orderkey", "o_custkey", "customer", "PLACED_BY"))


@query("g16_subgraph_view", "WITH c AS (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 100), o AS (SELECT o_orderkey, o_custkey FROM orders SEMI JOIN c ON o_custkey = c_custkey ORDER BY 1 LIMIT 200), n AS (SELECT c_custkey, c_nationkey FROM customer SEMI JOIN c USING (c_custkey)) SELECT src, dst, rel FROM (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'PLACED_BY' AS rel FROM o UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION' FROM n)")
def g16(spark, sf):
    """The view of a graph: its first 100 customers, the first 200 orders next to them, and all edges among what is shown."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    placed = o.select(F.col("o_orderkey").alias("src_key"), F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.lit("PLACED_BY").alias("rel"))
    located = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("rel"))
    return G.view(c.orderBy("c_custkey").limit(100).select(F.concat(F.lit("c"), "c_custkey").alias("id")), placed, located, 200)


@query("g17_ontology_read", "SELECT (SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT p_type AS n FROM part)) AS classes, (SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT p_brand AS n FROM part)) AS relations")
def g17(spark, sf):
    p = table(spark, sf, "part")
    return p.agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("classes"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("relations"))


@query("g19_folder_hierarchy", "SELECT DISTINCT lang AS parent, lang || '/' || source AS child, 'PARENT_OF' AS rel FROM documents UNION ALL SELECT lang || '/' || source, doc_id::VARCHAR, 'HAS_FILE' FROM documents")
def g19(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat_ws("/", "lang", "source")
    return d.select(F.col("lang").alias("parent"), path.alias("child"), F.lit("PARENT_OF").alias("rel")).distinct().union(d.select(path, F.col("doc_id").cast("string"), F.lit("HAS_FILE")))


@query("g18_sheet_to_graph", "SELECT p_partkey AS row, c AS column, v AS target FROM (SELECT p_partkey, unnest(['brand', 'type']) AS c, unnest([p_brand, p_type]) AS v FROM part)")
def g18(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey as row", "stack(2, 'brand', p_brand, 'type', p_type) as (column, target)")


@query("g13_triplets", "SELECT DISTINCT 'customer ' || o_custkey AS subject, 'PURCHASED' AS predicate, p_name AS object FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def g13b(spark, sf):
    return triplets(spark, sf, table(spark, sf, "orders"))


def triplets(spark, sf, orders):
    from kgloom.functions.scalars import predicate

    j = orders.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.select(F.concat(F.lit("customer "), "o_custkey").alias("subject"), predicate(F.lit("Ordered")).alias("predicate"), F.col("p_name").alias("object")).distinct()
