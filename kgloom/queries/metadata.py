"""Catalogue, profiling, value resolution and ranking helpers."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import catalog_ops as C
from kgloom.operators import ontology, relationships
from kgloom.registry import query


@query("n10_type_infer", "SELECT * FROM (VALUES ('p_partkey_s', 'integer'), ('p_name', 'string'), ('price', 'currency'), ('share', 'percentage'), ('flag', 'boolean'), ('day', 'datetime'), ('ret', 'float'), ('nothing', 'string')) t(\"column\", type)")
def n10(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("p_partkey_s"), "p_name", F.format_string("$ %d.50", "p_size").alias("price"), F.format_string("%d%%", "p_size").alias("share"), F.when(F.col("p_size") > 25, "Yes").otherwise("no").alias("flag"), F.format_string("2024-01-%02d", F.col("p_size") % 28 + 1).alias("day"), (F.col("p_retailprice") + 0.05).cast("string").alias("ret"), F.lit(None).cast("string").alias("nothing"))
    return C.infer_types(p, "p_partkey")


@query("s11_schema_introspection", "SELECT 'nation' AS tbl, * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(col, typ)")
def s11(spark, sf):
    return C.catalogue(spark, {"nation": table(spark, sf, "nation")})


@query("q01_partial_id", "SELECT c_custkey, c_name FROM customer WHERE ends_with(c_name, '77')")
def q01(spark, sf):
    partial = spark.createDataFrame([("77",)], "part string")
    return table(spark, sf, "customer").join(F.broadcast(partial), F.endswith("c_name", "part")).select("c_custkey", "c_name")  # the ids of one question


@query("q02_value_resolution", "SELECT p_partkey, CASE WHEN p_name = 'Red Widget' THEN 'EXACT' WHEN lower(p_name) = 'red widget' THEN 'NORMALIZED' WHEN 1 - levenshtein(lower(p_name), 'red widget')::DOUBLE / greatest(length(p_name), 10) >= 0.7 THEN 'FUZZY' ELSE 'NONE' END AS stage FROM part")
def q02(spark, sf):
    from kgloom.functions.scalars import levenshtein_ratio

    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.when(n == "Red Widget", "EXACT").when(F.lower(n) == "red widget", "NORMALIZED").when(levenshtein_ratio(F.lower(n), F.lit("red widget")) >= 0.7, "FUZZY").otherwise("NONE").alias("stage"))


@query("q03_column_roles", "SELECT * FROM (VALUES ('c_custkey', 'identifier'), ('c_name', 'name'), ('c_nationkey', 'identifier'), ('c_acctbal', 'amount'), ('c_mktsegment', 'attribute')) t(col, role)")
def q03(spark, sf):
    return C.catalogue(spark, {"customer": table(spark, sf, "customer")}).select("col", C.role(F.col("col")).alias("role"))


@query("q04_sensitive_values", "SELECT doc_id, regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+') AS has_email FROM documents WHERE regexp_matches(text, '@')")
def q04(spark, sf):
    d = table(spark, sf, "documents").where(F.contains("text", F.lit("@")))
    return d.select("doc_id", F.col("text").rlike(C.SENSITIVE[0][1]).alias("has_email"))


@query("q04_masking")
def q04_mask(spark, sf):
    return table(spark, sf, "documents").where(C.sensitive_kind(F.col("text")).isNotNull()).select("doc_id", C.masked(F.col("text")).alias("text"))


@query("q05_fk_inference", "SELECT round((SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))::DOUBLE / (SELECT count(DISTINCT o_custkey) FROM orders), 6) AS share")
def q05(spark, sf):
    return C.foreign_key_share(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey")


#: Whole-number and text (:s) columns of the tables.
KEY_COLUMNS = {
    "benchmark": "item_id text:s",
    "conversations": "conv_id turn role:s text:s",
    "customer": "c_custkey c_name:s c_nationkey c_mktsegment:s",
    "documents": "doc_id text:s lang:s source:s n_chars",
    "embeddings": "vec_id label",
    "events": "event_id user_id event_type:s props:s",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag:s l_linestatus:s",
    "nation": "n_nationkey n_name:s n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus:s o_orderpriority:s",
    "pages": "page_id url:s html:s",
    "part": "p_partkey p_name:s p_brand:s p_type:s p_size",
    "region": "r_regionkey r_name:s",
    "supplier": "s_suppkey s_name:s s_nationkey",
}
CELLS = " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c.split(':')[0]}' AS col, '{'s' if ':' in c else 'n'}' AS kind, {c.split(':')[0]}::VARCHAR AS value FROM {t}" for t, cs in KEY_COLUMNS.items() for c in cs.split())
STEM = "lower(regexp_replace({0}, '^[A-Za-z]_', ''))"
RELATED = f"""
WITH v AS (SELECT tab, col, kind, value, count(*) AS rows FROM ({CELLS}) WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT tab, col, count(*) AS n, max(rows) = 1 AS uniq FROM v GROUP BY ALL HAVING max(length(value)) <= 64),
k AS (SELECT v.* FROM v SEMI JOIN p ON p.tab = v.tab AND p.col = v.col),
s AS (SELECT a.tab, a.col, b.tab AS ref_tab, b.col AS ref_col, count(*) AS shared FROM k a JOIN k b ON a.kind = b.kind AND a.value = b.value AND a.tab <> b.tab GROUP BY ALL),
c AS (SELECT s.*, x.n, CASE WHEN {STEM.format("s.col")} = {STEM.format("s.ref_col")} THEN 1.0 WHEN contains(lower(s.col), CASE WHEN ref_tab LIKE '%ies' THEN ref_tab[:-4] || 'y' WHEN ref_tab LIKE '%s' AND ref_tab NOT LIKE '%ss' THEN ref_tab[:-2] ELSE ref_tab END) THEN 0.75 ELSE 0.0 END AS name
      FROM s JOIN p x ON x.tab = s.tab AND x.col = s.col JOIN p y ON y.tab = ref_tab AND y.col = ref_col AND y.uniq),
d AS (SELECT tab, col, ref_tab, ref_col, 'draft' AS status, round(0.6::DOUBLE * shared / n + 0.4::DOUBLE * name, 4) AS confidence FROM c WHERE shared >= 0.95 * n AND round(0.6::DOUBLE * shared / n + 0.4::DOUBLE * name, 4) >= 0.8 AND NOT (tab = 'orders' AND col = 'o_custkey' AND ref_tab = 'customer'))
SELECT tab || '.' || col || '->' || ref_tab || '.' || ref_col AS item_key, * FROM (SELECT * FROM d UNION ALL SELECT 'orders', 'o_custkey', 'customer', 'c_custkey', 'confirmed', 1.0)"""
PATHS = f"""
WITH RECURSIVE e AS (SELECT tab AS a, ref_tab AS b, round(1000 + 1000 * (1 - confidence))::BIGINT AS cost FROM ({RELATED})),
w AS (SELECT a, b, min(cost) AS cost FROM (SELECT * FROM e UNION ALL SELECT b, a, cost FROM e) WHERE a <> b GROUP BY ALL),
r AS (SELECT a, b, cost, a || ' -> ' || b AS path, [a, b] AS nodes FROM w UNION ALL SELECT r.a, w.b, r.cost + w.cost, r.path || ' -> ' || w.b, list_append(nodes, w.b) FROM r JOIN w ON w.a = r.b WHERE NOT list_contains(nodes, w.b))
SELECT a, b, cost, path FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY cost, path) = 1"""


def related(spark, sf):
    return relationships.relationships({t: table(spark, sf, t) for t in KEY_COLUMNS}, [("orders", "o_custkey", "customer", "c_custkey")])


@query("q05_relationships", RELATED)
def q05_relationships(spark, sf):
    """Foreign keys among all columns of all tables, from their values and names; one is declared."""
    return related(spark, sf)


@query("q05_join_paths", PATHS)
def q05_paths(spark, sf):
    """The cheapest chain of joins between each two tables."""
    return relationships.join_paths(related(spark, sf))


@query("q06_value_index", "SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS frequency FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2")
def q06(spark, sf):
    return C.value_index(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("q07_metric_validation", "SELECT 'sum(l_quantity * l_discount)' AS metric, 'l_discount,l_quantity' AS columns, round(sum(l_quantity * l_discount), 4) AS value FROM lineitem")
def q07(spark, sf):
    li = table(spark, sf, "lineitem")
    metric = "sum(l_quantity * l_discount)"
    return li.agg(F.round(F.expr(metric), 4).alias("value")).select(F.lit(metric).alias("metric"), F.lit(",".join(C.metric_columns(metric, li))).alias("columns"), "value")


@query("q08_sql_guard", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 LIMIT 100")
def q08(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("guarded_nation")
    return spark.sql(C.guarded_sql("SELECT n_nationkey, n_name FROM guarded_nation WHERE n_regionkey = 1", {"guarded_nation"}))


@query("q09_schema_diff", "SELECT * FROM (VALUES ('part', 'p_partkey', 'UNCHANGED'), ('part', 'p_name', 'COLUMN_REMOVED'), ('part', 'p_brand', 'UNCHANGED'), ('part', 'p_type', 'UNCHANGED'), ('part', 'p_size', 'TYPE_CHANGED'), ('part', 'p_retailprice', 'UNCHANGED'), ('part', 'p_extra', 'COLUMN_ADDED')) t(tbl, col, event)")
def q09(spark, sf):
    p = table(spark, sf, "part")
    new = p.drop("p_name").withColumn("p_size", F.col("p_size").cast("string")).withColumn("p_extra", F.lit(1))
    return C.schema_diff(C.catalogue(spark, {"part": p}), C.catalogue(spark, {"part": new}))


@query("q10_quality_report", "SELECT lang, count(*) AS docs, round(100.0 * count(*) FILTER (n_chars > 500) / count(*), 2) AS described_pct, CASE WHEN avg(n_chars) >= 3000 THEN 'HIGH' WHEN avg(n_chars) >= 2000 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM documents GROUP BY 1")
def q10(spark, sf):
    n, long = F.count(F.lit(1)), F.avg("n_chars")
    return table(spark, sf, "documents").groupBy("lang").agg(n.alias("docs"), F.round(F.lit(100.0) * F.count_if(F.col("n_chars") > 500) / n, 2).alias("described_pct"), F.when(long >= 3000, "HIGH").when(long >= 2000, "MEDIUM").otherwise("LOW").alias("band"))


SCHEMA = [
    *[(f"class/{x}", "subClassOf", "class/customer") for x in ("automobile", "building", "furniture", "household", "machinery")],
    ("class/customer", "subClassOf", "class/party"), ("class/party", "subClassOf", "class/thing"), ("class/order", "subClassOf", "class/thing"), ("class/place", "subClassOf", "class/thing"),
    ("placedBy", "subPropertyOf", "concerns"), ("concerns", "subPropertyOf", "linkedTo"), ("placedBy", "inverseOf", "placed"), ("placedBy", "domain", "class/order"), ("placedBy", "range", "class/customer"),
    ("locatedIn", "range", "class/place"), ("locatedIn", "type", "TransitiveProperty"),
]
FACTS = "SELECT 'customer/' || c_custkey AS s, 'type' AS p, 'class/' || lower(c_mktsegment) AS o FROM customer UNION SELECT 'customer/' || c_custkey, 'locatedIn', 'nation/' || c_nationkey FROM customer UNION SELECT 'nation/' || n_nationkey, 'locatedIn', 'region/' || n_regionkey FROM nation UNION SELECT 'order/' || o_orderkey, 'placedBy', 'customer/' || o_custkey FROM orders"
STATED = f"SELECT * FROM ({FACTS}) UNION SELECT * FROM (VALUES {', '.join(map(str, SCHEMA))}) t(s, p, o)"
CLOSED = f"""
WITH RECURSIVE stated AS ({STATED}),
classes AS (SELECT s, o FROM stated WHERE p = 'subClassOf' UNION SELECT c.s, t.o FROM classes c JOIN stated t ON t.s = c.o AND t.p = 'subClassOf'),
properties AS (SELECT s, o FROM stated WHERE p = 'subPropertyOf' UNION SELECT c.s, t.o FROM properties c JOIN stated t ON t.s = c.o AND t.p = 'subPropertyOf'),
rules AS (SELECT 'same' AS kind, s AS p, o AS q FROM properties UNION SELECT 'subject', s, o FROM stated WHERE p = 'domain' UNION SELECT 'object', s, o FROM stated WHERE p = 'range' UNION SELECT 'turned', s, o FROM stated WHERE p = 'inverseOf' UNION SELECT 'turned', o, s FROM stated WHERE p = 'inverseOf'),
facts AS (
  SELECT s, p, o FROM (SELECT * FROM stated UNION SELECT s, 'subClassOf', o FROM classes UNION SELECT s, 'subPropertyOf', o FROM properties)
  UNION
  SELECT * FROM (
    SELECT CASE WHEN kind IN ('turned', 'object') THEN f.o ELSE f.s END AS s, CASE WHEN kind IN ('subject', 'object') THEN 'type' ELSE q END AS p, CASE kind WHEN 'same' THEN f.o WHEN 'turned' THEN f.s ELSE q END AS o FROM facts f JOIN rules r ON r.p = f.p
    UNION ALL SELECT f.s, f.p, c.o FROM facts f JOIN classes c ON c.s = f.o WHERE f.p = 'type'
    UNION ALL SELECT f.s, f.p, t.o FROM facts f JOIN stated t ON t.s = f.o AND t.p = f.p WHERE f.p = 'locatedIn'))
SELECT s, p, o FROM facts"""


def stated(spark, sf):
    c, n, o = (table(spark, sf, t) for t in ("customer", "nation", "orders"))
    name = lambda kind, key: F.concat(F.lit(kind + "/"), key)
    edge = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    facts = edge(c, name("customer", "c_custkey"), "type", name("class", F.lower("c_mktsegment"))).union(edge(c, name("customer", "c_custkey"), "locatedIn", name("nation", "c_nationkey")))
    facts = facts.union(edge(n, name("nation", "n_nationkey"), "locatedIn", name("region", "n_regionkey"))).union(edge(o, name("order", "o_orderkey"), "placedBy", name("customer", "o_custkey")))
    return facts.union(spark.createDataFrame(SCHEMA, "s string, p string, o string"))


@query("q11_triple_layers", CLOSED)
def q11(spark, sf):
    """Customers, places and orders as triples, with everything that follows from their schema."""
    return ontology.consequences(stated(spark, sf))


SHAPES = [
    {"target": "class/order", "path": "placedBy", "min": 1, "max": 1, "type": "class/customer"},
    {"target": "class/customer", "path": "placed", "min": 1, "max": 15, "pattern": "^order/[0-9]+[02468]$"},
    {"target": "class/party", "path": "locatedIn", "one_of": [*(f"region/{i}" for i in range(5)), *(f"nation/{i}" for i in range(20))]},
]
VIOLATED = f"""
WITH f AS (SELECT * FROM ({CLOSED})), n AS (SELECT DISTINCT s AS focus, o AS target FROM f WHERE p = 'type'),
k AS (SELECT focus, count(f.o) AS n FROM n LEFT JOIN f ON f.s = focus AND f.p = 'placed' WHERE target = 'class/customer' GROUP BY 1),
b AS (SELECT focus, count(f.o) AS n FROM n LEFT JOIN f ON f.s = focus AND f.p = 'placedBy' WHERE target = 'class/order' GROUP BY 1)
SELECT focus, 'placedBy' AS path, CASE WHEN n < 1 THEN 'minCount' ELSE 'maxCount' END AS "constraint", n::VARCHAR AS value FROM b WHERE n <> 1
UNION ALL SELECT focus, 'placedBy', 'class', f.o FROM n JOIN f ON f.s = focus AND f.p = 'placedBy' WHERE target = 'class/order' AND f.o NOT IN (SELECT focus FROM n WHERE target = 'class/customer')
UNION ALL SELECT focus, 'placed', 'minCount', n::VARCHAR FROM k WHERE n < 1 UNION ALL SELECT focus, 'placed', 'maxCount', n::VARCHAR FROM k WHERE n > 15
UNION ALL SELECT focus, 'placed', 'pattern', f.o FROM n JOIN f ON f.s = focus AND f.p = 'placed' WHERE target = 'class/customer' AND NOT regexp_full_match(f.o, 'order/[0-9]+[02468]')
UNION ALL SELECT focus, 'locatedIn', 'in', f.o FROM n JOIN f ON f.s = focus AND f.p = 'locatedIn' WHERE target = 'class/party' AND f.o IN ('nation/20', 'nation/21', 'nation/22', 'nation/23', 'nation/24')"""


@query("q11_shape_report", VIOLATED)
def q11_shapes(spark, sf):
    """Every constraint of a shape that a node of the closed triples violates, with the value."""
    return ontology.violations(ontology.consequences(stated(spark, sf)), SHAPES)


@query("q11_rule_matrix", "WITH f AS (SELECT event_id, event_type AS predicate, CASE user_id % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' ELSE 'PLACE' END AS st, CASE event_id % 2 WHEN 0 THEN 'PRODUCT' ELSE 'PAGE' END AS ot, CASE WHEN event_type = 'purchase' OR value > 90 THEN 'event' ELSE 'relationship' END AS mode, CASE WHEN value > 90 THEN 1 ELSE 0 END AS k FROM events) SELECT event_id, mode, CASE WHEN mode = 'event' THEN CASE WHEN k = 0 THEN 'event with no participants or attributes' END WHEN (st = 'PERSON' AND predicate IN ('click', 'view')) OR (predicate = 'signup' AND ot = 'PAGE') THEN NULL ELSE 'OWL rule violation: ' || st || ' -[' || predicate || ']-> ' || ot END AS reason FROM f")
def q11_rules(spark, sf):
    """Events as facts: those with an attribute become events, the others have to be in the matrix."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "PERSON").when(F.col("user_id") % 3 == 1, "ORGANIZATION").otherwise("PLACE")
    large = (F.col("value") > 90).cast("int")
    facts = e.select("event_id", F.when(F.col("event_type") == "purchase", "event").otherwise("relationship").alias("mode"), F.col("event_type").alias("predicate"), F.col("user_id").cast("string").alias("subject"), kind.alias("subject_type"), F.col("event_id").cast("string").alias("object"), F.when(F.col("event_id") % 2 == 0, "PRODUCT").otherwise("PAGE").alias("object_type"), F.lit(None).cast("string").alias("event_name"), F.lit(0).alias("n_participants"), F.coalesce(large, F.lit(0)).alias("n_attributes"))
    matrix = spark.createDataFrame([("PERSON", "click", ontology.ANY_TYPE), ("PERSON", "view", ontology.ANY_TYPE), (ontology.ANY_TYPE, "signup", "PAGE")], "subject_type string, predicate string, object_type string")
    return ontology.enforced(ontology.routed(facts), matrix).select("event_id", "mode", "reason")


@query("q12_idf_discount", "WITH t AS (SELECT DISTINCT doc_id, lower(w) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents)), n AS (SELECT count(*) AS total FROM documents) SELECT term, count(*) AS docs, round(ln(max(total)::DOUBLE / count(*)) / ln(max(total)), 6) AS idf FROM t, n GROUP BY 1 HAVING count(*) >= 20")
def q12(spark, sf):
    d = table(spark, sf, "documents")
    # each term once a text before any shuffle; the ids are distinct, so counting rows counts documents
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower))
    terms = d.select(F.explode(words).alias("term"))
    total = d.count()
    g = terms.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 20")
    return g.select("term", "docs", F.round(C.idf(F.col("docs"), F.lit(float(total))), 6).alias("idf"))


@query("q13_relevance_filter", "SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE o_totalprice >= 0.5 * top")
def q13(spark, sf):
    o = table(spark, sf, "orders")
    top = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return o.join(top, "o_custkey").where(F.col("o_totalprice") >= F.col("top") * 0.5).select("o_custkey", "o_orderkey")


@query("q14_rrf", "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 50), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 50) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 8) AS rrf FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def q14(spark, sf):
    p = table(spark, sf, "part")

    def ranked(by, name):
        """Ranks of the best 50, numbered in one array: the top-k is taken before anything meets in one task."""
        best = p.orderBy(F.desc(by), "p_partkey").limit(50)
        a = best.agg(F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("k"), "p_partkey"))).alias("r"))
        return a.select(F.posexplode("r").alias("n", "x")).select(F.col("x.p_partkey").alias("p_partkey"), (F.col("n") + 1).alias(name))

    j = ranked("p_retailprice", "ra").join(ranked("p_size", "rb"), "p_partkey", "full")
    return j.select("p_partkey", F.round(C.rrf([F.col("ra"), F.col("rb")]), 8).alias("rrf"))


@query("q15_section_trust", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 0.5::DOUBLE WHEN n_chars > 5000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS trust, n_chars < 500 AS heuristic FROM documents")
def q15(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.when(n < 500, 0.5).when(n > 5000, 2.0).otherwise(1.0).alias("trust"), (n < 500).alias("heuristic"))


PLURALS = "CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN [w, w[:-4] || 'y'] WHEN regexp_matches(w, '(ss|us|is|sh|ch|x|z)es$') THEN [w, w[:-3]] WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|ws)$') THEN [w, w[:-2]] ELSE [w] END"


@query("q16_plural_variants", f"WITH s AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(p_name || ' ' || p_type || 'S ' || split_part(p_name, ' ', 1) || 'es ' || split_part(p_name, ' ', 2) || 'ies', '\\s+')) AS w FROM part)), o AS (SELECT w, {PLURALS} AS v FROM s), x AS (SELECT w, CASE WHEN regexp_matches(w, '[^aeiou]y$') THEN list_append(v, w[:-2] || 'ies') WHEN regexp_matches(w, '(s|sh|ch|x|z)$') AND NOT (w LIKE '%s' AND len(v) > 1) THEN list_append(v, w || 'es') WHEN w NOT LIKE '%s' THEN list_append(v, w || 's') ELSE v END AS v FROM o) SELECT w AS word, array_to_string(list_sort(list_distinct(v)), ',') AS variants FROM x")
def q16(spark, sf):
    """Singular and plural forms of all words of the parts' names and types, and of forms made of them."""
    p = table(spark, sf, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit("S "), first, F.lit("es "), second, F.lit("ies"))
    w = p.select(F.explode(F.split(text, r"\s+")).alias("w")).select(F.lower("w").alias("word")).distinct()
    return w.select("word", F.array_join(C.plural_forms(F.col("word")), ",").alias("variants"))


@query("q18_dataset_disambiguation", "SELECT p_brand, CASE WHEN a >= 1.2 * coalesce(b, 0) THEN 'PICK' ELSE 'ASK' END AS decision FROM (SELECT p_brand, max(n) FILTER (r = 1) AS a, max(n) FILTER (r = 2) AS b FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) GROUP BY 1)")
def q18(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("p_brand").agg(F.slice(F.reverse(F.array_sort(F.collect_list("n"))), 1, 2).alias("t"))
    return top.select("p_brand", F.when(F.get("t", F.lit(0)) >= F.lit(1.2) * F.coalesce(F.get("t", F.lit(1)), F.lit(0)), "PICK").otherwise("ASK").alias("decision"))


@query("q19_parent_child_chunks", "SELECT doc_id, (i // 1500)::INT AS parent_index, sha256(doc_id || ':' || substring(text, i + 1, 1500)) AS parent_id FROM documents, LATERAL (SELECT unnest(range(0, length(text), 1500)) AS i) WHERE length(text) > 0")
def q19(spark, sf):
    from kgloom.operators.chunking import fixed_windows

    d = table(spark, sf, "documents").select("doc_id", F.posexplode(fixed_windows(F.col("text"), 1500, 0)).alias("parent_index", "c"))
    return d.select("doc_id", "parent_index", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "c"), 256).alias("parent_id"))


@query("q20_heading_paths")
def q20(spark, sf):
    from kgloom.operators import chunking as K

    return K.chunked(table(spark, sf, "pages"), "page_id", "html", lambda t: [("heading", p) for k, p, _ in K.html_segments(t) if k == "heading"])


@query("q21_triplet_decision", "SELECT event_id, event_type NOT IN ('click', 'view') AS run FROM events")
def q21(spark, sf):
    intent = F.when(F.col("event_type").isin("click", "view"), "TABULAR").otherwise("GRAPH")
    return table(spark, sf, "events").select("event_id", intent.isin("GRAPH", "STRUCTURAL", "WHY", "COMPARISON").alias("run"))


@query("s01_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(spark, sf):
    from kgloom.sources.readers import scratch

    path = scratch(spark, "csv")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias(" n_nationkey "), "n_name", "n_regionkey").write.mode("overwrite").option("header", True).csv(path)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


@query("s02_csv_all_strings", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def s02(spark, sf):
    from kgloom.sources.readers import scratch

    path = scratch(spark, "csv-strings")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("n nationKey"), F.col("n_name").alias("N-Name")).write.mode("overwrite").option("header", True).csv(path)
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*C.headers(df.columns))


@query("s06_pdf_table_rows", "SELECT n_nationkey::INT AS row_index, n_name AS name, 'x' AS col_1 FROM nation")
def s06(spark, sf):
    """Cells to named fields: a blank header is numbered, rows without a value are dropped."""
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_index"), F.array("n_name", F.lit("x")).alias("cells"))
    blank = spark.range(1).select(F.lit(-1).alias("row_index"), F.array(F.lit(""), F.lit(" ")).alias("cells"))
    names = [h if h else f"col_{i}" for i, h in enumerate(["name", ""])]
    rows = t.union(blank).where(F.exists("cells", lambda c: F.trim(c) != ""))
    return rows.select("row_index", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("s17_ntriples_scan", "SELECT 'n' || n_nationkey AS s, 'label' AS p, n_name AS o FROM nation")
def s17(spark, sf):
    from kgloom.sources.readers import scratch
    from kgloom.sources.readers import ntriples

    path = scratch(spark, "nt")
    table(spark, sf, "nation").select(F.format_string('<n%d> <label> "%s" .', "n_nationkey", "n_name").alias("value")).write.mode("overwrite").text(path)
    return ntriples(spark, path)


@query("s18_dataset_registry", "SELECT r_regionkey, r_name FROM region")
def s18(spark, sf):
    from kgloom.sources.readers import active_dataset

    return active_dataset(spark, [{"name": "region", "version": 1, "path": f"{sf}/nation.parquet"}, {"name": "region", "version": 2, "path": f"{sf}/region.parquet"}], "region")
