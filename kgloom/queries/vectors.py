"""Vector search and hybrid retrieval."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.functions import vectors as V
from kgloom.operators import graph as G
from kgloom.operators import retrieval as R
from kgloom.operators import similarity
from kgloom.registry import query

Q = [((i * 37) % 17 - 8) / 10 for i in range(64)]
QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in Q) + "]"
E = "embedding::DOUBLE[]"
COS = f"list_cosine_similarity({E}, {QSQL})"


def emb(spark, sf):
    return table(spark, sf, "embeddings")


@query("v01_unit_cosine", f"SELECT vec_id, round(({COS} + 1) / 2, 6) AS similarity FROM embeddings")
def v01(spark, sf):
    return emb(spark, sf).select("vec_id", F.round(V.unit_cosine(F.col("embedding"), V.literal(Q)), 6).alias("similarity"))


@query("v02_raw_cosine", f"SELECT vec_id, round({COS}, 6) AS similarity FROM embeddings")
def v02(spark, sf):
    return emb(spark, sf).select("vec_id", F.round(V.cosine(F.col("embedding"), V.literal(Q)), 6).alias("similarity"))


@query("v03_similarity_search", f"SELECT vec_id, round(({COS} + 1) / 2, 6) AS similarity FROM embeddings WHERE ({COS} + 1) / 2 > 0.55")
def v03(spark, sf):
    """The score of the graph's vector search, (cosine + 1) / 2, over a threshold."""
    s = emb(spark, sf).select("vec_id", V.unit_cosine(F.col("embedding"), V.literal(Q)).alias("similarity"))
    return s.where("similarity > 0.55").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("v06_list_index")
def v06(spark, sf):
    """The five nearest rows of every hundredth one, by an approximate index. These vectors have hardly any structure, so
    three quarters of the lists are looked into for nine of ten neighbours."""
    e = emb(spark, sf)
    index = similarity.ListIndex(e, "vec_id", "embedding")
    lists = max([1, *(len(c) for c in index.centres.values())])
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return index.search(asked, 5, -(-3 * lists // 4), again=20).select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("x06_first_of_sorted", "SELECT a.label, a.vec_id, b.label AS best FROM embeddings a JOIN (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg((embedding[i])::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1) b ON true QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.c), 9) DESC, b.label) = 1")
def x06(spark, sf):
    """The best canonical row of each original: here the nearest centre of all labels, of which there are few."""
    centres = V.centroids(emb(spark, sf), "label", "embedding").select(F.col("label").alias("best"), "centroid")
    all_ = centres.agg(F.collect_list(F.struct("best", "centroid")).alias("c"))  # a row a label
    near = F.transform("c", lambda c: F.struct((-F.round(V.cosine(F.col("embedding"), c["centroid"]), 9)).alias("d"), c["best"].alias("best")))
    return emb(spark, sf).crossJoin(F.broadcast(all_)).select("label", "vec_id", F.array_min(near)["best"].alias("best"))


@query("v04_distances", f"SELECT vec_id, round(list_distance({E}, {QSQL}), 6) AS l2, round(-list_inner_product({E}, {QSQL}), 6) AS neg_inner, round(1 - {COS}, 6) AS cosine, round(list_sum(list_transform(range(1, 65), lambda i: abs(({E})[i] - ({QSQL})[i]))), 6) AS l1 FROM embeddings")
def v04(spark, sf):
    e, q = F.col("embedding"), V.literal(Q)
    return emb(spark, sf).select("vec_id", F.round(V.l2(e, q), 6).alias("l2"), F.round(-V.inner(e, q), 6).alias("neg_inner"), F.round(1 - V.cosine(e, q), 6).alias("cosine"), F.round(V.l1(e, q), 6).alias("l1"))


@query("v05_vector_helpers", f"SELECT vec_id, len(embedding)::INT AS dims, round(sqrt(list_inner_product({E}, {E})), 6) AS norm, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS head_sum FROM embeddings")
def v05(spark, sf):
    e = F.col("embedding")
    return emb(spark, sf).select("vec_id", F.size(e).alias("dims"), F.round(V.norm(e), 6).alias("norm"), V.binary(e).alias("bits"), F.round(V.total(V.doubles(F.slice(e, 1, 8))), 6).alias("head_sum"))


@query("v12_dimension_guard", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def v12(spark, sf):
    return emb(spark, sf).where(F.size("embedding") == 64).select("vec_id")


@query("a24_vector_average", "SELECT label, i::INT AS pos, round(avg((embedding[i])::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def a24(spark, sf):
    return V.centroids(emb(spark, sf), "label", "embedding").select("label", F.posexplode("centroid").alias("p", "m")).select("label", (F.col("p") + 1).alias("pos"), F.round("m", 6).alias("mean"))


@query("t05_vector_top_k", f"SELECT vec_id, round({COS}, 6) AS similarity FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")
def t05(spark, sf):
    return V.top_k(emb(spark, sf), "embedding", V.literal(Q), 10, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("v09_memory_search", f"SELECT * FROM (SELECT vec_id, round(({COS} + 1) / 2, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 5) WHERE score > 0.6")
def v09(spark, sf):
    """Top k first, the threshold after it."""
    return V.top_k(emb(spark, sf), "embedding", V.literal(Q), 5, "vec_id", unit=True).select("vec_id", F.round("similarity", 6).alias("score")).where("score > 0.6")


@query("v10_triplet_search", f"SELECT vec_id, round(({COS} + 1) / 2, 6) AS score FROM (SELECT * FROM embeddings WHERE label < 5 UNION SELECT * FROM embeddings WHERE label >= 5) ORDER BY {COS} DESC, vec_id LIMIT 10")
def v10(spark, sf):
    e = emb(spark, sf)
    both = e.where("label < 5").union(e.where("label >= 5")).dropDuplicates(["vec_id"])
    return V.top_k(both, "embedding", V.literal(Q), 10, "vec_id", unit=True).select("vec_id", F.round("similarity", 6).alias("score"))


@query("j09_similar_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 >= 0.7")
def j09(spark, sf):
    return similarity.pairs_above(emb(spark, sf), "vec_id", "embedding", 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("t07_similar_pair_cap", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 >= 0.7 ORDER BY round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 9) DESC, 1, 2 LIMIT 40")
def t07(spark, sf):
    return similarity.best_pairs(emb(spark, sf), "vec_id", "embedding", 0.7, 40).select("a", "b")


@query("g06_similar_edges", "WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 >= 0.7) SELECT x AS src, y AS dst FROM p UNION ALL SELECT y, x FROM p")
def g06(spark, sf):
    return G.undirected(similarity.pairs_above(emb(spark, sf), "vec_id", "embedding", 0.7).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("v11_retrieval_self_check", "WITH s AS (SELECT * FROM embeddings WHERE vec_id < 10), r AS (SELECT s.vec_id AS id, e.vec_id AS hit, row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS n FROM s, embeddings e) SELECT count(*) AS sampled, count(*) FILTER (found) AS passed, count(*) FILTER (found)::DOUBLE / count(*) >= 0.8 AS ok FROM (SELECT id, bool_or(hit = id) AS found FROM r WHERE n <= 5 GROUP BY 1)")
def v11(spark, sf):
    """A sample of at most 10 chunks, broadcast as queries against all."""
    e = emb(spark, sf)
    s = e.where("vec_id < 10").limit(10).select(F.col("vec_id").alias("id"), F.col("embedding").alias("q"))
    sim = F.round(V.cosine(F.col("q"), F.col("embedding")), 9)
    own = s.select("id", F.round(V.cosine(F.col("q"), F.col("q")), 9).alias("own"))
    every = e.crossJoin(F.broadcast(s)).join(F.broadcast(own), "id")
    rank = every.groupBy("id").agg(F.count_if((sim > F.col("own")) | ((sim == F.col("own")) & (F.col("vec_id") < F.col("id")))).alias("ahead"))
    return rank.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("ahead") < 5).alias("passed")).select("sampled", "passed", (F.col("passed") / F.col("sampled") >= 0.8).alias("ok"))


@query("j13_best_canonical", "SELECT vec_id, best, similarity FROM (SELECT a.vec_id, b.vec_id AS best, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < 50 AND a.vec_id >= 50) WHERE n = 1 AND similarity > 0.55")
def j13(spark, sf):
    e = emb(spark, sf)
    known = e.where("vec_id < 50").select(F.col("vec_id").alias("best"), F.col("embedding").alias("c"), "label")
    j = e.where("vec_id >= 50").join(known, "label").withColumn("similarity", F.round(V.unit_cosine(F.col("embedding"), F.col("c")), 6))
    m = j.groupBy("vec_id").agg(F.max_by(F.struct("best", "similarity"), F.struct("similarity", -F.col("best"))).alias("m"))
    return m.select("vec_id", "m.best", "m.similarity").where("similarity > 0.55")


@query("j14_type_grounding", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type WHEN 1 - levenshtein(p_type, 'STANDARDS')::DOUBLE / greatest(length(p_type), 9) > 0.85 THEN 'STANDARDS' END AS grounded FROM part")
def j14(spark, sf):
    from kgloom.functions.scalars import levenshtein_ratio

    exact = spark.createDataFrame([("ECONOMY",), ("PROMO",)], "cls string")
    p = table(spark, sf, "part").join(F.broadcast(exact), F.col("p_type") == F.col("cls"), "left")  # two classes
    return p.select("p_partkey", F.coalesce("cls", F.when(levenshtein_ratio(F.col("p_type"), F.lit("STANDARDS")) > 0.85, "STANDARDS")).alias("grounded"))


@query("u04_hybrid_append", f"WITH v AS (SELECT vec_id FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10), k AS (SELECT vec_id FROM embeddings WHERE label = 3) SELECT vec_id, 'vector' AS origin FROM v UNION ALL SELECT vec_id, 'keyword' FROM k WHERE vec_id NOT IN (SELECT vec_id FROM v)")
def u04(spark, sf):
    e = emb(spark, sf)
    v = V.top_k(e, "embedding", V.literal(Q), 10, "vec_id").select("vec_id")
    k = e.where("label = 3").select("vec_id").join(v, "vec_id", "left_anti")
    return v.withColumn("origin", F.lit("vector")).union(k.withColumn("origin", F.lit("keyword")))


@query("c14_keyword_boost", f"WITH v AS (SELECT vec_id, {COS} AS s FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 20), k AS (SELECT vec_id FROM embeddings WHERE label = 3) SELECT coalesce(v.vec_id, k.vec_id) AS vec_id, round(CASE WHEN v.vec_id IS NOT NULL AND k.vec_id IS NOT NULL THEN greatest(s, 0.85) WHEN v.vec_id IS NULL THEN 0.7 ELSE s END, 6) AS similarity, CASE WHEN v.vec_id IS NOT NULL AND k.vec_id IS NOT NULL THEN 1.5::DOUBLE WHEN v.vec_id IS NULL THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM v FULL JOIN k ON v.vec_id = k.vec_id")
def c14(spark, sf):
    e = emb(spark, sf)
    return R.boosted(V.top_k(e, "embedding", V.literal(Q), 20, "vec_id"), e.where("label = 3"), "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"), "weight")


def chunks(spark, sf):
    return emb(spark, sf).join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), "text", "embedding")


def next_edges(spark, sf):
    return emb(spark, sf).select(F.col("vec_id").alias("src"), (F.col("vec_id") + 10).alias("dst"))


@query("g03_hybrid_score", f"SELECT vec_id, round(least(1.0, (0.6 * {COS} + 0.4 * greatest(0.3, 1 - 0.25 * (vec_id % 4))) * (1 + 0.5 * (label = 3)::INT)), 6) AS score FROM embeddings")
def g03(spark, sf):
    depth = F.col("vec_id") % 4
    w = 1 + F.lit(0.5) * (F.col("label") == 3).cast("int")
    return emb(spark, sf).select("vec_id", F.round(R.hybrid_score(V.cosine(F.col("embedding"), V.literal(Q)), R.graph_score(depth), w), 6).alias("score"))


HYBRID = f"""
WITH RECURSIVE chunks AS (SELECT vec_id AS id, text, embedding FROM embeddings JOIN documents ON vec_id = doc_id),
vec AS (SELECT id, {COS} AS s FROM chunks ORDER BY {COS} DESC, id LIMIT 10),
kw AS (SELECT id FROM chunks WHERE contains(text, 'License') OR contains(text, 'rights') ORDER BY id LIMIT 10),
seeds AS (SELECT coalesce(vec.id, kw.id) AS id, CASE WHEN vec.id IS NOT NULL AND kw.id IS NOT NULL THEN greatest(s, 0.85) WHEN vec.id IS NULL THEN 0.7 ELSE s END AS sim, CASE WHEN vec.id IS NOT NULL AND kw.id IS NOT NULL THEN 1.5 WHEN vec.id IS NULL THEN 1.2 ELSE 1.0 END AS w FROM vec FULL JOIN kw ON vec.id = kw.id),
e AS (SELECT vec_id AS src, vec_id + 10 AS dst FROM embeddings UNION ALL SELECT vec_id + 10, vec_id FROM embeddings),
h1 AS (SELECT DISTINCT dst AS id FROM seeds JOIN e ON id = src WHERE dst NOT IN (SELECT id FROM seeds) ORDER BY 1 LIMIT 50),
h2 AS (SELECT DISTINCT dst AS id FROM h1 JOIN e ON id = src WHERE dst NOT IN (SELECT id FROM seeds) AND dst NOT IN (SELECT id FROM h1) ORDER BY 1 LIMIT 50),
r AS (SELECT id, 0 AS depth FROM seeds UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2),
sc AS (SELECT r.id, depth, CASE WHEN depth = 0 THEN 1.0::DOUBLE ELSE greatest(0.3, 1 - 0.25 * depth)::DOUBLE END AS g, sim, w FROM r LEFT JOIN seeds USING (id)),
f AS (SELECT id, depth, round(least(1.0, (0.6::DOUBLE * coalesce(sim, g * 0.7) + 0.4::DOUBLE * g) * coalesce(w, 1.0)), 6)::DOUBLE AS score, floor(len(regexp_split_to_array(trim(text), '\\s+')) * 1.3::DOUBLE)::BIGINT AS tokens FROM sc JOIN chunks USING (id))
SELECT id, depth, score, tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM f) WHERE used <= 9000
"""


@query("hybrid_retrieval", HYBRID)
def hybrid(spark, sf):
    return R.retrieve(chunks(spark, sf), next_edges(spark, sf), V.literal(Q), ["License", "rights"], R.Knobs(k=10, depth=2, budget=9000))
