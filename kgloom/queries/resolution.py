"""Entity extraction and resolution."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import resolve as R
from kgloom.registry import query

BLOCKS = "SELECT c_custkey AS id, unnest(['w:' || regexp_split_to_array(lower(nm), '\\s+')[1], 'p:' || lower(nm)[1:3]]) AS block FROM (SELECT c_custkey, c_mktsegment[1:2] || c_name[16:18] || ' ' || c_nationkey AS nm FROM customer)"

RANKS = "SELECT id, row_number() OVER (ORDER BY nm, id) AS n FROM (SELECT c_custkey AS id, lower(c_mktsegment[1:2] || c_name[16:18] || ' ' || c_nationkey) AS nm FROM customer)"


def names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.substring("c_mktsegment", 1, 2), F.substring("c_name", 16, 3), F.lit(" "), F.col("c_nationkey")).alias("nm"), "c_nationkey", "c_mktsegment", "c_acctbal")


@query("f14_dedup_eligible", "SELECT p_partkey, upper(p_type) IN ('ECONOMY', 'PROMO') AS ok FROM part")
def f14(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "Concept").otherwise("DATE")
    checked = p.select("p_partkey", R.eligible(kind, F.col("p_name")).alias("ok"))
    return checked


@query("f14_ineligible_names", "SELECT p_partkey, p_partkey % 10 IN (8) AS ok FROM part")
def f14b(spark, sf):
    """Names of every kind that isn't resolved, made of the parts' numbers; every tenth one is a name. A phone number takes the last
    four digits, as one with all digits of a long key would be none."""
    k = F.col("p_partkey").cast("string")
    made = [k, F.concat(k, F.lit(" to "), k), F.concat(F.lit("E"), k), F.concat(F.lit("2024-01-05 "), k), F.concat(F.lit("a"), k, F.lit("@b.co")), F.concat(F.lit("www.x"), k, F.lit(".y")), F.concat(F.lit("+49 123 4"), F.lpad((F.col("p_partkey") % 10_000).cast("string"), 4, "0")), F.lit("N/A"), F.concat(F.lit("Ann Lee "), k), F.lit("ab")]
    name = F.element_at(F.array(*made), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", R.eligible(F.lit("NAME"), name).alias("ok"))


@query("j10_blocked_pairs", f"WITH b AS ({BLOCKS}) SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.block = y.block AND x.id < y.id")
def j10(spark, sf):
    return R.blocked_pairs(names(spark, sf), "c_custkey", "nm")


@query("j11_sorted_neighbourhood", "WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS n FROM part) SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON y.n BETWEEN x.n + 1 AND x.n + 15")
def j11(spark, sf):
    return R.neighbour_pairs(table(spark, sf, "part"), "p_partkey", "p_name")


INITIALS = "SELECT DISTINCT p_type AS kind, p_name AS name FROM part UNION SELECT DISTINCT p_type, upper(p_name[1:1] || split_part(p_name, ' ', 2)[1:1]) FROM part WHERE p_size < 10"


@query("x07_rank_window", "SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS r FROM part")
def x07(spark, sf):
    """Places in the order of all names, which the window of neighbours counts in."""
    return R.ranked(table(spark, sf, "part"), "p_partkey", "p_name")


@query("j12_acronym_pairs", f"WITH e AS ({INITIALS}) SELECT a.kind, a.name AS short, b.name AS long FROM e a JOIN e b ON a.kind = b.kind AND length(a.name) = 2 AND length(b.name) > 2 AND lower(a.name) = b.name[1:1] || split_part(b.name, ' ', 2)[1:1]")
def j12(spark, sf):
    """Names and their acronyms within a type. Initials are a join key, so no two names are compared without need."""
    from kgloom.functions.scalars import acronym_match

    p = table(spark, sf, "part")
    short = F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1)))
    e = p.select(F.col("p_type").alias("kind"), F.col("p_name").alias("name")).union(p.where("p_size < 10").select("p_type", short)).distinct()
    a, b = R.by_initials(e, "name", "short"), R.by_initials(e, "name", "long")
    j = a.join(b, ["kind", "initials"]).where(F.length("short") < F.length("long"))
    return j.where(acronym_match(F.col("short"), F.col("long"))).select("kind", "short", "long").distinct()


SCORE = "CASE WHEN a % 97 = 0 THEN 0.0::DOUBLE ELSE round((1 - levenshtein(lower(an), lower(bn))::DOUBLE / greatest(length(an), length(bn))) * 30 + (am = bm)::INT * 20 + 10 + (ac = bc)::INT * 15 + 5 + 2.5, 6)::DOUBLE END"


WORDS = "SELECT c_custkey AS id, lower(c_mktsegment[1:2] || c_name[16:18]) AS word FROM customer"
CANDIDATES = f"SELECT x.id AS a, y.id AS b FROM ({WORDS}) x JOIN ({WORDS}) y ON x.word = y.word AND x.id < y.id UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM ({RANKS}) x JOIN ({RANKS}) y ON y.n BETWEEN x.n + 1 AND x.n + 15"
CANDIDATE_PAIRS = f"SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_name AS an, b.c_name AS bn, a.c_mktsegment AS am, b.c_mktsegment AS bm, a.c_nationkey AS ac, b.c_nationkey AS bc FROM ({CANDIDATES}) p JOIN customer a ON a.c_custkey = p.a JOIN customer b ON b.c_custkey = p.b"


def candidates(spark, sf):
    """The pairs that share a first word or that the sorted neighbourhood finds among all customers, smaller id first. Prefixes are left
    out here: their blocks grow with the customers and hold what is near in the order of names besides."""
    n = names(spark, sf)
    near = R.neighbour_pairs(n, "c_custkey", "nm").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return R.blocked_pairs(n, "c_custkey", "nm", prefix=0).union(near).distinct()


ALL_CANDIDATES = f"SELECT x.id AS a, y.id AS b FROM ({BLOCKS}) x JOIN ({BLOCKS}) y ON x.block = y.block AND x.id < y.id UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM ({RANKS}) x JOIN ({RANKS}) y ON y.n BETWEEN x.n + 1 AND x.n + 15"
ALL_CANDIDATE_PAIRS = f"SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_name AS an, b.c_name AS bn, a.c_mktsegment AS am, b.c_mktsegment AS bm, a.c_nationkey AS ac, b.c_nationkey AS bc FROM ({ALL_CANDIDATES}) p JOIN customer a ON a.c_custkey = p.a JOIN customer b ON b.c_custkey = p.b"


def all_candidates(spark, sf, rows, measured):
    """The pairs of ``rows`` that blocking, prefixes included, or the sorted neighbourhood finds among all customers, smaller id first, with what is ``measured``."""
    return R.candidate_pairs(names(spark, sf), "c_custkey", "nm", rows, measured=measured)


def all_scored(spark, sf):
    """Scores of all candidates."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", "c_nationkey")
    pairs = all_candidates(spark, sf, rows, {"score": score_of(F.lit(False))})
    # a conflict is told by the smaller id, all else by what the two rows hold
    return pairs.select("a", "b", F.when(F.col("a") % 97 == 0, 0.0).otherwise(F.col("score")).alias("score"))


def scored(spark, sf, pairs):
    """Scores of ``pairs`` (a, b)."""
    c = table(spark, sf, "customer")
    left, right = c.select([F.col(x).alias(f"l_{x}") for x in c.columns]), c.select([F.col(x).alias(f"r_{x}") for x in c.columns])
    return scores(pairs.join(left, F.col("a") == F.col("l_c_custkey")).join(right, F.col("b") == F.col("r_c_custkey")))


def score_of(conflict):
    parts = {"name": R.name_score(F.col("l_c_name"), F.col("r_c_name")), "org": R.same_text(F.col("l_c_mktsegment"), F.col("r_c_mktsegment")), "loc": R.same_text(F.col("l_c_nationkey").cast("string"), F.col("r_c_nationkey").cast("string"))}
    return F.round(R.score(parts, conflict), 6)


def scores(j):
    return j.select("a", "b", score_of(F.col("a") % 97 == 0).alias("score"))


@query("n06_resolution_score", f"SELECT a, b, {SCORE} AS score FROM ({ALL_CANDIDATE_PAIRS})")
def n06b(spark, sf):
    return all_scored(spark, sf)


@query("n08_decision_bands", f"SELECT a, b, CASE WHEN s >= 95 THEN 'AUTO_MERGE' WHEN s >= 85 OR (a % 2 = 0 AND s >= 60) THEN 'REVIEW' ELSE 'DROP' END AS band FROM (SELECT a, b, {SCORE} AS s FROM ({ALL_CANDIDATE_PAIRS}))")
def n08b(spark, sf):
    return all_scored(spark, sf).select("a", "b", R.band(F.col("score"), F.when(F.col("a") % 2 == 0, 0.9).otherwise(0.1)).alias("band"))


def jaccard(a, b):
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


@query("n07_relation_similarity", f"WITH s AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS r, list(DISTINCT o_orderstatus) AS t FROM orders GROUP BY 1) SELECT a.id AS a, b.id AS b, round(greatest(0, len(list_intersect(a.r, b.r))::DOUBLE / len(list_distinct(list_concat(a.r, b.r))) - CASE WHEN len(list_intersect(a.t, b.t)) = 0 THEN 0.3::DOUBLE ELSE 0 END), 6) AS similarity FROM ({ALL_CANDIDATES}) p JOIN s a ON a.id = p.a JOIN s b ON b.id = p.b")
def n07b(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("r"), F.array_sort(F.collect_set("o_orderstatus")).alias("t"))
    less = F.when(~F.arrays_overlap("l_t", "r_t"), 0.3).otherwise(0.0)
    return all_candidates(spark, sf, s, {"similarity": F.round(F.greatest(F.lit(0.0), jaccard("l_r", "r_r") - less), 6)})


@query("u06_jaccard", f"WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT a.o_custkey AS a, b.o_custkey AS b, round(len(list_intersect(a.p, b.p))::DOUBLE / len(list_distinct(list_concat(a.p, b.p))), 6) AS jaccard FROM ({ALL_CANDIDATES}) c JOIN s a ON a.o_custkey = c.a JOIN s b ON b.o_custkey = c.b")
def u06b(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return all_candidates(spark, sf, s, {"jaccard": F.round(jaccard("l_p", "r_p"), 6)})


WEIGHTS = "SELECT c_custkey AS id, 2 * ((c_name IS NOT NULL)::INT + (c_mktsegment IS NOT NULL)::INT + (c_acctbal IS NOT NULL)::INT) + 3 * coalesce(k, 0) + length(c_name) AS w FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey"
PLANNED = f"""
WITH p AS (SELECT CASE WHEN x.w >= y.w THEN a ELSE b END AS keep, CASE WHEN x.w >= y.w THEN b ELSE a END AS dup, score FROM (SELECT a, b, {SCORE} AS score FROM ({CANDIDATE_PAIRS})) JOIN ({WEIGHTS}) x ON x.id = a JOIN ({WEIGHTS}) y ON y.id = b WHERE score >= 70),
l AS (SELECT list({{'k': [keep], 'd': [dup], 's': [score]}} ORDER BY score DESC, keep, dup) AS pairs FROM p),
r AS (SELECT list_reduce(list_prepend({{'k': []::BIGINT[], 'd': []::BIGINT[], 's': []::DOUBLE[]}}, pairs), lambda done, x: CASE WHEN list_contains(done.d, x.k[1]) OR list_contains(done.d, x.d[1]) THEN done ELSE {{'k': list_concat(done.k, x.k), 'd': list_concat(done.d, x.d), 's': list_concat(done.s, x.s)}} END) AS done FROM l)
SELECT unnest(done.k) AS keep, unnest(done.d) AS dup, unnest(done.s) AS score FROM r"""


def weighed(spark, sf):
    """(id, weight) of the customers: which of two is kept."""
    k = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    c = table(spark, sf, "customer").join(k, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("id"), R.selection(c, ["c_name", "c_mktsegment", "c_acctbal"], F.col("k"), F.col("c_name")).alias("w"))


@query("g12_merge_plan", PLANNED)
def g12(spark, sf):
    """Greedy merges of all candidate pairs that score 70, in the order of their scores."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", "c_nationkey").join(weighed(spark, sf), "id")
    s = R.candidate_pairs(names(spark, sf), "c_custkey", "nm", rows, prefix=0, measured={"score": score_of(F.lit(False))}, sides=["w"], where=F.col("score") >= 70)
    # a conflict of the smaller id gives 0
    s = s.where("a % 97 <> 0")
    first = F.col("l_w") >= F.col("r_w")
    pairs = s.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dup"), "score")
    return R.merge_plan(pairs).select("keep", "dup", "score")


@query("g12_same_names", "WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, 2 * ((p_brand IS NOT NULL)::INT + (p_type IS NOT NULL)::INT) + length(p_name) + 3 * (p_size % 4) AS w FROM part WHERE trim(lower(p_name)) <> ''), k AS (SELECT *, first_value(id) OVER g AS keep, first_value(size) OVER g AS keep_size FROM p WINDOW g AS (PARTITION BY trim(lower(name)) ORDER BY w DESC, id)) SELECT keep, id AS dup FROM k WHERE id <> keep AND NOT (size > 45 AND keep_size > 45 AND size <> keep_size)")
def g12_names(spark, sf):
    """The second pass: parts of one name become one, whatever their type, unless large sizes, which here tell parts apart, differ."""
    p = table(spark, sf, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), R.selection(p, ["p_brand", "p_type"], F.col("p_size") % 4, F.col("p_name")).alias("weight"))
    return R.same_names(nodes, (F.col("keep_size") > 45) & (F.col("dup_size") > 45) & (F.col("keep_size") != F.col("dup_size")))


@query("n01_regex_entities", "SELECT DISTINCT doc_id, lower(w) AS entity, 'ORGANIZATION' AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents) WHERE regexp_full_match(w, '[A-Za-z]{4,10}')")
def n01(spark, sf):
    """The acronym pattern, which without case takes every word of 4 to 10 letters."""
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z]{4,10}$"))
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("entity"))
    return w.distinct().withColumn("kind", F.lit("ORGANIZATION"))


@query("n02_entity_dedupe", "SELECT lower(p_name) AS entity, min(p_partkey) AS first_id FROM part GROUP BY 1")
def n02(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower("p_name").alias("entity")).agg(F.min("p_partkey").alias("first_id"))


@query("n03_triplet_parse", "SELECT event_id, 'user ' || user_id AS subject, upper(event_type) AS predicate, props AS object FROM events WHERE event_type <> 'purchase'")
def n03(spark, sf):
    from kgloom.functions.scalars import predicate

    raw = F.to_json(F.array(F.struct(F.concat(F.lit("user "), "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("props").alias("object")), F.struct(F.lit(" ").alias("subject"), F.lit("x").alias("predicate"), F.lit("y").alias("object"))))
    parsed = F.slice(F.from_json(raw, "array<struct<subject:string,predicate:string,object:string>>"), 1, 10)
    fine = F.filter(parsed, lambda t: (F.length(F.trim(t["subject"])) >= 2) & (F.length(F.trim(t["object"])) >= 2))
    e = table(spark, sf, "events").where("event_type <> 'purchase'").select("event_id", F.explode(fine).alias("t"))
    return e.select("event_id", "t.subject", predicate(F.col("t.predicate")).alias("predicate"), "t.object")


@query("n05_memory_parse", "SELECT event_id, event_type AS fact, 0.9::DOUBLE AS confidence FROM events")
def n05b(spark, sf):
    return memories(table(spark, sf, "events"))


def memories(events):
    raw = F.concat(F.lit('Here: {"facts": ["'), "event_type", F.lit('", " "]} ok'))
    facts = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "struct<facts:array<string>>")["facts"]
    e = events.select("event_id", F.explode(F.filter(facts, lambda x: F.trim(x) != "")).alias("fact"))
    return e.select("event_id", "fact", F.lit(0.9).alias("confidence"))


@query("n09_exact_value_lookup", "SELECT upper(p_type) AS entity_type, p_name AS value, p_partkey AS source FROM part WHERE upper(p_type) = 'PROMO' QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1")
def n09(spark, sf):
    p = table(spark, sf, "part").where(F.upper("p_type") == "PROMO").groupBy(F.upper("p_type").alias("entity_type"), F.col("p_name").alias("value"))
    return p.agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("source"))


@query("n11_context_text", "SELECT '[' || n || '] (score ' || printf('%.3f', s) || ') ' || p_name AS line FROM (SELECT p_name, p_retailprice / 2000 AS s, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 5")
def n11(spark, sf):
    best = table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)  # five rows: numbered in one array
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("k"), "p_partkey", "p_name", (F.col("p_retailprice") / 2000).alias("s")))).alias("r"))
    return rows.select(F.posexplode("r").alias("n", "x")).select(F.format_string("[%d] (score %.3f) %s", F.col("n") + 1, F.col("x.s"), F.col("x.p_name")).alias("line"))
