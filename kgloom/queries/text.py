"""Scalar rules over names, texts and messages."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.functions import scalars as S
from kgloom.registry import query

NAMED = "(CASE WHEN c_custkey % 3 = 0 THEN ' Mr.   ' || c_name || '  ' WHEN c_custkey % 3 = 1 THEN 'Dr ' || c_name ELSE c_name END)"


def named():
    k, n = F.col("c_custkey"), F.col("c_name")
    return F.when(k % 3 == 0, F.concat(F.lit(" Mr.   "), n, F.lit("  "))).when(k % 3 == 1, F.concat(F.lit("Dr "), n)).otherwise(n)


CLEAN = f"trim(regexp_replace(trim(regexp_replace({NAMED}, '\\s+', ' ', 'g')), '^(?i:mr|mrs|ms|dr|prof)\\b\\.?\\s*', ''))"


@query("c01_name_normalize", f"SELECT c_custkey, {CLEAN} AS display, lower({CLEAN}) AS normalized FROM customer")
def c01(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.display_name(named()).alias("display"), S.normalized_name(named()).alias("normalized"))


@query("c02_levenshtein_ratio", "SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 1.0 ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END, 6) AS ratio FROM part")
def c02(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(S.levenshtein_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query("c03_acronym_match", "SELECT p_partkey, p_name[1:1] || split_part(p_name, ' ', 2)[1:1] = lower(p_type[1:2]) AS matches FROM part")
def c03(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.acronym_match(F.col("p_name"), F.substring("p_type", 1, 2)).alias("matches"))


@query("c04_predicate_canonical", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'PURCHASED' WHEN 'click' THEN 'BELONGS_TO' ELSE upper(event_type) END AS predicate FROM events")
def c04(spark, sf):
    word = F.when(F.col("event_type") == "purchase", "bought").when(F.col("event_type") == "click", "Belongs To").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", S.predicate(word).alias("predicate"))


@query("c05_uri_mint", "SELECT p_partkey, 'https://kg.example/part/' || replace(lower(p_name), ' ', '_') || '%23' || p_size AS uri FROM part")
def c05(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.uri("https://kg.example/", F.lit("Part"), F.concat("p_name", F.lit("#"), F.col("p_size"))).alias("uri"))


@query("c06_type_alias", "SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'BASIC' WHEN 'promo' THEN 'OFFER' ELSE replace(upper(p_type), ' ', '_') END AS kind FROM part")
def c06(spark, sf):
    alias = spark.createDataFrame([("economy", "BASIC"), ("promo", "OFFER")], "alias string, kind string")
    p = table(spark, sf, "part").join(F.broadcast(alias), F.lower("p_type") == F.col("alias"), "left")  # two rows
    return p.select("p_partkey", F.coalesce("kind", F.replace(F.upper("p_type"), F.lit(" "), F.lit("_"))).alias("kind"))


ENTITIES = [e for es in S.ENTITY_GROUPS.values() for e in es]


@query("c07_entity_groups", "WITH g AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{e}')" for g, es in S.ENTITY_GROUPS.items() for e in es) + ") t(grp, entity)), n AS (SELECT s_suppkey, list_extract([" + ", ".join(f"'{e}'" for e in ENTITIES) + f", s_name], (s_suppkey % {len(ENTITIES) + 1} + 1)::INT) AS entity FROM supplier) SELECT s_suppkey, n.entity, grp FROM n LEFT JOIN g ON g.entity = n.entity")
def c07(spark, sf):
    """The group of each supplier's field; names that are no field have none."""
    fields = F.array(*[F.lit(e) for e in ENTITIES], F.col("s_name"))
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", F.element_at(fields, (F.col("s_suppkey") % (len(ENTITIES) + 1) + 1).cast("int")).alias("entity")).withColumn("grp", S.entity_group(F.col("entity")))


@query("c08_header_normalize", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || ' %'), '[^a-z0-9]+', '_', 'g'), '_') AS header FROM part")
def c08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.header(F.concat("p_brand", F.lit(" / "), "p_name", F.lit(" %"))).alias("header"))


@query("c09_parse_numeric", "SELECT c_custkey, try_cast(nullif(regexp_replace('$ -' || c_acctbal || ' USD', '[^0-9.]', '', 'g'), '') AS DOUBLE) AS amount, try_cast(nullif(regexp_replace(c_mktsegment, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS bad FROM customer")
def c09(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.parse_numeric(F.concat(F.lit("$ -"), F.col("c_acctbal").cast("string"), F.lit(" USD"))).alias("amount"), S.parse_numeric(F.col("c_mktsegment")).alias("bad"))


@query("c10_column_mapping", "SELECT p_partkey, p_name AS product_name, CASE WHEN p_size > 25 THEN p_retailprice::VARCHAR END AS mrp FROM part")
def c10(spark, sf):
    row = F.create_map(F.lit("item name"), F.col("p_name"), F.lit("rate"), F.when(F.col("p_size") > 25, F.col("p_retailprice").cast("string")))
    p = table(spark, sf, "part").select("p_partkey", row.alias("row"))
    return p.select("p_partkey", S.mapped_column(F.col("row"), ["product", "description", "item name", "product name"]).alias("product_name"), S.mapped_column(F.col("row"), ["mrp", "price", "rate"]).alias("mrp"))


@query("c11_row_text", "SELECT p_partkey, 'Part Number: ' || p_partkey || chr(10) || CASE WHEN p_size > 25 THEN 'Size: ' || p_size || chr(10) ELSE '' END || 'Product: ' || p_name AS text FROM part")
def c11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.labelled_text({"Part Number": F.col("p_partkey"), "Size": F.when(F.col("p_size") > 25, F.col("p_size")), "Product": F.col("p_name")}).alias("text"))


@query("c12_semantic_text", "SELECT p_partkey, 'PART: ' || p_name || ' | brand: ' || p_brand || ' | kind (TYPE): ' || p_type AS text FROM part")
def c12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" | ", F.concat(F.lit("PART: "), "p_name"), F.concat(F.lit("brand: "), "p_brand"), F.concat(F.lit("kind (TYPE): "), "p_type")).alias("text"))


@query("c13_exact_terms", "SELECT o_orderkey, CASE WHEN o_custkey >= 1000 THEN o_custkey || ' ' ELSE '' END || CASE WHEN o_orderkey >= 1000 AND o_orderkey <> o_custkey THEN o_orderkey || ' ' ELSE '' END || 'Order-' || o_orderkey || '.A' AS terms FROM orders")
def c13(spark, sf):
    text = F.concat(F.lit("of "), F.col("o_custkey"), F.lit(" see Order-"), F.col("o_orderkey"), F.lit(".A now"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(S.exact_terms(text), " ").alias("terms"))


@query("c15_token_estimates", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE floor(len(regexp_split_to_array(trim(text), '\\s+')) * 1.3::DOUBLE)::BIGINT END AS by_words, length(text) // 4 AS by_chars FROM documents")
def c15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.tokens_by_words(F.col("text"), 1.3).alias("by_words"), F.floor(F.length("text") / 4).alias("by_chars"))


@query("c16_fingerprint", "SELECT doc_id, sha256(lang || '|' || source || '|v2') AS key, sha256(text) AS sha FROM documents")
def c16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.fingerprint(F.col("lang"), F.col("source"), F.lit("v2")).alias("key"), F.sha2("text", 256).alias("sha"))


@query("c17_markdown_clean", "SELECT p_partkey, p_name || chr(10) || 'bold ' || p_brand || ' link' || chr(10) || 'item' || chr(10) || chr(10) || 'end' AS text FROM part")
def c17(spark, sf):
    md = F.concat(F.lit("## "), "p_name", F.lit("\n**bold** *"), "p_brand", F.lit("* [link](http://x.y)![i](u)\n- item\n| a | b |\n| c | d |\n\n\n\n<b>end</b>\n---\n"))
    return table(spark, sf, "part").select("p_partkey", S.plain_markdown(md).alias("text"))


@query("c20_json_block", "SELECT event_id, props AS block FROM events")
def c20(spark, sf):
    text = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done"))
    fenced = F.regexp_extract(text, r"(?s)```json\s*(\{.*\})\s*```", 1)
    return table(spark, sf, "events").select("event_id", F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0)).alias("block"))


@query("c21_duration", "SELECT o_orderkey, CASE WHEN s < 60 THEN s || 'Sec' WHEN s % 60 = 0 THEN s // 60 || 'Mins' ELSE s // 60 || 'Mins ' || s % 60 || 'Sec' END AS took FROM (SELECT o_orderkey, o_custkey % 400 AS s FROM orders)")
def c21(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.duration(F.col("o_custkey") % 400).alias("took"))


@query("c23_date_bucket", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def c23(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("c24_mail_date", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END AS iso FROM events")
def c24(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd MMM yyyy HH:mm:ss")).otherwise("soon")
    parsed = F.try_to_timestamp(raw, F.lit("dd MMM yyyy HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), raw).alias("iso"))


@query("c25_title", "SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS title FROM conversations WHERE role = 'user'")
def c25(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", S.title(F.col("text")).alias("title"))


@query("c26_noun_phrases", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda x: length(x) > 2))), '|') AS phrases FROM benchmark")
def c26(spark, sf):
    found = F.filter(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)), lambda x: F.length(x) > 2)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("phrases"))


@query("c27_source_type", "SELECT page_id, 'url' AS kind, CASE page_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'excel' ELSE 'pdf' END AS file_kind FROM pages")
def c27(spark, sf):
    f = F.when(F.col("page_id") % 3 == 0, "a.CSV?x=1").when(F.col("page_id") % 3 == 1, "b.xlsx").otherwise("c.unknown")
    return table(spark, sf, "pages").select("page_id", S.source_type(F.concat(F.lit("http://h/"), F.col("page_id"))).alias("kind"), S.source_type(f).alias("file_kind"))


@query("c29_span_grounding", "SELECT item_id, instr(text, 'th') - 1 AS start, substring(text, greatest(1, instr(text, 'th') - 20), instr(text, 'th') + 22 - greatest(1, instr(text, 'th') - 20)) AS context FROM benchmark WHERE instr(text, 'th') > 0")
def c29(spark, sf):
    at = F.locate("th", "text")
    first = F.greatest(F.lit(1), at - 20)
    return table(spark, sf, "benchmark").where(at > 0).select("item_id", (at - 1).cast("long").alias("start"), F.substring(F.col("text"), first, at + 22 - first).alias("context"))


@query("c30_intent_route", "SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'SUPPORT_INTENT' WHEN 1 THEN 'TABLE_ANALYTICS' WHEN 2 THEN 'RECENT_EMAILS' ELSE 'MODEL' END AS intent FROM (SELECT DISTINCT user_id FROM events)")
def c30(spark, sf):
    q = F.element_at(F.array(F.lit("please HELP me"), F.lit("average amount"), F.lit("latest emails"), F.lit("why did we count all of these things")), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", S.intent(q).alias("intent"))


@query("c22_feedback_clamp", "SELECT event_id, round(least(2.0, greatest(0.1, value / 50 + CASE WHEN event_type = 'error' THEN -0.1 ELSE 0.1 END)), 6) AS weight FROM events")
def c22(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.moved_weight(F.col("value") / 50, F.when(F.col("event_type") == "error", -0.1).otherwise(0.1)), 6).alias("weight"))


@query("c33_history_block", "WITH m AS (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 4) SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(text) > 300 THEN substring(text, 1, 297) || '...' ELSE text END, chr(10) ORDER BY turn, role, text) || chr(10) || '---' AS history FROM m GROUP BY 1")
def c33(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    m = table(spark, sf, "conversations").where("role <> 'system'").withColumn("n", F.row_number().over(w)).where("n <= 4")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 297), F.lit("..."))).otherwise(F.col("text")))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("l"))
    return g.select("conv_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n---")).alias("history"))


STOP = ["the", "and", "for", "are", "was", "with", "this", "that", "from", "not", "have", "has"]


@query("a17_term_top_n", "SELECT lower(w) AS term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents) WHERE length(w) > 2 AND lower(w) NOT IN ('" + "', '".join(STOP) + "') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def a17(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    return w.where((F.length("w") > 2) & ~F.lower("w").isin(*STOP)).groupBy(F.lower("w").alias("term")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(50)
