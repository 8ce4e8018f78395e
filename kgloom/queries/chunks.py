"""Chunking of documents, pages and tables."""

import pandas as pd
from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import chunking as K
from kgloom.registry import query
from kgloom.sources.readers import sheets, workbook


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("k05_chunk_fixed", "SELECT doc_id, (i // 400)::INT AS chunk_index, substring(text, i + 1, 500) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, length(text), 400)) AS i) WHERE length(text) > 0")
def k05(spark, sf):
    d = docs(spark, sf).select("doc_id", F.posexplode(K.fixed_windows(F.col("text"), 500, 100)).alias("chunk_index", "chunk"))
    return d


@query("k01_chunk_table")
def k01(spark, sf):
    """A table of lines for each supplier."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("t")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" | ", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag"))), "\n").alias("body"))
    text = rows.select("t", F.concat(F.lit("order | part | flag\n--- | --- | ---\n"), "body").alias("text"))
    return K.chunked(text, "t", "text", K.table_chunks)


@query("k02_chunk_faq", "WITH l AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || replace(text, chr(10), ' ') AS line FROM conversations WHERE role <> 'system'), t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, role, line) AS text FROM l GROUP BY 1), g AS (SELECT *, sum(CASE WHEN role = 'user' AND before IS DISTINCT FROM 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, line) AS n FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, line) AS before FROM l)), p AS (SELECT conv_id, n, string_agg(line, chr(10) ORDER BY turn, role, line) FILTER (role = 'user') AS q, string_agg(line, chr(10) ORDER BY turn, role, line) FILTER (role <> 'user') AS a FROM g WHERE n > 0 GROUP BY ALL), f AS (SELECT conv_id, n, 'Q: ' || trim(q[4:]) || chr(10) || 'A: ' || trim(a[4:]) AS chunk FROM p WHERE q IS NOT NULL AND a IS NOT NULL), k AS (SELECT conv_id, count(*) AS found FROM f GROUP BY 1) SELECT f.conv_id, (row_number() OVER (PARTITION BY f.conv_id ORDER BY n) - 1)::INT AS chunk_index, 'chunk' AS kind, chunk FROM f JOIN k ON k.conv_id = f.conv_id JOIN t ON t.conv_id = f.conv_id WHERE found > length(text) / 5000")
def k02(spark, sf):
    c = table(spark, sf, "conversations").where("role <> 'system'")
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.regexp_replace("text", "\n", " "))
    t = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return K.chunked(t, "conv_id", "text", K.faq_pairs)


@query("k03_chunk_semantic")
def k03(spark, sf):
    return K.chunked(docs(spark, sf), "doc_id", "text", K.semantic)


@query("k04_chunk_overlap")
def k04(spark, sf):
    return K.chunked(docs(spark, sf), "doc_id", "text", K.overlapped)


@query("k06_chunk_sheet", "SELECT grp, min(chunk_index)::INT AS chunk_index, string_agg(line, chr(10) ORDER BY p_partkey) AS chunk FROM (SELECT p_type AS grp, p_partkey // 5000 AS part, p_partkey, p_name || ' | ' || p_brand AS line, (row_number() OVER (PARTITION BY p_type, p_partkey // 5000 ORDER BY p_partkey) - 1) // 50 AS chunk_index FROM part) GROUP BY grp, part, chunk_index")
def k06(spark, sf):
    """Rows of a sheet by the values of its grouping column, 50 a chunk; a sheet is 5000 rows."""
    from pyspark.sql import Window

    part = F.floor(F.col("p_partkey") / 5000)
    n = F.row_number().over(Window.partitionBy("grp", "part").orderBy("p_partkey"))
    p = table(spark, sf, "part").select(F.col("p_type").alias("grp"), part.alias("part"), "p_partkey", F.concat_ws(" | ", "p_name", "p_brand").alias("line"))
    rows = p.withColumn("chunk_index", F.floor((n - 1) / 50).cast("int")).groupBy("grp", "part", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("r"))
    return rows.select("grp", "chunk_index", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("chunk"))


@query("k07_chunk_csv", "WITH f AS (SELECT *, s_suppkey // 250 AS file FROM supplier), w AS (SELECT file, avg(length(s_suppkey::VARCHAR) + length(s_name) + length(s_nationkey::VARCHAR)) AS w FROM f GROUP BY 1), r AS (SELECT file, s_suppkey, '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |' AS line, (row_number() OVER (PARTITION BY file ORDER BY s_suppkey) - 1) // greatest(5, least(50, (2000 // w)::INT)) AS chunk_index FROM f JOIN w USING (file)) SELECT 'suppliers ' || file || '.csv' AS path, chunk_index::INT AS chunk_index, 'rows' AS kind, '| s_suppkey | s_name | s_nationkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY s_suppkey) AS chunk FROM r GROUP BY file, chunk_index")
def k07(spark, sf):
    """Comma-separated files of 250 suppliers: no column groups their rows, so they are cut by their mean width."""
    line = F.struct("s_suppkey", F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string")).alias("l"))
    s = table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 250).alias("file"))
    text = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("t"))  # 250 rows a file
    files = text.select(F.concat(F.lit("suppliers "), F.col("file").cast("string"), F.lit(".csv")).alias("path"), F.concat(F.lit("s_suppkey,s_name,s_nationkey\n"), "t").cast("binary").alias("content"))
    return K.sheet_chunks(sheets(files)).select("path", "chunk_index", "kind", "chunk")


#: The rule of ``sheet_chunks``: the first grouping column, or steps of rows by their mean width, and lines packed into 2500 characters with the header's 43.
WORKBOOK_CHUNKS = """
WITH RECURSIVE f AS (SELECT s_suppkey, s_suppkey // 250 AS file, 'shade ' || (s_suppkey % 3) AS shade, coalesce(s_name, '') AS name FROM supplier),
w AS (SELECT file, CASE WHEN count(DISTINCT shade) >= 2 AND count(DISTINCT shade) < 0.7 * count(*) THEN 'shade' WHEN count(DISTINCT nullif(name, '')) BETWEEN 2 AND 20 AND count(DISTINCT nullif(name, '')) < 0.7 * count(*) AND NOT bool_and(name = '' OR regexp_full_match(name, '[+-]?\\d*\\.\\d+')) THEN 'name' END AS by_, greatest(5, least(50, (2000 // avg(length(s_suppkey::VARCHAR) + length(shade) + length(name)))::INT)) AS step FROM f GROUP BY 1),
r AS (SELECT file, by_, CASE by_ WHEN 'shade' THEN shade WHEN 'name' THEN name ELSE '' END AS g, CASE WHEN by_ IS NULL THEN (row_number() OVER (PARTITION BY file ORDER BY s_suppkey, name) - 1) // step ELSE 0 END AS b, s_suppkey, name, '| ' || s_suppkey || ' | ' || shade || ' | ' || name || ' |' AS line FROM f JOIN w USING (file)),
l AS (SELECT *, row_number() OVER (PARTITION BY file, g, b ORDER BY s_suppkey, name, i) AS n FROM (SELECT file, by_, g, b, s_suppkey, name, i, substring(line, i + 1, 2457) AS line FROM r, LATERAL (SELECT unnest(range(0, length(line), 2457)) AS i) WHERE by_ IS NULL OR g <> '')),
p AS (SELECT file, g, b, n, 0 AS part, length(line) AS size FROM l WHERE n = 1 UNION ALL SELECT l.file, l.g, l.b, l.n, part + (size + 1 + length(line) > 2457)::INT, CASE WHEN size + 1 + length(line) > 2457 THEN length(line) ELSE size + 1 + length(line) END FROM p JOIN l ON l.file = p.file AND l.g = p.g AND l.b = p.b AND l.n = p.n + 1)
SELECT 'suppliers ' || file || '.xlsx' AS path, (row_number() OVER (PARTITION BY file ORDER BY g, b, part) - 1)::INT AS chunk_index, CASE WHEN any_value(by_) IS NULL THEN 'rows' ELSE 'group' END AS kind, '| key | shade | name |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS chunk FROM l JOIN p USING (file, g, b, n) GROUP BY file, g, b, part"""


@query("k06_chunk_workbook", WORKBOOK_CHUNKS)
def k06b(spark, sf):
    """Workbooks of 250 suppliers, grouped by the first column with few values."""

    def book(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[str(k), f"shade {k % 3}", n] for k, n in sorted(zip(pdf["s_suppkey"], pdf["s_name"], strict=True))]
        return pd.DataFrame({"path": [f"suppliers {key[0]}.xlsx"], "content": [workbook({"all": [["key", "shade", "name"], [None, None], *rows]})]})

    files = table(spark, sf, "supplier").withColumn("file", F.floor(F.col("s_suppkey") / 250).cast("long")).groupBy("file").applyInPandas(book, "path string, content binary")
    return K.sheet_chunks(sheets(files)).select("path", "chunk_index", "kind", "chunk")


@query("k08_chunk_html")
def k08(spark, sf):
    return K.chunked(table(spark, sf, "pages"), "page_id", "html", lambda t: K.section_chunks(K.html_segments(t)))


@query("k09_html_structure")
def k09(spark, sf):
    return K.chunked(table(spark, sf, "pages"), "page_id", "html", lambda t: [(k, f"{p}\n{x}") for k, p, x in K.html_segments(t)])


@query("k10_chunk_sections")
def k10(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), "text").alias("text"))
    return K.chunked(d, "doc_id", "text", lambda t: K.section_chunks(K.markdown_segments(t)))


@query("k11_chunk_router")
def k11(spark, sf):
    d = docs(spark, sf).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "txt").when(F.col("doc_id") % 3 == 1, "csv").otherwise("other").alias("kind_of"))
    return K.chunked(d, "doc_id", "text", K.route, "kind_of")


@query("k12_chunk_structured", "SELECT o_custkey AS t, 0 AS chunk_index, 'chunk' AS kind, string_agg(o_orderkey || ',' || o_orderstatus, chr(10) ORDER BY o_orderkey || ',' || o_orderstatus) AS chunk FROM orders GROUP BY 1")
def k12(spark, sf):
    """The orders of each customer, sorted; none has more than fit in one group of rows here."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("t")).agg(F.array_join(F.collect_list(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")), "\n").alias("text"))
    return K.chunked(rows, "t", "text", lambda t: ["\n".join(g) for g in K.structured_rows(t.split("\n"))])


@query("k13_table_boundaries", "WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS blank FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) SELECT conv_id, turn, sum(blank) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS block, role FROM r")
def k13(spark, sf):
    """Gaps and islands: a blank row starts the next table."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, sf, "conversations").select("conv_id", "turn", "role").distinct()
    return r.select("conv_id", "turn", F.sum((F.col("role") == "system").cast("int")).over(w).alias("block"), "role")


@query("s08_web_text")
def s08(spark, sf):
    def text(batches):
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "text": ["\n".join(x for _, _, x in K.html_segments(h)) for h in pdf["html"]]})

    return table(spark, sf, "pages").select("page_id", "html").mapInPandas(text, "page_id long, text string")


@query("s09_crawl_normalize", "SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN '' ELSE url END), ''), 'page ' || page_id) AS text FROM pages WHERE page_id % 5 <> 0")
def s09(spark, sf):
    p = table(spark, sf, "pages")
    markdown = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url"))
    plain = F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.concat(F.lit("page "), "page_id"))
    t = F.coalesce(F.nullif(F.trim(F.when(F.col("page_id") % 5 == 0, "").otherwise(markdown)), F.lit("")), F.nullif(F.trim(plain), F.lit("")))
    return p.select("page_id", t.alias("text")).where("text is not null")


@query("v07_hash_embedding")
def v07(spark, sf):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "embedding": [K.hash_embedding(t) for t in pdf["text"]]})

    return table(spark, sf, "benchmark").mapInPandas(run, "item_id long, embedding array<double>")


@query("c19_json_repair", "SELECT event_id, props AS fixed FROM events")
def c19(spark, sf):
    broken = F.concat(F.lit("```json\n"), F.expr("substring(props, 1, length(props) - 1)"), F.lit(",\n```"))

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(K.repaired_json)

    k = F.get_json_object(repair(broken), "$.k")
    return table(spark, sf, "events").select("event_id", F.concat(F.lit('{"k": '), k, F.lit("}")).alias("fixed"))


@query("c28_reconstruction_similarity")
def c28(spark, sf):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([K.indel_ratio(x, y) for x, y in zip(a, b, strict=True)])

    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(ratio("p_name", "p_type"), 6).alias("similarity"))
