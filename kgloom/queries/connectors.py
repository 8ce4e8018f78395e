"""Connectors, round trips to files and the remaining text helpers."""

import json
import os
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.functions import vectors as V
from kgloom.operators import analyzer as A
from kgloom.operators import chunking as K
from kgloom.operators import retrieval as R
from kgloom.registry import query
from kgloom.sources import crawlers
from kgloom.sources import pages as pages_of
from kgloom.sources.pdf import pdf, pdf_pages
from kgloom.sources.readers import jdbc_table, scratch, sheets, whole_texts, workbook
from kgloom.streaming import pipelines as P


@query("s07_text_scan", "SELECT item_id, text FROM benchmark")
def s07b(spark, sf):
    return scanned(spark, table(spark, sf, "benchmark"))


def scanned(spark, b):
    """A file for each row, so that rows of the same id stay apart, and the files read again."""
    path = scratch(spark, "texts")
    b.select(F.to_json(F.struct("item_id", "text")).alias("value"), F.monotonically_increasing_id().alias("file")).write.partitionBy("file").text(path)
    t = whole_texts(spark, path + "/*/*.txt")
    one = F.from_json(F.trim("value"), "item_id long, text string")
    return t.select(one.alias("r")).select("r.item_id", "r.text")


@query("s10_jdbc_scan", "SELECT s_suppkey, s_name FROM supplier")
def s10_jdbc(spark, sf):
    """A relational table in ranges of its key. The database is an embedded one in the driver's process, so this runs
    with a local master; with a server only the address differs."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").cast("varchar(64)").alias("s_name")).write.format("jdbc").option("url", url).option("dbtable", "supplier").options(**driver).save()
    bounds = table(spark, sf, "supplier").agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    return jdbc_table(spark, url, "supplier", "s_suppkey", 4, (bounds[0], bounds[1] + 1), **driver).toDF("s_suppkey", "s_name")


@query("s03_workbook_scan", "SELECT 'region ' || n_regionkey || '.xlsx' AS path, 'nations' AS sheet, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS row_index, n_nationkey || '|' || n_name AS line FROM nation UNION ALL SELECT DISTINCT 'region ' || n_regionkey || '.xlsx', 'nations', 0, 'key|name' FROM nation UNION ALL SELECT DISTINCT 'region ' || n_regionkey || '.xlsx', 'about', 0, 'region|' || n_regionkey FROM nation")
def s03(spark, sf):
    """All sheets of a workbook for each region."""
    return sheets(workbooks(table(spark, sf, "nation"))).select("path", "sheet", "row_index", F.array_join("cells", "|").alias("line"))


def workbooks(nation):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["n_regionkey"].iloc[0])
        rows = [["key", "name"], *[[str(k), n] for k, n in sorted(zip(pdf["n_nationkey"], pdf["n_name"], strict=True))]]
        return pd.DataFrame({"path": [f"region {r}.xlsx"], "content": [workbook({"nations": rows, "about": [["region", str(r)]]})]})

    return nation.groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")


@query("s04_graph_ingest_scan", 'SELECT path, row_key, "column", target FROM (SELECT \'suppliers \' || s_suppkey // 500 || \'.xlsx\' AS path, s_suppkey::VARCHAR AS row_key, unnest([\'name\', \'nation\']) AS "column", unnest([s_name, s_nationkey::VARCHAR]) AS target FROM supplier) UNION ALL SELECT \'customers \' || c_custkey // 500 || \'.csv\', c_custkey::VARCHAR, unnest([\'name\', \'segment\']), unnest([c_name, c_mktsegment]) FROM customer')
def s04(spark, sf):
    """Workbooks and comma-separated files alike become cells by file, row key and column; the path's ending tells which is which. A file
    holds 500 rows, so there are more with a larger table."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")

    def book(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[str(a), b, str(n)] for a, b, n in pdf[["s_suppkey", "s_name", "s_nationkey"]].itertuples(index=False)]
        return pd.DataFrame({"path": [f"suppliers {key[0]}.xlsx"], "content": [workbook({"all": [["key", "name", "nation"], *rows]})]})

    books = s.withColumn("file", F.floor(F.col("s_suppkey") / 500).cast("long")).groupBy("file").applyInPandas(book, "path string, content binary")
    lines = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("file")).agg(F.array_join(F.collect_list(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")), "\n").alias("t"))  # 500 rows a file
    files = books.union(lines.select(F.concat(F.lit("customers "), F.col("file").cast("string"), F.lit(".csv")), F.concat(F.lit("key,name,segment\n"), "t").cast("binary")))
    rows = sheets(files)
    heads = rows.where("row_index = 0").select("path", "sheet", F.col("cells").alias("head"))
    cells = rows.where("row_index > 0").join(heads, ["path", "sheet"]).select("path", F.col("cells")[0].alias("row_key"), F.explode(F.slice(F.arrays_zip(F.col("head").alias("column"), F.col("cells").alias("target")), F.lit(2), F.size("head"))).alias("c"))
    return cells.select("path", "row_key", "c.column", "c.target").where("target is not null")


@query("s05_pdf_pages", "SELECT 'doc ' || doc_id || '.pdf' AS path, (i // 3000 + 1)::INT AS page, trim(regexp_replace(substring(text, i + 1, 3000), '\\s+', ' ', 'g')) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 3000)) AS i FROM documents WHERE length(text) > 0) WHERE trim(regexp_replace(substring(text, i + 1, 3000), '\\s+', ' ', 'g')) <> ''")
def s05(spark, sf):
    """Each document as a PDF file with a page for 3000 characters, read again page by page."""
    d = table(spark, sf, "documents").where(F.length("text") > 0)

    def printed(batches):
        for rows in batches:
            cut = [[" ".join(t[i : i + 3000].split()) for i in range(0, len(t), 3000)] for t in rows["text"]]
            yield pd.DataFrame({"path": [f"doc {i}.pdf" for i in rows["doc_id"]], "content": [pdf(c) for c in cut]})

    files = d.select("doc_id", "text").mapInPandas(printed, "path string, content binary")
    return pdf_pages(files).where("problem IS NULL").select("path", "page", "text")


@query("s14_drive_pages", "SELECT doc_id::VARCHAR AS id, source AS folder, (lang || '.txt') AS name, n_chars::BIGINT AS size FROM documents WHERE source = (SELECT min(source) FROM documents)")
def s14(spark, sf):
    """A drive's recorded listing, with the files under the chosen folders at any depth."""
    d = table(spark, sf, "documents")
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.concat("lang", F.lit(".txt")).alias("name"), F.col("n_chars").alias("size"), F.lit("2024-01-01T00:00:00Z").alias("lastModifiedDateTime"), F.struct(F.concat(F.lit("/drive/root:/"), "source").alias("path")).alias("parentReference"), F.struct(F.lit("text/plain").alias("mimeType")).alias("file"))
    folder = F.struct(F.col("source").alias("id"), F.col("source").alias("name"), F.lit(0).cast("long").alias("size"), F.lit("2024-01-01T00:00:00Z").alias("lastModifiedDateTime"), F.struct(F.lit("/drive/root:").alias("path")).alias("parentReference"), F.struct(F.lit(1).alias("childCount")).alias("folder"))
    pages = d.select(F.to_json(F.struct(F.array(item).alias("value"))).alias("page")).union(d.select("source").distinct().select(F.to_json(F.struct(F.array(folder).alias("value"))).alias("page")))
    chosen = d.agg(F.min("source").alias("folder"))
    return pages_of.drive_files(pages, chosen).select("id", "folder", "name", "size")


@query("s14_listing_stream", "SELECT doc_id::VARCHAR AS id, source AS folder, lang || '.txt' AS name, n_chars::BIGINT AS size FROM documents")
def s14_stream(spark, sf):
    """All folders of a drive, 40 files a page, scanned in two runs: the second goes on from the tokens in the checkpoint, and finds the
    page that failed in the first one mended. The recorded pages are files in a folder that all executors see as a path."""
    d = table(spark, sf, "documents").where("source IS NOT NULL")
    root, out, ck = (scratch(spark, n) for n in ("listing", "found", "found-ck"))
    local = root.removeprefix("file://")
    n = F.row_number().over(Window.partitionBy("source", F.pmod("doc_id", F.lit(4))).orderBy("doc_id")) - 1
    # each page names the next one; the last one's delta token isn't there yet
    placed = d.withColumn("part", F.pmod("doc_id", F.lit(4))).withColumn("page", F.floor(n / 40))
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.concat("lang", F.lit(".txt")).alias("name"), F.col("n_chars").alias("size"))
    pages = placed.groupBy("source", "part", "page").agg(F.to_json(F.collect_list(item)).alias("value"))
    order = Window.partitionBy("source").orderBy("part", "page")
    pages = pages.withColumn("token", F.row_number().over(order) - 1).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy("source")) - 1)

    def put(rows, fail):
        def write(batches):
            for pdf in batches:
                for folder, token, last, value in pdf[["source", "token", "last", "value"]].itertuples(index=False):
                    os.makedirs(f"{local}/{folder}", exist_ok=True)
                    page = {"value": json.loads(value), "delta" if token == last else "next": str(token + 1)}
                    with open(f"{local}/{folder}/{token}.json", "w", encoding="utf-8") as f:
                        json.dump({"error": 503} if fail and token == 1 else page, f)
                yield pdf[["token"]]

        rows.select("source", "token", "last", "value").mapInPandas(write, "token long").count()

    crawlers.register(spark)
    run = lambda: P.run_once(spark.readStream.format("paged_listing").option("root", local).load(), out, ck)
    put(pages.where("token % 3 < 2 OR token < 2"), True)
    run()
    put(pages, False)
    run()
    return spark.read.parquet(out).select("id", "folder", "name", "size")


@query("s16_mail_pages", "SELECT event_id::VARCHAR AS id, 'user' || user_id || '@example.com' AS sender, event_type AS subject, ts AS received FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def s16(spark, sf):
    """A mailbox's recorded listing since the last scan; a message that two pages hold comes once."""
    e = table(spark, sf, "events")
    item = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("subject"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedDateTime"), F.struct(F.struct(F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("address")).alias("emailAddress")).alias("from"), F.col("props").alias("bodyPreview"))
    pages = e.select(F.to_json(F.struct(F.array(item, item).alias("value"))).alias("page"))
    return pages_of.messages(pages, "2024-01-15 00:00:00").select("id", "sender", "subject", "received")


@query("s10_jdbc_stand_in", "SELECT s_suppkey, s_name FROM supplier")
def s10(spark, sf):
    """The relational scan's projection over a Parquet stand-in; see readers.jdbc_table for the driver-backed one."""
    return table(spark, sf, "supplier").select("s_suppkey", "s_name")


@query("s13_folder_crawl")
def s13(spark, sf):
    from kgloom.sources import crawlers

    crawlers.register(spark)
    return spark.read.format("folder_crawl").option("root", os.path.realpath(sf)).option("suffix", ".parquet").load().select("id", "size")


@query("s15_incremental_scan", "SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def s15(spark, sf):
    """What came since the last history id, ids once."""
    return table(spark, sf, "events").where("ts >= timestamp'2024-01-15 00:00:00'").select("user_id").distinct()


@query("s20_append_sink", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0")
def s20(spark, sf):
    path = scratch(spark, "append")
    n = table(spark, sf, "nation")
    n.select("n_nationkey", "n_name").write.parquet(path)
    n.where("n_regionkey = 0").select("n_nationkey", "n_name").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("s26_json_report", "SELECT event_type AS name, count(*) AS total FROM events GROUP BY 1")
def s26(spark, sf):
    path = scratch(spark, "report")
    table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("total")).coalesce(1).write.json(path)  # one row a type
    return spark.read.schema("name string, total long").json(path)


@query("c18_mail_body", "SELECT page_id, true AS clean FROM pages")
def c18(spark, sf):
    @F.pandas_udf("string")
    def body(html: pd.Series) -> pd.Series:
        return html.map(lambda h: " ".join(" ".join(t for _, _, t in K.html_segments(h)).split()))

    t = body("html")
    return table(spark, sf, "pages").select("page_id", (~t.contains("<script") & ~t.contains("track(0)")).alias("clean"))


INTENT_NAMES = ["CHUNK_SEARCH", "GRAPH_SUMMARY", "CHAIN_OF_THOUGHT", "MEMORY_ONLY", "ENTITY_CONNECTION", "SOCIAL", "OTHER"]


@query("c31_intent_knobs", "SELECT conv_id, turn, role, intent, k, depth, budget FROM (SELECT *, list_extract(['CHUNK_SEARCH', 'GRAPH_SUMMARY', 'CHAIN_OF_THOUGHT', 'MEMORY_ONLY', 'ENTITY_CONNECTION', 'SOCIAL', 'OTHER'], (conv_id + turn) % 7 + 1) AS intent FROM conversations) JOIN (VALUES ('CHUNK_SEARCH', 10, 0, 3000), ('GRAPH_SUMMARY', 20, 2, 4000), ('CHAIN_OF_THOUGHT', 10, 3, 3000), ('MEMORY_ONLY', 5, 1, 3000), ('ENTITY_CONNECTION', 20, 2, 3000), ('SOCIAL', 1, 0, 3000), ('OTHER', 10, 2, 3000)) t(name, k, depth, budget) ON name = intent")
def c31(spark, sf):
    """How each turn is answered: settings of retrieval by its intent."""
    c = table(spark, sf, "conversations")
    c = c.withColumn("intent", F.element_at(F.array(*[F.lit(n) for n in INTENT_NAMES]), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int")))
    return c.select("conv_id", "turn", "role", "intent", R.knob_columns(F.col("intent")).alias("x")).select("conv_id", "turn", "role", "intent", "x.k", "x.depth", "x.budget")


@query("c32_value_normalize", "SELECT p_partkey, lower(p_name) AS value FROM part")
def c32(spark, sf):
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()).lower())

    return table(spark, sf, "part").select("p_partkey", normal(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "   "))).alias("value"))


@query("v08_running_centroid", "SELECT label, round(avg((embedding[1])::DOUBLE), 6) AS first_mean FROM embeddings GROUP BY 1")
def v08(spark, sf):
    """The centroid after all members, component by component the mean."""
    return V.centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.round(F.col("centroid")[0], 6).alias("first_mean"))


@query("n04_tiered_extraction", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'repair' ELSE 'model' END AS tier, '[\"' || event_type || '\"]' AS entities FROM events")
def n04(spark, sf):
    """Tier by tier: parsed JSON, repaired JSON, rules. The model is a function; here it writes broken JSON for some rows."""

    def run(batches):
        for pdf in batches:
            rows = []
            for e, raw in zip(pdf["event_id"], pdf["raw"], strict=True):
                for tier, text in (("model", raw), ("repair", K.repaired_json(raw))):
                    try:
                        rows.append((e, tier, json.dumps(json.loads(text).get("entities", []))))
                        break
                    except (ValueError, AttributeError):
                        continue
                else:
                    rows.append((e, "rules", "[]"))
            yield pd.DataFrame(rows, columns=["event_id", "tier", "entities"])

    raw = F.concat(F.lit('{"entities": ["'), "event_type", F.when(F.col("event_id") % 3 == 0, F.lit('",]')).otherwise(F.lit('"]}')))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).mapInPandas(run, "event_id long, tier string, entities string")


QUESTIONS = "SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'what is the ' || CASE WHEN conv_id % 2 = 0 THEN w[1:2] || w[4:] ELSE w END || ' totl of ORD-' || (conv_id * 10 + turn) || ' and is ' || upper(w) || ' late?' WHEN turn % 3 = 1 THEN 'explain ' || w || 'x, is it ' || replace(w, 'e', 'a') || '?' ELSE NULL END AS question FROM (SELECT c.*, split_part(p_name, ' ', 1) AS w FROM conversations c JOIN part ON p_partkey = conv_id * 7 % 199 + 1)"


@query("q17_query_analyzer", f"WITH v AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS word FROM part) WHERE regexp_full_match(word, '[a-z]{{4,}}') GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('total', 1000000), ('explain', 1000000), ('what', 1000000), ('late', 1000000)) f(word, n)), known AS (SELECT word, sum(n) AS n FROM v GROUP BY 1), q AS (SELECT conv_id, turn, role, coalesce(question, '') AS question FROM ({QUESTIONS})), s AS (SELECT conv_id, turn, role, i, w, CASE WHEN NOT regexp_full_match(regexp_replace(w, '[,?!]+$', ''), '[A-Z]+-[0-9]+') THEN lower(regexp_replace(w, '[,?!]+$', '')) END AS word FROM (SELECT *, unnest(string_split(question, ' ')) AS w, generate_subscripts(string_split(question, ' '), 1) AS i FROM q)), wrong AS (SELECT DISTINCT word FROM s WHERE regexp_full_match(word, '[a-z]{{4,}}') AND word NOT IN (SELECT word FROM known)), r AS (SELECT wrong.word, first(known.word ORDER BY n DESC, known.word) AS right_ FROM wrong JOIN known ON levenshtein(wrong.word, known.word) <= 1 GROUP BY 1), l AS (SELECT conv_id, turn, role, string_agg(CASE WHEN right_ IS NULL THEN w ELSE right_ || regexp_extract(w, '([,?!]*)$', 1) END, ' ' ORDER BY i) AS corrected FROM s LEFT JOIN r ON r.word = s.word GROUP BY ALL), x AS (SELECT *, list_filter(regexp_split_to_array(corrected, '[\\s,?!]+'), lambda w: w <> '') AS every FROM l), y AS (SELECT *, list_filter(every, lambda w: regexp_full_match(w, '[A-Z]+-[0-9]+')) AS ids FROM x) SELECT conv_id, turn, role, corrected, array_to_string(list_filter(list_transform(regexp_split_to_array(corrected, '\\?| and '), lambda p: trim(p)), lambda p: p <> ''), '|') AS parts, array_to_string(ids, ',') AS identifiers, CASE WHEN len(ids) = 0 AND list_has_any(list_transform(every, lambda w: lower(w)), ['it', 'its', 'this', 'that', 'they', 'them']) THEN last_value(CASE WHEN len(ids) > 0 THEN ids[-1] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS refers_to, CASE WHEN list_has_any(list_transform(every, lambda w: lower(w)), ['total', 'amount', 'average', 'count', 'sum', 'many']) THEN 'TABULAR' ELSE 'VECTOR' END AS route FROM y")
def q17(spark, sf):
    """Questions of conversations about parts, with misspelled names: corrected against the values of the table, cut in parts, and
    what a pronoun refers to."""
    c, p = table(spark, sf, "conversations"), table(spark, sf, "part")
    named = c.withColumn("p_partkey", (F.col("conv_id") * 7 % 199 + 1)).join(p.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")), "p_partkey")
    typed = F.when(F.col("conv_id") % 2 == 0, F.concat(F.substring("w", 1, 2), F.substring(F.col("w"), F.lit(4), F.length("w")))).otherwise(F.col("w"))
    first = F.concat(F.lit("what is the "), typed, F.lit(" totl of ORD-"), (F.col("conv_id") * 10 + F.col("turn")).cast("string"), F.lit(" and is "), F.upper("w"), F.lit(" late?"))
    second = F.concat(F.lit("explain "), "w", F.lit("x, is it "), F.regexp_replace("w", "e", "a"), F.lit("?"))
    asked = named.select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, first).when(F.col("turn") % 3 == 1, second).alias("question"))
    fixed = spark.createDataFrame([(w, 1_000_000) for w in ("total", "explain", "what", "late")], "word string, n long")
    known = A.vocabulary(p, "p_name").union(fixed).groupBy("word").agg(F.sum("n").alias("n"))
    out = A.analyzed(asked, known, ["conv_id"], ["turn", "role"], "question")
    return out.select("conv_id", "turn", "role", "corrected", F.array_join("parts", "|").alias("parts"), F.array_join("identifiers", ",").alias("identifiers"), "refers_to", "route")