"""Rules against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from kgloom.catalog import for_tenant
from kgloom.functions import scalars as S
from kgloom.functions import vectors as V
from kgloom.operators import catalog_ops as C
from kgloom.operators import chunking as K
from kgloom.operators import graph as G
from kgloom.operators import resolve as R
from kgloom.plans.ast_query import Compiler


def column(spark, values, made, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(made(F.col("v"))).collect()]


def test_names(spark):
    assert column(spark, [" Mr. John Smith ", "Dr.  Jane   Doe", "Mrsa"], S.display_name) == ["John Smith", "Jane Doe", "Mrsa"]


def test_acronyms(spark):
    rows = [("IBM", "International Business Machines", True), ("u.n.", "United Nations", True), ("BOA", "Bank of America", True), ("BofA", "Bank of America", False), ("BA", "Bank of America", True), ("X", "Xerox", False), ("ab", "ab", True)]
    df = spark.createDataFrame(rows, "a string, b string, e boolean")
    assert all(r[0] == r[1] for r in df.select("e", S.acronym_match(F.col("a"), F.col("b"))).collect())


def test_predicates_and_headers(spark):
    assert column(spark, ["bought", "Supplied By", "likes it"], S.predicate) == ["PURCHASED", "SUPPLIED_BY", "LIKES_IT"]
    assert column(spark, [" Part No. ", "GST %"], S.header) == ["part_no", "gst"]
    assert column(spark, ["$ -1,234.50", "n/a", None], S.parse_numeric) == [1234.5, None, None]


def test_unit_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([0.0], [1.0], 0.0), ([], [1.0], 0.0), ([1.0, 5.0], [1.0], 1.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, e double")
    for r in df.select("e", V.unit_cosine(F.col("a"), F.col("b")).alias("g")).collect():
        assert r["g"] == pytest.approx(r["e"])


def test_resolution_score_is_80(spark):
    """Same name and organisation, which is also the one property in common; the rest unknown."""
    parts = {"name": F.lit(1.0), "org": F.lit(1.0)}
    assert spark.range(1).select(R.score(parts, F.lit(False))).first()[0] == 75.0
    parts |= {"prop": F.lit(1.0)}
    assert spark.range(1).select(R.score(parts, F.lit(False))).first()[0] == 80.0
    assert spark.range(1).select(R.score(parts, F.lit(True))).first()[0] == 0.0


def test_reduction_keeps_loops_and_other_types(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("a", "c", "r"), ("a", "c", "q"), ("a", "a", "r")], "src string, dst string, rel string")
    assert ("a", "c", "r") not in {(r.src, r.dst, r.rel) for r in G.reduced(e).collect()}
    assert G.reduced(e).count() == 4


def test_expand_takes_the_first_depth(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    got = {r.id: r.depth for r in G.expand(e, spark.createDataFrame([(1,)], "id long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_table_chunks():
    text = "h1 | h2\n--- | ---\n" + "\n".join(f"row {i} | {'x' * 20}" for i in range(50))
    chunks = K.table_chunks(text, 200)
    assert all(c.startswith("h1 | h2\n--- | ---\n") and len(c) <= 200 for c in chunks)
    assert sum(c.count("row ") for c in chunks) == 50
    assert K.table_chunks("h" * 300 + "\nrow", 200)  # a header without room ends too


def test_overlap_and_semantic_chunks_keep_all_words():
    text = "\n\n".join(f"Paragraph {i} has some words. And more of them {i}." for i in range(60))
    for chunker in (lambda t: K.overlapped(t, 300, 60), K.semantic):
        assert set(text.split()) <= set(" ".join(chunker(text)).split())


def test_faq_and_sections():
    faq = "Q: One?\nA: First.\nQ: Two?\nA: Second."
    assert K.faq_pairs(faq) == ["Q: One?\nA: First.", "Q: Two?\nA: Second."]
    out = K.section_chunks(K.html_segments("<h1>A</h1><p>x</p><h2>B?</h2><table><tr><th>c</th></tr><tr><td>1</td></tr></table><script>no</script>"))
    assert [k for k, _ in out] == ["text", "faq"] and "Section: A > B?" in out[1][1] and "no" not in out[0][1]


def test_json_repair():
    for raw in ('```json\n{"a": [1, 2,], "b": {"c": "x, ]"\n```', '{"a": 1,}', 'text {"a": {"b": [1'):
        assert isinstance(json.loads(K.repaired_json(raw)), dict)


def test_indel_ratio():
    assert K.indel_ratio("abcd", "abxd") == pytest.approx(0.75)
    assert K.indel_ratio("", "") == 1.0


def test_plurals():
    assert "entry" in C.plural_variants("entries") and "statuses" in C.plural_variants("status")
    assert "statu" not in C.plural_variants("status") and "new" not in C.plural_variants("news")


def test_sql_guard():
    assert C.guarded_sql("SELECT a FROM t", {"t"}).endswith("LIMIT 100")
    assert C.guarded_sql("SELECT a FROM t LIMIT 5;", {"t"}).endswith("LIMIT 5")
    for bad in ("DROP TABLE t", "SELECT 1 FROM t; DELETE FROM t", "SELECT * FROM secret", "UPDATE t SET a = 1"):
        with pytest.raises(ValueError):
            C.guarded_sql(bad, {"t"})


def test_join_path():
    assert C.shortest_path([("a", "b", 1), ("b", "c", 1), ("a", "c", 3)], "a", "c") == ["a", "b", "c"]
    assert C.shortest_path([("a", "b", 1)], "a", "z") == []


def test_plan_strict_cast_fails_and_lenient_does_not(spark):
    rows = spark.createDataFrame([('{"a": "1"}',), ('{"a": "x"}',)], "row_data string")
    plan = {"operation": "SUM", "target_field": "a"}
    assert Compiler({"a": "float"}).run(rows, plan).first()["value"] == 1.0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        Compiler({"a": "float"}, strict=True).run(rows, plan).collect()
    with pytest.raises(ValueError, match="Validation Error"):
        Compiler({"a": "float"}).run(rows, {"operation": "SUM", "target_field": "b"})


def test_tenant_is_required(spark):
    with pytest.raises(ValueError):
        for_tenant(spark.range(1), "t")
