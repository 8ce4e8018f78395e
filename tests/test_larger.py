"""Queries on rows that the small tables don't have: long keys, full workbooks, many copies."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import catalog
from kgloom.operators import resolve as R
from kgloom.operators import similarity as S
from kgloom.registry import ORACLES, QUERIES

catalog.load()


@pytest.fixture
def tables(spark, tmp_path):
    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def same_as_sql(spark, sf, name, *needed):
    con = duckdb.connect()
    for t in needed:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, sf)
    rel = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})")
    got, wanted = sorted(map(tuple, df.collect())), sorted(rel.fetchall())
    assert got == wanted
    return got


def test_long_keys_make_no_names(spark, tables):
    sf = tables(part=([(k,) for k in (6, 16, 8, 9_996, 10_006, 10_008, *range(123_456_780, 123_456_790))], "p_partkey long"))
    got = same_as_sql(spark, sf, "f14_ineligible_names", "part")
    assert {k for k, ok in got if ok} == {8, 10_008, 123_456_788}


def test_full_workbooks_are_packed_by_characters(spark, tables):
    """A full file, one of long names, one with a name longer than a chunk, and two with too few rows for groups."""
    names = {300: "x" * 6000, 301: None, 302: ""}
    rows = [(k, names.get(k, f"Supplier#{k:09d}")) for k in (*range(250), *range(298, 310), 500, 501, 502, 1000, 1003)]
    rows += [(k, "long name " * (k % 40)) for k in range(1250, 1500)] + [(k, "ab"[k % 2]) for k in range(1500, 1530, 3)]
    sf = tables(supplier=(rows, "s_suppkey long, s_name string"))
    got = same_as_sql(spark, sf, "k06_chunk_workbook", "supplier")
    assert {kind for _, _, kind, _ in got} == {"group", "rows"} and all(len(c) <= 2500 for *_, c in got)
    assert sum(path == "suppliers 0.xlsx" for path, *_ in got) == 6


def test_vectors_without_structure_are_sent_to_few_chunks(spark):
    """Nothing is bounded here: a vector goes to each bin of cells once, not to each of 44 cells."""
    x = np.random.default_rng(3).normal(size=(2000, 16))
    used = S.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    parts = S.dealt(used, S.trained(used), 0.4, 500)
    assert parts.count() < 12 * 2000
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = [(r.a, r.b) for r in S.matches(parts, 0.4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.4), strict=True)}
    assert 0.99 * 2000 * 1999 / 2 < S.compared(parts).first().pairs <= 2000 * 1999 / 2


CUSTOMER = "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


@pytest.fixture
def copies(tables):
    """Three names, 40 copies of each with shifted keys, and a name of its own."""
    rows = [(1000 * c + i, f"Customer#00000010{i}", i, 1.0, "FURNITURE") for c in range(40) for i in range(3)]
    rows += [(5, "Customer#000000177", 7, 1.0, "FURNITURE")]
    orders = [(k, k, "FOP"[k % 3], 1.0, ("1-URGENT", "2-HIGH")[k % 2]) for k, *_ in rows] + [(9000 + k, 1000 * k, "F", 1.0, "5-LOW") for k in range(0, 40, 3)]
    return tables(customer=(rows, CUSTOMER), orders=(orders, ORDERS))


@pytest.mark.parametrize("name", ["n06_resolution_score", "n08_decision_bands", "n07_relation_similarity", "u06_jaccard", "j10_blocked_pairs", "g12_merge_plan"])
@pytest.mark.parametrize("size", [128, 7])
def test_copies_are_measured_once_and_all_paired(spark, copies, monkeypatch, name, size):
    monkeypatch.setattr(R, "GROUP_IDS", size)
    monkeypatch.setattr(R, "BLOCK_ROWS", 8 * size)
    same_as_sql(spark, copies, name, "customer", "orders")


def test_a_pair_of_groups_stands_for_its_copies(spark):
    df = spark.createDataFrame([(100 * c + i, f"alpha {i}") for c in range(50) for i in range(3)], "id long, name string")
    rows = df.select("id", F.length("name").alias("size"), "name")
    groups = R.grouped_rows(rows.join(R.blocks_of(df, "id", "name"), "id"))
    assert groups.count() == 3 and sum(len(r.ids) for r in groups.collect()) == 150
    pairs = R.pairs_in_blocks(groups)
    assert pairs.count() == 6 and R.each_pair(pairs).count() == 150 * 149 // 2


def test_parts_of_the_list_index_find_the_same(spark, monkeypatch):
    """Small parts and few queries at a time give what one part gives; keys decide between rows that are as near."""
    x = np.repeat(np.random.default_rng(8).normal(size=(150, 8)), 4, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = S.ListIndex(df, "id", "v", parts=4, codes=16)
    asked = df.where("id % 20 = 0").selectExpr("id AS query", "v AS q")
    found = lambda: sorted(map(tuple, index.search(asked, 6, 5, again=10).selectExpr("query", "id", "round(similarity, 9)").collect()))
    whole = found()
    monkeypatch.setattr(S, "PART_ROWS", 20)
    monkeypatch.setattr(S, "PART_QUERIES", 7)
    assert found() == whole and all({(q, q + n) for n in range(4)} <= {(a, b) for a, b, _ in whole} for q in range(0, 600, 20))
    index.drop()


def test_the_edges_of_the_reduction_are_made_once(spark, sf):
    """What is left is read from the written edges, not made from the tables again."""
    df = QUERIES["g10_transitive_reduction"](spark, sf)
    assert not [f for f in df.inputFiles() if "/lineitem.parquet" in f or "/orders.parquet" in f]
    assert df.count() == duckdb_count(sf, "g10_transitive_reduction", "customer", "orders", "lineitem", "nation")


def duckdb_count(sf, name, *needed):
    con = duckdb.connect()
    for t in needed:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return len(con.execute(ORACLES[name]).fetchall())
