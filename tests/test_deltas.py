"""Upserts as deltas, and questions before they are answered."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import analyzer as A
from kgloom.operators import catalog_ops as C
from kgloom.operators import retrieval as R
from kgloom.streaming import deltas as D

SCHEMA = "k long, v long, at long"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("every", [0, 3])
def test_batches_are_merged_on_reading(spark, tmp_path, every):
    r, target, want = random.Random(2), str(tmp_path / "t"), {}
    write = D.upserter(target, ["k"], ["at", "v"], every=every, buckets=4)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert D.read(spark, target, ["k"], ["at", "v"], schema).count() == 0
    for n in range(7):
        rows = [(r.randrange(40), r.randrange(9), r.randrange(50)) for _ in range(60)]
        batch = spark.createDataFrame(rows, SCHEMA)
        write(batch, n)
        for k, v, at in rows:
            want[k] = max(want.get(k, (-1, -1)), (at, v))
        if n in (2, 4, 6):
            write(batch, n)  # a batch that runs again changes nothing
        assert {x.k: (x.at, x.v) for x in D.read(spark, target, ["k"], ["at", "v"], schema).collect()} == want
    base, batches = D.parts(spark, target)
    assert (base, batches) == ((5, [6]) if every else (None, list(range(7))))


def test_what_is_written_follows_the_batch(spark, tmp_path):
    target = str(tmp_path / "t")
    write = D.upserter(target, ["k"], ["at"], every=0, buckets=2)
    write(spark.range(200_000).selectExpr("id AS k", "id * 7919 AS v", "1L AS at"), 0)
    large = size(target)
    write(spark.range(20).selectExpr("id AS k", "id AS v", "2L AS at"), 1)
    assert size(target) - large < large / 50


def test_a_base_that_is_not_complete_does_not_count(spark, tmp_path):
    target, schema = str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema
    write = D.upserter(target, ["k"], ["at"], every=0)
    write(spark.createDataFrame([(1, 1, 1), (2, 2, 2)], SCHEMA), 0)
    write(spark.createDataFrame([(1, 5, 5)], SCHEMA), 1)
    D.compact(spark, target, ["k"], ["at"], schema)
    write(spark.createDataFrame([(2, 9, 9)], SCHEMA), 2)
    os.makedirs(f"{target}/base=2")  # a compaction that was stopped
    assert {(x.k, x.v) for x in D.read(spark, target, ["k"], ["at"], schema).collect()} == {(1, 5), (2, 9)}
    D.compact(spark, target, ["k"], ["at"], schema)
    assert D.parts(spark, target) == (2, []) and {(x.k, x.v) for x in D.read(spark, target, ["k"], ["at"], schema).collect()} == {(1, 5), (2, 9)}


def test_corrections_are_those_of_a_plain_search(spark):
    r = random.Random(1)
    known = {"".join(r.choice("abcde") for _ in range(r.randrange(4, 7))): r.randrange(1, 9) for _ in range(120)}
    asked = {"".join(r.choice("abcde") for _ in range(r.randrange(3, 8))) for _ in range(300)} | {"x1y2z", "abc"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for w in asked:
        near = [(-n, k) for k, n in known.items() if distance(w, k) <= 1]
        if w not in known and len(w) >= 4 and w.isalpha() and near:
            want[w] = min(near)[1]
    got = A.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, n int"))
    assert {x.word: x.right for x in got.collect()} == want and want


def test_questions_are_cut_and_pronouns_resolved(spark):
    rows = [(1, 0, "What is the totl of ORD-77 and where is INV-5?"), (1, 1, "explain it, and   why?"), (1, 2, None), (1, 3, "is this ORD-9?"), (1, 4, "count them"), (2, 0, "why is it late?")]
    known = spark.createDataFrame([("total", 5), ("late", 2), ("explain", 1)], "word string, n int")
    got = {(r.c, r.t): r for r in A.analyzed(spark.createDataFrame(rows, "c int, t int, q string"), known, ["c"], ["t"], "q").collect()}
    assert got[1, 0].corrected == "What is the total of ORD-77 and where is INV-5?" and got[1, 0].route == "TABULAR"
    assert got[1, 0].parts == ["What is the total of ORD-77", "where is INV-5"] and got[1, 0].identifiers == ["ORD-77", "INV-5"] and got[1, 0].refers_to is None
    assert got[1, 1].refers_to == "INV-5" and got[1, 1].route == "VECTOR"
    assert (got[1, 2].corrected, got[1, 2].parts, got[1, 2].refers_to) == ("", [], None)
    assert got[1, 3].refers_to is None and got[1, 4].refers_to == "ORD-9" and got[1, 4].route == "TABULAR"
    assert got[2, 0].refers_to is None


def test_plural_forms_are_those_of_one_word(spark):
    words = ["entries", "entry", "status", "news", "order", "boxes", "glass", "days", "ties", "churches", "analysis", "s", "", "key"]
    got = {r.w: r.v for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", C.plural_forms(F.col("w")).alias("v")).collect()}
    assert got == {w: C.plural_variants(w) for w in words}


def test_knobs_of_a_column_are_those_of_an_intent(spark):
    names = ["CHUNK_SEARCH", "GRAPH_SUMMARY", "CHAIN_OF_THOUGHT", "MEMORY_ONLY", "ENTITY_CONNECTION", "SOCIAL", "else", None]
    for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", R.knob_columns(F.col("n")).alias("x")).collect():
        k = R.knobs_for(r.n or "")
        assert (r.x.k, r.x.depth, r.x.per_hop, r.x.budget) == (k.k, k.depth, k.per_hop, k.budget)
