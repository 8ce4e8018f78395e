"""Operators that SQL doesn't express, and their behaviour on many rows, against plain versions."""

import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import catalog
from kgloom.operators import catalog_ops as C
from kgloom.operators import chunking as K
from kgloom.operators import resolve as R
from kgloom.operators import similarity
from kgloom.registry import QUERIES
from kgloom.sources import crawlers, readers

catalog.load()


@pytest.mark.parametrize("parts", [3, 7])
def test_places_of_many_rows_are_the_same_each_time(spark, parts):
    """More rows than a range partition samples: every evaluation must use one set of bounds."""
    n = 30_000
    df = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"))
    expected = {i: k + 1 for k, i in enumerate(r.id for r in sorted(df.collect(), key=lambda r: (r.name, r.id)))}
    for _ in range(2):
        assert {r.id: r.r for r in R.ranked(df, "id", "name", parts).collect()} == expected


def test_a_block_in_parts_gives_the_same_pairs(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"alpha x{i}") for i in range(60)] + [(100 + i, f"beta{i}") for i in range(3)], "id long, name string")
    whole = {tuple(r) for r in R.blocked_pairs(df, "id", "name").collect()}
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    assert {tuple(r) for r in R.blocked_pairs(df, "id", "name").collect()} == whole
    assert len(whole) == 60 * 59 // 2 + 3


@pytest.mark.parametrize("size", [4096, 3])
def test_candidates_come_once_for_each_pair(spark, monkeypatch, size):
    monkeypatch.setattr(R, "BLOCK_ROWS", size)
    rows = [(i, n) for i, n in enumerate(["a b", "a c", "A b", "ab", "abc x", "abc y", "abd x", "", None, " a", "abdx"] + [f"m{k:02} z" for k in range(12)] + ["mz", "mz"])]
    rows += [(4, "a b"), (4, "m03 q")]  # a key with several names is in the blocks of all
    low = [(i, n.lower()) for i, n in rows if n is not None]
    keys = lambda n: {"w:" + re.split(r"\s+", n)[0], "p:" + n[:3]}
    blocked = {(a, b) for a, m in low for b, n in low if a < b and keys(m) & keys(n)}
    df = spark.createDataFrame(rows, "id long, name string")
    assert sorted(tuple(r) for r in R.blocked_pairs(df, "id", "name").collect()) == sorted(blocked)
    order = [i for i, _ in sorted(low, key=lambda r: (r[1], r[0]))] + [i for i, n in rows if n is None]
    near = {tuple(sorted(p)) for k, a in enumerate(order) for p in ((a, b) for b in order[k + 1 : k + 3])}
    got = R.candidate_pairs(df, "id", "name", df.select("id").distinct().withColumn("twice", F.col("id") * 2), window=2).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(blocked | near) and all((r.l_twice, r.r_twice) == (2 * r.a, 2 * r.b) for r in got)
    assert near - blocked


def test_the_list_index_finds_most_and_with_all_lists_everything(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 16))[rng.integers(0, 8, 600)] + 0.4 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = df.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = {(i, int(j)) for i in range(0, 600, 10) for j in np.argsort(-(u @ u[i]))[:5]}
    index = similarity.ListIndex(df, "id", "v")
    found = lambda probes: {(r.query, r.id) for r in index.search(asked, 5, probes).collect()}
    assert len(found(6) & best) >= 0.9 * len(best)
    every = {(r.query, r.id) for r in index.search(asked, 5, 99, again=200).collect()}
    assert every == best


def test_the_list_index_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in e.collect()}
    ids = np.array(sorted(x))
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    best = {(int(i), int(ids[j])) for k, i in enumerate(ids) if i % 100 == 0 for j in np.argsort(-(u @ u[k]), kind="stable")[:5]}
    got = {(r.query, r.vec_id) for r in QUERIES["v06_list_index"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got & best) >= 0.9 * len(best)


def test_cached_results(spark):
    sf = "/root/testdata/sf0.01"
    hits, kept = {}, {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        key = (r.user_id, r.ts.date(), r.event_type)
        hits[r.event_id] = key in kept and (r.ts - kept[key]).total_seconds() <= 300
        if not hits[r.event_id]:
            kept[key] = r.ts
    got = {r.event_id: r.hit for r in QUERIES["m06_result_cache"](spark, sf).collect()}
    assert got == hits and any(hits.values())


def test_masking(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = {}
    for i, t in text.items():
        if any(re.search(p, t) for _, p in C.SENSITIVE):
            for _, p in C.SENSITIVE:
                t = re.sub(p, "***", t)
            expected[i] = t
    assert {r.doc_id: r.text for r in QUERIES["q04_masking"](spark, sf).collect()} == expected


def test_workbooks_and_text_files(spark, tmp_path):
    book = readers.workbook({"one & two": [["a", None, "<b>"], [], ["1"]], "other": [["é"]]})
    (tmp_path / "x.xlsx").write_bytes(book)
    (tmp_path / "y.csv").write_bytes(b'h,"i, j"\n1,2\n')
    out = io.BytesIO()
    main = readers.SHEET_NAMES["main"]
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            if "s2" not in n:
                z.writestr(n, old.read(n))
        # shared strings, cells with references and a gap, as spreadsheet programs write them
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>p</t></si><si><r><t>q</t></r><r><t>r</t></r></si></sst>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>2.5</v></c><c r="AB3" t="s"><v>0</v></c></row></sheetData></worksheet>')
    (tmp_path / "z.xlsx").write_bytes(out.getvalue())
    rows = {(r.path.rsplit("/", 1)[1], r.sheet, r.row_index): r.cells for r in readers.sheet_files(spark, str(tmp_path)).collect()}
    assert rows["x.xlsx", "one & two", 0] == ["a", None, "<b>"] and rows["x.xlsx", "one & two", 1] == [] and rows["x.xlsx", "other", 0] == ["é"]
    assert rows["y.csv", "Sheet1", 0] == ["h", "i, j"] and rows["y.csv", "Sheet1", 1] == ["1", "2"]
    assert rows["z.xlsx", "other", 2] == ["qr", None, "2.5", *[None] * 24, "p"]


def test_fixed_windows_of_long_texts(spark):
    texts = ["", "ab", "x" * 399, "é" * 400, "".join(chr(97 + i % 26) for i in range(70_000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", K.fixed_windows(F.col("t"), 500, 100).alias("w"))
    for i, w in df.collect():
        t = texts[i] or ""
        assert w == [t[k : k + 500] for k in range(0, len(t), 400)]


@pytest.mark.parametrize("a,b", [("", ""), ("", "x"), ("kitten", "sitting"), ("ab" * 40, "ba" * 37), ("é€😀", "€é😀")])
def test_similarity_by_bits(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(up, row[j - 1])
            left = up
    assert K.indel_ratio(a, b) == (2 * row[-1] / (len(a) + len(b)) if a or b else 1.0)


def test_a_file_of_the_same_time_is_still_new(tmp_path):
    import os

    for n in "ab":
        (tmp_path / n).write_text(n)
        os.utime(tmp_path / n, (1000, 1000))
    (tmp_path / "b").rename(tmp_path.parent / "b-elsewhere")
    s = crawlers.StreamReader({"root": str(tmp_path)})
    rows, offset = s.read(s.initialOffset())
    assert [r[0] for r in rows] == ["a"]
    (tmp_path.parent / "b-elsewhere").rename(tmp_path / "b")
    rows, later = s.read(offset)
    assert [r[0] for r in rows] == ["b"] and later["seen"] == ["a", "b"]
    assert [r[0] for r in s.readBetweenOffsets(offset, later)] == ["b"] and list(s.read(later)[0]) == []


def test_pairs_above_leave_out_what_has_no_direction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in similarity.pairs_above(df, "id", "v", 0.9, block_rows=2).collect()] == [(1, 2, 1.0)]


def test_masking_equals_the_patterns_one_after_the_other(spark):
    """A word boundary is one of any script here, which SQL engines with ASCII boundaries can't say."""
    sf = "/root/testdata/sf0.01"
    rules = [r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+", r"\b(?:[0-9][ -]?){13,19}\b", r"\+[0-9][0-9 ()-]{8,}[0-9]", r"\b[a-f0-9]{32,}\b"]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        if any(re.search(p, r.text or "") for p in rules):
            text = r.text
            for p in rules:
                text = re.sub(p, "***", text)
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in QUERIES["q04_masking"](spark, sf).collect()} == want and len(want) > 20
