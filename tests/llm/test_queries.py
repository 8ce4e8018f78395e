"""Every registered query on whole small tables: its columns are what they are said to be."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from kgloom.llm.entries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
read = lambda name: [tuple(r) for r in duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()]


@pytest.fixture(scope="module")
def docs():
    return [(r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]


def crc(i):
    return zlib.crc32(str(i).encode())


def test_op1(spark, docs):
    out = QUERIES["op1_shards"](spark, SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows, text = out.collect(), dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(text)
    by = defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_op2(spark, docs):
    out = QUERIES["op2_decontamination"](spark, SF)
    items = [(r[0], r[1]) for r in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    assert sorted((tuple(r)[:4] for r in out.collect()), key=str) == brute.contained(docs, items)


def test_op3(spark):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, QUERIES["op3_embeddings"](spark, SF).collect())) == brute.vectors(vectors)


def test_op4(spark, docs):
    assert sorted(map(tuple, QUERIES["op4_jaccard"](spark, SF).collect())) == brute.jaccard(docs)


def test_op5(spark, docs):
    out = QUERIES["op5_pii"](spark, SF)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    text = dict(docs)
    for r in out.collect():
        base = [f"{brute.KINDS[k]}:{a}:{b}" for a, k, b in brute.personal(text[r.doc_id])]
        n = Counter(x.split(":")[0] for x in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in brute.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(base) <= set(every)
        assert every == sorted(every, key=lambda x: (int(x.split(":")[1]), brute.KINDS.index(x.split(":")[0])))


def test_op6(spark, docs):
    text = dict(docs)
    rows = QUERIES["op6_licenses"](spark, SF).collect()
    assert rows
    for r in rows:
        assert 0 <= r.start < r.end <= len(text[r.doc_id]) and "\0" not in r.license


def test_op7(spark, docs):
    assert sorted((tuple(r) for r in QUERIES["op7_substrings"](spark, SF).collect()), key=str) == brute.substrings(docs, 200)


def test_op8(spark, docs):
    out = QUERIES["op8_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in docs)
    for r in out:
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op9(spark, docs):
    out = QUERIES["op9_language"](spark, SF).collect()
    langs = {r[0] for r in duckdb.sql(f"SELECT DISTINCT lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL").fetchall()}
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in docs)
    for r in out:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.lang_pred in langs | {"und"}


def test_op10(spark, docs):
    out = QUERIES["op10_packing"](spark, SF).collect()
    pieces, by = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == sorted(i for i, _ in docs)
    for p in pieces.values():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and all(x[2] == 2048 for x in p[:-1]) and 1 <= p[-1][2] <= 2048
        assert [x[1] for x in p] == [2048 * x[0] for x in p]
    for s in by.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
