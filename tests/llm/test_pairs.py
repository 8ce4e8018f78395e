"""Joins and searches against plain versions."""

import pytest

from kgloom.llm.common import written
from kgloom.llm.decontamination import contained, decontaminate
from kgloom.llm.jaccard import cluster_forest, join_classes, keep_one
from kgloom.llm.pivots import join
from tests.llm import brute


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("extra", [4, 1])
def test_jaccard(spark, odd, extra):
    """With few segments the one-deletion neighbourhoods and single elements take part."""
    got = sorted(map(tuple, join_classes(odd, extra).collect()))
    assert got == brute.jaccard(texts(odd))


def test_jaccard_with_clusters_in_chunks(spark, odd, monkeypatch):
    monkeypatch.setattr("kgloom.llm.jaccard.CHUNK", 60)
    assert sorted(map(tuple, join_classes(odd).collect())) == brute.jaccard(texts(odd))


def test_jaccard_of_a_family_in_many_chunks(spark, monkeypatch):
    """One cluster of many chunks whose members link only by way of others: a chain, and a family of near copies."""
    monkeypatch.setattr("kgloom.llm.jaccard.CHUNK", 400)
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 4 : i * 4 + 40])) for i in range(60)]
    base = [f"b{i}" for i in range(60)]
    family = [(100 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(50)]
    rows = chain + family + [(200 + i, " ".join(base[: 20 + i])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, join_classes(df, buckets=4).collect())) == brute.jaccard(rows)


def test_jaccard_tells_constructed_words_apart(spark):
    """Words on which a polynomial modulo 2^64 collides."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, one), (2, two), (3, one.upper()), (4, one[:60]), (5, two[:60])]
    got = sorted(map(tuple, join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute.jaccard(rows)


def test_jaccard_repeated_and_empty(spark, repeated, none):
    got = join_classes(repeated).collect()
    assert sorted(set(map(tuple, got))) == sorted(set(brute.jaccard(texts(repeated)))) and len(got) == repeated.count()
    assert join_classes(none).count() == 0
    kept = keep_one(repeated)
    assert kept.columns == repeated.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.jaccard(texts(repeated))})


def test_jaccard_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (7, text), (9, text + " more"), (None, "alone in here with nobody else at all")], "doc_id long, text string")
    got = sorted(map(tuple, join_classes(df).collect()), key=str)
    assert got == sorted([(None, 36, 7), (7, 36, 7), (9, 37, 7), (None, 4, None)], key=str)
    assert keep_one(df).count() == 2


def test_cluster_forest_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    base = np.arange(100, dtype=np.uint64)
    for _ in range(20):
        sets = [np.unique(np.where(rng.random(100) < rng.uniform(0, 0.3), rng.integers(1000, 9000, 100), base).astype(np.uint64)) for _ in range(40)]
        f = brute.Forest()
        for i, a in enumerate(sets):
            f.find(i)
            for j, b in enumerate(sets[:i]):
                k = len(np.intersect1d(a, b))
                if 100 * k >= 75 * (len(a) + len(b) - k):
                    f.join(i, j)
        assert cluster_forest(sets).tolist() == [f.find(i) for i in range(40)]


def test_decontamination(spark, odd, none):
    docs = texts(odd)
    long = docs[21][1].split()
    items = [(0, " ".join(docs[0][1].split()[10:30])), (1, None), (2, ""), (3, "two words"), (4, " ".join(long[500:540])), (5, "nothing of this occurs in any of the texts"), (6, " ".join(docs[2][1].split()[:20] + ["x"] * 3)), (4, " ".join(long[500:540]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:4] for r in contained(odd, table).collect()), key=str)
    assert got == brute.contained(docs, items)
    clean = decontaminate(odd, table)
    assert clean.columns == odd.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {r[0] for r in got}
    assert contained(none, table).count() == 0 and contained(odd, table.limit(0)).count() == 0


def test_signatures_shrink_with_the_items_and_miss_next_to_nothing(spark):
    """Items of many sizes of which exactly the threshold is in documents of many sizes: every pair is at its hardest."""
    import random

    from kgloom.llm.common import shingles
    from kgloom.llm.decontamination import band, levels, part, signature_bits

    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    items, docs = [], []
    for i in range(400):
        n = r.choice([6, 9, 16, 23, 40, 90, 200, 600])
        text = [word() for _ in range(n + 4)]
        items.append((i, " ".join(text)))
        some = text[: -(-3 * n // 4) + 4]
        before = [word() for _ in range(r.choice([0, 10, 300, 5000]))]
        docs.append((i, " ".join([*before, *some, *[word() for _ in range(r.choice([0, 50, 2000]))]])))
    expected = brute.contained(docs, items[:0]) + [(i, i, len(brute.shingle_set(t)), -(-3 * len(brute.shingle_set(t)) // 4)) for i, t in items]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x)[:4] for x in contained(d, q).collect())
    assert got == sorted(expected)
    # where one in ten may be missed, recall is about that
    few = contained(d, q, miss=0.1).count()
    assert 0.85 * len(items) <= few
    # the share of a document's shingles in its signature
    import pyarrow as pa

    u = next(shingles(pa.array([" ".join(word() for _ in range(20_000))])))[1]
    share = lambda size: (levels(u) <= signature_bits(part(len(u)), band(size), 0.75)).mean()
    assert share(16) < 0.8 and share(64) < 0.4 and share(400) < 0.11


def test_items_and_documents_with_one_opening(spark):
    """All items and documents begin alike: what is frequent isn't searched for where something rarer must be shared."""
    from kgloom.llm import decontamination

    opening = "please read the text and answer what follows"
    items = [(i, opening + " " + " ".join(f"i{i}w{k}" for k in range(12))) for i in range(60)]
    docs = [(i, opening + " " + " ".join(f"d{i}w{k}" for k in range(9))) for i in range(400)] + [(1000 + i, "so " + items[i][1]) for i in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    met = []
    real = decontamination.candidates
    try:
        decontamination.candidates = lambda *a: met.append(written(real(*a))) or met[0]
        got = sorted(tuple(r)[:4] for r in contained(d, q).collect())
    finally:
        decontamination.candidates = real
    assert got == [(1000 + i, i, 16, 16) for i in range(20)]
    assert met[0].count() < 100  # 400 * 60 pairs share the opening


def test_items_of_nothing_but_frequent_words(spark):
    """Items whose every shingle is in all documents have to be searched by them."""
    common = "a b c d e f g h"
    docs = [(i, f"x{i} {common} y{i}") for i in range(50)]
    items = [(1, common), (2, common + " z1"), (3, common + " z1 z2 z3 z4")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contained(d, q).collect())) == sorted(brute_contained(docs, items))


def brute_contained(docs, items):
    return [(*r, r[3] / r[2]) for r in brute.contained(docs, items)]


def test_an_item_that_many_documents_hold(spark):
    """One item in a third of all rows, and documents that hold many items."""
    text = " ".join(f"q{i}" for i in range(30))
    docs = [(i, f"{text} tail{i} a b c d" if i % 3 == 0 else f"other{i} words {i} that are not in it") for i in range(900)]
    items = [(k, text) for k in range(5)]
    got = contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, k) for i in range(0, 900, 3) for k in range(5)]


def test_items_under_five_words_inside_documents(spark):
    docs = [(1, "here are Two\nwords of a longer text"), (2, "two  words"), (3, "two other words and two"), (4, "a b c d e"), (5, "x b c d"), (6, "b"), (7, None)]
    items = [(10, "two words"), (11, "b c d"), (12, "b"), (13, "TWO WORDS"), (14, "d a"), (15, ""), (16, "a b c d e")]
    got = sorted(map(tuple, contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()))
    pairs = [(1, 10), (1, 13), (2, 10), (2, 13), (4, 11), (4, 12), (4, 16), (5, 11), (5, 12), (6, 12)]
    assert got == [(d, i, 1, 1, 1.0) for d, i in pairs]


VECTORS = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.1]), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.7, 0.5]), (11, [1e-200, 1e-200]), (12, [float("inf"), 0.0])]


def test_vectors(spark):
    df = spark.createDataFrame([(*v, "x") for v in VECTORS], "vec_id long, embedding array<double>, node string")
    assert sorted(map(tuple, join(df).collect())) == brute.vectors(VECTORS)
    assert join(df.limit(0)).count() == 0
    assert [tuple(r) for r in join(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<float>")).collect()] == [(None, 0, None, False)]


@pytest.mark.parametrize("element", ["double", "float"])
def test_vectors_of_many_lengths(spark, element):
    """Every length is joined: those with many vectors by pivots, the others in a cell each, all in one job."""
    import random

    r = random.Random(6)
    rows = []
    for dim in [1, 2, 3, *range(40, 90)]:
        for _ in range(60 if dim == 3 else 3):
            rows.append((len(rows), [float(r.randrange(-4, 5)) for _ in range(dim)]))
        rows.append((len(rows), [2 * x for x in rows[-1][1]]))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>")
    assert sorted(map(tuple, join(df, cell_rows=10).collect())) == brute.vectors(rows)


def test_vectors_in_many_cells(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").limit(200)
    data = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = sorted(map(tuple, join(spark.createDataFrame(data, "vec_id long, embedding array<float>"), cell_rows=20).collect()))
    assert got == brute.vectors(data)


@pytest.mark.parametrize("structure", [0, 6])
def test_no_group_of_vectors_exceeds_two_chunks(spark, monkeypatch, structure):
    """Without structure nearly every vector is a guest of nearly every cell: guests come in chunks like a cell's own."""
    import numpy as np

    from kgloom.llm import pivots

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) if not structure else rng.normal(size=(structure, 16))[rng.integers(structure, size=1500)] + 0.2 * rng.normal(size=(1500, 16))
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    real, groups = pivots.dealt_cells, []

    def seen(*args):
        dealt = written(real(*args))
        size = {}
        for r in dealt.collect():
            key = (r.dim, r.cell, r.i, r.j)
            size[key] = size.get(key, 0) + int.from_bytes(r.data[:4], "little")
        groups.append(size)
        return dealt

    monkeypatch.setattr(pivots, "dealt_cells", seen)
    got = sorted(map(tuple, join(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), cell_rows=100).collect()))
    assert got == brute.vectors(rows)
    assert max(groups[0].values()) <= 2.6 * 100 and len({k[1] for k in groups[0]}) > 5


def test_the_given_table_goes_through_pivots():
    from kgloom.llm.pivots import pivot_count

    assert [pivot_count(n, 4096, 16_384) for n in (50, 500, 10_000, 10**6, 10**8)] == [1, 5, 25, 250, 16_384]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    from tests.llm.conftest import sentence

    a, b, c = (sentence(60, 400 + i) for i in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, a + " tail", "x"), (3, c, "x"), (3, c, "x"), (None, c, "q"), (None, b, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lo string")
    for parts in (1, 4):
        got = sorted(((r.doc_id, r.text) for r in keep_one(df.repartition(parts)).collect()), key=str)
        texts_ = [t for _, t in got]
        # no text is lost, near copies are one, and what an id-less copy is a copy of stays
        assert sorted(texts_) == sorted({a, b, c}) and (3, c) in got and (2, a + " tail") not in got
        assert len({x for x in got}) == 3
