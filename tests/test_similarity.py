"""Vector joins and the list index against plain products."""

import numpy as np
import pytest

from kgloom.operators import similarity as S

SCHEMA = "id long, v array<double>"


def rows(x):
    return [(i, [float(f) for f in v]) for i, v in enumerate(x)]


def clustered(n, centres, dim, spread, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dim))[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))


def plain_pairs(data, threshold):
    out = set()
    for i, a in data:
        for j, b in data:
            if i < j and a and b and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                size = np.linalg.norm(x) * np.linalg.norm(y)
                if size > 0 and (x @ y / size + 1) / 2 >= threshold:
                    out.add((i, j))
    return out


@pytest.mark.parametrize(("x", "threshold"), [(clustered(300, 12, 16, 0.3), 0.9), (np.random.default_rng(2).normal(size=(300, 8)), 0.8), (clustered(200, 3, 4, 0.01), 0.97), (clustered(150, 5, 6, 0.5), 0.3)])
def test_joins_equal_all_products(spark, x, threshold):
    data = rows(x)
    got = S.pairs_above(spark.createDataFrame(data, SCHEMA).repartition(3), "id", "v", threshold, block_rows=40).collect()
    pairs = [(r.a, r.b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_pairs(data, threshold)
    for r in got[:50]:
        a, b = x[r.a], x[r.b]
        assert abs(r.similarity - (a @ b / np.linalg.norm(a) / np.linalg.norm(b) + 1) / 2) < 1e-9


def test_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 1.0]), (10, [-1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(data, SCHEMA)
    assert {(r.a, r.b) for r in S.pairs_above(df, "id", "v", 0.9).collect()} == {(1, 2)}
    assert S.pairs_above(df.limit(0), "id", "v", 0.9).count() == 0
    assert S.best_pairs(df.limit(0), "id", "v", 0.9, 5).count() == 0


def test_clusters_are_not_all_compared(spark):
    """Vectors in 40 clusters: the two bounds leave a small part of all pairs."""
    x = clustered(2000, 40, 32, 0.1)
    df = spark.createDataFrame(rows(x), SCHEMA)
    used = S.usable(df, "id", "v")
    parts = S.dealt(used, S.trained(used), 0.8, 512)
    n = sum(r.pairs for r in S.compared(parts).collect())
    assert n < 0.2 * 2000 * 1999 / 2, n / (2000 * 1999 / 2)
    near = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    assert S.matches(parts, 0.8).count() == int((np.triu(near, 1) >= 0.8).sum())


@pytest.mark.parametrize("most", [10, 400, 10**6])
def test_the_best_pairs_are_the_best_of_all(spark, most):
    data = rows(clustered(250, 10, 12, 0.3, seed=4))
    df = spark.createDataFrame(data, SCHEMA)
    unit = np.stack([np.array(v) / np.linalg.norm(v) for _, v in data])
    sim = (unit @ unit.T + 1) / 2
    every = sorted((-round(sim[i, j], 9), i, j) for i in range(250) for j in range(i + 1, 250) if sim[i, j] >= 0.7)
    got = [(r.a, r.b) for r in S.best_pairs(df, "id", "v", 0.7, most, block_rows=64).collect()]
    assert got == [(i, j) for _, i, j in every[:most]]


def test_nine_of_ten_neighbours_from_a_quarter_of_the_lists(spark):
    x = clustered(4000, 60, 24, 0.35, seed=6)
    df = spark.createDataFrame(rows(x), SCHEMA)
    index = S.ListIndex(df, "id", "v")
    (lists,) = [len(c) for c in index.centres.values()]
    assert lists == 63
    asked = df.where("id % 100 = 0").selectExpr("id AS query", "v AS q")
    found = {}
    for r in index.search(asked, 10, lists // 4).collect():
        found.setdefault(r.query, []).append(r.id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = sum(len(set(np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist()) & set(found[q])) for q in found)
    assert len(found) == 40 and hits >= 0.9 * 400
    read = index.rows.groupBy("list").count().collect()
    assert max(r["count"] for r in read) < 0.2 * 4000
    index.drop()


def test_every_list_finds_what_an_exact_search_finds(spark):
    x = clustered(300, 9, 7, 0.4, seed=7)
    df = spark.createDataFrame(rows(x), SCHEMA)
    index = S.ListIndex(df, "id", "v", parts=3, codes=16)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = [r.id for r in index.search(df.where("id = 5").selectExpr("id AS query", "v AS q"), 6, 99, again=60).orderBy("similarity").collect()][::-1]
    assert got == np.argsort(-(unit @ unit[5]), kind="stable")[:6].tolist()
