"""Foreign keys from values, join paths, and the state of conversations over restarts."""

import random

import pytest

from kgloom.operators import relationships as R
from kgloom.streaming import memory as M
from kgloom.streaming import pipelines as P


@pytest.fixture
def shop(spark):
    r = random.Random(3)
    make = spark.createDataFrame
    return {
        "customers": make([(i, f"name {i % 7}", None) for i in range(1, 41)], "id long, name string, note string"),
        "orders": make([(100 + i, r.randrange(1, 41), "4111 1111 1111 1111") for i in range(90)], "id long, customer_id int, card_number string"),
        "order_items": make([(1000 + i, 100 + r.randrange(90), None if i % 9 else 5) for i in range(200)], "id long, order_id long, x int"),
        "texts": make([(1, "x" * 100)], "k int, body string"),
    }


def test_inclusions_equal_those_of_all_pairs(shop):
    columns = {}
    for t, df in shop.items():
        for f in df.schema.fields:
            if not R.SENSITIVE.search(f.name):
                v = [r[0] for r in df.select(f.name).collect() if r[0] is not None]
                if v and max(len(str(x)) for x in v) <= R.LONGEST:
                    columns[t, f.name] = ("n" if not isinstance(v[0], str) else "s", v)
    want = set()
    for a, (ka, va) in columns.items():
        for b, (kb, vb) in columns.items():
            both = {str(x) for x in va} & {str(x) for x in vb}
            if a != b and ka == kb and both:
                want.add((*a, *b, len(set(va)), len(both), len(set(vb)) == len(vb)))
    assert {tuple(r) for r in R.inclusions(shop).collect()} == want


def test_keys_are_found_and_cards_are_not_read(shop):
    got = {r.item_key: (r.status, r.confidence) for r in R.relationships(shop, [("orders", "customer_id", "customers", "id")]).collect()}
    assert got["orders.customer_id->customers.id"] == ("confirmed", 1.0)
    assert got["order_items.order_id->orders.id"] == ("draft", 0.9)
    assert not any("card_number" in k for k in got)


def test_the_way_between_tables(spark, shop):
    rel = R.relationships(shop, [("orders", "customer_id", "customers", "id")])
    got = {(r.a, r.b): (r.cost, r.path) for r in R.join_paths(rel.where("confidence >= 0.9")).collect()}
    assert got["order_items", "customers"] == (2100, "order_items -> orders -> customers")
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.0), ("c", "d", 0.5), ("x", "y", 1.0), ("b", "a", 0.2)]
    got = {(r.a, r.b): (r.cost, r.path) for r in R.join_paths(spark.createDataFrame(edges, "tab string, ref_tab string, confidence double")).collect()}
    assert got["a", "c"] == (2000, "a -> b -> c") or got["a", "c"] == (2000, "a -> c")
    assert got["a", "d"][0] == 3500 and ("a", "x") not in got and got["y", "x"] == (1000, "y -> x")


def test_a_pin_counts_down_and_is_replaced():
    m = M.Memory(turns=3)
    m.take("pick", "sales")
    assert [m.current() for _ in range(4)] == ["sales"] * 3 + [None]
    m.take("pick", "a")
    assert m.current() == "a"
    m.take("pick", "b")
    assert [m.current() for _ in range(4)] == ["b"] * 3 + [None]


def test_memory_is_bounded_and_asked_for():
    m = M.Memory(most=4)
    for i in range(9):
        m.take(str(i), None)
    assert m.said == ["5", "6", "7", "8"] and m.context(2) == ["7", "8"] and m.context(99) == m.said and m.context(0) == []


def test_state_lives_over_restarts(spark, tmp_path):
    """Three runs over parts of long conversations; every message sees what came before it in earlier runs."""
    r = random.Random(5)
    rows = [(c, t, f"m{c}.{t}", r.choice([None, 0, 5, 50]), r.choice([None, None, None, f"d{t}"])) for c in (1, 2, None) for t in range(60)]
    df = spark.createDataFrame(rows, "conv long, turn int, message string, asked int, choice string")
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    M.in_runs(spark, df, "turn", path, 3, lambda: P.run_once(M.remembering(P.files(spark, path, df), "conv", ["turn"], "message", "asked", "choice"), out, ck))
    got = {(x.conv, x.turn): (x.context, x.pinned) for x in spark.read.parquet(out).collect()}
    for c in (1, 2, None):
        m = M.Memory()
        for _, t, text, asked, choice in sorted((x for x in rows if x[0] == c), key=lambda x: x[1]):
            assert got[c, t] == ("\n".join(m.context(10 if asked is None else asked)), m.current()), (c, t)
            m.take(text, choice)
    assert len(got) == 180
