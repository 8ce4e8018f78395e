"""Merge plans, node merges, reduction of edges and rule layers against plain versions."""

import random
from collections import defaultdict

from kgloom.operators import graph as G
from kgloom.operators import ontology as T
from kgloom.operators import resolve as R

PAIRS = "keep long, dup long, score double"


def plain_plan(pairs):
    """All at once: (keep, dup, score) in order of the score, then keep and dup."""
    gone, out = set(), []
    for score, keep, dup in sorted((-s, k, d) for k, d, s in pairs if k != d):
        if keep not in gone and dup not in gone:
            gone.add(dup)
            out.append((keep, dup, -score))
    return out


def test_plans_equal_the_sequence_on_ten_thousand_lists(spark):
    """Lists of pairs over few nodes, with ties and repeated pairs, each over ids of its own."""
    r = random.Random(4)
    rows = []
    for i in range(10_000):
        n = r.choice([2, 3, 5, 8])
        rows += [(100 * i + r.randrange(n), 100 * i + r.randrange(n), float(r.choice([60, 70, 80, 90, 95]))) for _ in range(r.randrange(1, 9))]
    best = {}
    for k, d, s in rows:
        best[k, d] = max(s, best.get((k, d), s))
    got = sorted((x.keep, x.dup, x.score) for x in R.merge_plan(spark.createDataFrame(rows, PAIRS)).collect())
    assert got == sorted(plain_plan([(k, d, s) for (k, d), s in best.items()]))


def test_a_chain_of_pairs_needs_the_order(spark):
    """Each pair deletes what the next one would keep: every second one is applied, however long the chain."""
    rows = [(i + 1, i, 100.0 - i) for i in range(24)]
    assert sorted((x.keep, x.dup, x.score) for x in R.merge_plan(spark.createDataFrame(rows, PAIRS)).collect()) == sorted(plain_plan(rows))
    rows = [(i, i + 1, 100.0 - i) for i in range(24)]
    assert sorted((x.keep, x.dup, x.score) for x in R.merge_plan(spark.createDataFrame(rows, PAIRS)).collect()) == sorted(plain_plan(rows))


def test_one_node_in_all_pairs(spark):
    rows = [(0, i, float(i % 7)) for i in range(1, 500)] + [(1000, 0, 3.5)]
    assert sorted((x.keep, x.dup, x.score) for x in R.merge_plan(spark.createDataFrame(rows, PAIRS)).collect()) == sorted(plain_plan(rows))
    assert R.merge_plan(spark.createDataFrame([], PAIRS)).count() == 0


def plain_merge(nodes, edges, plan, props, rel_props):
    """Nodes {id: {name, aliases, labels, ...}} and edges [(src, dst, rel, {...})], one merge after the other."""
    nodes = {i: {**n, "aliases": list(n["aliases"] or []), "labels": set(n["labels"] or [])} for i, n in nodes.items()}
    into = {}
    for _, dup, keep in sorted((at, d, k) for d, k, at in plan):
        a, b = nodes[keep], nodes.pop(dup)
        for p in props:
            a[p] = b[p] if a[p] is None else a[p]
        for name in [b["name"], *b["aliases"]]:
            if name and name != a["name"] and name not in a["aliases"]:
                a["aliases"].append(name)
        a["labels"] |= b["labels"]
        into[dup] = keep

    def root(i):
        while i in into:
            i = into[i]
        return i

    at = {d: t for d, _, t in plan}

    def path(i):
        out = []
        while i in into:
            out.append(at[i])
            i = into[i]
        return out[::-1]

    alike = defaultdict(list)
    for s, d, rel, p in edges:
        if root(s) != root(d) or s == d:
            alike[root(s), root(d), rel].append((path(s), path(d), s, d, p))
    out = {}
    for key, found in alike.items():
        found.sort(key=lambda x: x[:4])
        out[key] = (len(found), *[next((x[4][p] for x in found if x[4][p] is not None), None) for p in rel_props])
    return nodes, out


def test_nodes_merge_as_one_after_the_other(spark):
    r = random.Random(9)
    nodes = {i: {"name": f"n{i % 37}", "a": r.choice([None, i]), "b": r.choice([None, None, f"b{i}"]), "aliases": r.choice([None, [], [f"x{i % 11}", f"n{i % 5}"], [f"y{i}"]]), "labels": r.choice([None, ["L"], ["L", f"M{i % 3}"]])} for i in range(120)}
    alive, plan = list(nodes), []
    for at in range(80):  # chains: what was merged into may be merged itself later on
        dup = alive.pop(r.randrange(len(alive)))
        plan.append((dup, r.choice(alive[:25]), at))
    edges = list({(r.randrange(120), r.randrange(120), r.choice("RS")): None for _ in range(600)})
    edges = [(*e, {"w": r.choice([None, float(k)])}) for k, e in enumerate(edges)]
    want_nodes, want_edges = plain_merge(nodes, edges, plan, ["a", "b"], ["w"])
    n = spark.createDataFrame([(i, x["name"], x["a"], x["b"], x["aliases"], x["labels"]) for i, x in nodes.items()], "id long, name string, a long, b string, aliases array<string>, labels array<string>")
    e = spark.createDataFrame([(s, d, rel, p["w"]) for s, d, rel, p in edges], "src long, dst long, rel string, w double")
    got_nodes, got_edges = G.merge_nodes(n, e, spark.createDataFrame(plan, "dup long, keep long, at long"), ["a", "b"], ["w"])
    got = {x.id: x for x in got_nodes.collect()}
    assert set(got) == set(want_nodes)
    for i, x in want_nodes.items():
        assert (got[i].name, got[i].a, got[i].b, got[i].aliases, set(got[i].labels)) == (x["name"], x["a"], x["b"], x["aliases"], x["labels"]), i
    assert {(x.src, x.dst, x.rel): (x.edges, x.w) for x in got_edges.collect()} == want_edges


def test_a_plan_merges_what_it_names(spark):
    """The plan of scored pairs and the merge take each other's columns."""
    pairs = [(1, 2, 90.0), (2, 3, 95.0), (4, 1, 80.0), (5, 2, 70.0)]
    plan = R.merge_plan(spark.createDataFrame(pairs, PAIRS))
    n = spark.createDataFrame([(i, f"n{i}", None if i in (1, 4) else i) for i in range(1, 6)], "id long, name string, a long").selectExpr("*", "cast(null as array<string>) AS aliases", "array('x') AS labels")
    e = spark.createDataFrame([(3, 5, "R"), (4, 5, "R"), (2, 1, "S")], "src long, dst long, rel string")
    nodes, edges = G.merge_nodes(n, e, plan.select("dup", "keep", "at"), ["a"])
    # 3 goes into 2, 2 into 1, 1 into 4
    assert [(x.id, x.a, x.aliases) for x in nodes.orderBy("id").collect()] == [(4, 2, ["n1", "n2", "n3"]), (5, 5, [])]
    assert [(x.src, x.dst, x.rel, x.edges) for x in edges.collect()] == [(4, 5, "R", 2)]


def test_same_names(spark):
    rows = [(1, "Ann", 5), (2, " ann ", 9), (3, "ANN", 9), (4, "", 1), (5, None, 1), (6, "bob", 2)]
    nodes = spark.createDataFrame(rows, "id long, name string, weight long")
    assert sorted(tuple(x) for x in R.same_names(nodes).collect()) == [(2, 1), (2, 3)]
    from pyspark.sql import functions as F

    assert sorted(tuple(x) for x in R.same_names(nodes, F.col("dup_id") == 3).collect()) == [(2, 1)]


def plain_reduced(edges):
    out = set()
    for u, v, rel in edges:
        nxt = lambda x: {b for a, b, t in edges if a == x and t == rel and b != x}
        gone = u != v and any(x not in (u, v) and (v in nxt(x) or any(y not in (u, v, x) and v in nxt(y) for y in nxt(x))) for x in nxt(u))
        if not gone:
            out.add((u, v, rel))
    return out


def test_reduction_of_random_edges(spark):
    for seed, n, k in ((1, 12, 30), (2, 9, 50), (3, 40, 60), (4, 6, 36)):
        r = random.Random(seed)
        edges = {(r.randrange(n), r.randrange(n), r.choice("ab")) for _ in range(k)} | {(0, i, "a") for i in range(n)}  # with a hub
        got = {tuple(x) for x in G.reduced(spark.createDataFrame(list(edges), "src long, dst long, rel string")).select("src", "dst", "rel").collect()}
        assert got == plain_reduced(edges)


def plain_closure(facts):
    facts = set(facts)
    while True:
        new = set()
        of = lambda p, facts=facts: [(s, o) for s, q, o in facts if q == p]
        for p in ("subClassOf", "subPropertyOf"):
            new |= {(a, p, d) for a, b in of(p) for c, d in of(p) if b == c and a != d}
        for s, p, o in facts:
            new |= {(s, q, o) for x, q in of("subPropertyOf") if x == p and q != p} | {(s, "type", c) for x, c in of("domain") if x == p} | {(o, "type", c) for x, c in of("range") if x == p}
            new |= {(o, q, s) for x, q in of("inverseOf") if x == p} | {(o, q, s) for q, x in of("inverseOf") if x == p}
            if p == "type":
                new |= {(s, p, c) for x, c in of("subClassOf") if x == o and c != o}
            if (p, "type", "TransitiveProperty") in facts:
                new |= {(s, p, z) for x, z in of(p) if x == o}
        if new <= facts:
            return facts
        facts |= new


def test_closure_of_random_schemas(spark):
    for seed in range(3):
        r = random.Random(seed)
        classes, props, things = [f"C{i}" for i in range(6)], [f"p{i}" for i in range(5)], [f"t{i}" for i in range(9)]
        facts = {(r.choice(classes), "subClassOf", r.choice(classes)) for _ in range(6)} | {(r.choice(props), "subPropertyOf", r.choice(props)) for _ in range(4)}
        facts |= {(r.choice(props), "domain", r.choice(classes)), (r.choice(props), "range", r.choice(classes)), (r.choice(props), "inverseOf", r.choice(props)), (r.choice(props), "type", "TransitiveProperty")}
        facts |= {(r.choice(things), r.choice(props), r.choice(things)) for _ in range(14)} | {(r.choice(things), "type", r.choice(classes)) for _ in range(4)}
        facts = {f for f in facts if not (f[1] in ("subClassOf", "subPropertyOf") and f[0] == f[2])}
        got = {tuple(x) for x in T.consequences(spark.createDataFrame([*facts, (None, "p0", "x")], "s string, p string, o string")).collect()}
        assert got == plain_closure(facts)


def test_routes_rules_and_reasons(spark):
    rows = [
        ("relationship", "WORKS_FOR", "alice", "PERSON", "google", "ORGANIZATION", None, 0, 0),
        ("relationship", "EATS", "cat", "ANIMAL", "fish", "FOOD", None, 0, 0),
        ("relationship", "RELATES_TO", "a", "CONCEPT", "b", "CONCEPT", None, 0, 0),
        ("relationship", "WORKS_FOR", "", "PERSON", "google", "ORGANIZATION", None, 0, 0),
        ("relationship", "ACQUISITION", "a", "PERSON", "b", "PRODUCT", None, 0, 1),
        ("relationship", "MEETING", "a", "PERSON", "b", "PERSON", "standup", 3, 0),
        ("event", "x", None, None, None, None, "Empty Event", 0, 0),
        ("event", None, "nameless", None, None, None, "", 1, 0),
        (None, None, None, None, None, None, None, None, None),
    ]
    facts = spark.createDataFrame(rows, "mode string, predicate string, subject string, subject_type string, object string, object_type string, event_name string, n_participants int, n_attributes int")
    matrix = spark.createDataFrame([("PERSON", "WORKS_FOR", "ORGANIZATION"), ("CONCEPT", "RELATES_TO", "CONCEPT")], "subject_type string, predicate string, object_type string")
    got = {(r.predicate, r.subject, r.event_name): (r.mode, r.reason) for r in T.enforced(T.routed(facts), matrix).collect()}
    assert got[("WORKS_FOR", "alice", None)] == ("relationship", None)
    assert got[("EATS", "cat", None)] == ("relationship", "OWL rule violation: ANIMAL -[EATS]-> FOOD")
    assert got[("RELATES_TO", "a", None)] == ("relationship", None)
    assert got[("WORKS_FOR", "", None)][1] == "empty subject, predicate or object"
    assert got[("ACQUISITION", "a", "ACQUISITION")] == ("event", None)
    assert got[("MEETING", "a", "standup")] == ("event", None)
    assert got[("x", None, "Empty Event")] == ("event", "event with no participants or attributes")
    assert got[(None, "nameless", None)] == ("event", "event without a name")
    assert got[(None, None, None)] == ("relationship", "empty subject, predicate or object")
    assert {r.reason for r in T.enforced(T.routed(facts), matrix, strict=False).where("predicate = 'EATS'").collect()} == {None}
