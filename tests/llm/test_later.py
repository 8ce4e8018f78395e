"""Conversations, phrases and passages against plain versions, and on odd tables."""

import os
import random

import duckdb
import pytest

from kgloom.llm.common import follow, written
from kgloom.llm.debruijn import SQL as PASSAGES_SQL
from kgloom.llm.debruijn import paths, remove_repeats, texts_of
from kgloom.llm.entries import QUERIES
from kgloom.llm.phrases import SQL as PHRASES_SQL
from kgloom.llm.phrases import collocations, ranked
from kgloom.llm.tries import SQL as CONVERSATIONS_SQL
from kgloom.llm.tries import prefix_trie, rebuilt, turns_in_order
from tests.llm import brute
from tests.llm.conftest import rows, sentence

SF = "/root/testdata/sf0.001"
tuples = lambda df: sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("name", "sql"), [("op11_conversations", CONVERSATIONS_SQL), ("op12_phrases", PHRASES_SQL), ("op13_passages", PASSAGES_SQL)])
def test_queries_agree_with_sql(spark, name, sql):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    out = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(out.columns)
    assert tuples(out.select(*columns)) == sorted(want.fetchall(), key=str)


# ------------------------------------------------------------- conversations

TURNS = "conv_id long, turn long, role string, text string, depth string, n int"


def table(spark, data):
    return spark.createDataFrame([(*x, "x", 1) for x in data], TURNS).repartition(5)


def trie_of(spark, data, chunk, stretch=2):
    turns, counts, _ = turns_in_order(table(spark, data))
    return tuples(prefix_trie(*rebuilt(written(turns), written(counts)), chunk=chunk, stretch=stretch))


def conversations(seed, n):
    """Conversations that begin alike in many ways; nulls, ties, repeated rows, a long one and its copies."""
    r, out = random.Random(seed), []
    for c in range(n):
        source = r.choice([c, 5, 100, c // 7])
        size = r.choice([0, 1, 2, 3, 6, 9])
        for t in range(size):
            out.append((c, t, r.choice(["user", "user", None]), f"t{t} {source if r.random() < 0.8 else c}" if r.random() < 0.9 else r.choice([None, "", "é😀"])))
    out += [(7, None, "user", "no turn"), (7, None, None, None), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "bot", "tie"), (None, 1, "user", "nobody")]
    for c in (300, 301, 302, 311):
        out += [(c, t, "user", f"long {t}") for t in range(40 if c < 311 else 25)]
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 4096), (2, 3)])
def test_trie_equals_the_plain_one(spark, seed, chunk):
    data = conversations(seed, 240)
    assert trie_of(spark, data, chunk) == brute.trie(brute.rebuild(data))


def test_trie_of_nested_conversations(spark):
    """A path of many chains with many that hang from it: each conversation goes on where the one before ends."""
    data = [(c, t, "user", f"n{t}" if t < c or c % 3 else f"own {c} {t}") for c in range(60) for t in range(c + 1)]
    turns, counts, _ = turns_in_order(table(spark, data))
    plain = {c: [("user", x) for i, t, _, x in sorted(data) if i == c] for c in range(60)}
    assert tuples(prefix_trie(turns, counts, chunk=4)) == brute.trie(plain)


def test_trie_of_nothing(spark):
    assert trie_of(spark, [], 4096) == []
    assert trie_of(spark, [(None, 1, "user", "x")], 4096) == []


def test_rebuilt_conversations_may_have_no_turns(spark):
    """Number 3 of an absent base whose own turns all fall away is in the root only."""
    import zlib

    c = next(c for c in range(501, 600) if zlib.crc32(str(c).encode()) % 6 == 4)
    data = [(c, t, "user", f"x{t}") for t in range(3)]
    assert trie_of(spark, data, 4096) == brute.trie({c: []})


def test_pointers_that_run_in_a_circle_do_not_end(spark):
    data = [(1, None, 0), (2, 1, 5), (3, 2, 5), (10, 11, 1), (11, 10, 1)]
    got = {r.k: (r.head, r.offset, r.ended) for r in follow(spark.createDataFrame(data, "k long, to long, d long"), "k").collect()}
    assert got[1] == (1, 0, True) and got[2] == (1, 5, True) and got[3] == (1, 10, True)
    assert not got[10][2] and not got[11][2]


# ------------------------------------------------------------------ phrases


def spoken(seed, n):
    r = random.Random(seed)
    words = ["the", "House", "of", "é", "red-ish", "a", "b", "THE"]
    out = [(r.choice(["en", "de", None, ""]), "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "? "]) for _ in range(r.randrange(90)))) for _ in range(n)]
    out += [("en", None), ("en", ""), (None, "a a a a a a a a a a a a a a"), ("de", "x y z " * 900), ("de", "no break " * 40), ("en", ".,;:!?"), (None, "İstanbul x. " * 12)]
    return out


@pytest.mark.parametrize(("size", "share", "longest"), [(1 << 19, 50, 3), (32, 50, 3), (40, 90, 4), (24, 100, 2)])
def test_phrases_equal_plain_counts(spark, size, share, longest):
    data = spoken(4, 60)
    docs = spark.createDataFrame([(*x, 1, "w") for x in data], "lang string, text string, h1 int, word string").repartition(3)
    got = ranked(collocations(docs, size=size, share=share, longest=longest), 50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert tuples(got) == sorted(brute.phrases(data, longest=longest, share=share, top=50), key=str)


def test_phrases_of_the_odd_table(spark, odd, repeated, none):
    for docs in (odd, repeated):
        data = [(r.lang, r.text) for r in docs.collect()]
        got = ranked(collocations(docs, least=3), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert tuples(got) == sorted(brute.phrases(data, least=3), key=str)
    assert collocations(none).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    """a*a * 1000000 passes 64 bits from 3.04 million occurrences on; the arithmetic is that of ``collocations``."""
    a, left, right = 9_999_999_999_999, 10_000_000_000_003, 12_345_678_901_234
    e = "(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    assert spark.sql(f"SELECT {e} AS s FROM VALUES ({a}L, {left}L, {right}L) AS t(a, l, r)").first().s == 1000000 * a * a // (left * right)


# ----------------------------------------------------------------- passages


def shared_texts(seed, n):
    """Texts made of a few passages, some of them common, some periodic; many cut short."""
    r = random.Random(seed)
    stock = [sentence(r.randrange(20, 90), 1000 + i) for i in range(6)] + ["x y " * 60, "z " * 80]
    out = []
    for i in range(n):
        parts = [r.choice(stock) if r.random() < 0.7 else sentence(r.randrange(60), seed * 1000 + i) for _ in range(r.randrange(5))]
        text = r.choice([" ", "  ", "\n"]).join(parts)
        out.append((i - 3, " ".join(text.split()[r.randrange(9) :]) if r.random() < 0.5 else text))
    return out + [(None, out[5][1]), (4, out[6][1]), (4, out[7][1]), (2, None), (3, ""), (100, out[8][1]), (100, out[8][1])]


@pytest.mark.parametrize(("bits", "seed", "hot"), [(64, 1, 1 << 15), (64, 2, 30), (9, 3, 1 << 15), (9, 4, 30)])
def test_passages_equal_plain_removal(spark, bits, seed, hot):
    """With 9 bits most windows share a hash with others: what is compared decides. Runs with one hash meet by edge beyond ``hot``."""
    data = shared_texts(seed, 40)
    docs = spark.createDataFrame([(*x, 1, "p") for x in data], "doc_id long, text string, n int, path string").repartition(3)
    assert tuples(remove_repeats(docs, bits=bits, hot_edges=hot)) == brute.passages(data)


def test_small_windows(spark):
    data = shared_texts(5, 30)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert tuples(remove_repeats(docs, width=7, gram=3)) == brute.passages(data, 7)


def test_passages_of_the_odd_table(spark, odd, repeated, none):
    assert tuples(remove_repeats(odd)) == brute.passages(rows())
    assert tuples(remove_repeats(repeated)) == brute.passages([(r.doc_id, r.text) for r in repeated.collect()])
    assert remove_repeats(none).count() == 0


def test_a_repeated_text_is_one_path(spark):
    """Compaction joins what doesn't branch: a text of 3,000 words and its copies are one path, cut where a third text leaves it."""
    long = sentence(3000, 8)
    other = " ".join(long.split()[:500] + sentence(200, 9).split())
    docs = spark.createDataFrame([(1, long), (2, "before " + long), (3, other)], "doc_id long, text string")
    got = sorted((r.doc, r.first, r.n) for r in paths(texts_of(docs, "text", "doc_id"))[0].collect())
    assert got == [(1, 0, 451), (1, 451, 2500), (2, 1, 451), (2, 452, 2500), (3, 0, 451)]
