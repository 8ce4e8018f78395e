import pytest

from kgloom.llm.common import written

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows():
    """Nulls, empty and very long texts, repeated rows, near copies, ties; ids may be missing."""
    base = [sentence(60, i) for i in range(6)]
    near = [b.replace(b.split()[20], "CHANGED") for b in base]
    far = [" ".join(b.split()[:30] + sentence(30, 90 + i).split()) for i, b in enumerate(base)]
    long = sentence(9000, 77)
    texts = [*base, *near, *far, base[0], base[0], base[1].upper(), long, long + " tail words here", None, "", " \t\n", "one", "one", "two words", "a b c d e", "a b c d e f", "é😀 " * 40, "xyz " * 100, "xyz " * 90 + "k", "q" * 5000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    data = [(i, t, "en", f"src{i % 3}", 0 if t is None else len(t), "x", 1) for i, t in rows()]
    # extra columns whose names the operators use themselves
    return written(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, found string, score int").repartition(3))


@pytest.fixture(scope="session")
def repeated(odd):
    return written(odd.union(odd.where("doc_id in (0, 3, 20)")))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
