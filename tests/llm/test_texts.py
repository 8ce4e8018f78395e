"""Operators on single documents against plain versions, round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import language, licenses, packing, pii, quality, sharding, substrings, suffixes
from tests.llm import brute


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ shards


def test_shards(spark, repeated, none):
    text = F.coalesce("text", F.lit(""))
    out = sharding.shard(repeated, "doc_id", shards=4, vnodes=16, columns={"size": F.octet_length(text)}).collect()
    n = repeated.count()
    sizes = Counter(r.shard for r in out)
    assert len(out) == n and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sharding.shard(none, "doc_id").count() == 0


def test_one_key_with_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("k"))
    sizes = Counter(r.shard for r in sharding.shard(df, "k").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("epsilon,most,most_between_old", [(0.0, 0.16, 0.05), (0.25, 0.14, 0.02)])
def test_a_ninth_shard_moves_little(spark, epsilon, most, most_between_old):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    old, new = ({r.k: r.shard for r in sharding.shard(df, "k", shards=s, epsilon=epsilon).collect()} for s in (8, 9))
    assert sum(old[k] != new[k] for k in old) <= most * len(old)
    assert sum(old[k] != new[k] != 8 for k in old) <= most_between_old * len(old)
    sizes = Counter(new.values())
    assert max(sizes.values()) <= (1 + epsilon) * len(old) / 9 + 1


def test_shards_follow_from_the_rows_and_not_from_their_files(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 5).alias("v"))
    place = lambda d: Counter((r.k, r.v, r.shard, r.slot) for r in sharding.shard(d, "k", columns={"v": F.col("v")}).collect())
    assert place(df.repartition(3)) == place(df.orderBy(F.desc("v"), F.rand(3)).repartition(7))


# ------------------------------------------------------------------ packing


def test_packing(spark, repeated, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(repeated).collect()
    expected = Counter()
    for i, t in texts(repeated):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            expected[i, p, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in out) // 2048) + 3
    assert packing.pack(none).count() == 0


def test_tokenizer_is_the_library_s():
    import random

    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, own = Tokenizer.from_file(path), packing.WordTokenizer(path, chunks_kept=50)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for part in (every[i : i + 4000] for i in range(0, len(every), 4000)):
        texts_ = [f"a{c}b {c}{c}1" for c in part]
        assert [np.frombuffer(own.encode(x), "<u4").tolist() for x in texts_] == [e.ids for e in tok.encode_batch(texts_, add_special_tokens=False)]
    letters = [chr(c) for c in range(0x250)] + ["\u0558", "\u0c5c"] + list("̀́İſẞΣ　 一٠½Ⅰ​") + ["'s", " ", "<|endoftext|>", "<|"] * 20
    random.seed(4)
    for _ in range(1500):
        x = "".join(random.choices(letters, k=25))
        assert np.frombuffer(own.encode(x), "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("low,high", [(1, 300), (300, 1200), (900, 1100), (1, 2049)])
def test_plan_is_dense(low, high):
    rng = np.random.default_rng(0)
    lengths = rng.integers(low, high, 4000)
    h = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    fill, placed = Counter(), Counter()
    for length, lo, hi, first, each, offset in packing.plan(h):
        for r in range(hi - lo):
            fill[first + r // each] += length
        placed[length] += hi - lo
    assert dict(placed) == h and max(fill.values()) <= 2048
    if high <= 300:
        assert len(fill) <= -(-lengths.sum() // 2048) * 1.02 + 1


# ------------------------------------------------------------- suffix arrays


def test_suffix_array_and_prefixes(monkeypatch):
    import random

    random.seed(3)
    for k in range(300):
        most = random.choice([1, 2, 9, 2000])
        t = np.array([random.randint(1, most) for _ in range(random.randint(1, 50))] + [0])
        if k % 3 == 0:
            t = np.concatenate([t[:-1], t[:-1], t])
        # all ways to induce, at every depth of the recursion
        monkeypatch.setattr(suffixes, "FEW_CHARACTERS", random.choice([0, 4096]))
        monkeypatch.setattr(suffixes, "LONG_RUNS", random.choice([0, 4096]))
        sa = suffixes.suffix_array(t)
        expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == expected
        starts = np.array(sorted(random.sample(range(len(t)), min(3, len(t)))))
        p = suffixes.permuted_common_prefixes(t, sa, 5, random.choice([None, starts]))
        for x, y in zip(expected[1:], expected[:-1], strict=True):
            k = 0
            while k < 5 and max(x, y) + k < len(t) and t[x + k] == t[y + k]:
                k += 1
            assert p[x] == k


@pytest.mark.parametrize("width,gram", [(200, 40), (30, 8)])
def test_repeated_passages(spark, repeated, width, gram):
    got = sorted((tuple(r)[:5] for r in substrings.repeated_spans(repeated, width, gram, buckets=4).collect()), key=str)
    assert got == brute.substrings(texts(repeated), width)


def test_suffix_array_of_a_long_string_with_many_names():
    """More than 1024 names, so strings of names are sorted by the same recursion, several times over."""
    rng = np.random.default_rng(4)
    part = rng.integers(1, 200, 9000)
    t = np.concatenate([part, rng.integers(1, 200, 20_000), part[:7000], np.tile([7, 3, 9], 900), part, [0]])
    sa = suffixes.suffix_array(t)
    raw = bytes(t.astype(np.uint8))
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    p = suffixes.permuted_common_prefixes(t, sa, 200)
    for i in range(1, len(sa), 97):
        x, y = raw[sa[i] : sa[i] + 200], raw[sa[i - 1] : sa[i - 1] + 200]
        assert p[sa[i]] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("hot_segments,hot_bytes", [(3, 1 << 30), (4096, 100), (4096, 1500)])
def test_a_passage_in_many_documents_is_counted_by_windows(spark, repeated, monkeypatch, hot_segments, hot_bytes):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot_segments)
    monkeypatch.setattr(substrings, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(substrings, "RUN", 700)
    passage = " ".join(f"passage{i}" for i in range(20))
    extra = spark.createDataFrame([(100 + i, f"{'é' * (i % 7)} start{i * 7919} {passage} end{i * 104729} {'z' * i}") for i in range(40)], "doc_id long, text string")
    rows = repeated.select("doc_id", "text").union(extra)
    got = sorted((tuple(r)[:5] for r in substrings.repeated_spans(rows.repartition(2), 60, 12, buckets=3).collect()), key=str)
    assert got == brute.substrings(texts(rows), 60)


def test_repeated_passages_of_nothing(spark, none):
    assert substrings.repeated_spans(none, buckets=2).count() == 0


# ------------------------------------------------------------ personal data

CASES = [None, "", "a@b.com_foo@bar.com x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0255.000001.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111111111", "+1 (555) 123-4567+44 20 7946 0958 +1", "é+33 1 23 45 67 89é 😀a.b@c-d.e.f😀 x", "9" * 30000, "a" * 50000 + "@b.c", "a@b" * 3000, "+1" * 5000, "1." * 20000, "mail joe@example.com or +49 30 1234567, host 10.0.0.1, card 4111111111111111"]


def spans(row):
    return [(x.start, brute.KINDS.index(x.kind), x.end) for x in row.found if x.base]


def test_personal_data(spark, odd, none):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, found string")
    for r in pii.find(df, ["doc_id", "text"]).collect():
        assert spans(r) == brute.personal(r.text)
    assert pii.find(none, ["doc_id"]).count() == 0
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[12] == "mail [EMAIL] or [PHONE], host [IP], card [CARD]" and out[0] is None and out[1] == ""
    assert pii.redact(odd).columns == odd.columns


def test_many_matches_in_one_text(spark, monkeypatch):
    """Results don't depend on stretches, and time follows the matches."""
    import time

    text = lambda n: " ".join(f"mail{i}@ex.com 10.0.{i % 256}.1 555-123-{1000 + i % 9000} a{i} at b dot com" for i in range(n))
    took = {}
    for n in (1000, 2000, 8000):
        began = time.time()
        row = pii.find(spark.createDataFrame([(1, text(n))], "doc_id long, text string"), ["doc_id", "text"]).collect()[0]
        took[n] = time.time() - began
        assert spans(row) == brute.personal(row.text)
    assert took[8000] < 8 * took[2000] + 5
    df = spark.createDataFrame([(i, text(i)) for i in (0, 1, 255, 256, 257, 600)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i in (255, 256, 257, 600):
        assert out[i].count("[EMAIL]") >= i and out[i].count("[IP]") == i and not brute.personal(out[i])
        assert out[i].split(" ")[0] == "[EMAIL]" and out[i].split(" ")[1] == "[IP]"
    monkeypatch.setattr(pii, "STRETCH", 3)
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == out


def test_personal_data_plan_has_no_python(spark, odd):
    plan = pii.find(odd, ["doc_id"])._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_labelers_are_weighed():
    rows = [{"kind": "phone", "strict": s, "checksum": 0, "gazetteer": g, "context": c, "n": n, "source": "phone" if s > 0 else "digits", "size": 2, "spaced": 1} for s, g, c, n in ((1, 1, 1, 50), (1, 1, 0, 100), (-1, 0, -1, 80), (-1, 0, 0, 20))]
    learned, posterior = pii.reliabilities(rows)
    assert posterior[0] > 0.9 and posterior[2] < 0.1
    weights = pii.train(rows, posterior)
    assert weights["source", "phone"] > weights["source", "digits"]


# ---------------------------------------------------------------- licenses


def test_licenses(spark, none):
    t = licenses.TEMPLATES
    docs = [(1, "Intro text.\n" + t["MIT"] + " More words follow."), (2, t["GPL-3.0"].replace("version 3", "version 2")), (3, "licensed UNDER the apache license version 2.0"), (4, "No license is named here."), (5, None), (6, ""), (7, t["CC-BY-NC-4.0"] + " " + t["all-rights-reserved"]), (8, "word " * 20000 + t["MIT"]), (8, "Lichen grows")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license) for r in licenses.notices(df).collect())
    assert got == [(1, "MIT"), (2, "GPL-2.0"), (3, "Apache-2.0"), (7, "CC-BY-NC-4.0"), (7, "all-rights-reserved"), (8, "MIT")]
    for r in licenses.notices(df.where("doc_id = 1")).collect():
        assert docs[0][1][r.start : r.end] == "Released under the MIT License"
    assert licenses.notices(none).count() == 0


def test_licenses_over_lines_and_without_a_mention(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\n'
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    docs = [(1, "Intro.\nThis work is licensed under the GNU\nGeneral Public License, version 3.\nMore."), (2, "x " * 700 + mit), (3, bsd), (4, gpl), (5, "Permission is hereby\ngranted.\nRedistribution and use are not."), (6, "All rights\n * reserved.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.license) for r in licenses.notices(df).collect())
    assert got == [(1, "GPL-3.0"), (2, "MIT-grant"), (3, "BSD-grant"), (4, "LGPL-3.0-or-later"), (6, "all-rights-reserved")]


def test_usual_headers_tags_and_texts(spark):
    t = licenses.TEMPLATES
    wrapped = lambda x, mark: "\n".join(f"{mark}{' '.join(x.split()[i : i + 9])}" for i in range(0, len(x.split()), 9))
    names = [n for n in t if n.endswith(("-header", "-text", "-tag"))]
    docs = [(i, f"code here\n{wrapped(t[n], mark)}\n\nmore code") for i, (n, mark) in enumerate((n, m) for n in names for m in ("", " * ", "# ", "// "))]
    got = {}
    for r in licenses.notices(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert got == {i: [names[i // 4]] for i in range(len(docs))}


def test_notices_are_those_that_trying_every_template_at_every_word_finds(spark):
    """The brute-force version: every template at every place and length, by number of words that differ."""
    t = {n: licenses.TEMPLATES[n] for n in ("MIT", "GPL-3.0", "GPL-2.0", "Apache-2.0", "CC-BY-4.0", "all-rights-reserved", "BSD-3-Clause", "MIT-tag", "ISC-tag")}
    rows = []
    for i, n in enumerate(t):
        w = t[n].split()
        rows += [f"a b {t[n]} c", f"x {t[n].upper()} y", f"{' '.join(w[:-1])} z", f"{' '.join(w[1:])} q", f"p {w[0]}\n{' '.join(w[1:])}", f"{t[n]} {t[n]}", "none of it " + " ".join(reversed(w))]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else min(last, row[j], row[j - 1]) + 1
        return row[-1]

    def brute_found(text):
        have = [w for w, _, _ in licenses.words(text)]
        out = set()
        for n, x in t.items():
            want = [w for w, _, _ in licenses.words(x)]
            for a in range(len(have)):
                for b in range(a + 1, min(len(have), a + 2 * len(want)) + 1):
                    part = have[a:b]
                    if licenses.marked(x) <= set(part) and distance(part, want) == 0:
                        out.add(n)
        return out

    got = {i: set() for i in range(len(rows))}
    for r in licenses.notices(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), t).collect():
        got[r.doc_id].add(r.license)
    for i, x in enumerate(rows):
        assert brute_found(x) <= got[i], (x, got[i])


def test_license_templates_of_the_caller(spark):
    """Any wording and any length: places are the notice's own."""
    long = " ".join(f"clause{i} grants what is written there" for i in range(60))
    own = {"short": "Feel free to share.", "long": long, "empty": ""}
    texts = ["word " * 500 + t + " end" for t in ("feel free\nto share", long, long.replace(" ", "\n", 100), "feel free to sell")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.start, r.end) for r in licenses.notices(df, own).collect())
    assert got == [(0, "short", 2500, 2518), (1, "long", 2500, 2500 + len(long)), (2, "long", 2500, 2500 + len(long))]


def test_many_licenses_in_one_text(spark):
    t = licenses.TEMPLATES
    # a notice that is a part of another one, or the start of it, is not found in it
    t = {n: x for n, x in t.items() if not n.endswith(("-grant", "-endorsement", "-header", "-text")) and n not in ("Apache-2.0", "MPL-2.0")}
    text = "\n".join(t[n] for _ in range(40) for n in sorted(t))
    got = Counter(r.license for r in licenses.notices(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert got == {n: 40 for n in t}


def test_no_exact_notice_depends_on_its_saving(spark):
    """Dense notices save little each, and short ones little in a long line."""
    t = licenses.TEMPLATES
    docs = [(i, f"{t['GPL-3.0']} All the rights{i} are reserved{i} by those of line {i}. {t['all-rights-reserved']} All words{i} left.") for i in range(50)]
    got = Counter(r.license for r in licenses.notices(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == {"GPL-3.0": 50, "all-rights-reserved": 50}


# -------------------------------------------------------------- classifiers


def test_quality(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(d, labels)
    held = labels.where(quality.remainder("doc_id", 3) == 1)
    both = quality.score(d.join(held, "doc_id"), model, ["doc_id", "quality"]).collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in both)
    assert len(both) > 50 and right >= 0.95 * len(both)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (1, None, "a")], "doc_id long, text string, score string")
    assert quality.filter_quality(odd.withColumn("_score", F.lit(1)), labels.limit(0)).columns == ["doc_id", "text", "score", "_score"]
    assert quality.score(odd, model, ["doc_id"]).count() == 4
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model, ["doc_id"]).collect())
    assert quality.score(none, model, ["doc_id"]).count() == 0
    nobody = quality.fit_quality(d, labels.limit(0))
    assert {r.score for r in quality.score(odd, nobody, ["doc_id"]).collect()} == {0.5}


def test_all_label_values_are_classes(spark):
    rows = [(i, f"text {i}", f"l{i % 300:03}" if i < 900 else "l000") for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts_, y, priors = quality.labelled_sample(d.select("doc_id", "text"), d.select("doc_id", "lang"), "lang", 2, 1000)
    assert Counter(y) == {f"l{k:03}": 2 for k in range(300)} and len(texts_) == 600
    assert priors["l000"] == 0.103 and priors["l299"] == 0.003 and len(priors) == 300
    # long texts are left out before the choice, and many classes share what may go to the driver
    long = d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.repeat("text", 500)).otherwise(F.col("text")))
    texts_, y, _ = quality.labelled_sample(long.select("doc_id", "text"), d.select("doc_id", "lang"), "lang", 2, 1000)
    assert max(map(len, texts_)) < 1000 and Counter(y)["l001"] == 2 and Counter(y)["l000"] == 2
    _, y, _ = quality.labelled_sample(d.select("doc_id", "text"), d.select("doc_id", "lang"), "lang", 2, 1000, 400_000)
    assert Counter(y) == {f"l{k:03}": 1 for k in range(300)}
    with pytest.raises(ValueError, match="more than 299 labels"):
        quality.labelled_sample(d.select("doc_id", "text"), d.select("doc_id", "lang"), "lang", 2, 1000, 299_000)


def test_language(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_language(d)
    held = d.where(quality.remainder("doc_id", 4) == 2)
    both = language.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.97 * len(both)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ?!"), (4, "the and of is")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert language.identify(none, model).count() == 0
    twice = odd.union(odd).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "lang": F.lit(None)})
    assert sorted((r.doc_id, r.lang_pred) for r in language.identify(twice, model).collect()) == sorted([(i, got[i][0]) for i in got] * 2)
    # scores are calibrated as they are given: of the accepted texts about as many are right as was asked for
    kept = [r for r in both if not r.rejected]
    assert len(kept) >= 0.9 * len(both) and sum(r.lang == r.lang_pred for r in kept) >= 0.985 * len(kept)


@pytest.mark.parametrize("text", ["some words é of a text " * 300, "ohne" * 700, "汉字" * 900, "a b " * 900])
def test_a_long_text_scores_like_its_parts(monkeypatch, text):
    """Whole texts count: the features of all stretches are those of the whole."""
    import pyarrow as pa

    from kgloom.llm import subwords

    rows = ["x", text, "", "y z", None]
    whole = subwords.bags(rows, True)
    monkeypatch.setattr(subwords, "RUN", 100)
    one = subwords.bags([text], True)[0]
    assert (one[0] == whole[1][0]).all() and (one[1] == whole[1][1]).all()
    model = subwords.Model([0, 1], np.random.default_rng(0).normal(size=(2, 1 << subwords.BITS)).astype(np.float32), np.zeros(2), np.zeros(2), 1.0, 0.0, True)
    alone = model.probabilities(pa.array([text]))
    p = model.probabilities(pa.array(rows))
    assert np.allclose(alone[0], p[1])
    assert len(p) == 5 and np.allclose(p[2], 0.5) and np.allclose(p[4], 0.5)


def test_labels_that_no_text_teaches(spark, odd, none):
    """Labels without documents, of other documents, or of texts that are all too long: nothing is learned and nothing fails."""
    other = spark.createDataFrame([(i, i % 2) for i in range(5000, 5100)], "doc_id long, quality int")
    own = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    same = lambda model: {r.score for r in quality.score(odd, model, ["doc_id"]).collect()}
    for docs, taught in ((none, own), (odd, other), (odd, own.limit(0)), (odd, spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int"))):
        assert same(quality.fit_quality(docs, taught)) == {0.5}
    assert same(quality.fit_quality(odd, own, longest=1)) == {0.5}
    assert quality.filter_quality(odd, other).count() == odd.count() and quality.filter_quality(none, own).count() == 0
    for model in (language.fit_language(none), language.fit_language(odd.where("lang IS NULL"))):
        assert {r.lang_pred for r in language.identify(odd, model).collect()} == {"und"}
    # one language alone: every text with a letter is of it
    assert {r.lang_pred for r in language.identify(odd, language.fit_language(odd)).collect()} == {"en", "und"}


def test_rows_that_repeat_are_filtered_alike(spark, repeated):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    kept = [r.doc_id for r in quality.filter_quality(repeated, labels).collect()]
    every = [r.doc_id for r in repeated.collect()]
    assert all(kept.count(i) in (0, every.count(i)) for i in set(every))


def test_titles_addresses_and_expressions(spark):
    rows = {
        "// SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT OR Apache-2.0-tag"],
        "SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-only. More text.": ["(MIT AND BSD-3-Clause) OR GPL-2.0-only-tag"],
        "SPDX-License-Identifier: MIT or nothing": ["MIT or nothing-tag"],
        "SPDX-License-Identifier: MIT\norders": ["MIT-tag"],
        "The MIT License (MIT)": ["MIT-title"],
        "MIT License\n\nCopyright (c) 2020": ["MIT-short-title"],
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": ["GPL-3.0-title"],
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": ["Apache-2.0-title"],
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": ["BSD-style"],
        "see https://creativecommons.org/licenses/by-sa/4.0/ for it": ["CC-BY-SA-4.0-url-folder"],
        "see http://creativecommons.org/licenses/by/4.0.": ["CC-BY-4.0-url"],
        "a general public, license by MIT and others in version 3; the GNU library": [],
        "https://creativecommons.org/licenses/by/9.0/": [],
    }
    got = {}
    for r in licenses.notices(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.license))
    assert {t: [n for _, n in sorted(got.get(i, []))] for i, t in enumerate(rows)} == rows


def test_every_expression_is_inside_its_text(spark):
    text = "x " * 50 + "SPDX-License-Identifier: MIT WITH Classpath-exception-2.0." + " y" * 50
    (r,) = licenses.notices(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert text[r.start : r.end] == "SPDX-License-Identifier: MIT WITH Classpath-exception-2.0"
