"""Phrases whose words stand together more often than apart, from bitmaps of positions.

A text with A-Z lowered is cut in pieces at ``.,;:!?`` and line breaks, a piece in words at spaces and tabs. The
words of a language are dealt into shards of ``SHARD`` positions at most, cut anywhere: a shard that begins inside a
piece repeats the last words before it, which are seen and not counted.

1. Each shard holds, for each word, the bitmap of its positions, compressed: only bytes with a bit set are kept, with
   their places. One more bitmap says which positions begin a piece.
2. Phrases grow depth first. The bitmap of a phrase's last words is shifted by one, cleared where a piece begins, and
   met (AND) with the bitmaps of the words in the same bytes; what is left are the ends of the longer phrases, and
   popcounts are their counts in the shard. Groups of phrases are extended together, so numpy does the work.
3. Counts are summed over the shards by Spark. A phrase can only be frequent if what it begins and ends with is, so
   there is a pass for each length, and a bitmap of bounded size over the frequent shorter phrases prunes the next.

Only counts are shuffled, a frequent word or phrase once for each shard or task. Words are numbered by 64-bit hashes
that are checked to be different for all words of a language; should two be the same, another seed is taken.

Defined results: null text is empty; null languages are ``und``; ids play no part, so repeated rows count as often
as they occur; ties are in the order of the phrase's bytes; texts of any length are cut in shards; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import LOWER, Marks, clean_shuffles, drop_written, mix, slim, small_batches, utf8_parts, word_hashes, written

#: Positions of a shard; places of bytes fit in 16 bits up to twice as many.
SHARD = 1 << 18
#: Words that wait for their shards to fill in a task, over all languages.
WAITING = 4 * SHARD
#: Entries of bitmaps that are extended together.
GROUP = 1 << 15
#: Counts of phrases that meet in one part, on average over the occurrences of words.
PART = 1 << 20

BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
_MULTIPLY = np.uint64(0x9FB21C651E98DF25)

SHARDS = "lang string, skip int, words array<string>, ends binary, places binary, bits binary, inside binary"


def words_in_pieces(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, whether each begins a piece) for runs of rows."""
    for _, _, data, offsets in utf8_parts(texts):
        solid = ~GAP[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | cut[1:-1]
        stop[:-1] &= ~solid[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if not len(starts):
            continue
        piece = np.searchsorted(np.flatnonzero(BREAK[data]), starts)
        row = np.searchsorted(offsets, starts, side="right")
        first = np.ones(len(starts), dtype=bool)
        first[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
        places = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=places[1:])
        yield pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(LOWER[data[solid]]))), first


def shard(lang: str, words: pa.Array, first: np.ndarray, skip: int) -> dict:
    """The bitmaps of consecutive words; the first ``skip`` positions are not counted."""
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy()
    at = np.argsort(ids, kind="stable")
    ids, byte = ids[at], at >> 3
    new = np.ones(len(at), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (byte[1:] != byte[:-1])
    entry = np.flatnonzero(new)
    bits = np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), entry)
    ends = np.searchsorted(ids[entry], np.arange(len(coded.dictionary)), side="right").astype(np.int32)
    inside = np.packbits(~first, bitorder="little")
    return {"lang": lang, "skip": skip, "words": coded.dictionary, "ends": ends.tobytes(), "places": byte[entry].astype(np.uint16).tobytes(), "bits": bits.tobytes(), "inside": inside.tobytes()}


class Waiting:
    """Words of a language that don't fill a shard yet."""

    def __init__(self, lang: str, before: int):
        self.lang, self.before, self.skip, self.parts, self.n = lang, before, 0, [], 0

    def add(self, words: pa.Array, first: np.ndarray) -> None:
        self.parts.append((words, first))
        self.n += len(first)

    def shards(self, size: int, all_of_it: bool = False) -> Iterator[dict]:
        """Full shards, and what is left too if ``all_of_it``. A shard that begins inside a piece sees ``before`` words more."""
        if self.n < size and not (all_of_it and self.n > self.skip):
            return
        words, first = pa.concat_arrays([w for w, _ in self.parts]), np.concatenate([f for _, f in self.parts])
        while len(first) >= size or (all_of_it and len(first) > self.skip):
            end = min(size, len(first))
            yield shard(self.lang, words.slice(0, end), first[:end], self.skip)
            back = 0 if end == len(first) or first[end] else min(self.before, end)
            words, first, self.skip = words.slice(end - back), first[end - back :].copy(), back
            first[:1] = True
        # words that filled the shards are not kept alive by what is left
        self.parts, self.n = ([(pa.concat_arrays([words, words[:0]]), first)], len(first)) if len(first) else ([], 0)
        if not self.n:
            self.skip = 0


def position_shards(docs: DataFrame, text: str, lang: str, longest: int, size: int = SHARD) -> DataFrame:
    """A row a shard. What lies in one shard depends on how rows are partitioned, sums over shards don't."""
    if not longest * 8 <= size <= 1 << 19:
        raise ValueError(f"shards hold {longest * 8} to {1 << 19} positions")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, Waiting] = {}
        schema = pa.schema([("lang", pa.string()), ("skip", pa.int32()), ("words", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("ends", "places", "bits", "inside")]])

        def row(s: dict) -> pa.RecordBatch:
            words = pa.ListArray.from_arrays(pa.array([0, len(s["words"])], pa.int32()), s["words"])
            return pa.RecordBatch.from_arrays([words if f.name == "words" else pa.array([s[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            of = coded.indices.to_numpy()
            for k, name in enumerate(coded.dictionary.to_pylist()):
                mine = waiting.setdefault(name, Waiting(name, longest - 1))
                for words, first in words_in_pieces(batch.column(1).take(pa.array(np.flatnonzero(of == k)))):
                    mine.add(words, first)
                    yield from map(row, mine.shards(size))
            if sum(w.n for w in waiting.values()) > WAITING:
                for w in waiting.values():
                    yield from map(row, w.shards(size, True))
                waiting = {}
        for w in waiting.values():
            yield from map(row, w.shards(size, True))

    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return small_batches(texts).mapInArrow(slim(build), SHARDS)


class Bitmaps:
    """A shard in a task: entries (word, place, bits), also in the order of places."""

    def __init__(self, row: dict, seed: int):
        words = row["words"].values if isinstance(row["words"], pa.ListScalar) else row["words"]
        self.lang, self.n_words = row["lang"].as_py(), len(words)
        self.ends = np.frombuffer(row["ends"].as_buffer(), dtype=np.int32).astype(np.int64)
        self.places = np.frombuffer(row["places"].as_buffer(), dtype=np.uint16).astype(np.int64)
        self.bits = np.frombuffer(row["bits"].as_buffer(), dtype=np.uint8)
        self.inside = np.frombuffer(row["inside"].as_buffer(), dtype=np.uint8)
        self.counted = np.full(len(self.inside), 255, dtype=np.uint8)
        skip = row["skip"].as_py()
        self.counted[: skip >> 3] = 0
        self.counted[skip >> 3 : (skip >> 3) + 1] = (255 << (skip & 7)) & 255
        self.owner = np.repeat(np.arange(self.n_words), np.diff(self.ends, prepend=0))
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = words.buffers()[2]
        self.words = words
        self.hashes = word_hashes(np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets[:-1], offsets[1:], 0x452821E638D01377 + seed)

    def by_place(self, keep: np.ndarray) -> None:
        """Lists the entries of the words in ``keep`` by place."""
        own = np.flatnonzero(keep[self.owner])
        at = own[np.argsort(self.places[own], kind="stable")]
        self.first = np.searchsorted(self.places[at], np.arange(len(self.inside) + 1))
        self.at_word, self.at_bits = self.owner[at], self.bits[at]

    def word_counts(self) -> np.ndarray:
        return np.add.reduceat(POPCOUNT[self.bits & self.counted[self.places]], np.append(0, self.ends[:-1])) if self.n_words else np.zeros(0, np.int64)

    def extend(self, phrase: np.ndarray, places: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shifts the bitmaps of phrases by one position and meets them with those of the words: (phrase, word, place, bits) of the ends of longer phrases."""
        over = np.flatnonzero(bits >> 7)
        p, at = np.concatenate([phrase, phrase[over]]), np.concatenate([places, places[over] + 1])
        b = np.concatenate([bits << 1, np.ones(len(over), dtype=np.uint8)])
        b &= np.append(self.inside, np.uint8(0))[at]
        live = np.flatnonzero(b)
        p, at, b = p[live], at[live], b[live]
        many = self.first[at + 1] - self.first[at]
        mine = np.repeat(np.arange(len(p)), many)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many - self.first[at], many)
        both = b[mine] & self.at_bits[other]
        live = np.flatnonzero(both)
        return p[mine[live]], self.at_word[other[live]], at[mine[live]], both[live]


def lang_code(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def phrase_keys(lang: np.ndarray | np.uint64, hashes: list[np.ndarray]) -> np.ndarray:
    x = np.full(len(hashes[0]), 1, dtype=np.uint64) * lang
    for h in hashes:
        x = mix(x * _MULTIPLY + h)
    return x


Test = Callable[[np.ndarray], np.ndarray]


def grow(s: Bitmaps, length: int, frequent: list[Test]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts) of the phrases of ``length`` words in a shard whose shorter parts ``frequent`` lets through, depth first: ``frequent[k]`` tests keys of k + 1 words."""
    code = lang_code(s.lang)
    keep = frequent[0](phrase_keys(code, [s.hashes]))
    s.by_place(keep)
    own = np.flatnonzero(keep)
    sizes = np.diff(s.ends, prepend=0)[own]
    group = np.cumsum(sizes) // GROUP
    stack = []
    for g in range(int(group[-1]) + 1 if len(own) else 0):
        words = own[group == g]
        n = np.diff(s.ends, prepend=0)[words]
        entries = np.repeat(s.ends[words] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(words):
            stack.append((words[:, None], np.repeat(np.arange(len(words)), n), s.places[entries], s.bits[entries]))
    while stack:
        phrases, p, places, bits = stack.pop()
        p, word, places, bits = s.extend(p, places, bits)
        if not len(p):
            continue
        at = np.argsort(p * s.n_words + word, kind="stable")
        p, word, places, bits = p[at], word[at], places[at], bits[at]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        longer = np.column_stack([phrases[p[first]], word[first]])
        k = longer.shape[1]
        fine = np.ones(len(longer), dtype=bool)
        if k > 2:
            fine &= frequent[k - 2](phrase_keys(code, [s.hashes[longer[:, j]] for j in range(1, k)]))
        if k == length:
            counts = np.add.reduceat(POPCOUNT[bits & s.counted[places]], first)
            fine &= counts > 0
            yield longer[fine], counts[fine]
            continue
        fine &= frequent[k - 1](phrase_keys(code, [s.hashes[longer[:, j]] for j in range(k)]))
        of = np.cumsum(new) - 1
        live = np.flatnonzero(fine[of])
        if len(live):
            stack.append((longer[fine], (np.cumsum(fine) - 1)[of[live]], places[live], bits[live]))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


def word_table(shards: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, f) of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (Bitmaps(r, seed) for b in batches for r in rows_of(b)):
            n = s.word_counts()
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([s.lang] * len(some), pa.string()), s.words.take(pa.array(some)), pa.array(s.hashes[some].view(np.int64)), pa.array(n[some])], names=["lang", "word", "h1", "f"])

    counted = shards.select("lang", "skip", "words", "ends", "places", "bits", "inside").mapInArrow(slim(count), "lang string, word string, h1 long, f long")
    return counted.groupBy("lang", "word", "h1").agg(F.sum("f").alias("f"))


def phrase_table(shards: DataFrame, seed: int, length: int, frequent: list[Test], least: int, parts: int) -> DataFrame:
    """(lang, h1 .. , f) of the phrases of ``length`` words that occur ``least`` times. A shard packs its counts by part of the
    phrases' keys, in which it has each phrase once: a part has no hot key and is summed with numpy."""
    names = [f"h{k + 1}" for k in range(length)]
    width = length + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (Bitmaps(r, seed) for b in batches for r in rows_of(b)):
            table = [np.column_stack([s.hashes[phrases].view(np.int64), n]) for phrases, n in grow(s, length, frequent)]
            table = np.concatenate([*table, np.zeros((0, width), np.int64)])
            if not len(table):
                continue
            part = (phrase_keys(np.uint64(1), [table[:, k].view(np.uint64) for k in range(length)]) % np.uint64(parts)).astype(np.int64)
            at = np.argsort(part, kind="stable")
            part, table = part[at], table[at]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            cells = [table[a:z].tobytes() for a, z in zip(first, np.append(first[1:], len(part)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s.lang] * len(first), pa.string()), pa.array(part[first]), pa.array(cells, pa.binary())], names=["lang", "part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([np.frombuffer(c.as_buffer(), dtype="<i8") for b in batches for c in b.column("counts")]).reshape(-1, width)
        at = np.lexsort([table[:, k] for k in range(length)])
        table = table[at]
        new = np.ones(len(table), dtype=bool)
        new[1:] = (table[1:, :length] != table[:-1, :length]).any(axis=1)
        first = np.flatnonzero(new)
        f = np.add.reduceat(table[:, length], first)
        enough = f >= least
        found = table[first[enough]]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(found), pa.string()), *[pa.array(np.ascontiguousarray(found[:, k])) for k in range(length)], pa.array(f[enough])], names=["lang", *names, "f"])

    counted = shards.mapInArrow(slim(count), "lang string, part long, counts binary")
    return counted.groupBy("lang", "part").applyInArrow(add, ", ".join(["lang string", *[f"{h} long" for h in names], "f long"]))


def key_marks(table: DataFrame, length: int) -> Test:
    """A test of keys of phrases that holds for those in ``table``, and few others."""

    def keys(lang: pd.Series, *hashes: pd.Series) -> pd.Series:
        codes, names = pd.factorize(lang)
        code = np.array([lang_code(x) for x in names], dtype=np.uint64)[codes] if len(lang) else np.zeros(0, np.uint64)
        return pd.Series(phrase_keys(code, [h.to_numpy().view(np.uint64) for h in hashes]).view(np.int64))

    keyed = F.pandas_udf(keys_of(keys, length), "long")
    return Marks(table.select(keyed("lang", *[f"h{k + 1}" for k in range(length)]).alias("key"))).test()


def keys_of(keys: Callable[..., pd.Series], length: int) -> Callable[..., pd.Series]:
    """``keys`` with the fixed number of arguments that Spark reads from its signature."""
    if length == 1:

        def f1(lang: pd.Series, a: pd.Series) -> pd.Series:
            return keys(lang, a)

        return f1

    def f(lang: pd.Series, a: pd.Series, *more: pd.Series) -> pd.Series:
        return keys(lang, a, *more)

    return f


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, size: int = SHARD, seed: int = 0) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(words and counts of each language, frequent phrases by length, written tables): the first element has (lang, n),
    the second for k words (lang, h1 .. hk, f), for one word also its ``word``."""
    shards = written(position_shards(docs, text, lang, longest, size))
    while True:
        words = written(word_table(shards, seed))
        if words.groupBy("lang", "h1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            break
        drop_written(words)
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((totals.agg(F.sum("n")).first()[0] or 0) / PART))
    tables, tests = [words.where(F.col("f") >= least)], []
    keep = [words]
    for k in range(2, longest + 1):
        tests.append(key_marks(tables[-1], k - 1))
        tables.append(written(phrase_table(shards, seed, k, list(tests), least, parts)))
        keep.append(tables[-1])
        clean_shuffles(docs.sparkSession)
    drop_written(shards)
    return totals, tables, keep


def candidates(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 50, size: int = SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of the candidates that stay: phrases of 2 to ``longest`` words that occur
    ``least`` times, without those inside a longer candidate that occurs in ``share`` of a hundred of their places; and (lang, n).

    The score is a million times a*a / (l*r) at the cut where that is lowest, in decimals of 38 digits: counts up to
    10**15 are exact.
    """
    totals, tables, _ = phrase_counts(docs, text, lang, longest, least, size, seed)
    words = tables[0]
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    found = []
    for k in range(2, longest + 1):
        t = tables[k - 1].withColumnRenamed("f", "a")
        for j in range(1, k + 1):
            w = words.select(F.col("lang"), F.col("h1").alias(f"h{j}"), F.col("word").alias(f"w{j}"), F.col("f").alias(f"f{j}_{j}"))
            t = t.join(w, ["lang", f"h{j}"])
        for i, j in itertools.chain(((1, c) for c in range(2, k)), ((c, k) for c in range(2, k))):
            part = tables[j - i].select("lang", *[F.col(f"h{m + 1}").alias(f"h{i + m}") for m in range(j - i + 1)], F.col("f").alias(f"f{i}_{j}"))
            t = t.join(part, ["lang", *[f"h{m}" for m in range(i, j + 1)]])
        cuts = []
        for c in range(1, k):
            left, right = f"f1_{c}", f"f{c + 1}_{k}"
            value = F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")
            cuts.append(F.struct(value.alias("score"), F.lit(c).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r")))
        best = F.array_min(F.array(*cuts)).alias("best")
        found.append(t.select("lang", F.array(*[f"h{m + 1}" for m in range(k)]).alias("ids"), F.concat_ws(" ", *[f"w{m + 1}" for m in range(k)]).alias("phrase"), "a", best))
    every = None
    for k, t in enumerate(found, 2):
        inside = None
        for m in range(k + 1, longest + 1):
            longer = tables[m - 1].select("lang", F.array(*[f"h{j + 1}" for j in range(m)]).alias("ids"), "f")
            part = longer.select("lang", "f", F.explode(F.array(*[F.slice("ids", j + 1, k) for j in range(m - k + 1)])).alias("ids"))
            inside = part if inside is None else inside.union(part)
        if inside is not None:
            most = inside.groupBy("lang", "ids").agg(F.max("f").alias("most"))
            t = t.join(most, ["lang", "ids"], "left").where(F.col("most").isNull() | (100 * exact("most") < share * exact("a"))).drop("most")
        t = t.select("lang", "phrase", "a", "best.l", "best.r", F.col("best.score").cast("long").alias("score"))
        every = t if every is None else every.union(t)
    return every, totals


def collocations(docs: DataFrame, **options) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the ``candidates``."""
    every, totals = candidates(docs, **options)
    return every.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def ranked(rows: DataFrame, top: int, parts: tuple[int, ...] = (64, 4)) -> DataFrame:
    """The first ``top`` of each language with their rank from 1. First each part of a language gives its own first
    ones, then each of fewer parts, so no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for n in parts:
        part = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(n)))
        rows = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


TOP = 2000


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    every, totals = candidates(docs)
    # counts of words join what is left: before, they would gather each language in one task
    return ranked(every, TOP).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
f1 AS (SELECT lang, x AS p1, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, x[1] AS p1, x[2] AS p2, count(*) AS f
       FROM (SELECT lang, unnest([ws[i:i+1] FOR i IN range(1, len(ws))]) AS x FROM w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x[1] AS p1, x[2] AS p2, x[3] AS p3, count(*) AS f
       FROM (SELECT lang, unnest([ws[i:i+2] FOR i IN range(1, len(ws) - 1)]) AS x FROM w) GROUP BY ALL HAVING count(*) >= 10),
c2 AS (
  SELECT f2.lang, f2.p1 || ' ' || f2.p2 AS phrase, f2.f AS a, a.f AS l, b.f AS r,
         (1000000::HUGEINT * f2.f * f2.f // (a.f::HUGEINT * b.f)) AS score, p1, p2
  FROM (SELECT lang, p1, p2, f FROM f2) f2
  JOIN (SELECT lang, p1 AS x, f FROM f1) a ON a.lang = f2.lang AND a.x = p1
  JOIN (SELECT lang, p1 AS y, f FROM f1) b ON b.lang = f2.lang AND b.y = p2),
c3 AS (
  SELECT f3.lang, f3.p1 || ' ' || f3.p2 || ' ' || f3.p3 AS phrase, f3.f AS a,
         a.f AS l1, bc.f AS r1, (1000000::HUGEINT * f3.f * f3.f // (a.f::HUGEINT * bc.f)) AS s1,
         ab.f AS l2, c.f AS r2, (1000000::HUGEINT * f3.f * f3.f // (ab.f::HUGEINT * c.f)) AS s2
  FROM f3
  JOIN f1 a ON a.lang = f3.lang AND a.p1 = f3.p1
  JOIN f1 c ON c.lang = f3.lang AND c.p1 = f3.p3
  JOIN f2 ab ON ab.lang = f3.lang AND ab.p1 = f3.p1 AND ab.p2 = f3.p2
  JOIN f2 bc ON bc.lang = f3.lang AND bc.p1 = f3.p2 AND bc.p2 = f3.p3),
inside AS (
  SELECT lang, p1, p2, max(f) AS most FROM (SELECT lang, p1, p2, f FROM f3 UNION ALL SELECT lang, p2, p3, f FROM f3) GROUP BY ALL),
every AS (
  SELECT c2.lang, phrase, a, l, r, score FROM c2 LEFT JOIN inside i ON i.lang = c2.lang AND i.p1 = c2.p1 AND i.p2 = c2.p2
  WHERE most IS NULL OR 100 * most < 50 * a
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
numbered AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM every)
SELECT m.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM numbered m JOIN t ON t.lang = m.lang WHERE rank <= 2000
"""
