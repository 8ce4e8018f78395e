"""Removal of passages that an earlier document holds, by paths of a de Bruijn graph over words.

A window of ``width`` words is an edge of the graph; its first and last ``width - 1`` words are the nodes. An edge that
two documents hold is repeated. Where all occurrences of an edge are followed by the same edge, which itself always
follows it, the two belong to one path; a path of repeated edges therefore occurs as a whole wherever it occurs, and one
document is the first to hold it.

1. A window belongs to the smallest hash of its ``GRAM``-word runs. Windows in a row with the same place of that hash
   travel as one run with their hashes and those of the windows before and after. Hashes that only one document holds
   can't be in a repeated window and send nothing.
2. Equal runs become one and meet by that hash, which all runs with an edge have. Edges are told by documents and
   neighbours; what follows without a branch inside a run is a fragment. Joins glue the fragments to paths by pointer
   jumping: so many rounds as the longest path has doublings.
3. Runs give the places of whole paths in documents. The words at the first place of each path are read from the source
   and digested (SHA-256); each other place is compared with that digest before it is removed. A path for which one
   doesn't agree (two windows with one 64-bit hash) is decided window by window over digests of the words.

Should an edge have two places in paths, for which there is a count, its paths are decided in this way too, so what is
removed is exact whatever the hashes.

Hot keys: equal runs are aggregated before they are shuffled, joins read exchanges directly, so that AQE can split a run
or a path that a third of all documents hold. Where very many different runs have one smallest hash, as at the ends of
a usual line, they meet by edge instead, and edges are aggregated before they do.

Defined results: null text has no words; a null doc_id is smaller than nothing and nothing is smaller than it, so such a
document keeps all; equal ids aren't smaller than each other, so repeated rows both stay as they are; texts shorter than
a window keep all; very long texts are read whole, a row at a time; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import Marks, clean_shuffles, drop_written, follow, mix, same_table, slim, small_batches, utf8_parts, word_hashes, words_of, written
from kgloom.llm.substrings import sliding

WIDTH = 50
#: Long enough that a changed word is in most of the runs that windows with it have: those don't travel.
GRAM = 24
#: Edges of different runs that meet in one part, on average and at most; and of those with one smallest hash, beyond which they meet by edge.
PART_EDGES = 1 << 18
HOT_EDGES = 1 << 13
_MULTIPLY = np.uint64(0x8CB92BA72F3D8DD7)


def run_hash(word: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, from runs of half as many."""
    h, n = word, 1
    while n < width:
        step = min(n, width - n)
        size = max(0, len(h) - step)
        h = mix(mix(h[:size] * _MULTIPLY + np.uint64(n + step)) ^ h[step : step + size])
        n += step
    return h


def window_runs(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Of concatenated documents: (row, first window, windows, smallest hash) of each run, the hashes of all windows and
    the place of each run's first window among them, and the first word of each row."""
    starts, ends, at = words_of(data, offsets)
    word = word_hashes(data, starts, ends)
    n = len(word)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, at
    edge = run_hash(word, width)
    if bits < 64:
        edge = edge & np.uint64((1 << bits) - 1)
    edge = np.where(edge == 0, np.uint64(1), edge)
    small = mix(run_hash(word, gram) ^ np.uint64(0x5851F42D4C957F2D))
    span = width - gram + 1
    least = sliding(small, span, np.minimum, (1 << 64) - 1)
    last = np.searchsorted(at, np.arange(len(edge)), side="right") - 1  # row of a window's first word
    ok = np.arange(len(edge)) + width <= at[np.minimum(last + 1, len(at) - 1)]
    new = np.ones(len(edge), dtype=bool)
    # the place of the smallest hash moves when it changes or comes again at the end
    new[1:] = (least[1:] != least[:-1]) | (small[span : span + len(edge) - 1] == least[1:]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stops = np.append(np.flatnonzero(new | ~ok), len(edge))
    stop = stops[np.searchsorted(stops, first, side="right")]
    row = last[first]
    return row, first - at[row], stop - first, least[first], edge, first, at




def texts_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc, digest and text: digest tells texts of one id apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("digest"), body.alias("text"))


def smallest_hashes(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Smallest hashes that windows of two documents share."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, offsets in utf8_parts(b.column(1)):
                row, _, _, least, *_ = window_runs(data, offsets, width, gram)
                if len(row):
                    seen = pd.DataFrame({"h": least.view(np.int64), "d": ids[i:j][row]}).groupby("h", sort=False)["d"].agg(["min", "max"])
                    yield pa.RecordBatch.from_arrays([pa.array(seen.index.to_numpy()), pa.array(seen["min"].to_numpy()), pa.array(seen["max"].to_numpy())], names=["h", "lo", "hi"])

    found = texts.where("doc IS NOT NULL").select("doc", "text").mapInArrow(slim(each), "h long, lo long, hi long")
    return found.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("h")


def runs(texts: DataFrame, width: int, gram: int, wanted, bits: int) -> DataFrame:
    """doc, digest, start, least and edges of the runs whose smallest hash ``wanted`` lets through: edges are the packed hashes of the
    window before, the windows and the window after, 0 for none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, data, offsets in utf8_parts(b.column(2)):
                row, start, n, least, edge, first, at = window_runs(data, offsets, width, gram, bits)
                keep = np.flatnonzero(wanted(least)) if len(row) else []
                if not len(keep):
                    continue
                row, start, n, first = row[keep], start[keep], n[keep], first[keep]
                windows = np.diff(at)[row] - width + 1
                place = np.cumsum(n + 2) - (n + 2)
                packed = np.zeros(int((n + 2).sum()), dtype=np.uint64)
                inner = np.arange(len(packed)) - np.repeat(place, n + 2) + np.repeat(first, n + 2) - 1
                fine = (inner >= 0) & (inner < len(edge))
                packed[fine] = edge[inner[fine]]
                packed[place[start == 0]] = 0
                packed[(place + n + 1)[start + n == windows]] = 0
                ends = np.append(place, len(packed)).astype(np.int64) * 8
                cells = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(digests[i:j][row]), pa.array(start), pa.array(least[keep].view(np.int64)), cells], names=["doc", "digest", "start", "least", "edges"])

    found = texts.where("doc IS NOT NULL").mapInArrow(slim(each), "doc long, digest long, start long, least long, edges binary")
    return found.withColumn("k1", F.xxhash64("edges")).withColumn("k2", F.xxhash64(F.lit(7), "edges"))


def unpacked(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed runs: run, place in it, hash, and the hashes before and after, for each edge."""
    ends = np.frombuffer(cells.buffers()[1], dtype=np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64) // 8
    packed = np.frombuffer(cells.buffers()[2], dtype="<i8", count=int(ends[-1]))[ends[0] :] if len(cells) else np.zeros(0, "<i8")
    ends = ends - ends[0]
    n = np.diff(ends) - 2
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = ends[:-1][of] + 1 + i
    return of, i, packed[at], packed[at - 1], packed[at + 1]


def edges_of(distinct: DataFrame) -> DataFrame:
    """k1, k2, i, h, before, after, lo, hi: a row for each edge of each different run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 4096):
                c = b.slice(part, 4096)
                of, i, *hashes = unpacked(c.column(4))
                k1, k2, lo, hi = (c.column(k).take(pa.array(of)) for k in range(4))
                yield pa.RecordBatch.from_arrays([k1, k2, pa.array(i.astype(np.int32)), *map(pa.array, hashes), lo, hi], names=["k1", "k2", "i", "h", "before", "after", "lo", "hi"])

    return distinct.select("k1", "k2", "lo", "hi", "edges").mapInArrow(slim(each), "k1 long, k2 long, i int, h long, before long, after long, lo long, hi long")


PIECES = "k1 long, k2 long, i long, n long, head long, back long, tail long, next long"


def fragments_by_hash(distinct: DataFrame, parts: int, places: bool = False) -> DataFrame:
    """PIECES of runs that meet by their smallest hash, which all runs with an edge have: ``n`` edges from ``i`` on that follow each other
    without a branch, from ``head`` to ``tail``, and the only edges before and after them, 0 if there are several. A row
    without keys has the number of repeated edges. With ``places``, each repeated edge's places instead."""

    def each(table: pa.Table) -> pa.Table:
        of, i, h, before, after = unpacked(table.column("edges").combine_chunks() if table.num_rows else pa.array([], pa.binary()))
        k1, k2, lo, hi = (table.column(c).to_numpy() for c in ("k1", "k2", "lo", "hi"))
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[order][1:] != h[order][:-1]
        first = np.flatnonzero(new)
        group = np.empty(len(h), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        some = lambda x, op: op.reduceat(x[order], first) if len(first) else x[:0]
        shared = some(lo[of], np.minimum) < some(hi[of], np.maximum)
        only = lambda x: np.where(some(x, np.minimum) == some(x, np.maximum), some(x, np.minimum), 0)
        repeated, back, ahead = shared[group], only(before)[group], only(after)[group]
        linked = np.zeros(len(h) + 1, dtype=bool)  # to the edge before, in the same run
        linked[1:-1] = (of[1:] == of[:-1]) & repeated[1:] & repeated[:-1] & (ahead[:-1] == h[1:]) & (back[1:] == h[:-1])
        start, stop = np.flatnonzero(repeated & ~linked[:-1]), np.flatnonzero(repeated & ~linked[1:])
        n = stop - start + 1
        if places:
            which = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            return pa.table({"h": h[start[which] + at], "head": h[start[which]], "n": n[which], "at": at})
        run = of[start]
        count = lambda x, last: pa.concat_arrays([pa.array(x, pa.int64()), pa.array([last], pa.int64())])
        return pa.table({"k1": count(k1[run], None), "k2": count(k2[run], None), "i": count(i[start], None), "n": count(n, int(shared.sum())), "head": count(h[start], None), "back": count(back[start], None), "tail": count(h[stop], None), "next": count(ahead[stop], None)})

    sent = distinct.select(F.pmod(F.xxhash64("least"), F.lit(parts)).alias("part"), "k1", "k2", "lo", "hi", "edges")
    return sent.groupBy("part").applyInArrow(each, "h long, head long, n long, at long" if places else PIECES)


def fragments_by_edge(distinct: DataFrame, places: bool = False) -> DataFrame:
    """The same of runs whose smallest hash very many different runs have, by edges, which are aggregated before they meet."""
    listed = edges_of(distinct)
    sides = [f(c).alias(n) for c, n, f in (("lo", "lo", F.min), ("hi", "hi", F.max), ("before", "b0", F.min), ("before", "b1", F.max), ("after", "a0", F.min), ("after", "a1", F.max))]
    only = lambda a, b: F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.lit(0))
    known = written(listed.groupBy("h").agg(*sides).where("lo < hi").select("h", only("b0", "b1").alias("back"), only("a0", "a1").alias("next")))
    over = "OVER (PARTITION BY k1, k2 ORDER BY i)"
    cut = listed.select("k1", "k2", "i", "h").join(known, "h").selectExpr("*", f"CASE WHEN lag(i) {over} = i - 1 AND lag(next) {over} = h AND lag(h) {over} = back THEN 0 ELSE 1 END AS begins").selectExpr("*", f"sum(begins) {over} AS fragment")
    if places:
        first = "OVER (PARTITION BY k1, k2, fragment ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return cut.selectExpr("h", f"first(h) {first} AS head", f"count(*) {first} AS n", f"cast(i - first(i) {first} AS long) AS at")
    pieces = cut.groupBy("k1", "k2", "fragment").agg(F.min("i").cast("long").alias("i"), F.count(F.lit(1)).alias("n"), F.min_by("h", "i").alias("head"), F.min_by("back", "i").alias("back"), F.max_by("h", "i").alias("tail"), F.max_by("next", "i").alias("next"))
    null = F.lit(None).cast("long")
    return pieces.drop("fragment").union(known.agg(F.count(F.lit(1)).alias("n")).select(null, null, null, "n", null, null, null, null))


def glued(fragments: DataFrame) -> DataFrame:
    """head, n, path, path_n and offset of fragments (head, n, back, tail, next). A path has the name of its first fragment; what
    runs in a circle (two hashes that are one by chance) is left in fragments."""
    single = written(fragments.groupBy("head").agg(F.count(F.lit(1)).alias("c"), *[F.min(c).alias(c) for c in ("n", "back", "tail", "next")]).where("c = 1"))
    ahead = single.where("next <> 0").select(F.col("next").alias("at"), F.col("tail").alias("back"), F.col("head").alias("to"), F.col("n").alias("d"))
    chain = follow(single.select(F.col("head").alias("at"), "back").join(ahead, ["at", "back"], "left").select("at", "to", "d"), "at")
    named = chain.where("ended").join(single.select("head", F.col("n").alias("path_n")), "head").select(F.col("at").alias("head"), F.col("head").alias("path"), "path_n", "offset")
    out = written(fragments.select("head", "n").distinct().join(named, "head", "left").select("head", "n", "path", "path_n", "offset"))
    drop_written(single, chain)
    # a head that several fragments have stays alone under its own name
    own = F.col("path").isNull()
    return same_table(out.select("head", "n", F.coalesce("path", "head").alias("path"), F.when(own, F.col("n")).otherwise(F.col("path_n")).alias("path_n"), F.coalesce("offset", F.lit(0)).alias("offset")), out)


def paths(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, bits: int = 64, hot_edges: int = HOT_EDGES) -> tuple[DataFrame, DataFrame | None]:
    """doc, digest, path, path_n, rel, first, n: where documents hold paths of repeated windows, from window ``first`` on for
    ``n`` windows, ``rel`` after the path's beginning; and, where an edge has several places in paths (two windows with
    one hash), the paths with such an edge. Written."""
    shared = written(smallest_hashes(texts, width, gram))
    found = written(runs(texts, width, gram, Marks(shared).test(), bits))
    drop_written(shared)
    distinct = written(found.groupBy("k1", "k2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.any_value("least").alias("least"), F.any_value("edges").alias("edges")))
    clean_shuffles(texts.sparkSession)
    edges = F.octet_length("edges") / 8 - 2
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((distinct.agg(F.sum(edges)).first()[0] or 0) / PART_EDGES))
    hot = written(distinct.groupBy("least").agg(F.sum(edges).alias("n")).where(F.col("n") > hot_edges).select("least"))
    usual, spread = distinct.join(hot, "least", "left_anti"), distinct.join(hot, "least", "left_semi")
    both = lambda places: fragments_by_hash(usual, parts, places) if hot.isEmpty() else fragments_by_hash(usual, parts, places).union(fragments_by_edge(spread, places))
    told = written(both(False))
    pieces = told.where("k1 IS NOT NULL")
    fragments = written(pieces.select("head", "n", "back", "tail", "next").distinct())
    named = glued(fragments)
    mixed = None
    # each edge has one place in one fragment, or else the numbers differ
    if fragments.agg(F.sum("n")).first()[0] != (told.where("k1 IS NULL").agg(F.sum("n")).first()[0] or None):
        held = written(both(True).select("h", F.struct("head", "n", "at").alias("place")).distinct())
        several = held.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
        mixed = written(held.join(several, "h", "left_semi").select("place.head", "place.n").distinct().join(named, ["head", "n"]).select("path").distinct())
        drop_written(held)
    drop_written(distinct, fragments, hot)
    placed = pieces.join(named, ["head", "n"]).select("k1", "k2", "i", "n", "path", "path_n", "offset")
    places = found.select("doc", "digest", "start", "k1", "k2").join(placed, ["k1", "k2"])
    places = places.select("doc", "digest", "path", "path_n", (F.col("start") + F.col("i")).alias("at"), "n", "offset")
    spans = places.groupBy("doc", "digest", "path", "path_n", (F.col("at") - F.col("offset")).alias("zero")).agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("n")).alias("stop"))
    out = written(spans.select("doc", "digest", "path", "path_n", (F.col("first") - F.col("zero")).alias("rel"), "first", (F.col("stop") - F.col("first")).alias("n")))
    drop_written(found, told, named)
    clean_shuffles(texts.sparkSession)
    return out, mixed


def in_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each; where each begins, with the end; and the first word of each row."""
    starts, ends, at = words_of(data, offsets)
    size = ends - starts
    begin = np.append(0, np.cumsum(size + 1))
    out = np.full(int(begin[-1]), 32, dtype=np.uint8)
    source = np.repeat(starts - begin[:-1], size + 1) + np.arange(len(out))
    letter = np.ones(len(out), dtype=bool)
    letter[begin[1:] - 1] = False
    out[letter] = data[source[letter]]
    return out, begin, at


def requests(spans: DataFrame, *extra: str) -> DataFrame:
    """One row for each text, with its spans."""
    return spans.groupBy("doc", "digest").agg(F.collect_set(F.struct("first", "n", *extra)).alias("spans"))


def read_back(texts: DataFrame, spans: DataFrame, width: int, per_window: bool = False) -> DataFrame:
    """The SHA-256 of the words of each span (doc, digest, first, n, path, path_n, rel), read from the texts; or of each window of it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in utf8_parts(b.column(2)):
                joined, begin, at = in_words(data, offsets)
                rows = []
                for r in range(i, j):
                    for s in b.column(3)[r].as_py():
                        for first, n in ((k, 1) for k in range(s["first"], s["first"] + s["n"])) if per_window else [(s["first"], s["n"])]:
                            a = int(at[r - i]) + first
                            z = min(a + n + width - 1, int(at[r - i + 1]))
                            rows.append((b.column(0)[r].as_py(), b.column(1)[r].as_py(), s["path"], s["path_n"], s["rel"], first, n, hashlib.sha256(joined[begin[a] : begin[z] - 1].tobytes()).digest()))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.binary()], strict=True)], names=["doc", "digest", "path", "path_n", "rel", "first", "n", "sha"])

    asked = texts.join(requests(spans, "path", "path_n", "rel"), ["doc", "digest"])
    return asked.select("doc", "digest", "text", "spans").mapInArrow(slim(each), "doc long, digest long, path long, path_n long, rel long, first long, n long, sha binary")


def cut_out(texts: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """doc, n_words, n_removed, kept_sha256, failed: ``spans`` (doc, digest, first, n, path, sha) whose words have the digest ``sha`` are
    removed; ``failed`` lists the paths of the others."""
    schema = "doc long, n_words long, n_removed long, kept_sha256 string, failed array<long>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in utf8_parts(b.column(1)):
                joined, begin, at = in_words(data, offsets)
                rows = []
                for r in range(i, j):
                    a, z = int(at[r - i]), int(at[r - i + 1])
                    spans = b.column(2)[r].as_py() or []
                    kept, failed = joined[begin[a] : begin[z]], []
                    gone = 0
                    if spans:
                        change = np.zeros(z - a + 1, dtype=np.int64)
                        for s in spans:
                            first, stop = s["first"], min(s["first"] + s["n"] + width - 1, z - a)
                            if hashlib.sha256(joined[begin[a + first] : begin[a + stop] - 1].tobytes()).digest() == s["sha"]:
                                change[first] += 1
                                change[stop] -= 1
                            else:
                                failed.append(s["path"])
                        stay = np.cumsum(change[:-1]) == 0
                        gone = int((~stay).sum())
                        kept = kept[np.repeat(stay, np.diff(begin[a : z + 1]))]
                    rows.append((b.column(0)[r].as_py(), z - a, gone, hashlib.sha256(kept[:-1].tobytes()).hexdigest(), failed))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["doc", "n_words", "n_removed", "kept_sha256", "failed"])

    asked = requests(spans, "path", "sha")
    test = Marks(spans.select(F.xxhash64("doc", "digest").alias("h"))).test()

    @F.pandas_udf("boolean")
    def near(h: pd.Series) -> pd.Series:
        return pd.Series(test(h.to_numpy().view(np.uint64)))

    # texts without spans stay where they are
    marked = texts.withColumn("near", near(F.xxhash64("doc", "digest")))
    none = F.lit(None).cast(asked.schema["spans"].dataType)
    far = marked.where("NOT near OR doc IS NULL").select("doc", "text", none.alias("spans")).mapInArrow(slim(each), schema)
    close = marked.where("near AND doc IS NOT NULL").join(asked, ["doc", "digest"], "left").select("doc", "text", "spans").mapInArrow(slim(each), schema)
    return far.union(close)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, gram: int = GRAM, bits: int = 64, hot_edges: int = HOT_EDGES) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what stays (words joined by a space) for every row: words in a window of
    ``width`` that a document with a smaller id holds too are removed. ``bits`` of a window's hash are used; few make collisions, for tests."""
    if not 1 <= gram <= width:
        raise ValueError("the runs that place a window lie inside it")
    texts = small_batches(texts_of(docs, text, key))
    spans, mixed = paths(texts, width, gram, bits, hot_edges)
    group = ["path", "path_n", "rel", "n"]
    canonical = spans.groupBy(*group).agg(F.min(F.struct("doc", "digest", "first")).alias("source"), F.max("doc").alias("last"))
    canonical = written(canonical.where("source.doc < last").select(*group, "source.*"))
    several = spans.groupBy("path", "path_n").agg(F.min(F.struct("rel", "n")).alias("x"), F.max(F.struct("rel", "n")).alias("y")).where("x <> y").select("path")
    if mixed is not None:
        several = several.union(mixed)
    told = written(read_back(texts, canonical, width).select(*group, F.col("doc").alias("from"), "sha").distinct())
    candidates = spans.join(told, group).where(F.col("doc") > F.col("from")).select("doc", "digest", "first", "n", "path", "path_n", "sha")
    out = written(cut_out(texts, candidates.join(several, "path", "left_anti"), width))
    failed = out.select(F.explode("failed").alias("path")).distinct()
    if not (several.isEmpty() and failed.isEmpty()):
        # two different windows have one hash: all places of their paths are decided window by window
        unsure = written(several.union(failed).distinct())
        windows = read_back(texts, spans.join(unsure, "path"), width, True)
        windows = written(windows)
        least = windows.groupBy("sha").agg(F.min("doc").alias("from"))
        sure = windows.join(least, "sha").where(F.col("doc") > F.col("from")).select("doc", "digest", "first", "n", "path", "path_n", "sha")
        again = written(cut_out(texts, candidates.join(unsure, "path", "left_anti").unionByName(sure), width))
        drop_written(out, windows, unsure)
        out = again
    drop_written(spans, canonical, told)
    return out.select(F.col("doc").alias(key), "n_words", "n_removed", "kept_sha256")


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 50 that a document with a smaller id holds."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
hit AS (SELECT v.doc_id, v.i FROM v JOIN m ON v.h = m.h WHERE v.doc_id > m.least),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
c AS (SELECT w.doc_id, w.i, w.word,
             max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.i = w.i),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
