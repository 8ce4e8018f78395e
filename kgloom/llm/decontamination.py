"""Benchmark decontamination: which documents contain which test items.

Containment of an item's shingles in a document's is searched with MinHash signatures
on both sides, whose length follows the sizes. A permutation of the hashes is cut in
bins and a signature holds the least hash of each bin. Documents and items are
partitioned by size (items by powers of two, documents by quarters of them); for each pair of partitions the number of bins is
chosen so that an item with a share of ``threshold`` in a document is missed with a
chance of about ``miss``: with c shingles in common, each in both signatures with a
chance p, that is (1 - p)^c, so long items need a small part of a document's shingles
and short ones most. All these signatures are nested, as a bin of few is a union of bins
of many: a shingle is sent once, with the least number of bins (a power of two, its
*level*) from which on it is in the signature. Signatures meet in one join on the
hashes, however many items there are, and one scan of the documents is enough.

A bitmap of all items' shingles (of bounded size, see ``common.Marks``) goes over the
documents first: shingles that no item has leave neither signature entries nor anything
else behind. What a document keeps is enough to confirm candidates by exact containment
of the shingles of whole texts.

A shingle that very many documents hold, as of a usual opening, would make each of them a candidate for
each item with it. So an item may be searched by its rarest shingles alone: of n of which s must be shared, the
rarest n - s + c hold c at least, for which signatures are then made. Documents are counted by shingle,
and each item takes the c, s halved some times, with the fewest expected meetings.

Items of 1 to 4 words have no shingle inside a longer document: they are contained
in the documents in which their words occur in a row, and count as one shingle.

Defined results: null text or text without words contains nothing; an item
without words is contained in nothing; a document or item that repeats appears for
each row; ids may be null and are returned as they are; very long texts are
searched whole; empty tables give no rows; other columns, whatever their names, are
ignored by ``contained`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import SHINGLE, Marks, distinct, fresh, grams, shingles, slim, utf8_parts, words_of, written

MISS = 1e-6
#: Partitions of documents: sets have fewer than 2^32 shingles.
PARTS = 128
#: The partition of items under five words.
SHORT = -1
#: So many times the shared shingles of an item's search may be halved.
HALVINGS = 6


def part(size: int) -> int:
    """The partition of a document of so many shingles."""
    return int(4 * math.log2(size))


def signature_bits(doc_part: int, item_band: int, threshold: float, miss: float = MISS, halved: int = 0) -> int:
    """log2 of the bins for documents of up to 2^((doc_part + 1) / 4) and items of at least 2^item_band shingles, of
    whose shared ones a half, ``halved`` times over, is among those searched for."""
    shared = max(1, math.ceil(threshold * (1 << item_band)) >> halved)
    share = 1 - miss ** (1 / shared)
    # with x hashes a bin, one of them is the least with chance (1 - e^-x) / x
    low, high = 1e-9, 1e9
    for _ in range(100):
        x = math.sqrt(low * high)
        low, high = (x, high) if -math.expm1(-x) / x > share else (low, x)
    return max(1, min(63, math.ceil(math.log2((2 ** ((doc_part + 1) / 4) + (2 << item_band)) / low))))


def levels(u: np.ndarray) -> np.ndarray:
    """For sorted distinct hashes, log2 of the fewest bins in which each is its bin's least:
    one more than the leading bits that it has in common with the one before."""
    apart = u[1:] ^ u[:-1]
    upper = (apart >> np.uint64(32)).astype(np.float64)
    length = np.where(upper > 0, 32 + np.frexp(upper)[1], np.frexp((apart & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
    return np.append(np.zeros(1), 65 - length)[: len(u)].astype(np.uint8)


def band(size: int) -> int:
    return size.bit_length() - 1


def item_sets(items: DataFrame) -> DataFrame:
    """_item, item_id, band and the shingles (packed, sorted) of every item with words."""

    def run(batches):
        for batch in batches:
            words = np.concatenate([np.diff(words_of(d, o)[2]) for _, _, d, o in utf8_parts(batch.column(1))] or [np.zeros(0, int)])
            rows = [(r, SHORT if words[r] < SHINGLE else band(len(u)), u.tobytes()) for r, u in shingles(batch.column(1)) if len(u)]
            at, bands, sets = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(bands, pa.int32()), pa.array([int(words[r]) for r in at], pa.int32()), pa.array(sets, pa.binary())], names=["item_id", "band", "words", "set"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(slim(run), "item_id long, band int, words int, set binary")
    return written(rows.withColumn("_item", F.monotonically_increasing_id()))


def entries(sets: DataFrame, owner: str, packed: str = "set") -> DataFrame:
    """(hash, owner, band, level) of every element of packed sets that carry no levels of their own."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(2)]
            sizes = [len(u) for u in found]
            h = np.concatenate([*found, np.zeros(0, "<u8")])
            level = np.concatenate([*map(levels, found), np.zeros(0, np.uint8)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(np.array(batch.column(0)), sizes), pa.int64()), pa.array(np.repeat(np.array(batch.column(1)), sizes), pa.int32()), pa.array(level.astype(np.int32))], names=["hash", owner, "band", "level"])

    return sets.select(owner, "band", packed).mapInArrow(slim(run), f"hash long, {owner} long, band int, level int")


def searched(asked: DataFrame, fixed: DataFrame, held: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(hash, _item, band, level, half): the shingles each item is searched by, the rarest in ``held`` (hash, docs) with the fewest
    expected meetings."""
    n = fixed.select("_item", (F.octet_length("set") / 8).cast("long").alias("n"), F.greatest(F.lit(1), F.ceil(F.octet_length("set") / 8 * threshold - 1e-9)).cast("long").alias("s"))
    known = asked.join(held, "hash", "left").join(n, "_item").withColumn("docs", F.coalesce("docs", F.lit(0)))
    order = Window.partitionBy("_item").orderBy("docs", "hash")
    placed = written(known.withColumn("place", F.row_number().over(order)).withColumn("cost", F.sum("docs").over(order)))
    options = []
    for half in range(HALVINGS):
        c = F.greatest(F.lit(1), F.shiftright("s", half)).cast("long")
        # a shingle is in both signatures with this chance
        cost = F.max(F.when(F.col("place") == F.col("n") - F.col("s") + c, F.col("cost"))) * (1 - F.pow(F.lit(miss), 1 / F.max(c)))
        options.append(F.struct(cost.alias("cost"), F.lit(half).alias("half"), F.max(F.col("n") - F.col("s") + c).alias("take")))
    best = placed.groupBy("_item").agg(F.array_min(F.array(*options)).alias("best")).select("_item", "best.half", "best.take")
    return placed.join(best, "_item").where("place <= take").select("hash", "_item", "band", "level", "half")


def candidates(sent: DataFrame, wanted: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct (_doc, _item, band) whose signatures meet; only ids travel. ``table``: PARTS partitions of documents by those of items."""
    met = sent.join(wanted, "hash").join(F.broadcast(table), ["k", "band", "half"]).where((F.col("lev") <= F.col("bits")) & (F.col("level") <= F.col("bits")))
    return met.select("_doc", "_item", "band").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.75, miss: float = MISS) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment) for ``docs`` (doc_id, text) and ``items`` (item_id, text)."""
    spark = docs.sparkSession
    fixed = item_sets(items)
    asked = written(entries(fixed, "_item"))
    kinds = [(r["band"], r["words"]) for r in fixed.select("band", F.when(F.col("band") == SHORT, F.col("words")).alias("words")).distinct().collect()]  # 68 at most
    short = sorted(w for b, w in kinds if b == SHORT)
    has = Marks(asked.select("hash")).test()

    def search(batches):
        for batch in batches:
            runs = grams(batch.column(1), short) if short else iter(lambda: None, 0)
            rows = []
            for (r, u), g in zip(shingles(batch.column(1)), runs, strict=False):
                near = np.flatnonzero(has(u))
                g = distinct(g[has(g)]) if g is not None and len(g) else u[:0]
                if len(near) or len(g):
                    k = part(len(u)) if len(u) else 0
                    # levels of what is near follow from the whole set
                    rows.append((r, k, u[near].tobytes(), levels(u)[near].tobytes(), g.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["doc_id", "band", "near", "lev", "short"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(d.mapInArrow(slim(search), "doc_id long, band int, near binary, lev binary, short binary").withColumn("_doc", F.monotonically_increasing_id()))

    def counted(batches):
        """Documents by shingle, a row a batch."""
        for batch in batches:
            h = np.concatenate([*(np.frombuffer(x.as_buffer(), "<u8") for c in batch.columns for x in c), np.zeros(0, "<u8")])
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "docs"])

    held = found.select("near", "short").mapInArrow(slim(counted), "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs"))
    wanted = written(searched(asked, fixed, held, threshold, miss))
    kinds = [(r["band"], r["half"]) for r in wanted.where(F.col("band") != SHORT).select("band", "half").distinct().collect()]  # 32 * HALVINGS at most
    bits = [(k, j, half, signature_bits(k, j, threshold, miss, half)) for k in range(PARTS) for j, half in sorted(kinds)]
    longest = np.array([max((b for kk, _, _, b in bits if kk == k), default=-1) for k in range(PARTS)])
    still = Marks(wanted.select("hash")).test()

    def signatures(batches):
        """(hash, _doc, band, level) of what is searched for; runs of 1 to 4 words have the band of short items."""
        for batch in batches:
            near, short_ = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(i)] for i in (2, 4))
            n, m = [len(x) for x in near], [len(x) for x in short_]
            doc, k = np.array(batch.column(0)), np.array(batch.column(1))
            level = np.concatenate([*(np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(3)), np.zeros(sum(m), np.uint8)])
            h, of, part_ = np.concatenate([*near, *short_, np.zeros(0, "<u8")]), np.concatenate([np.repeat(doc, n), np.repeat(doc, m)]), np.concatenate([np.repeat(k, n), np.full(sum(m), SHORT)])
            keep = np.flatnonzero(((part_ == SHORT) | (level <= longest[part_])) & still(h))
            columns = (h[keep].view(np.int64), of[keep], part_[keep], level[keep])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["hash", "_doc", "k", "lev"])

    sent = found.select("_doc", "band", "near", "lev", "short").mapInArrow(slim(signatures), "hash long, _doc long, k int, lev int")
    table = spark.createDataFrame([*bits, *[(SHORT, SHORT, half, 64) for half in range(HALVINGS)]], "k int, band int, half int, bits int")
    pairs = candidates(sent, wanted, table)

    def confirm(batches):
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                near, item = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (3, 4))
                short_item = batch.column(2)[i].as_py() == SHORT
                n = 1 if short_item else int(np.isin(item, near, assume_unique=True).sum())
                if n >= threshold * len(item) - 1e-9:
                    rows.append((i, len(item), n, n / len(item)))
            at, size, n, share = zip(*rows, strict=True) if rows else ((),) * 4
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

    whole = pairs.join(fixed.select("_item", "item_id", "set"), "_item").join(found.select("_doc", "doc_id", "near"), "_doc")
    return whole.select("doc_id", "item_id", "band", "near", "set").mapInArrow(slim(confirm), "doc_id long, item_id long, n_item long, n_shared long, containment double")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents that contain no item, with their columns; rows without an id stay only if the text is clean."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))))
    hits = written(contained(keyed.select(F.col(key).alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(hits, key, "left_anti").select(*docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
