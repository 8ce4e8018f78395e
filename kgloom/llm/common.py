"""What the operators share: written tables, ranks, components, text hashing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ storage


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is
    unset, a temporary folder in local mode and the warehouse elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            path = "file://" + tempfile.mkdtemp(prefix="loom-")
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loom"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Texts go to Python workers in Arrow batches of about so many bytes (one longer text alone), unless the session was started with a limit of its own.
BATCH_BYTES = 2 << 20

#: Packed arrays make rows of megabytes: pages and row groups are closed by their bytes from the first row on, since what a page
#: takes is taken again by the compressor outside the heap, and kept there.
PARQUET = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small: what a batch takes outside the heap and in a worker doesn't grow with the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.sparkContext.getConf().contains(name):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def release() -> None:
    """Gives back to the system what this process has freed: Spark keeps workers for later tasks, and their heaps with them."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


#: Bytes of input after which a running task gives back memory too.
RELEASE_BYTES = 32 << 20


def slim(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow``, without memory that stays behind in the worker."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            n += b.nbytes
            yield b
            if n > RELEASE_BYTES:
                n = 0
                release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(seen(batches))
        finally:
            release()

    return run


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**PARQUET).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._loom_path = path
    return out


def drop_written(*dfs: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later plan reads, and lets Spark clean old shuffles."""
    for df in dfs:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._loom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected the plans that used them."""
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame, a_row: int = 2_000) -> int:
    """Catalyst's estimate of the input, or rows times ``a_row`` where it has none; for sizing buckets."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else df.count() * a_row


def buckets_for(df: DataFrame, each: int, least: int) -> int:
    """A number of buckets that grows with the input: one for ``each`` bytes, ``least`` at least."""
    return max(least, math.ceil(input_bytes(df) / each))


# -------------------------------------------------------------------- ranks


def rank_within(df: DataFrame, keys: list[str], order: list[str], rank: str, per_bucket: int = 200_000, least: int = 16) -> tuple[DataFrame, DataFrame]:
    """Gapless ranks from 0 within ``keys`` without gathering a key in one task. Returns the ranked rows, and the
    counts by key.

    Rows of a key are in the order of a hash of ``order``, then of ``order`` itself, so a rank depends on what the
    rows hold and not on where they lie. Alike rows are one row with a number until the end; a range of
    hashes is numbered by a window and starts after the ranges before it.
    """
    kept = df.columns
    alike = df.groupBy(*kept).agg(F.count(F.lit(1)).alias("_n"))
    alike = written(alike.withColumn("_hash", F.xxhash64(*order)))
    bits = max(least, math.ceil(alike.count() / per_bucket)).bit_length()
    bucketed = alike.withColumn("_bucket", F.shiftright("_hash", 64 - bits).cast("int"))
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))))
    counts = starts.groupBy(*keys).agg(F.sum("_size").alias("n"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_hash", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("_row", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    on = [placed[k].eqNullSafe(starts[k]) for k in keys] + [placed["_bucket"] == starts["_bucket"]]
    placed = placed.join(starts.hint("shuffle_hash"), on, "inner").select(*[placed[c] for c in kept], placed["_n"], (F.col("_start") + F.col("_row")).alias("_first"))
    # the rows of a large number leave in stretches, so that no array grows with it
    stretch = 10_000
    parts = placed.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(stretch))))
    nth = F.explode(F.sequence(F.col("_at"), F.least(F.col("_n"), F.col("_at") + stretch) - 1)).alias("_nth")
    ranked = parts.select(*kept, "_first", nth).select(*kept, (F.col("_first") + F.col("_nth")).cast("long").alias(rank))
    return ranked, counts


# ------------------------------------------------------------------ membership

#: A bitmap for membership has at most 2**MARK_BITS bits (8 MB); beyond a million members it lets more and more through.
MARK_BITS = 26


class Marks:
    """Which 64-bit hashes may be members: one bit for each value of their leading bits. Never wrong about a member."""

    def __init__(self, hashes: DataFrame):
        """``hashes`` has one long column; the bitmap is made by Spark and its size bounded whatever the input."""
        name = hashes.columns[0]
        n = hashes.count()
        self.bits = int(min(MARK_BITS, max(12, (64 * n).bit_length())))
        place = F.shiftrightunsigned(name, 64 - self.bits)
        words = hashes.where(F.col(name).isNotNull()).groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{name}`, {64 - self.bits}) & 63 as int))")).alias("b"))
        table = words.toArrow()  # 2**(bits - 6) rows of two numbers at most
        self.words = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        self.words[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
        self.shared = hashes.sparkSession.sparkContext.broadcast(self.words)

    def test(self):
        """A function of hashes (uint64) for use in tasks, which carries no bitmap itself."""
        bits, shared = np.uint64(64 - self.bits), self.shared

        def has(h: np.ndarray) -> np.ndarray:
            at = h >> bits
            return (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

        return has


def may_be_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``rows`` whose long ``key`` is among those of ``wanted``, and a few others: for a join to come, at every size."""
    test = Marks(wanted.select(F.xxhash64(wanted_key).alias("h"))).test()

    @F.pandas_udf("boolean")
    def near(h: pd.Series) -> pd.Series:
        return pd.Series(test(h.to_numpy().view(np.uint64)))

    return rows.where(near(F.xxhash64(key)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --------------------------------------------------------------- components


def union_pairs(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i] in ``parent``; roots are the smallest members."""
    while len(a):
        a, b = roots(parent, a), roots(parent, b)
        keep = a != b
        a, b = a[keep], b[keep]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        parent[x] = parent[up]
        x = parent[up]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, root), root the
    smallest node of the component; nodes without an edge don't appear.

    Each round every node points at its smallest neighbour and the edges are
    rewritten to the pointed-at nodes, so the graph shrinks at least by half;
    each round's tables are written. Joins read exchanges directly, so AQE can
    split a hub.
    """
    kind = edges.schema[a].dataType
    e = written(edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where("a <> b").distinct())
    mapping = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m"))
        point = written(nearest.select(F.col("a").alias("x"), F.least("a", "m").alias("p")))
        if mapping is None:
            new_map = point.select(F.col("x").alias("node"), F.col("p").alias("root"))
        else:
            new_map = mapping.join(point, mapping["root"] == point["x"], "left").select("node", F.coalesce("p", "root").alias("root"))
        new_map = written(new_map)
        left = e.join(point, e["a"] == point["x"]).select(F.col("p").alias("a2"), "b")
        moved = left.join(point, left["b"] == point["x"]).select("a2", F.col("p").alias("b2")).where("a2 <> b2")
        pairs = moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        new_e = written(pairs)
        drop_written(e, point, *([mapping] if mapping is not None else []))
        e, mapping = new_e, new_map
        if e.isEmpty():
            drop_written(e)
            return mapping


def follow(pointers: DataFrame, key: str) -> DataFrame:
    """(key, head, offset, ended) of chains: ``pointers`` has ``key``, ``to`` (null for the head of a chain) and the distance ``d`` to it.
    Pointers jump over twice as many rows each round; what doesn't end after the most rounds a chain can take runs in a
    circle and has ``ended`` false. Written."""
    jump = written(pointers.select(key, F.coalesce("to", key).alias("to"), F.when(F.col("to").isNull(), 0).otherwise(F.col("d")).cast("long").alias("d"), F.col("to").isNull().alias("ended")))
    for _ in range(jump.count().bit_length() + 1):
        if jump.where("NOT ended").isEmpty():
            break
        # heads are where they are; the others go on from where they point
        target = jump.select(F.col(key).alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("ended").alias("e2"))
        ahead = jump.where("NOT ended").drop("ended").join(target, "to").select(key, F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("e2").alias("ended"))
        moved = written(jump.where("ended").select(key, "to", "d", "ended").union(ahead))
        drop_written(jump)
        jump = moved
    return same_table(jump.withColumnsRenamed({"to": "head", "d": "offset"}), jump)


def same_table(view: DataFrame, table: DataFrame) -> DataFrame:
    """``view``, which reads the written ``table`` alone: ``drop_written`` knows it too."""
    view._loom_path = table._loom_path
    return view


# ------------------------------------------------------------- text hashing

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


BYTE_CODE = _table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's step and of its inverse, modulo 2^64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _STEP), ("down", _STEP_INVERSE)):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[i] the hash of the first i codes; see ``span_hash``."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the codes in [start, end), equal for equal codes."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def utf8_parts(array: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary array in runs of rows of up to ``most`` bytes (a longer
    row alone): (first row, row after the last, bytes, offsets). Nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first-word index by row of the words (runs without space or
    tab to carriage return) of concatenated rows; words don't cross rows."""
    n = len(data)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a word that is hashed in lanes of eight bytes; longer ones by a keyed digest.
LANES = 64
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x452821E638D01377, lanes_to: int = LANES) -> np.ndarray:
    """64-bit hashes of the bytes of spans: each lane of eight bytes goes through a mixer that also takes what came
    before, so spans don't collide by their structure, as they may under a polynomial modulo a power of two. Two
    given different spans have the same hash with a chance of about 2**-64."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(seed))
    for i in np.flatnonzero(size > lanes_to):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"words").digest(), "little")
    view, live, at = lanes(data), np.flatnonzero((size > 0) & (size <= lanes_to)), 0
    while len(live):
        x = view[starts[live] + at] & _TAIL[np.minimum(8, size[live] - at)]
        h[live] = mix((h[live] ^ x) * np.uint64(0xE7037ED1A0B428DB))
        at += 8
        live = live[size[live] > at]
    return h


SHINGLE = 5
_MULTIPLY = np.uint64(0xA0761D6478BD642F | 1)


def run_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that start at each word and end within them."""
    h = np.full(max(0, len(word) - n + 1), n, dtype=np.uint64)
    for j in range(n):
        h = mix(h * _MULTIPLY + word[j : len(h) + j])
    return h


def words_hashed(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, first word by row, hashes of the words with A-Z lowered) for runs of rows.
    Memory a byte of text is bounded whatever the text: some flags a byte and 8 bytes for each number of a word."""
    for first, after, data, offsets in utf8_parts(array):
        starts, ends, at = words_of(data, offsets)
        yield first, after, at, word_hashes(LOWER[data], starts, ends)


def shingles(array: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its 5-word shingles) for every row: A-Z lowered; 1 to 4 words give
    one hash, none give an empty set. Two given shingles are taken for one with a chance of about 2**-64."""
    for first, after, at, word in words_hashed(array):
        h = run_hashes(word, SHINGLE)
        for r in range(after - first):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= SHINGLE:
                yield first + r, distinct(h[a : b - SHINGLE + 1])
            else:
                yield first + r, run_hashes(word[a:b], b - a) if b > a else word[:0]


def grams(array: pa.Array, sizes: list[int]) -> Iterator[np.ndarray]:
    """For every row the hashes of its runs of so many words; a run of 1 to 4 words has the
    hash that ``shingles`` gives a text of just these words."""
    for first, after, at, word in words_hashed(array):
        runs = [run_hashes(word, n) for n in sizes]
        for r in range(after - first):
            a, b = int(at[r]), int(at[r + 1])
            yield np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(sizes, runs, strict=True)])


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_or_empty(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))
