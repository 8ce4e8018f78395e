"""Removal of repeated passages with suffix arrays.

Every byte that a string of ``width`` bytes covers which also starts anywhere
else, in the same document or another one, is removed. Equal strings meet in one
shard: a window of ``width`` bytes goes to the shard of the smallest hash among
its ``GRAM``-byte substrings, and neighbouring windows with the same smallest
hash travel as one segment.

1. Each document sends one record a segment: smallest hash, digest of the segment's
   bytes, place. A smallest hash that occurs once can't be in a repeated window.
   Equal segments are one segment with a number, which is repeated throughout if there
   are two; those that meet in one run of documents are reduced to one before
   anything is sent. What is left are segments that share their smallest hash with
   different ones or in themselves.
2. The bytes of those, and of one segment for each of the repeated contents that
   share a smallest hash with them, are sorted by a suffix array a shard
   (``suffixes``); permuted common prefixes of ``width`` bytes tell repeated windows.
3. Covered bytes are cut from the texts.

A smallest hash that very many different segments share, such as at the ends of a passage
that a third of all documents hold, would make one shard of them. Such segments are counted
window by window over 128-bit digests of the windows, which meet in no one task.

Equal texts are one text with a count: if it is long enough, all of it goes.
Texts are identified by 128 bits of their SHA-256, equal segments by their 64-bit digest
and their 64-bit smallest hash, windows of very frequent smallest hashes by 128 bits; all
other windows are compared byte by byte in the suffix arrays.

Defined results: null text is empty; documents shorter than ``width`` keep all;
repeated rows are equal texts; ids may be null or repeat; very long texts are read in
overlapping runs; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import BYTE_CODE, buckets_for, clean_shuffles, drop_written, may_be_in, prefix_hash, slim, span_hash, utf8_parts, word_hashes, written
from kgloom.llm.jaccard import row_key
from kgloom.llm.suffixes import permuted_common_prefixes, suffix_array

WIDTH = 200
GRAM = 40
LONGEST = 512  # windows in one segment
RUN = 1 << 19  # windows of a long text at once
#: Segments with one smallest hash in one shard, and bytes of records in one bucket; beyond, windows are counted.
HOT_SEGMENTS = 4096
HOT_BYTES = 16 << 20

ENTRY = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("fp", "<u8"), ("content", "<u8"), ("pos", "<u4"), ("windows", "<u2"), ("repeats", "u1")])
PIECE = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("fp", "<u8"), ("pos", "<u4"), ("windows", "<u2"), ("open", "u1")])


def text_key(raw: bytes) -> tuple[int, int]:
    d = hashlib.sha256(raw).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def sliding(x: np.ndarray, width: int, op: np.ufunc, worst: int) -> np.ndarray:
    """op over every run of ``width`` values."""
    n = len(x)
    pad = (-n) % width
    blocks = np.append(x, np.full(pad, worst, dtype=x.dtype)).reshape(-1, width)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of concatenated documents: row, start, windows, smallest hash, content hash and
    whether the smallest hash occurs more than once, for every segment."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    prefix = prefix_hash(BYTE_CODE[data])
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    span = width - gram + 1
    least = sliding(h, span, np.minimum, (1 << 64) - 1)  # of window i
    most = sliding(np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span, np.maximum, 0)
    minimal = np.flatnonzero(most[: len(h)] == h)
    start = np.ones(len(least), dtype=bool)
    start[1:] = least[1:] != least[:-1]
    # windows must lie in one document
    size = np.diff(offsets)
    valid = np.zeros(len(least) + 1, dtype=np.int64)
    has = size >= width
    np.add.at(valid, offsets[:-1][has], 1)
    np.add.at(valid, offsets[:-1][has] + size[has] - width + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    start[1:] |= ok[1:] & ~ok[:-1]
    start[offsets[:-1][has]] = True
    first = np.flatnonzero(start & ok)
    stop = np.flatnonzero(start)
    stop = np.append(stop, len(least))[np.searchsorted(stop, first) + 1]
    ends = np.append(np.flatnonzero(ok[:-1] & ~ok[1:]) + 1, len(least))
    stop = np.minimum(stop, ends[np.searchsorted(ends, first, side="right")])
    # long runs in parts
    parts = -(-(stop - first) // LONGEST)
    which = np.repeat(np.arange(len(first)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    s = first[which] + nth * LONGEST
    e = np.minimum(s + LONGEST, stop[which])
    fp = least[s]
    content = word_hashes(data, s, e + width - 1, 0x3F84D5B5B5470917, 1 << 62)
    lo, hi = np.searchsorted(minimal, s), np.searchsorted(minimal, e + width - gram)
    pair = np.repeat(np.arange(len(s)), hi - lo)
    m = np.arange(len(pair)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    hits = np.bincount(pair[h[minimal[m]] == fp[pair]], minlength=len(s))
    row = np.searchsorted(offsets, s, side="right") - 1
    return row, s - offsets[row], e - s, fp, content, hits > 1


def segments_of(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """``segments``, with a long row in overlapping runs."""
    if len(offsets) > 2 or len(data) < RUN + width:
        return segments(data, offsets, width, gram)
    found = []
    for low in range(0, len(data) - width + 1, RUN):
        part = data[low : low + RUN + width - 1]
        row, pos, *rest = segments(part, np.array([0, len(part)]), width, gram)
        found.append((row, pos + low, *rest))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def emit(docs: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """Rows (bucket, kind, id, n_bytes, key, data): kind 0 a document, kind 1 segments of a bucket by smallest hash,
    kind 2 segments that are known to be repeated, of a bucket by text; one of them goes with kind 1, marked by ``repeats`` 2."""
    names = ["bucket", "kind", "id", "doc_id", "n_bytes", "sha", "data"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        for batch in batches:
            ids, doc = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen = set()
            for first, after, data, offsets in utf8_parts(batch.column(2), 1 << 20):
                rows, keys, new = [], np.zeros((after - first, 2), dtype=np.int64), np.zeros(after - first, dtype=bool)
                for i in range(after - first):
                    raw = data[offsets[i] : offsets[i + 1]]
                    sha = hashlib.sha256(raw).digest()
                    keys[i] = np.frombuffer(sha, "<i8", 2)
                    new[i] = sha not in seen
                    seen.add(sha)
                    rows.append((int(keys[i, 1] % buckets), 0, ids[first + i], doc[first + i], len(raw), sha, None))
                row, pos, windows, fp, content, repeats = segments_of(data, offsets, width, gram)
                keep = new[row]
                e = np.empty(int(keep.sum()), dtype=ENTRY)
                e["hi"], e["lo"] = keys[row[keep], 0], keys[row[keep], 1]
                for f, x in (("fp", fp), ("content", content), ("pos", pos), ("windows", windows), ("repeats", repeats)):
                    e[f] = x[keep]
                e = e[np.lexsort((e["content"], e["fp"]))]
                first = starts_of(e["fp"], e["content"], e["windows"])
                number = np.cumsum(first) - 1
                many = np.bincount(number, minlength=1)[number] > 1
                rows += [(b, 2, None, None, None, None, x) for b, x in dealt(e["lo"][many] % buckets, as_pieces(e[many]))]
                e["repeats"] |= (2 * many).astype(np.uint8)
                e = e[first]
                to = (e["fp"] >> np.uint64(7)) % np.uint64(buckets)
                rows += [(b, 1, None, None, None, None, x) for b, x in dealt(to, e)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(row_key().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(slim(run), "bucket int, kind int, id long, doc_id long, n_bytes long, sha binary, data binary")


def dealt(bucket: np.ndarray, rows: np.ndarray):
    if len(rows):
        order = np.argsort(bucket, kind="stable")
        found, at = np.unique(bucket[order], return_index=True)
        for b, part in zip(found.tolist(), np.split(rows[order], at[1:]), strict=True):
            yield int(b), part.tobytes()


def starts_of(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def as_pieces(e: np.ndarray, open_: np.ndarray | int = 0) -> np.ndarray:
    p = np.empty(len(e), dtype=PIECE)
    for f in ("hi", "lo", "fp", "pos", "windows"):
        p[f] = e[f]
    p["open"] = open_
    return p


def unsifted(buckets: int):
    """The segments of buckets that are too large to sift, dealt by text."""

    def run(batches):
        for batch in batches:
            e = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in batch.column(0)] or [np.zeros(0, ENTRY)])
            rows = list(dealt(e["lo"] % buckets, as_pieces(e, 1)))
            b, x = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "data"])

    return run


def sifted(buckets: int):
    """Of a bucket's segments: those repeated throughout (kind 1), those to sort (kind 2) and those to count by windows
    (kind 3), dealt by text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in pdf["data"]])
        e = e[np.lexsort((-e["repeats"].astype(np.int8), e["pos"], e["lo"], e["hi"], e["content"], e["fp"]))]
        e = e[starts_of(e["fp"], e["content"], e["hi"], e["lo"], e["pos"])]  # a text sends its segments from every copy
        same_fp, same = np.cumsum(starts_of(e["fp"])) - 1, np.cumsum(starts_of(e["fp"], e["content"], e["windows"])) - 1
        count = np.bincount(same)[same]
        repeated = (count > 1) | (np.bincount(same, weights=e["repeats"] & 2)[same] > 0)
        open_ = ~repeated & ((np.bincount(same_fp)[same_fp] > 1) | (e["repeats"] > 0))
        n_open = np.bincount(same_fp, weights=open_)[same_fp]
        left = open_ | (repeated & starts_of(same) & (n_open > 0))
        out = []
        for kind, take in ((1, repeated), (2, left & (n_open <= HOT_SEGMENTS)), (3, left & (n_open > HOT_SEGMENTS))):
            out += [(b, kind, x) for b, x in dealt(e["lo"][take] % buckets, as_pieces(e[take], open_[take]))]
        return pd.DataFrame(out, columns=["bucket", "kind", "data"])

    return run


def by_text(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a text with all its pieces."""
    p = np.concatenate([np.frombuffer(x, PIECE) for x in pdf["data"]])
    p = p[np.lexsort((p["pos"], p["lo"], p["hi"]))]
    at = np.append(np.flatnonzero(starts_of(p["hi"], p["lo"])), len(p))
    return pd.DataFrame([(int(p["hi"][a]), int(p["lo"][a]), p[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], columns=["hi", "lo", "pieces"])


def cut_pieces(buckets: int, width: int):
    """Rows (bucket, pieces, bytes) of the texts' pieces, by smallest hash."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                raw = batch.column(0)[i].as_py().encode()
                hi, lo = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if text_key(raw) != (hi, lo):
                    continue
                for p in np.frombuffer(batch.column(3)[i].as_buffer(), PIECE):
                    start = int(p["pos"])
                    rows.append((int((int(p["fp"]) >> 7) % buckets), p.tobytes(), raw[start : start + int(p["windows"]) + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "piece", "raw"])

    return run


def sort_shard(buckets: int, width: int):
    """A shard's suffix array over its pieces; repeated windows of open pieces, dealt by text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.frombuffer(b"".join(pdf["piece"]), PIECE)
        order = np.lexsort((p["pos"], p["lo"], p["hi"]))
        order = order[starts_of(p["hi"][order], p["lo"][order], p["pos"][order])]
        p, raw = p[order], pdf["raw"].to_numpy()[order]
        # 0: the end, 1: the end of a piece, then the bytes
        t = (np.frombuffer(b"".join(x + b"\0" for x in raw), dtype=np.uint8).astype(np.int32)) + 2
        length = np.array([len(x) + 1 for x in raw])
        at = np.cumsum(length) - length
        t[at + length - 1] = 1
        t = np.append(t, 0)
        sa = suffix_array(t)
        plcp = permuted_common_prefixes(t, sa, width, at)
        again = plcp == width  # as the suffix before
        hit = again.copy()
        hit[sa[:-1]] |= again[sa[1:]]  # as the suffix after
        # windows start where a whole window is left in the piece
        window = np.zeros(len(t) + 1, dtype=np.int64)
        np.add.at(window, at, 1)
        np.add.at(window, at + p["windows"].astype(np.int64), -1)
        hit &= np.cumsum(window)[:-1] > 0
        piece = np.searchsorted(at, np.flatnonzero(hit), side="right") - 1
        where = np.flatnonzero(hit)
        keep = p["open"][piece] > 0
        piece, where = piece[keep], where[keep]
        run_start = starts_of(piece) | np.append(True, np.diff(where) != 1) if len(where) else np.zeros(0, bool)
        first = np.flatnonzero(run_start)
        out = np.empty(len(first), dtype=PIECE)
        of = piece[first]
        for f in ("hi", "lo", "fp"):
            out[f] = p[f][of]
        out["pos"] = p["pos"][of] + (where[first] - at[of]).astype(np.uint32)
        out["windows"] = np.diff(np.append(first, len(where)))
        out["open"] = 0
        return pd.DataFrame([(b, 1, x) for b, x in dealt(out["lo"] % buckets, out)], columns=["bucket", "kind", "data"])

    return run


def windows_of(width: int):
    """(d1, d2, hi, lo, pos): a digest of every window of the texts' pieces, each place once."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                raw = batch.column(0)[i].as_py().encode()
                hi, lo = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if text_key(raw) != (hi, lo):
                    continue
                p = np.frombuffer(batch.column(3)[i].as_buffer(), PIECE)
                n = p["windows"].astype(np.int64)
                at = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p["pos"].astype(np.int64), n))
                data = np.frombuffer(raw, dtype=np.uint8)
                d = [word_hashes(data, at, at + width, seed, 1 << 62).view(np.int64) for seed in (0x9216D5D98979FB1B, 0xD1310BA698DFB5AC)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, d), pa.array(np.full(len(at), hi)), pa.array(np.full(len(at), lo)), pa.array(at)], names=["d1", "d2", "hi", "lo", "pos"])

    return run


def window_pieces(buckets: int):
    """Single windows as pieces, dealt by text."""

    def run(batches):
        for batch in batches:
            p = np.zeros(len(batch), dtype=PIECE)
            for i, f in enumerate(("hi", "lo", "pos")):
                p[f] = np.array(batch.column(i))
            p["windows"] = 1
            rows = list(dealt(p["lo"] % buckets, p))
            b, x = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "data"])

    return run


def covered(pieces: np.ndarray, width: int) -> np.ndarray:
    """Disjoint [start, end) of the bytes that the windows cover."""
    order = np.argsort(pieces["pos"], kind="stable")
    s = pieces["pos"][order].astype(np.int64)
    e = s + pieces["windows"][order].astype(np.int64) + width - 1
    reach = np.maximum.accumulate(e)
    new = np.append(True, s[1:] > reach[:-1])
    return np.stack([s[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])], axis=1)


def removed(width: int):
    """(hi, lo, n_removed, n_spans, sha, kept text) of the texts with covered bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                raw = batch.column(0)[i].as_py().encode()
                hi, lo = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if text_key(raw) != (hi, lo):
                    continue
                spans = covered(np.frombuffer(batch.column(3)[i].as_buffer(), PIECE), width)
                cut = np.append(0, spans.ravel()).tolist() + [len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True))
                rows.append((hi, lo, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["hi", "lo", "n_removed", "n_spans", "kept", "spans"])

    return run


EMPTY = hashlib.sha256(b"").hexdigest()


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (packed byte ranges) of every document."""
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs, 1 << 22, 64)
    base = written(emit(docs, buckets, width, gram))
    profile = base.where("kind = 0").select("id", "doc_id", "n_bytes", "sha")
    keyed = base.where("kind = 0").select("id", "sha", "n_bytes")
    classes = written(keyed.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes")))
    entries = base.where("kind = 1").select("bucket", "data")
    hot = written(entries.groupBy("bucket").agg(F.sum(F.octet_length("data")).alias("n")).where(F.col("n") > HOT_BYTES).select("bucket"))
    some_hot = not hot.isEmpty()
    small = entries.join(hot, "bucket", "left_anti") if some_hot else entries
    sift = written(small.groupBy("bucket").applyInPandas(sifted(buckets), "bucket int, kind int, data binary"))
    to_count = sift.where("kind = 3").select("bucket", "data")
    if some_hot:
        to_count = to_count.union(entries.join(hot, "bucket", "left_semi").select("data").mapInArrow(slim(unsifted(buckets)), "bucket int, data binary"))
    clean_shuffles(spark)

    def with_keys(batches):
        for batch in batches:
            k = np.array([np.frombuffer(x.as_buffer(), "<i8", 2) for x in batch.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), *batch.columns], names=["hi", "lo", "sha", "rep", "copies", "n_bytes"])

    named = written(classes.select("sha", "rep", "copies", "n_bytes").mapInArrow(slim(with_keys), "hi long, lo long, sha binary, rep long, copies long, n_bytes long"))
    d = docs.select(row_key().alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))

    def of_texts(pieces: DataFrame) -> DataFrame:
        wanted = written(pieces.groupBy("bucket").applyInPandas(by_text, "hi long, lo long, pieces binary").join(named.select("hi", "lo", "rep"), ["hi", "lo"]))
        # texts that nobody wants stay where they are
        near = may_be_in(d, "_id", wanted, "rep")
        return near.join(wanted.hint("merge"), near["_id"] == wanted["rep"]).select("_text", "hi", "lo", "pieces")

    to_sort = of_texts(sift.where("kind = 2").select("bucket", "data"))
    sorted_ = written(to_sort.mapInArrow(slim(cut_pieces(buckets, width)), "bucket int, piece binary, raw binary").groupBy("bucket").applyInPandas(sort_shard(buckets, width), "bucket int, kind int, data binary"))
    clean_shuffles(spark)
    found = sift.where("kind = 1").select("bucket", "data").union(sorted_.select("bucket", "data")).union(base.where("kind = 2").select("bucket", "data"))
    if some_hot or not to_count.isEmpty():
        windows = written(of_texts(to_count).mapInArrow(slim(windows_of(width)), "d1 long, d2 long, hi long, lo long, pos long"))
        twice = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
        found = found.union(windows.join(twice, ["d1", "d2"]).select("hi", "lo", "pos").mapInArrow(slim(window_pieces(buckets)), "bucket int, data binary"))
    cuts = of_texts(found).mapInArrow(slim(removed(width)), "hi long, lo long, n_removed long, n_spans long, kept string, spans binary").dropDuplicates(["hi", "lo"])
    results = named.join(cuts, ["hi", "lo"], "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    results = written(
        results.select(
            "sha",
            F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(all_gone, F.lit(EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
            "spans",
        )
    )
    drop_written(sift, sorted_)
    return profile.join(results, "sha").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
