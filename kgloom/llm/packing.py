"""Best-fit packing of token sequences by linear grouping.

A document's ids (and the closing id) are cut in full pieces of ``capacity``
and a last piece. Planning needs only how many pieces there are of each length,
a histogram of at most ``capacity`` entries whatever the input:

1. lengths above ``small`` are large; sorted downwards they are dealt to
   ``groups`` groups of equal cardinality and rounded up to the longest of the
   group;
2. few sizes are left, for which configurations (multisets that fit one
   sequence) are optimised as a linear programme by column generation, whole
   multiples of the configurations are used, and what rounding down leaves is
   packed best-fit;
3. actual documents replace the rounded sizes, and small ones go best-fit into
   the gaps.

Everything is kept as runs of alike sequences, so plans stay small and pieces
find their place from their rank among those of their length.

Defined results: null and empty text give the closing id alone; very long texts
give as many full pieces as they need and one last piece; a null doc_id is kept;
repeated rows are packed each, and pieces of one length take their places in the
order of their contents; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import rank_within, slim, small_batches

CAPACITY = 2048

# -------------------------------------------------------------- tokenization


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of a BPE with word ends, whose merges never cross words.

    White space always ends a word, so ids are remembered by white-space chunk
    and only unseen chunks are encoded; ``chunks_kept`` and ``bytes_kept`` bound
    the memory, after which remembering starts anew, and long chunks aren't
    remembered. The vocabulary's merges run in tiktoken, with a zero byte for the
    end of a word; texts that hold that byte, a special token's opening, a
    separator control or a code point that Python's tables don't know (the
    tokenizer's may be newer) go to the tokenizer itself.
    """

    #: The splitting pattern of the tokenizer file: fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    LONG = 256

    def __init__(self, path: str, chunks_kept: int = 150_000, bytes_kept: int = 16 << 20):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.chunks_kept, self.bytes_kept, self.held = chunks_kept, bytes_kept, 0
        self.find = regex.compile(self.PATTERN).findall
        self.odd = re.compile("<\\||[\x00\x1c-\x1f\u03a3]").search
        # a class beyond the first plane is tested range by range, so only texts that reach there meet it
        self.unknown = re.compile(f"[{unassigned(0, 0xFFFF)}]").search
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.unknown_beyond = re.compile(f"[{unassigned(0x10000, sys.maxunicode)}]").search
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks, self.ends = {}, np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for word, i in vocabulary.items():
            if word not in special:
                body, last = (word[:-4], b"\0") if word.endswith("</w>") else (word, b"")
                ranks[bytes(byte_of[c] for c in body) + last] = i
                self.ends[i] = bool(last)
        ranks[b"\0"] = len(self.ends)  # never left over: a byte and its end merge first
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.odd(text) or not text.isascii() and (self.unknown(text) or self.beyond(text) and self.unknown_beyond(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        chunks = text.lower().split()
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > self.chunks_kept or self.held > self.bytes_kept:
                known.clear()
                self.held = 0
            missing = list({c for c in chunks if c not in known})
            split = [self.find(c) for c in missing]
            ids = np.array(self.merge(" ".join([w + "\0" for words in split for w in words])), dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum([len(words) for words in split])
            at, raw = 0, ids.tobytes()
            for c, n in zip(missing, upto.tolist(), strict=True):
                to = 4 * int(stops[n - 1]) if n else 0
                known[c] = raw[at:to]
                self.held += len(c) + to - at
                at = to
            out = b"".join([known[c] for c in chunks])
            for c in missing:
                if len(c) > self.LONG:
                    self.held -= len(c) + len(known.pop(c))
            return out


def unassigned(least: int, most: int) -> str:
    """A pattern's character class of the code points from ``least`` to ``most`` without a category in Python's tables."""
    ranges, first = [], None
    for c in range(least, most + 2):
        none = c <= most and unicodedata.category(chr(c)) == "Cn"
        if none and first is None:
            first = c
        elif not none and first is not None:
            ranges.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(ranges)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer a Python worker, so that tasks share what it remembers."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([closing], dtype="<u4").tobytes()

    def cut(batches):
        encode = tokenizer_at(tokenizer_path).encode
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for to, value in zip(rows, (doc, p, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(slim(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------------ planning


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` of most value that fits: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, dtype=np.int64)
    for i, (s, v) in enumerate(zip(sizes.tolist(), value.tolist(), strict=True)):
        for _ in range(capacity // s):
            got = best[:-s] + v
            better = got > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = got[better]
            last[s:][better] = i
    out = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    while last[room] >= 0:
        out[last[room]] += 1
        room -= int(sizes[last[room]])
    return float(value @ out), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each: the linear programme of least
    sequences that covers ``demand``, by column generation from the simplex basis."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / (capacity // sizes))
    x = (inverse * demand).sum(axis=1)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        gain, column = best_pattern(sizes, np.maximum(dual, 0), capacity)
        if gain <= 1 + 1e-9:
            break
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        # the basis changes in one column: its inverse follows by one elimination step
        row = inverse[out] / step[out]
        step[out] = 0
        inverse -= step[:, None] * row
        inverse[out] = row
        x = (inverse * demand).sum(axis=1)
    return basis.astype(np.int64), x


class Runs:
    """Groups of alike sequences: (first sequence, how many, tokens used)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.next = 0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first, count)
        self.placed: list[tuple[int, int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)

    def put(self, length: int, first: int, bins: int, each: int, offset: int) -> None:
        """``each`` pieces of ``length`` in each of ``bins`` sequences from ``first``; offset: of the first."""
        lo = self.used[length]
        self.used[length] += bins * each
        self.placed.append((length, lo, lo + bins * each, first, each, offset))

    def best_fit(self, length: int, count: int) -> None:
        """``count`` pieces into the tightest gaps, then into new sequences."""
        while count:
            room = min((r for r in self.free if r >= length and self.free[r]), default=None)
            if room is None:
                first, bins, room = self.next, -(-count // (self.capacity // length)), self.capacity
                self.next += bins
            else:
                first, bins = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room]
            each = min(room // length, count)
            whole = min(bins, count // each)
            self.put(length, first, whole, each, self.capacity - room)
            count -= whole * each
            self.leave(room - each * length, first, whole)
            if bins > whole:
                rest = count if count < each else 0
                if rest:
                    self.put(length, first + whole, 1, rest, self.capacity - room)
                    self.leave(room - rest * length, first + whole, 1)
                    count = 0
                    self.leave(room, first + whole + 1, bins - whole - 1)
                else:
                    self.leave(room, first + whole, bins - whole)

    def leave(self, room: int, first: int, bins: int) -> None:
        if bins and room:
            self.free[room].append((first, bins))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 128, small: int | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, first, each, offset): piece number r of ``length``, lo <= r < hi,
    goes to sequence first + (r - lo) // each at offset + (r - lo) % each * length."""
    small = capacity // 6 if small is None else small
    left = {int(k): int(v) for k, v in histogram.items() if v}
    runs = Runs(capacity)
    if n := left.pop(capacity, 0):
        runs.put(capacity, 0, n, 1, 0)
        runs.next = n
    large = sorted((k for k in left if k > small), reverse=True)
    total = sum(left[k] for k in large)
    if total:
        # groups of equal cardinality: a length may be split between two
        edges = [total * (g + 1) // groups for g in range(groups)]
        members: list[list[list[int]]] = []
        seen, g, now = 0, 0, []
        for k in large:
            n = left[k]
            while n:
                while edges[g] <= seen:
                    if now:
                        members.append(now)
                        now = []
                    g += 1
                take = min(n, edges[g] - seen)
                now.append([k, take])
                n -= take
                seen += take
        members.append(now)
        sizes = np.array([m[0][0] for m in members], dtype=np.int64)
        demand = np.array([sum(c for _, c in m) for m in members], dtype=np.float64)
        merged = defaultdict(list)
        for s, m in zip(sizes, members, strict=True):
            merged[int(s)] += m
        sizes = np.array(sorted(merged, reverse=True), dtype=np.int64)
        members = [merged[int(s)] for s in sizes]
        demand = np.array([sum(c for _, c in m) for m in members], dtype=np.float64)
        patterns, times = configurations(sizes, demand, capacity)
        for j in range(len(sizes)):
            use = int(times[j] + 1e-9)
            column = patterns[:, j]
            if use <= 0 or not column.any():
                continue
            fill = [g for g in range(len(sizes)) for _ in range(int(column[g]))]
            while use > 0 and all(sum(c for _, c in members[g]) >= fill.count(g) for g in set(fill)):
                # the longest run of sequences that get the same actual lengths
                heads, bins, at = [], use, defaultdict(int)
                for g in fill:
                    while members[g] and not members[g][0][1]:
                        members[g].pop(0)
                take = []
                for g in sorted(set(fill)):
                    need = fill.count(g)
                    i = 0
                    while need:
                        length, have = members[g][i]
                        each = need if have >= need and i == 0 else min(need, have)
                        if each:
                            take.append((g, i, length, each))
                            bins = min(bins, have // each)
                            need -= each
                        i += 1
                bins = max(1, bins)
                first, offset = runs.next, 0
                runs.next += bins
                for g, i, length, each in take:
                    members[g][i][1] -= bins * each
                    runs.put(length, first, bins, each, offset)
                    offset += each * length
                runs.leave(capacity - offset, first, bins)
                use -= bins
        for k in large:
            left[k] = 0
        for m in members:
            for k, c in m:
                left[k] += c
    for k in sorted(left, reverse=True):
        if left[k]:
            runs.best_fit(k, left[k])
    return runs.placed


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer_path or default_tokenizer(), capacity, closing)
    ranked, counts = rank_within(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    rows = plan({r["length"]: r["n"] for r in counts.collect()}, capacity)  # at most ``capacity`` rows
    table = spark.createDataFrame(rows, "_length long, _lo long, _hi long, _first long, _each long, _at long")
    fits = (ranked["length"] == table["_length"]) & (ranked["_rank"] >= table["_lo"]) & (ranked["_rank"] < table["_hi"])
    nth = F.col("_rank") - F.col("_lo")
    # the plan's rows follow from capacity and groups, not from the input
    return ranked.join(F.broadcast(table), fits).select(*cut.columns, (F.col("_first") + F.expr("(_rank - _lo) div _each")).alias("sequence_id"), (F.col("_at") + nth % F.col("_each") * F.col("length")).alias("offset"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
