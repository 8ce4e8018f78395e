"""N-gram Jaccard join by universe partition.

A document's set holds the hashes of its distinct 5-word shingles. The hash
universe is cut in equal segments; how many depends on the size band (powers of
two) of the larger set of a pair, so a set takes part in its own band and, when
it is large enough to have partners there, in the next one. Sets r and s with
Jaccard >= 3/4 differ in at most ``budget(r)`` elements, and each of those
spoils at most one of r's non-empty segments, so

* r shares at least ``segments(r) - budget(r)`` segment subsets exactly. A set
  that shares fewer with all others together has no partner and drops out;
* the allocation is by cost: of a set's segments only the ``budget + 1`` whose
  subsets are rarest are probed, and segments that nobody shares cost nothing;
* a set whose segments are too few for the pigeonhole also probes with the
  one-deletion neighbourhoods of its segments of two or more elements, each of
  which counts twice; in a band with a set for which that isn't enough either,
  every element is a segment of its own, which is always enough.

Sets that meet in a probed group are in one cluster; clusters are joined
independently, by counting common elements over an inverted index of the whole
sets. In a cluster the members are first compared with a few of them, and only
members outside the largest component so far are compared with all, so a family
of near copies costs a multiple of its size and no link between different texts
is lost. A cluster with many elements is cut in chunks, a task each, which all hold
a few of the cluster's sets; members that are outside the largest component after
that go to the other chunks, too. Only a spanning forest of the links leaves a
task. Equal sets are one class from the start.

Shingles are compared by 64-bit hashes (two given different shingles are taken
for one with a chance of about 2^-64) and sets are identified by 80 bits.

Defined results: null text and text without words have an empty set, linked
with nothing; repeated rows are equal sets and rows with one doc_id are one
node; a null doc_id takes part, is larger than any other (ids are below 2^62)
and gives a null component_id only where the whole class has none; very long
texts are sets like others; an empty table gives no rows; other columns, whatever
their names, are ignored by ``join_classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import buckets_for, clean_shuffles, components, drop_written, fresh, may_be_in, mix, roots, shingles, slim, small_batches, union_pairs, utf8_parts, written

#: Sets of fewer elements than this (as a power of two) get so many more segments that nearly every element has its own.
SMALL_BANDS, SMALL_EXTRA = 6, 4
#: Rows without a doc_id get a key from here on, made from their text.
NO_ID = 1 << 62

SET = np.dtype([("hi", "<u2"), ("lo", "<u8"), ("scheme", "u1"), ("n", "<u4"), ("segments", "<u4")])
#: Before packed hashes: whose they are, and how many. ``share`` ranks pivots (a logarithm of what a set shares).
HEAD = np.dtype([("hi", "<u2"), ("lo", "<u8"), ("scheme", "u1"), ("share", "u1"), ("count", "<u2")])
PROFILE = np.dtype([("id", "<i8"), ("hi", "<u2"), ("lo", "<u8"), ("n", "<u4")])
#: Members of a cluster that are compared with all others at the start.
PIVOTS = 8
#: Elements in one chunk of a cluster, and how many of its sets all chunks hold.
CHUNK = 1 << 18
COMMON = 4


def segment_bits(scheme: int, extra: int = SMALL_EXTRA) -> int:
    return scheme + extra if scheme < SMALL_BANDS else scheme


def schemes(n: int) -> list[int]:
    """The bands in which a set of n elements has partners, by the larger set's size."""
    own = n.bit_length() - 1
    return [own, own + 1] if 2 * n >= 3 << own else [own]


def budget(n: int, scheme: int) -> int:
    """The most elements in which a set of n and a partner in this band can differ: (|r|+|s|)/7, |s| <= 4|r|/3."""
    return min(n // 3, (n + (2 << scheme) - 1) // 7)


def identity(u: np.ndarray) -> tuple[int, int]:
    a = np.bitwise_xor.reduce(mix(u + np.uint64(0x243F6A8885A308D3))) if len(u) else np.uint64(0)
    b = mix(u ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64) if len(u) else np.uint64(0)
    return int(mix(np.array([a ^ np.uint64(len(u))]))[0]) & 0xFFFF, int(b)


def segment_starts(u: np.ndarray, bits: int) -> np.ndarray:
    segment = u >> np.uint64(64 - bits)
    return np.append(0, np.flatnonzero(segment[1:] != segment[:-1]) + 1)


def subset_hashes(u: np.ndarray, scheme: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every non-empty segment's subset, and where the subsets start."""
    starts = segment_starts(u, bits)
    sums = np.add.reduceat(mix(u), starts)
    return mix(sums + (u[starts] >> np.uint64(64 - bits)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme)), starts


def deletion_hashes(u: np.ndarray, scheme: int, bits: int) -> np.ndarray:
    """The hashes of the segments' subsets with one element less, for subsets of two elements or more."""
    starts = segment_starts(u, bits)
    sizes = np.diff(np.append(starts, len(u)))
    m = mix(u)
    sums = np.repeat(np.add.reduceat(m, starts), sizes) - m
    h = mix(sums + (u >> np.uint64(64 - bits)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme))
    return h[np.repeat(sizes, sizes) >= 2]


# -------------------------------------------------- 1: sets, and shared subsets


def row_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID >> 1)))


def element_hashes(u: np.ndarray, scheme: int) -> np.ndarray:
    return mix(u * np.uint64(0x2545F4914F6CDD1D) + np.uint64(scheme))


def emit(docs: DataFrame, buckets: int, extra: int, again: dict[int, bool] | None = None) -> DataFrame:
    """Rows (bucket, kind, data). Kind 0: the documents' sets. Kind 1: subset hashes with a
    table of the sets they are of. Kind 4: the tables alone, by set. Kind 2: sets whose segments are too few for the
    pigeonhole; ``segments`` is then 1 where deletions don't help either.

    With ``again`` (bands, and whether elements are needed) only kind 1 for those bands: subsets and one-deletion
    neighbourhoods, or single elements; ``share`` then says whether a set lacks some.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            text = batch.column(1)
            for first, after, _, _ in utf8_parts(text, 1 << 23):
                rows, out, seen, table, hashes, owner = [], [], set(), [], [], []
                for r, u in shingles(text.slice(first, after - first)):
                    hi, lo = identity(u)
                    n = len(u)
                    rows.append((ids[first + r], hi, lo, n))
                    if not n or (hi, lo) in seen:
                        continue
                    seen.add((hi, lo))
                    for k in schemes(n):
                        bits = segment_bits(k, extra)
                        if again is not None and k not in again:
                            continue
                        h, starts = subset_hashes(u, k, bits)
                        few = len(h) < budget(n, k) + 1
                        if again is not None:
                            h = element_hashes(u, k) if again[k] else np.concatenate([h, deletion_hashes(u, k, bits)])
                        elif few:
                            more = int((np.diff(np.append(starts, n)) >= 2).sum())
                            out.append((lo % buckets, 2, np.array([(hi, lo, k, n, len(h) + more < budget(n, k) + 1)], dtype=SET).tobytes()))
                        owner.append(np.full(len(h), len(table), dtype=np.uint32))
                        table.append((hi, lo, k, n, int(few) if again is not None else len(h)))
                        hashes.append(h & ~np.uint64(0xFFFF))
                if again is None:
                    rows = np.array(rows, dtype=PROFILE)
                    part = rows["lo"] % np.uint64(16)
                    out += [(int(rows["lo"][part == p][0] % np.uint64(buckets)), 0, rows[part == p].tobytes()) for p in np.unique(part)]
                if table:
                    table, hashes, owner = np.array(table, dtype=SET), np.concatenate(hashes), np.concatenate(owner)
                    out += [(b, 1, x) for b, x in dealt((hashes >> np.uint64(20)) % np.uint64(buckets), heads(table), hashes, owner)]
                    if again is None:
                        home = table["lo"] % np.uint64(buckets)
                        out += [(int(b), 4, table[home == b].tobytes()) for b in np.unique(home)]
                yield batch_of(out)

    return small_batches(docs).select(row_key().alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(slim(run), "bucket int, kind int, data binary")


def dealt(bucket: np.ndarray, table: np.ndarray, hashes: np.ndarray, owner: np.ndarray):
    """(bucket, packed hashes) for every bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    for b, i, j in zip(found.tolist(), at, np.append(at[1:], len(order)), strict=True):
        yield int(b), pack(table, hashes[order[i:j]], owner[order[i:j]])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    b, k, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "kind", "data"])


def heads(table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(table), dtype=HEAD)
    for f in ("hi", "lo", "scheme"):
        out[f] = table[f]
    out["share"] = np.minimum(table["segments"], 255)
    return out


def pack(table: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> bytes:
    """Hashes by owner after a head for each owner of ``table`` that has some; the
    lowest 16 bits, where all are 0, are left out."""
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], hashes[order]
    who, first = np.unique(owner, return_index=True)
    sizes = np.diff(np.append(first, len(owner)))
    parts = -(-sizes // 65535)
    head = table[np.repeat(who, parts)].copy()
    head["count"] = 65535
    head["count"][np.cumsum(parts) - 1] = sizes - 65535 * (parts - 1)
    wide = bool((hashes & np.uint64(0xFFFF)).any())
    raw = hashes if wide else np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 2:])
    return np.array([len(head), wide], dtype="<u4").tobytes() + head.tobytes() + raw.tobytes()


def unpack(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All owners of the blobs (one row each, merged), and for every hash its owner's row and the hash."""
    found, hashes = [], []
    for x in blobs:
        n, wide = (int(v) for v in np.frombuffer(x, "<u4", 2))
        found.append(np.frombuffer(x, HEAD, n, 8))
        raw = np.frombuffer(x, np.uint8, -1, 8 + n * HEAD.itemsize)
        full = np.zeros((len(raw) // (8 if wide else 6), 8), dtype=np.uint8)
        full[:, 0 if wide else 2 :] = raw.reshape(len(full), -1)
        hashes.append(full.view("<u8").ravel())
    head, h = np.concatenate(found), np.concatenate(hashes)
    first, same = merged(head)
    return head[first], np.repeat(same, head["count"]), h


def merged(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct (hi, lo, scheme), in their order, and every row's number among them."""
    order = np.lexsort((head["scheme"], head["hi"], head["lo"]))
    new = np.ones(len(head), dtype=bool)
    for i, f in enumerate(("lo", "hi", "scheme")):
        x = head[f][order]
        new[1:] = (x[1:] != x[:-1]) if i == 0 else new[1:] | (x[1:] != x[:-1])
    same = np.empty(len(head), dtype=np.int64)
    same[order] = np.cumsum(new) - 1
    return order[new], same


def groups_of(h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, set) in order of the hash, and the size of each one's hash group."""
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[keep], who[keep]
    start = np.ones(len(h), dtype=bool)
    start[1:] = h[1:] != h[:-1]
    group = np.cumsum(start) - 1
    return h, who, np.bincount(group, minlength=1)[group] if len(h) else np.zeros(0, int)


def shared(buckets: int):
    """Passes the other kinds on; of kind 1 keeps hashes that two sets or more have, dealt to the sets' buckets with their group sizes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        other = pdf[pdf["kind"] != 1]
        out = list(zip(other["bucket"], other["kind"], other["data"], strict=True))
        blobs = pdf["data"][pdf["kind"] == 1]
        if len(blobs):
            head, who, h = unpack(blobs)
            h, who, size = groups_of(h & ~np.uint64(0xFFFF), who)
            more = size > 1
            h, who, size = h[more], who[more], size[more]
            # the low 16 bits now hold the group's size, 65535 at most: it only ranks
            h = (h & ~np.uint64(0xFFFF)) | np.minimum(size, 0xFFFF).astype(np.uint64)
            out += [(b, 1, x) for b, x in dealt(head["lo"][who] % np.uint64(buckets), head, h, who)]
        return pd.DataFrame(out, columns=["bucket", "kind", "data"])

    return run


# ------------------------------------------------------------- 2: survivors


def survive(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets that share enough subsets to have a partner, with their shared hashes;
    the lowest bit says whether to probe."""
    head, who, h = unpack(pdf["data"][pdf["kind"] == 1])
    table = np.concatenate([np.frombuffer(x, SET) for x in pdf["data"][pdf["kind"] == 4]])
    table = table[merged(table)[0]]
    # both are in the order of (lo, hi, scheme), and every set has its row in the table
    every = np.concatenate([heads(table), head])
    place = merged(every)[1][len(table) :]
    info = table[place]
    order = np.lexsort((h & np.uint64(0xFFFF), who))
    h, who = h[order], who[order]
    mine = np.bincount(who, minlength=len(head))
    n, band = info["n"].astype(np.int64), info["scheme"].astype(np.int64)
    most = np.minimum(n // 3, (n + (2 << band) - 1) // 7)
    probes = most + 1 - (info["segments"].astype(np.int64) - mine)  # segments that no other set has are probed for nothing
    nth = np.arange(len(h)) - np.repeat(np.cumsum(mine) - mine, mine)
    score = np.bincount(who, weights=(h & np.uint64(0xFFFF)).astype(float), minlength=len(head))
    keep = probes[who] > 0
    probe = nth[keep] < probes[who[keep]]
    h, who = (h[keep] & ~np.uint64(0xFFFF)) | probe.astype(np.uint64), who[keep]
    head["share"] = np.minimum(8 * np.log2(score + 1), 255)
    return head, who, h


def surviving(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf["kind"] == 1).any():
            return pd.DataFrame({"bucket": [], "data": []})
        head, who, h = survive(pdf)
        out = list(dealt((h >> np.uint64(20)) % np.uint64(buckets), head, h, who))
        return pd.DataFrame(out, columns=["bucket", "data"])

    return run


def star(buckets: int):
    """Each member of a probed hash group with the member that shares most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head, who, h = unpack(pdf["data"])
        probe, h = (h & np.uint64(0xFFFF)) > 0, h >> np.uint64(16)
        order = np.lexsort((head["lo"][who], -head["share"][who].astype(np.int64), h))
        h, who, probe = h[order], who[order], probe[order]
        if not len(h):
            return pd.DataFrame({"bucket": [], "data": []})
        first = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(first) - 1
        asked = np.bincount(group, weights=probe)[group] > 0
        pivot = who[first][group]
        return edges_dealt(head, np.stack([who, pivot], axis=1)[asked], buckets)

    return run


def edges_dealt(head: np.ndarray, pairs: np.ndarray, buckets: int) -> pd.DataFrame:
    """Distinct pairs of sets, packed by bucket. Here 64 bits tell sets apart: a collision only makes a cluster larger."""
    e = np.sort(head["lo"][pairs].astype(np.uint64), axis=1)
    e = np.unique(e[e[:, 0] != e[:, 1]], axis=0) if len(e) else e.reshape(0, 2)
    to = (e[:, 0] ^ e[:, 1]) % np.uint64(buckets)
    return pd.DataFrame([(int(t), e[to == t].tobytes()) for t in np.unique(to)], columns=["bucket", "data"])


EDGE = "a long, b long"


def edge_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    e = np.unique(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in pdf["data"]]), axis=0)
    return pd.DataFrame(e, columns=["a", "b"])


# ---------------------------------------------------------- 3: verification


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (hi, lo, rep, root, chunks) with the sets' elements, read again from the documents."""

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            take, data = [], []
            for r, u in shingles(batch.column(0)):
                if signed(identity(u)) == keys[r]:
                    take.append(r)
                    data.append(u.tobytes())
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array(data, pa.binary())], names=["hi", "lo", "rep", "root", "chunks", "elements"])

    d = docs.select(row_key().alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    # texts that nobody wants stay where they are
    near = may_be_in(d, "_id", wanted, "rep")
    found = near.join(wanted, near["_id"] == wanted["rep"]).select("_text", "hi", "lo", "rep", "root", "chunks")
    return found.mapInArrow(slim(run), "hi long, lo long, rep long, root long, chunks int, elements binary")


def signed(pair: tuple[int, int]) -> tuple[int, int]:
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in pair)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 4 * len(small) < 3 * len(large):
        return False
    at = np.searchsorted(large, small)
    inside = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * inside >= 75 * (len(a) + len(b) - inside)


def cluster_forest(sets: list[np.ndarray]) -> np.ndarray:
    """The root of every set in the components of similar sets, as positions."""
    g = len(sets)
    parent = np.arange(g)
    sizes = np.array([len(x) for x in sets])
    if g == 2:
        if similar(*sets):
            parent[1] = 0
        return parent
    elements, owner = np.concatenate(sets), np.repeat(np.arange(g), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    number = np.cumsum(np.append(True, elements[1:] != elements[:-1])) - 1
    starts = np.append(np.flatnonzero(np.append(True, elements[1:] != elements[:-1])), len(elements))
    mine = np.empty(len(order), dtype=np.int64)
    mine[order] = number
    offsets = np.append(0, np.cumsum(sizes))

    def compare(r: int) -> None:
        ids = mine[offsets[r] : offsets[r + 1]]
        length = starts[ids + 1] - starts[ids]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts[ids], length)
        common = np.bincount(owner[at], minlength=g)
        near = np.flatnonzero(100 * common >= 75 * (sizes[r] + sizes - common))
        union_pairs(parent, np.full(len(near), r), near)

    central = np.bincount(owner, weights=(starts[number + 1] - starts[number]).astype(float), minlength=g) / np.maximum(1, sizes)
    pivots = np.unique(np.append(np.argsort(-central, kind="stable")[: PIVOTS // 2], np.linspace(0, g - 1, PIVOTS // 2).astype(int)))
    for r in pivots:
        compare(int(r))
    done = set(pivots.tolist())
    root = roots(parent, np.arange(g))
    main = int(np.bincount(root).argmax())
    for r in range(g):
        if r not in done and int(roots(parent, np.array([r]))[0]) != int(roots(parent, np.array([main]))[0]):
            compare(r)
    return roots(parent, np.arange(g))


def cluster_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links in each cluster of a task, between representatives."""
    pdf = pdf.drop_duplicates(["hi", "lo"]).sort_values(["root", "hi", "lo"])
    root, rep = pdf["root"].to_numpy(), pdf["rep"].to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in pdf["elements"]]
    at = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(root))
    a, b = [], []
    for i, j in zip(at[:-1], at[1:], strict=True):
        if j - i > 1:
            found = cluster_forest(sets[i:j])
            moved = np.flatnonzero(found != np.arange(j - i))
            a.append(rep[i + moved])
            b.append(rep[i + found[moved]])
    return pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}, dtype="int64")


# ------------------------------------------------------- where segments are few


def asked_groups(buckets: int):
    """Each member of a hash group with one of them, where a member lacks segments: sets that meet are in one cluster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head, who, h = unpack(pdf["data"])
        h, who, size = groups_of(h >> np.uint64(16), who)
        h, who = h[size > 1], who[size > 1]
        if not len(h):
            return pd.DataFrame({"bucket": [], "data": []})
        first = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(first) - 1
        asked = np.bincount(group, weights=head["share"][who] > 0)[group] > 0
        return edges_dealt(head, np.stack([who, who[first][group]], axis=1)[asked], buckets)

    return run


# ------------------------------------------------- clusters of several chunks


def query_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links of a chunk's sets with the sets that ask (column ``asks``)."""
    pdf = pdf.drop_duplicates(["hi", "lo"])
    asks, rep = pdf["asks"].to_numpy(dtype=bool), pdf["rep"].to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in pdf["elements"]]
    base = np.flatnonzero(~asks)
    if not len(base) or not asks.any():
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sizes = np.array([len(x) for x in sets])
    elements, owner = np.concatenate([sets[i] for i in base]), np.repeat(base, sizes[base])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    parent = np.arange(len(sets))
    for r in np.flatnonzero(asks):
        low, high = np.searchsorted(elements, sets[r], "left"), np.searchsorted(elements, sets[r], "right")
        n = high - low
        common = np.bincount(owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)], minlength=len(sets))
        near = np.flatnonzero((common > 0) & (100 * common >= 75 * (sizes[r] + sizes - common)))
        union_pairs(parent, np.full(len(near), r), near)
    found = roots(parent, np.arange(len(sets)))
    moved = np.flatnonzero(found != np.arange(len(sets)))
    return pd.DataFrame({"a": rep[moved], "b": rep[found[moved]]}, dtype="int64")


def cluster_edges(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """Links that span the components of similar sets in every cluster. ``wanted``: hi, lo, rep, root, chunks."""
    sets = sets_of(docs, wanted)
    mine = F.pmod(F.xxhash64("hi", "lo"), F.col("chunks")).cast("int")
    # small clusters share tasks; a large one has a task for each chunk, and some of its sets are in all of them
    large = wanted.where("chunks > 1")
    common = [F.min_by(F.struct("hi", "lo"), F.xxhash64("hi", "lo", F.lit(i))).alias(f"p{i}") for i in range(COMMON)]
    pivots = written(large.groupBy("root").agg(*common).select(F.explode(F.array_distinct(F.array(*[F.col(f"p{i}") for i in range(COMMON)]))).alias("p")).select("p.hi", "p.lo", F.lit(True).alias("pivot")))
    everywhere = sets.join(pivots, ["hi", "lo"], "left")
    chunk = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(mine))
    task = F.when(F.col("chunks") == 1, F.pmod("root", F.lit(4 * buckets))).otherwise(F.col("root"))
    dealt_sets = everywhere.select(task.alias("task"), F.explode(chunk).alias("i"), "hi", "lo", "rep", "root", "elements")
    links = written(dealt_sets.groupBy("task", "i").applyInPandas(cluster_links, EDGE))
    if large.isEmpty():
        return links
    so_far = components(links)
    labelled = written(large.join(so_far.withColumnRenamed("root", "comp"), F.col("rep") == F.col("node"), "left").select(*large.columns, F.coalesce("comp", "rep").alias("comp")))
    main = labelled.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"))
    rest = written(labelled.join(main, "root").where("comp <> main").select("hi", "lo", "root").withColumn("outside", F.lit(True)))
    if rest.isEmpty():
        return links
    again = labelled.join(rest.select("root").distinct(), "root", "left_semi").select("hi", "lo", "rep", "root", "chunks")
    flagged = sets_of(docs, written(again)).join(rest.select("hi", "lo", "outside"), ["hi", "lo"], "left")
    own = F.struct(mine.alias("i"), F.lit(False).alias("asks"))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != mine), lambda k: F.struct(k.alias("i"), F.lit(True).alias("asks")))
    places = F.when(F.col("outside"), F.concat(F.array(own), others)).otherwise(F.array(own))
    asked = flagged.select("root", "hi", "lo", "rep", "elements", F.explode(places).alias("p")).select("root", "p.i", "p.asks", "hi", "lo", "rep", "elements")
    return written(links.union(asked.groupBy("root", "i").applyInPandas(query_links, EDGE)))


# -------------------------------------------------------------------- the join


def joined(docs: DataFrame, extra: int = SMALL_EXTRA, buckets: int | None = None) -> DataFrame:
    """id (see ``row_key``), n_shingles and comp, the smallest id of its component, of every document."""
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs, 1 << 23, 48)
    base = written(emit(docs, buckets, extra).groupBy("bucket").applyInPandas(shared(buckets), "bucket int, kind int, data binary"))

    def profiles(batches):
        for batch in batches:
            rows = np.concatenate([np.frombuffer(x.as_buffer(), PROFILE) for x in batch.column(0)] or [np.zeros(0, PROFILE)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[f]).astype("<u8").view(np.int64)) for f in ("id", "hi", "lo", "n")], names=["id", "hi", "lo", "n"])

    profile = base.where("kind = 0").select("data").mapInArrow(slim(profiles), "id long, hi long, lo long, n long")
    classes = written(profile.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n")))
    clean_shuffles(spark)
    hashes = base.where("kind in (1, 4)").select("bucket", "kind", "data")
    blob = "bucket int, data binary"
    alive = hashes.groupBy("bucket").applyInPandas(surviving(buckets), blob)
    edges = alive.groupBy("bucket").applyInPandas(star(buckets), blob).groupBy("bucket").applyInPandas(edge_rows, EDGE)
    few = base.where("kind = 2").select(F.substring("data", 11, 1).alias("band"), F.substring("data", 16, 1).alias("elements")).distinct().collect()  # two rows a band: 128 at most
    if few:
        need: dict[int, bool] = {}
        for r in few:
            need[r["band"][0]] = need.get(r["band"][0], False) or r["elements"][0] > 0
        again = emit(docs, buckets, extra, need).select("bucket", "data")
        edges = edges.union(again.groupBy("bucket").applyInPandas(asked_groups(buckets), blob).groupBy("bucket").applyInPandas(edge_rows, EDGE))
    clusters = components(written(edges))
    clean_shuffles(spark)
    members = written(classes.join(clusters, F.col("lo") == F.col("node")).select("hi", "lo", "rep", "root", "n"))
    sizes = written(members.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks")))
    wanted = written(members.join(sizes, "root").select("hi", "lo", "rep", "root", "chunks"))
    final = components(cluster_edges(docs, wanted, buckets))
    known = written(classes.join(final, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("root", "rep").alias("comp")))
    drop_written(members, sizes, wanted, classes)
    clean_shuffles(spark)
    out = profile.where("n > 0").join(known, ["hi", "lo"], "left")
    # empty sets are alike and link with nothing: they don't meet in the join
    alone = profile.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("comp"))
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("comp")).union(alone)


def join_classes(docs: DataFrame, extra: int = SMALL_EXTRA, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document of ``docs`` (doc_id, text)."""
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return joined(docs, extra, buckets).select(real("id").alias("doc_id"), "n_shingles", real("comp").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns. Rows with one id and text are one document, of which the
    row with the least hash of all columns stays; of different texts with one id the one with the least hash has the id, and the others are documents
    without one: they stay unless they are near copies, and so does their id in the result."""
    key, own, least = fresh(docs, "_key"), fresh(docs, "_own"), fresh(docs, "_least")
    again = written(docs.groupBy(row_key().alias(key)).agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("n > 1"))
    mixed = again.where("lo <> hi").select(key, F.col("lo").alias(least))
    rows = docs.withColumn(own, F.col("doc_id"))
    if not mixed.isEmpty():
        other = F.col(least).isNotNull() & (F.xxhash64("text") != F.col(least))
        named = F.when(other, F.lit(NO_ID) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(NO_ID >> 1))).otherwise(F.col("doc_id"))
        rows = rows.join(mixed, rows["doc_id"] == mixed[key], "left").withColumn("doc_id", named).drop(key, least)
        again = rows.groupBy(row_key().alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = written(joined(rows).where("comp < id").select(F.col("id").alias(key)).distinct())
    kept = rows.withColumn(key, row_key()).join(rest, key, "left_anti")
    if not again.isEmpty():
        columns = kept.columns
        several = kept.join(again.select(key), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
        kept = kept.join(again.select(key), key, "left_anti").select(*columns).union(several.select(*columns))
    return kept.withColumn("doc_id", F.col(own)).select(*docs.columns)


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
