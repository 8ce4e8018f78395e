"""Exact joins and approximate searches by cosine, over cells around trained centres.

Centres come from Lloyd steps on a bounded sample, the square root of the vectors in number. A vector belongs to the
nearest centre. For the join, a vector can only have a partner in another cell if two bounds allow it: its angle to the cell's centre less
the cell's radius, and its distance to the plane between the two centres. Cells share bins, which are compared in chunks, cell by cell; inside a chunk
the products of the first coordinates (those that vary most) bound the whole ones, which are made only where
the bound reaches the threshold. Nothing is missed, and what can't be bounded is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.vectors import doubles, norm
from kgloom.sources.readers import drop, kept

#: Vectors of the sample for each centre, and most centres of one length of vectors.
PER_CENTRE = 64
MOST_CENTRES = 2048
STEPS = 6
SLACK = 1e-9
#: Cells of a bin, at most, as each is a bit of a long; vectors that are dealt at a time, and rows of a batch that they make.
MOST_CELLS = 60
SLICE = 1024
DEALT_ROWS = 8192
#: Rows of a part of the list index, and queries that it is asked at a time.
PART_ROWS = 32_768
PART_QUERIES = 4096


def spherical_means(x: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """``k`` unit centres of unit vectors by Lloyd steps; a centre without vectors stays where it is."""
    rng = np.random.default_rng(5)
    c = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(steps if len(x) > k else 0):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v, dim) of the vectors with a norm, in double precision."""
    rows = df.select(F.col(key).alias("k"), doubles(F.col(vector)).alias("v"), F.size(vector).alias("dim"))
    return rows.where((F.col("dim") > 0) & F.coalesce(norm(F.col("v")) > 0, F.lit(False)) & F.coalesce(norm(F.col("v")) < float("inf"), F.lit(False)))


def unit_rows(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy())
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def trained(rows: DataFrame, lists: int | None = None) -> dict[int, np.ndarray]:
    """Centres by length of the vectors (k, v, dim); ``lists`` of them, or the square root of the vectors of the length."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    many = {dim: int(np.clip(lists or math.isqrt(n), 1, min(MOST_CENTRES, n))) for dim, n in sizes.items()}
    if not many:
        return {}
    wanted = rows.sparkSession.createDataFrame([(dim, n, PER_CENTRE * many[dim]) for dim, n in sizes.items()], "dim int, n long, take long")
    near = rows.join(F.broadcast(wanted), "dim").where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) * F.col("n") <= F.col("take") * (1 << 20))
    found: dict[int, list] = {}
    for r in near.select("dim", "v").orderBy("dim", F.xxhash64("k"), "k").collect():  # PER_CENTRE * MOST_CENTRES vectors a length, about
        found.setdefault(r["dim"], []).append(r["v"])
    return {dim: spherical_means(unit_rows(pd.Series(v)), many[dim]) for dim, v in sorted(found.items())}


def bounds(x: np.ndarray, centres: np.ndarray, radius: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell, and for each cell whether a vector within ``angle`` may be there."""
    dot = x @ centres.T
    own = dot.argmax(axis=1)
    apart = np.arccos(np.clip(dot, -1, 1))
    near = apart - radius[None, :] <= angle + SLACK
    # chords: d(v, q)^2 = 2 - 2 v.q, and the plane between two centres is half their difference away
    chord = math.sqrt(max(0.0, 2 - 2 * math.cos(min(angle, math.pi))))
    between = np.sqrt(np.maximum(1e-12, 2 - 2 * (centres @ centres.T)))
    near &= (dot[np.arange(len(x)), own][:, None] - dot) / between[own] <= chord + SLACK
    near[np.arange(len(x)), own] = True
    return own, near


def bins_of(held: np.ndarray, rows: int) -> np.ndarray:
    """The first cells of bins: cells one after the other as long as they hold ``rows`` vectors together, MOST_CELLS at most."""
    first, n = [0], 0
    for c, size in enumerate(held.tolist()):
        if c > first[-1] and (n + size > rows or c - first[-1] == MOST_CELLS):
            first.append(c)
            n = 0
        n += size
    return np.array(first)


def dealt(rows: DataFrame, centres: dict[int, np.ndarray], cosine: float, block_rows: int | None = None, own_cells: bool = False) -> DataFrame:
    """(dim, bin, i, j, side, cell, mask, k, v): cells share bins, and each vector is a host (side 0) in its own one and a guest (side 1) of each bin
    with cells that it is compared with: its own cell and those with a smaller number that the bounds leave, or the former only with ``own_cells``.
    Hosts of a bin are dealt in chunks i, guests in chunks j, of ``block_rows`` (a sixteenth of the vectors, 4096 to 32,768, where none are given), so a vector is sent
    as often as there are chunks, however many cells. ``mask`` has the places of a guest's cells in the bin. ``cell`` is a host's place there, and a guest's
    where the hosts are the chunk that it is in itself (else -1)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # MOST_CENTRES vectors a length
    angle = math.acos(max(-1.0, min(1.0, cosine)))
    radius = {dim: np.full(len(c), -10.0) for dim, c in centres.items()}
    held = {dim: np.zeros(len(c), dtype=np.int64) for dim, c in centres.items()}

    def grouped(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for dim, every in pdf.groupby("dim").indices.items():
            for at in np.array_split(every, -(-len(every) // SLICE)) if dim in shared.value else []:
                yield int(dim), at, unit_rows(pdf["v"].iloc[at])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, _, x in grouped(pdf):
                dot = x @ shared.value[dim].T
                own = dot.argmax(axis=1)
                yield pd.DataFrame({"dim": dim, "cell": own, "r": np.arccos(np.clip(dot[np.arange(len(x)), own], -1, 1)), "n": 1})

    for r in rows.mapInPandas(measure, "dim int, cell int, r double, n long").groupBy("dim", "cell").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect():  # a row a centre
        radius[r["dim"]][r["cell"]], held[r["dim"]][r["cell"]] = r["r"], r["n"]
    if block_rows is None:
        block_rows = int(np.clip(max([0, *(h.sum() for h in held.values())]) // 16, 4096, 32_768))
    first = {dim: bins_of(h, block_rows) for dim, h in held.items()}
    chunks = {dim: np.maximum(1, -(-np.add.reduceat(h, first[dim]) // block_rows)) for dim, h in held.items()}
    parties = {dim: np.ones_like(c) for dim, c in chunks.items()}

    def visited(dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own bin and own place in it, and the mask of the cells in each bin."""
        own, near = bounds(x, shared.value[dim], radius[dim], angle)
        cells = np.arange(near.shape[1])
        near &= (held[dim] > 0)[None, :] & ((cells[None, :] == own[:, None]) if own_cells else (cells[None, :] <= own[:, None]))
        bin_ = np.searchsorted(first[dim], cells, side="right") - 1
        place = cells - first[dim][bin_]
        return bin_[own], place[own], np.add.reduceat(near.astype(np.int64) << place[None, :], first[dim], axis=1)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, _, x in grouped(pdf):
                n = (visited(dim, x)[2] != 0).sum(axis=0)
                yield pd.DataFrame({"dim": dim, "bin": np.flatnonzero(n), "n": n[n > 0]})

    for r in rows.mapInPandas(visits, "dim int, bin int, n long").groupBy("dim", "bin").agg(F.sum("n").alias("n")).collect():  # a row a bin
        parties[r["dim"]][r["bin"]] = max(1, -(-r["n"] // block_rows))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spread = pd.util.hash_array(pdf["k"].to_numpy()).astype(np.uint64) >> np.uint64(8)
            for dim, at, x in grouped(pdf):
                own, place, masks = visited(dim, x)
                mine = (spread[at] % chunks[dim][own].astype(np.uint64)).astype(np.int64)
                rows_: list[tuple[np.ndarray, ...]] = []

                def put(*columns, rows_=rows_):
                    rows_.append(tuple(np.broadcast_to(c, len(columns[0])) for c in columns))

                every = np.arange(len(x))
                for j in range(int(parties[dim][own].max())):
                    host = every[j < parties[dim][own]]
                    put(host, own[host], mine[host], j, 0, place[host], 0)
                v, b = np.nonzero(masks)
                party = (spread[at][v] % parties[dim][b].astype(np.uint64)).astype(np.int64)
                for i in range(int(chunks[dim][b].max())):
                    some = i < chunks[dim][b]
                    # within a cell the chunks up to the vector's own one
                    at_home = (own[v] == b) & (i == mine[v])
                    mask = np.where((own[v] == b) & (i > mine[v]), masks[v, b] & ~(1 << place[v]), masks[v, b])
                    some &= mask != 0
                    put(v[some], b[some], i, party[some], 1, np.where(at_home, place[v], -1)[some], mask[some])
                take, bin_, i, j, side, cell, mask = (np.concatenate(y) for y in zip(*rows_, strict=True))
                for to in range(0, len(take), DEALT_ROWS):
                    s = slice(to, to + DEALT_ROWS)
                    yield pd.DataFrame({"dim": dim, "bin": bin_[s], "i": i[s], "j": j[s], "side": side[s], "cell": cell[s], "mask": mask[s], "k": pdf["k"].to_numpy()[at[take[s]]], "v": [y.tobytes() for y in x[take[s]]]})

    return rows.mapInPandas(deal, f"dim int, bin int, i int, j int, side int, cell int, mask long, k {rows.schema['k'].dataType.simpleString()}, v binary")


def compared(parts: DataFrame) -> DataFrame:
    """(dim, pairs): how many pairs the chunks of ``dealt`` hold."""
    key = ["dim", "bin", "i", "j", "place"]
    hosts = parts.where("side = 0").groupBy(*key[:4], F.col("cell").alias("place")).agg(F.count(F.lit(1)).alias("x"))
    places = F.filter(F.sequence(F.lit(0), F.lit(MOST_CELLS - 1)), lambda b: F.call_function("shiftright", "mask", b).bitwiseAND(1) == 1)
    guests = parts.where("side = 1").withColumn("place", F.explode(places)).groupBy(*key).agg(F.count(F.lit(1)).alias("y"), F.count_if(F.col("cell") == F.col("place")).alias("same"))
    return hosts.join(guests, key).groupBy("dim").agg(F.sum(F.col("x") * (F.col("y") - F.col("same")) + (F.col("x") - 1) * F.col("same") / 2).cast("long").alias("pairs"))


def matches(parts: DataFrame, cosine: float) -> DataFrame:
    """(a, b, similarity) of the pairs in ``parts`` with a cosine of at least ``cosine``, a < b; similarity is (cosine + 1) / 2. Pairs
    leave in batches, so what a task holds is bounded by its chunks."""
    kind = parts.schema["k"].dataType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns: dict[str, list] = {c: [] for c in ("side", "cell", "mask", "k", "v")}
        for pdf in batches:
            for c in ("side", "cell", "mask", "k"):
                columns[c].append(pdf[c].to_numpy())
            columns["v"].append(np.frombuffer(b"".join(pdf["v"]), dtype="<f8").reshape(len(pdf), -1))
        side, cell, mask, k, x = (np.concatenate(columns.pop(c)) for c in ("side", "cell", "mask", "k", "v"))
        # the coordinates that vary most come first, so that the rest has short vectors
        order = np.argsort(-x.var(axis=0), kind="stable")
        head = max(1, x.shape[1] // 4)
        h, t = x[:, order[:head]], x[:, order[head:]]
        rest = np.sqrt((t * t).sum(axis=1))
        hosts, guests = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for place in np.unique(cell[hosts]):
            left, right = hosts[cell[hosts] == place], guests[(mask[guests] >> place) & 1 == 1]
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                for to in range(0, len(right), 4096):
                    others = right[to : to + 4096]
                    part = h[some] @ h[others].T
                    i, j = np.nonzero(part + rest[some][:, None] * rest[others][None, :] >= cosine - SLACK)
                    if len(i) > 0.1 * part.size:
                        i, j = np.nonzero((score := x[some] @ x[others].T) >= cosine - SLACK)
                        score = score[i, j]
                    else:
                        score = np.einsum("ij,ij->i", x[some[i]], x[others[j]])
                    one, two, score = k[some[i]], k[others[j]], (score + 1) / 2
                    # the members of a chunk of a cell meet twice
                    fine = (score >= (cosine + 1) / 2) & np.where(cell[others[j]] == place, one < two, one != two)
                    one, two = one[fine], two[fine]
                    if len(one):
                        yield pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "similarity": score[fine]})

    # the number of parts is given: a chunk's bytes say nothing about the work that it makes
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["dim", "bin", "i", "j"]
    return parts.repartition(n, *key).groupBy(*key).applyInPandas(compare, f"a {kind}, b {kind}, similarity double")


def pairs_above(df: DataFrame, key: str, vector: str, threshold: float, block_rows: int | None = None, centres: dict[int, np.ndarray] | None = None) -> DataFrame:
    """All pairs a < b with unit cosine of ``threshold`` or more.

    Defined results: vectors without a norm, with a null or a component that is not finite are in no pair; vectors of different lengths aren't compared;
    rows that share a key aren't compared with each other; a null key is in no pair; an empty table gives no rows."""
    rows = usable(df.where(F.col(key).isNotNull()), key, vector)
    cosine = 2 * threshold - 1
    return matches(dealt(rows, trained(rows) if centres is None else centres, cosine, block_rows), cosine)


def best_pairs(df: DataFrame, key: str, vector: str, threshold: float, most: int, block_rows: int | None = None, digits: int = 9) -> DataFrame:
    """The ``most`` most similar pairs of those above ``threshold``, ties by keys.

    The pairs inside the cells come first: where they are many enough, the similarity of the last one that is needed bounds the
    threshold of the join from below, so it compares far fewer."""
    rows = usable(df.where(F.col(key).isNotNull()), key, vector)
    centres = trained(rows)
    floor = 2 * threshold - 1
    inner = matches(dealt(rows, centres, floor, block_rows, own_cells=True), floor)
    steps = inner.groupBy(F.floor(F.col("similarity") * 10_000).alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect()  # 10,001 at most
    have, least = 0, threshold
    for r in steps:
        have += r["n"]
        if have >= most:
            least = max(threshold, r["s"] / 10_000)
            break
    every = pairs_above(df, key, vector, least, block_rows, centres)
    return every.orderBy(F.desc(F.round("similarity", digits)), "a", "b").limit(most)


class ListIndex:
    """An inverted-file index: vectors belong to lists around trained centres, whose number grows with the square root of the table, and
    are kept as product-quantized residuals: ``parts`` pieces of the difference to the centre, each the number of the nearest of
    ``codes`` trained pieces. A query looks into the ``probes`` nearest lists, ranks their rows by the codes and the best of those again by
    the vectors themselves. More probes and a longer list to rank again find more."""

    def __init__(self, df: DataFrame, key: str, vector: str, lists: int | None = None, parts: int = 8, codes: int = 64):
        self.key, rows = key, usable(df, key, vector)
        self.centres = trained(rows, lists)
        self.books = self.trained_codes(rows, parts, codes)
        kind = rows.schema["k"].dataType.simpleString()
        centres, books = self.centres, self.books

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, at in pdf.groupby("dim").indices.items():
                    x = unit_rows(pdf["v"].iloc[at])
                    own = (x @ centres[dim].T).argmax(axis=1)
                    code = np.stack([nearest(piece, book) for piece, book in zip(np.array_split(x - centres[dim][own], len(books[dim]), axis=1), books[dim], strict=True)], axis=1).astype(np.uint8)
                    yield pd.DataFrame({"dim": dim, "list": own, "k": pdf["k"].to_numpy()[at], "code": [c.tobytes() for c in code]})

        self.rows = kept(rows.mapInPandas(encode, f"dim int, list int, k {kind}, code binary"), "index")
        self.vectors = rows

    def trained_codes(self, rows: DataFrame, parts: int, codes: int) -> dict[int, list[np.ndarray]]:
        """Code books by length from a bounded sample: 16 vectors for each code, about."""
        sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
        if not sizes:
            return {}
        wanted = rows.sparkSession.createDataFrame(list(sizes.items()), "dim int, n long")
        near = rows.join(F.broadcast(wanted), "dim").where(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1 << 20)) * F.col("n") <= F.lit(16 * codes * (1 << 20)))
        found: dict[int, list] = {dim: [] for dim in sizes}
        for r in near.select("dim", "v").orderBy("dim", F.xxhash64("k"), "k").collect():  # 16 * codes vectors a length, about
            found[r["dim"]].append(r["v"])
        books = {}
        for dim, v in found.items():
            x = unit_rows(pd.Series(v)) if v else self.centres[dim]
            left = x - self.centres[dim][(x @ self.centres[dim].T).argmax(axis=1)]
            books[dim] = [plain_means(p, codes) for p in np.array_split(left, min(parts, dim), axis=1)]
        return books

    def search(self, queries: DataFrame, k: int, probes: int = 8, again: int = 10) -> DataFrame:
        """(query, key, similarity): up to ``k`` rows for each of ``queries`` (query, q), best first by cosine, then key; ``again * k`` are ranked again."""
        asked = queries.select("query", doubles(F.col("q")).alias("q"), F.size("q").alias("dim"))
        kind, key_kind = asked.schema["query"].dataType.simpleString(), self.rows.schema["k"].dataType.simpleString()
        centres, books = self.centres, self.books

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, at in pdf.groupby("dim").indices.items():
                    if dim not in centres:
                        continue
                    x = unit_rows(pdf["q"].iloc[at])
                    near = np.argsort(-(x @ centres[dim].T), axis=1, kind="stable")[:, :probes]
                    lists = np.zeros((len(x), len(centres[dim])), dtype=np.uint8)
                    np.put_along_axis(lists, near, 1, axis=1)
                    yield pd.DataFrame({"dim": dim, "lists": [b.tobytes() for b in np.packbits(lists, axis=1)], "query": pdf["query"].to_numpy()[at], "q": [v.tobytes() for v in x]})

        # rows are dealt in parts whatever their lists, so no part holds a long list and each names its best rows for all lists together
        n = self.rows.count()
        split = max(16, -(-n // PART_ROWS))
        crowds = max(1, -(-asked.count() // PART_QUERIES))
        crowd = F.pmod(F.xxhash64("query"), F.lit(crowds)).cast("int")
        places = asked.mapInPandas(probe, f"dim int, lists binary, query {kind}, q binary").select("*", crowd.alias("crowd"), F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("part"))
        listed = self.rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(split)).cast("int")).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
        most = again * k

        def rank(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query": [], "k": [], "near": []})
            if rows.empty or asks.empty:
                return none
            dim = int(key[0])
            rows = rows.sort_values(["list", "k"])
            keys, of = rows["k"].to_numpy(), rows["list"].to_numpy()
            code = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
            # what the codes say the vectors are
            x = centres[dim][of] + np.concatenate([book[code[:, p]] for p, book in enumerate(books[dim])], axis=1)
            lists, start = np.unique(of, return_index=True)
            stop = np.append(start[1:], len(of))
            q = np.frombuffer(b"".join(asks["q"]), dtype="<f8").reshape(len(asks), -1)
            probed = np.unpackbits(np.frombuffer(b"".join(asks["lists"]), dtype=np.uint8).reshape(len(asks), -1), axis=1)
            names, out = asks["query"].to_numpy(), []
            for at in range(0, len(q), 256):
                some, looks = q[at : at + 256], probed[at : at + 256].astype(bool)
                near = np.full((len(some), len(x)), -np.inf)
                for one, a, b in zip(lists, start, stop, strict=True):
                    who = np.flatnonzero(looks[:, one])
                    near[who, a:b] = some[who] @ x[a:b].T
                # all that are as near as the last one of the best; which of them are taken is left to the keys
                least = np.partition(near, -most, axis=1)[:, -most, None] if most < near.shape[1] else -np.inf
                i, j = np.nonzero((near >= least) & (near > -np.inf))
                out.append(pd.DataFrame({"query": names[at + i], "k": keys[j], "near": near[i, j]}))
            return pd.concat(out)

        hits = listed.groupBy("dim", "part", "crowd").cogroup(places.groupBy("dim", "part", "crowd")).applyInPandas(rank, f"query {kind}, k {key_kind}, near double")
        first = hits.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "k"))).where(F.col("n") <= most).select("query", "k")
        exact = first.join(self.vectors.select("k", "v"), "k").join(asked.select("query", "q"), "query")
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        scored = exact.select("query", "k", (dot / (norm(F.col("v")) * norm(F.col("q")))).alias("similarity"))
        w = Window.partitionBy("query").orderBy(F.desc("similarity"), "k")
        return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("query", F.col("k").alias(self.key), "similarity")

    def drop(self) -> None:
        drop(self.rows)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (2 * x @ book.T - (book * book).sum(axis=1)[None, :]).argmax(axis=1)


def plain_means(x: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(steps if len(x) > k else 0):
        own = nearest(x, c)
        total, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c
