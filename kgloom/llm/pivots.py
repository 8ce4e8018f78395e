"""Embedding near-duplicates: an exact metric range join.

Vectors are scaled to length 1, where cosine >= c is a Euclidean distance of at
most eps = sqrt(2 - 2c). Pivots cut the space into cells of nearest pivots. A
vector v can have a partner in the cell of pivot q only if it is within eps of
that cell; two lower bounds on the distance to it decide on replication, both
from the triangle inequality and its Euclidean form: v is at least
d(v, q) - radius(q) away, and at least (d(v,q)^2 - d(v,p)^2) / (2 d(p,q)) for
its own pivot p (the distance to the plane between them). A pair of different
cells meets in the cell with the smaller number only, so each pair is compared
once, and cells join independently. Cells with many vectors are cut in chunks
and their pairs of chunks dealt out; the guests that may have a partner in a cell are counted
first and come in chunks too, so no task holds more than about two chunks. Pivots grow with the
square root of the vectors.

Equal vectors are one with a count. In a cell only counts of partners and a
spanning forest of the links leave, never all pairs. Comparisons run in single
precision with a margin and in double precision within it.

On vectors without structure in many dimensions (pairwise right angles, eps 0.45)
no metric bound excludes anything and the join compares nearly all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; a pair at exactly the threshold, in double precision, links;
vectors of different lengths don't link; repeated
rows are vectors of their own; rows with one vec_id are one node; a null vec_id
has a null component unless linked; very long vectors are compared whole; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from kgloom.llm.common import components, drop_written, roots, slim, union_pairs, written

NO_ID = 1 << 62
MARGIN = 1e-4


def unit(raw: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype("<f8")
    return x, x / np.linalg.norm(x, axis=1)[:, None]


def scaled(v: list[float], kind: str) -> bytes:
    """A multiple by a power of two whose largest component is near 1, so that no norm under- or overflows."""
    x = np.array(v, dtype="<f8")
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).astype(kind).tobytes()


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Spread-out members of the sample: each next one is the farthest of a few from those chosen."""
    rng = np.random.default_rng(5)
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and near.max() > 1e-9:
        few = rng.choice(len(sample), min(len(sample), 32), replace=False)
        chosen.append(int(few[near[few].argmax()]) if near[few].max() > 1e-9 else int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_count(n: int, cell_rows: int, most: int) -> int:
    """A quarter of the square root, and enough for cells of ``cell_rows`` on average; one below 64 vectors."""
    return int(np.clip(max(math.isqrt(n) // 4, -(-n // cell_rows)), 1, most))


def apart(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))


def bound_cells(units: np.ndarray, pivots: np.ndarray, radius: np.ndarray | None, between: np.ndarray | None, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell, distance to its pivot, and for every cell whether a partner may be there."""
    d2 = np.maximum(0, 2 - 2 * (units @ pivots.T))
    own = d2.argmin(axis=1)
    d = np.sqrt(d2)
    mine = d[np.arange(len(units)), own]
    if radius is None:
        return own, mine, d
    plane = (d2 - (mine**2)[:, None]) / np.maximum(1e-12, 2 * between[own])
    reach = (d - radius[None, :] <= eps + 1e-9) & (plane <= eps + 1e-9)
    reach[np.arange(len(units)), own] = True
    return own, mine, reach


def join(vectors: DataFrame, cosine: float = 0.9, cell_rows: int = 4096, sample_rows: int = 20_000, most_pivots: int = 16_384) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * cosine)
    # single-precision vectors travel as such: that loses nothing
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.coalesce((F.size("embedding") > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))

    def raw_of(batches):
        for batch in batches:
            raw = [scaled(v, kind) if ok else None for v, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), e.alias("e"), fine.alias("ok")).mapInArrow(slim(raw_of), "id long, raw binary")
    # rows without an id get one from their place in a written table
    rows = written(rows.withColumn("node", F.coalesce("id", F.lit(NO_ID) + F.monotonically_increasing_id())))
    groups = written(rows.where("raw is not null").groupBy("raw").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = groups.select("rep", "copies", "raw", (F.octet_length("raw") / np.dtype(kind).itemsize).cast("int").alias("dim"))
    # lengths with enough vectors for two pivots are cut by them; all others are a cell each
    sizes = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(64, cell_rows + 1))
    few = F.least(F.lit(float(sample_rows)), 16 * F.sqrt("n"))
    sampled = reps.join(sizes, "dim").where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) * F.col("n") <= few * F.lit(1 << 20))
    by_dim: dict[int, tuple[int, list[bytes]]] = {}
    for r in sampled.select("dim", "n", "raw").orderBy("dim", "raw").collect():
        by_dim.setdefault(r["dim"], (r["n"], []))[1].append(bytes(r["raw"]))
    pivots = {dim: choose_pivots(unit(raw[:sample_rows], kind)[1], pivot_count(n, cell_rows, most_pivots)) for dim, (n, raw) in sorted(by_dim.items())}
    counts, links = join_cells(reps, pivots, cosine, eps, cell_rows, kind)
    total = written(counts.groupBy("rep").agg(F.sum("n").alias("n")))
    comp = components(links)
    info = groups.join(total, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    info = written(info.select("raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("comp")))
    out = rows.where("raw is not null").join(info, "raw", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    # what links with nothing is alike and doesn't meet in the join
    out = out.union(rows.where("raw is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("comp")))
    drop_written(groups, total)
    comp_id = F.when(F.col("comp") < NO_ID, F.col("comp"))
    return out.select(F.col("id").alias("vec_id"), "n_links", comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))


def dealt_cells(reps: DataFrame, pivots: dict[int, np.ndarray], eps: float, cell_rows: int, kind: str) -> DataFrame:
    """(dim, cell, i, j, side, data): packed vectors by pair of chunks (i, j) of a cell; j is -1 - q where chunk i meets the cell's guests of chunk q."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(pivots)  # most_pivots vectors a length with many
    between: dict[int, np.ndarray] = {}

    def planes(dim: int) -> np.ndarray:
        """Distances of the pivots, once a worker."""
        if dim not in between:
            between[dim] = apart(shared.value[dim])
        return between[dim]

    def measure(batches):
        for batch in batches:
            dims = np.array(batch.column(1))
            for dim in np.unique(dims):
                own, mine, _ = bound_cells(unit(batch.column(0).take(pa.array(np.flatnonzero(dims == dim))).to_pylist(), kind)[1], shared.value[int(dim)], None, None, eps)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, dtype=np.int32)), pa.array(own.astype(np.int32)), pa.array(mine)], names=["dim", "cell", "d"])

    radius = {dim: np.full(len(p), -10.0) for dim, p in pivots.items()}
    held = {dim: np.zeros(len(p), dtype=np.int64) for dim, p in pivots.items()}
    if pivots:
        large = reps.join(spark.createDataFrame([(d,) for d in pivots], "dim int"), "dim", "left_semi").select("raw", "dim")
        for s in large.mapInArrow(slim(measure), "dim int, cell int, d double").groupBy("dim", "cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
            radius[s["dim"]][s["cell"]], held[s["dim"]][s["cell"]] = s["r"], s["n"]

    def visit(batches):
        """How many guests each cell gets: a guest's own cell has a larger number."""
        for batch in batches:
            dims = np.array(batch.column(1))
            for dim in np.unique(dims).tolist():
                own, _, reach = bound_cells(unit(batch.column(0).take(pa.array(np.flatnonzero(dims == dim))).to_pylist(), kind)[1], shared.value[dim], radius[dim], planes(dim), eps)
                n = (reach & (own[:, None] > np.arange(reach.shape[1]))).sum(axis=0)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), dim, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["dim", "cell", "n"])

    guests = {dim: np.zeros(len(p), dtype=np.int64) for dim, p in pivots.items()}
    if pivots:
        for s in large.mapInArrow(slim(visit), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect():  # a row a pivot
            guests[s["dim"]][s["cell"]] = s["n"]

    def deal(batches):
        """Each vector to its cell's chunk pairs, and as a guest to the chunks of cells with a smaller number."""
        for batch in batches:
            dims, rep, copies = np.array(batch.column(3)), np.array(batch.column(0)), np.array(batch.column(1))
            out = []
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                raw = batch.column(2).take(pa.array(of)).to_pylist()
                pack = lambda rows, of=of, raw=raw: np.uint32(len(rows)).tobytes() + rep[of[rows]].astype("<i8").tobytes() + copies[of[rows]].astype("<i8").tobytes() + b"".join([raw[i] for i in rows])
                if dim not in shared.value:
                    out.append((dim, 0, 0, 0, 0, pack(np.arange(len(of)))))
                    continue
                chunks = np.maximum(1, -(-held[dim] // cell_rows))
                own, _, reach = bound_cells(unit(raw, kind)[1], shared.value[dim], radius[dim], planes(dim), eps)
                spread = (rep[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                chunk, parties = spread % chunks[own], -(-guests[dim] // cell_rows)
                for c in np.flatnonzero(reach.any(axis=0)).tolist():
                    home, g = own == c, np.flatnonzero(reach[:, c] & (own > c))
                    for i in range(int(chunks[c])):
                        me = np.flatnonzero(home & (chunk == i))
                        if len(me):
                            # row side of the pair (i, j) for i <= j; column side for i > j
                            data = pack(me)
                            out += [(dim, c, min(i, j), max(i, j), 0 if i <= j else 1, data) for j in range(int(chunks[c]))]
                            out += [(dim, c, i, -1 - q, 0, data) for q in range(int(parties[c]))]
                    if len(g) and held[dim][c]:
                        for q in np.unique(spread[g] % parties[c]).tolist():
                            party = pack(g[spread[g] % parties[c] == q])
                            out += [(dim, c, i, -1 - q, 1, party) for i in range(int(chunks[c]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (*(pa.int32(),) * 5, pa.binary()), strict=True)], names=["dim", "cell", "i", "j", "side", "data"])

    return reps.select("rep", "copies", "raw", "dim").mapInArrow(slim(deal), "dim int, cell int, i int, j int, side int, data binary")


def join_cells(reps: DataFrame, pivots: dict[int, np.ndarray], cosine: float, eps: float, cell_rows: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Partners by vector (rep, n), and links (a, b) that span the components, of vectors of all lengths in one job."""

    def unpack(blobs, width):
        rep, copies, x = [], [], []
        for b in blobs:
            n = int(np.frombuffer(b, "<u4", 1)[0])
            rep.append(np.frombuffer(b, "<i8", n, 4))
            copies.append(np.frombuffer(b, "<i8", n, 4 + 8 * n))
            x.append(np.frombuffer(b, kind, n * width, 4 + 16 * n).reshape(n, width))
        if not rep:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))
        return np.concatenate(rep), np.concatenate(copies), np.concatenate(x).astype("<f8")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, _, i, j = (int(v) for v in key)
        a_rep, a_copies, a = unpack(pdf["data"][pdf["side"] == 0], dim)
        same = i == j
        b_rep, b_copies, b = (a_rep, a_copies, a) if same else unpack(pdf["data"][pdf["side"] == 1], dim)
        if not len(a_rep) or not len(b_rep):
            return pd.DataFrame({"data": []})
        a_norm, b_norm = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        a32, b32 = (a / a_norm[:, None]).astype(np.float32), (b / b_norm[:, None]).astype(np.float32)
        n_a, n_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        shift = 0 if same else len(a)
        parent = np.arange(shift + len(b))
        for at in range(0, len(a), 512):
            for to in range(at if same else 0, len(b), 4096):
                dots = a32[at : at + 512] @ b32[to : to + 4096].T
                r, c = np.nonzero(dots >= cosine - MARGIN)
                near = dots[r, c] < cosine + MARGIN
                r, c = r + at, c + to
                if near.any():
                    rn, cn = r[near], c[near]
                    exact = np.einsum("ij,ij->i", a[rn], b[cn]) / (a_norm[rn] * b_norm[cn])
                    ok = np.ones(len(r), dtype=bool)
                    ok[near] = exact >= cosine
                    r, c = r[ok], c[ok]
                if same:
                    r, c = r[c > r], c[c > r]
                np.add.at(n_a, r, b_copies[c])
                np.add.at(n_b, c, a_copies[r])
                union_pairs(parent, r, c + shift)
        reps_ = a_rep if same else np.concatenate([a_rep, b_rep])
        n = n_a + n_b if same else np.concatenate([n_a, n_b])
        root = roots(parent, np.arange(len(parent)))
        out = np.stack([reps_, n, reps_[root]], axis=1)[(n > 0)]
        return pd.DataFrame({"data": [out.astype("<i8").tobytes()]} if len(out) else {"data": []})

    def rows_of(batches):
        for batch in batches:
            x = np.concatenate([np.frombuffer(v.as_buffer(), "<i8").reshape(-1, 3) for v in batch.column(0)] or [np.zeros((0, 3), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(3)], names=["rep", "n", "root"])

    dealt = dealt_cells(reps, pivots, eps, cell_rows, kind)
    found = written(dealt.groupBy("dim", "cell", "i", "j").applyInPandas(compare, "data binary"))
    found = found.mapInArrow(slim(rows_of), "rep long, n long, root long")
    return found.select("rep", "n"), found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
