"""A trie of conversations: which begin alike, and what is saved where that is kept once.

1. Turns are put in order by ranges over all conversations, so a conversation may be of any length. A prefix is known by
   the sum of the hashes of its turns and places; sums run in chunks of ``CHUNK`` turns.
2. Prefixes with the same members in a row are one chain, so the tree that is left has at most two chains a conversation.
3. Heavy-path decomposition: each chain's child with the most members continues its path, every other child begins one.
   Members at least halve from a path to one attached to it, so no chain has more paths above it than the logarithm
   of the conversations. Pointer jumping tells path and place of each chain.
4. Totals of paths are attached to the chains they hang from, round by round upwards, then one suffix sum along each
   path gives the sums over all subtrees, again in chunks.

Members of a prefix are counted before they are shuffled; the ids of those that end there are digested as sorted
stretches, in the order of the ids.

Defined results: rows without a conversation id belong to none and are left out; a null turn comes first; equal turns are in the
order of role, then text; repeated rows are repeated turns; null roles and texts are empty, and empty ones are turns like
others; texts of any length are hashed; an empty table has no nodes; other columns, whatever their names, are ignored.
Prefixes are identified by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import clean_shuffles, drop_written, follow, slim, written

#: Turns of a conversation, or chains of a path, that are summed in one task.
CHUNK = 4096
#: Ids in one stretch of a digest.
STRETCH = 4096
SUMS = ["s1", "s2", "s3", "s4", "cp"]


def turns_in_order(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conv, pos, code, cp): places from 1, a digest of role and text, and the text's code points; (conv, turns); and the
    written table behind both."""
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), x.alias("text"), F.monotonically_increasing_id().alias("tie"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("tie")]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    code = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seq = written(placed.select("conv", F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().alias("p"), code.alias("code"), F.length("text").cast("long").alias("cp")))
    parts = seq.groupBy("conv", "p").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = seq.join(starts, ["conv", "p"]).select("conv", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("pos"), "code", "cp")
    return out, parts.groupBy("conv").agg(F.sum("n").alias("turns")), seq


def running_sums(df: DataFrame, keys: list[str], place: str, columns: list[str], down: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the sums ``{c}_to`` of ``columns`` over the rows of the keys up to a row's ``place``, itself included (from it on with
    ``down``). Places are dense; rows of a key meet in chunks only."""
    d = df.withColumn("_chunk", F.floor(F.col(place) / chunk))
    way = F.desc if down else F.asc
    inside = Window.partitionBy(*keys, "_chunk").orderBy(way(place)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(way("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    before = totals.select(*keys, "_chunk", *[F.sum(f"{c}_all").over(across).alias(f"{c}_before") for c in columns]).where(F.col(f"{columns[0]}_before").isNotNull())
    summed = d.select("*", *[F.sum(c).over(inside).alias(f"{c}_in") for c in columns]).join(before, [*keys, "_chunk"], "left")
    return summed.select(*df.columns, *[(F.col(f"{c}_in") + F.coalesce(F.col(f"{c}_before"), F.lit(0))).alias(f"{c}_to") for c in columns])


def key_of(sums: list[Column]) -> tuple[Column, Column]:
    """128 bits of four sums, each modulo 2**32."""
    low = [s.bitwiseAND(F.lit(0xFFFFFFFF)) for s in sums]
    return F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv, depth, a, b, pa, pb, cp, cum: the key of each prefix and of the one before it, and code points of the last turn and of all."""
    h = [F.xxhash64(F.lit(k), "pos", "code") for k in (1, 2)]
    half = lambda c, high: F.shiftrightunsigned(c, 32) if high else c.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = turns.select("conv", "pos", half(h[0], True).alias("s1"), half(h[0], False).alias("s2"), half(h[1], True).alias("s3"), half(h[1], False).alias("s4"), "cp")
    summed = running_sums(parts, ["conv"], "pos", SUMS, chunk=chunk)
    a, b = key_of([F.col(f"{s}_to") for s in SUMS[:4]])
    pa_, pb = key_of([F.col(f"{s}_to") - F.col(s) for s in SUMS[:4]])
    return summed.select("conv", F.col("pos").alias("depth"), a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "cp", F.col("cp_to").alias("cum"))


def joined_digests(members: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(m, n, sha): SHA-256 of the ids ``conv`` of each (m, n), ascending and comma-joined. Ranges of sorted ids become
    stretches of text; the digest, which goes from one to the next, takes these in order."""
    order = ["m", "n", "conv"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n, conv = (b.column(i).to_numpy() for i in range(3))
            begin = [0, *((m[1:] != m[:-1]) | (n[1:] != n[:-1])).nonzero()[0].tolist()]
            begin[1:] = [x + 1 for x in begin[1:]]
            cuts = [(a, min(a + stretch, z)) for x, z in zip(begin, [*begin[1:], len(m)], strict=True) for a in range(x, z, stretch)]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array([a for a, _ in cuts])) for i in range(3)] + [pa.array([",".join(map(str, conv[a:z])) for a, z in cuts])], names=["m", "n", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for m, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (m, n) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (m, n), hashlib.sha256(ids.encode())
            yield rows(out)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["m", "n", "sha"])

    cut = members.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(slim(stretches), "m long, n long, first long, ids string")
    return cut.repartition("m", "n").sortWithinPartitions("m", "n", "first").mapInArrow(slim(digests), "m long, n long, sha string")


def subtree_sums(tree: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """(sid, {c}_sum) of a tree (sid, parent, size, tie, and ``columns``): sums over subtrees by heavy paths."""
    largest = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("s"), "tie", "sid")).alias("x")).select(F.col("x.sid").alias("sid"), F.lit(True).alias("heavy"))
    on = tree.join(largest, "sid", "left").select("sid", "parent", F.when(F.col("heavy"), F.col("parent")).alias("to"), F.lit(1).alias("d"))
    placed = follow(on.select("sid", "to", "d"), "sid")
    # path, place in it, and the chain that the path hangs from
    heads = tree.select(F.col("sid").alias("head"), F.col("parent").alias("up"))
    label = written(placed.join(heads, "head").select("sid", "head", F.col("offset").alias("place"), "up"))
    drop_written(placed)
    sums = [F.sum(c).alias(c) for c in columns]
    sent = written(tree.join(label, "sid").where("up IS NOT NULL").groupBy("up").agg(*sums).withColumnRenamed("up", "sid"))
    rounds = [sent]
    while not sent.isEmpty():
        sent = written(sent.join(label, "sid").where("up IS NOT NULL").groupBy("up").agg(*sums).withColumnRenamed("up", "sid"))
        rounds.append(sent)
    hung = rounds[0]
    for r in rounds[1:]:
        hung = hung.union(r)
    hung = hung.groupBy("sid").agg(*[F.sum(c).alias(f"{c}_hung") for c in columns])
    weighed = tree.join(label, "sid").join(hung, "sid", "left").select("sid", "head", "place", *[(F.col(c) + F.coalesce(F.col(f"{c}_hung"), F.lit(0))).alias(c) for c in columns])
    out = written(running_sums(weighed, ["head"], "place", columns, down=True, chunk=chunk).select("sid", *[F.col(f"{c}_to").alias(f"{c}_sum") for c in columns]))
    drop_written(label, *rounds)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """The nodes of the trie of conversations ``convs`` (conv, turns), whose turns are ``turns`` (conv, pos, code, cp): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Each conversation is one row of ``convs``, with no turns too."""
    steps = written(prefixes(turns, chunk))
    root = convs.agg(F.min("conv").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 0")
    zero = F.lit(0).cast("long")
    inner = steps.groupBy("depth", "a", "b").agg(F.min("conv").alias("m"), F.count(F.lit(1)).alias("n"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("cp").alias("cp"), F.min("cum").alias("cum"))
    nodes = written(inner.select("depth", "a", "b", "m", "n", "pa", "pb", "cp", "cum").union(root.select(zero, zero, zero, "m", "n", zero, zero, zero, zero)))
    # a chain: nodes with the same members, all on the way of the smallest of them
    chains = nodes.groupBy("m", "n").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max("cum").alias("last"), F.min(F.col("cum") - F.col("cp")).alias("start"))
    chains = written(chains.withColumn("sid", F.monotonically_increasing_id()))
    tops = nodes.join(chains.select("m", "n", "top", "sid"), ["m", "n"]).where("depth = top AND depth > 0").select("sid", (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    above = tops.join(nodes.select("depth", "a", "b", F.col("m").alias("pm"), F.col("n").alias("pn")), ["depth", "a", "b"])
    above = written(above.join(chains.select(F.col("m").alias("pm"), F.col("n").alias("pn"), F.col("sid").alias("parent")), ["pm", "pn"]).select("sid", "parent", "pm"))
    children = above.groupBy(F.col("parent").alias("sid")).agg(F.count(F.lit(1)).alias("children"))
    own = (F.col("n") - 1) * (F.col("last") - F.col("start"))
    tree = chains.join(above, "sid", "left").join(children, "sid", "left")
    tree = written(tree.select("sid", "m", "n", "top", "bottom", "last", "parent", "pm", F.coalesce("children", F.lit(0)).cast("long").alias("children"), own.alias("saved"), F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves")))
    drop_written(chains, above)
    sums = subtree_sums(tree.select("sid", "parent", F.col("n").alias("size"), F.col("m").alias("tie"), "saved", "leaves"), ["saved", "leaves"], chunk)
    # members that end at a node end at the bottom of its chain
    last = steps.join(convs, "conv").where("depth = turns").select("conv", "depth", "a", "b")
    ends = last.join(nodes.select("depth", "a", "b", "m", "n"), ["depth", "a", "b"]).select("m", "n", "conv")
    ends = ends.union(convs.where("turns = 0").join(F.broadcast(root), F.lit(True)).select("m", "n", "conv"))
    digests = written(joined_digests(ends, stretch))
    known = tree.join(sums, "sid").join(digests, ["m", "n"], "left")
    known = known.select("m", "n", "top", "bottom", "last", "pm", "children", "leaves_sum", (F.col("saved_sum") - F.col("saved")).alias("below"), "sha")
    at_top, at_bottom = F.col("depth") == F.col("top"), F.col("depth") == F.col("bottom")
    out = nodes.select("m", "n", "depth", "cp", "cum").join(known, ["m", "n"]).select(
        F.col("m").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.when(at_top, F.col("pm")).otherwise(F.col("m"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves_sum").cast("long").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("last") - F.col("cum") + F.col("cp"))).cast("long").alias("saved_tokens"),
        F.when(at_bottom & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = written(out)
    drop_written(steps, nodes, tree, sums, digests)
    clean_shuffles(turns.sparkSession)
    return out


def rebuilt(turns: DataFrame, counts: DataFrame, cycle: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation c begins with the first h turns of conversation c - c % ``cycle``, h the CRC-32 of its
    decimal digits modulo ``heads``, and goes on with its own turns after the first h."""
    h = F.when(F.pmod("conv", F.lit(cycle)) == 0, F.lit(0)).otherwise(F.crc32(F.col("conv").cast("string")) % heads)
    convs = counts.select("conv", "turns", h.cast("long").alias("h"), (F.col("conv") - F.pmod("conv", F.lit(cycle))).alias("base"))
    bases = counts.select(F.col("conv").alias("base"), F.col("turns").alias("there"))
    plan = written(convs.join(bases, "base", "left").select("conv", "base", "h", F.least(F.col("h"), F.coalesce("there", F.lit(0))).cast("long").alias("taken"), F.col("turns").alias("own")))
    mine = turns.join(plan.select("conv", "h", "taken"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "code", "cp")
    first = turns.where(F.col("pos") < heads).where(F.pmod("conv", F.lit(cycle)) == 0).select(F.col("conv").alias("base"), "pos", "code", "cp")
    given = plan.where("h > 0").select("conv", "base", "h").join(first, "base").where("pos <= h").select("conv", "pos", "code", "cp")
    return mine.union(given), plan.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns, counts, seq = turns_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns, counts = written(turns), written(counts)
    out = prefix_trie(*rebuilt(turns, counts))
    drop_written(seq, turns, counts)
    return out


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS item FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 100 AS base,
         CASE WHEN c % 100 = 0 THEN 0 ELSE xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)
         ), 4294967295::BIGINT) % 6 END AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT k.c, t.pos, t.item FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
  UNION ALL SELECT k.c, 1000 + t.pos, t.item FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
s AS (SELECT k.c, coalesce(l.seq, []) AS seq FROM k LEFT JOIN (SELECT c, list(item ORDER BY pos) AS seq FROM r GROUP BY c) l ON l.c = k.c),
m AS (SELECT c, len(seq) AS n, d, seq[1:d] AS p FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
v AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM m GROUP BY p, d),
ch AS (SELECT p[1:d-1] AS p, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
w AS (
  SELECT v.*, coalesce(ch.n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(v.p[d].text) END AS own
  FROM v LEFT JOIN ch ON ch.p = v.p),
up AS (SELECT p[1:x] AS p, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
       FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM w) GROUP BY 1)
SELECT w.conv_id, w.d::BIGINT AS depth, par.conv_id AS parent_conv_id, w.n_convs, w.n_children, up.n_leaves, up.saved_tokens, w.ends_sha256
FROM w JOIN up ON up.p = w.p LEFT JOIN v par ON w.d > 0 AND par.p = w.p[1:w.d-1]
"""
