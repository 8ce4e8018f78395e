"""Retrieval in one plan: vector and keyword seeds, graph expansion, hybrid scores, token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import vectors
from kgloom.operators import graph


@dataclass(frozen=True)
class Knobs:
    k: int = 10
    depth: int = 2
    per_hop: int = 50
    budget: int = 3000
    threshold: float = -1.0


def knobs_for(intent: str, base: Knobs = Knobs()) -> Knobs:
    """Retrieval settings by intent: fixed values."""
    from dataclasses import replace

    return {
        "CHUNK_SEARCH": replace(base, depth=0),
        "GRAPH_SUMMARY": replace(base, k=min(2 * base.k, 30), budget=base.budget + 1000),
        "CHAIN_OF_THOUGHT": replace(base, depth=max(3, base.depth)),
        "MEMORY_ONLY": replace(base, k=5, depth=1),
        "ENTITY_CONNECTION": replace(base, depth=max(2, base.depth), k=20),
        "SOCIAL": replace(base, k=1, depth=0),
    }.get(intent, base)


def knob_columns(intent: Column, base: Knobs = Knobs()) -> Column:
    """``knobs_for`` of a column of intents; a null or unknown one has the usual settings."""
    known = ("CHUNK_SEARCH", "GRAPH_SUMMARY", "CHAIN_OF_THOUGHT", "MEMORY_ONLY", "ENTITY_CONNECTION", "SOCIAL")
    of = lambda x: F.struct(F.lit(x.k).alias("k"), F.lit(x.depth).alias("depth"), F.lit(x.per_hop).alias("per_hop"), F.lit(x.budget).alias("budget"))
    table = F.create_map(*[c for n in known for c in (F.lit(n), of(knobs_for(n, base)))])
    return F.coalesce(F.try_element_at(table, F.coalesce(intent, F.lit(""))), of(knobs_for("", base)))


def graph_score(depth: Column) -> Column:
    return F.when(depth == 0, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - F.lit(0.25) * depth))


def hybrid_score(similarity: Column, graph_part: Column, weight: Column) -> Column:
    return F.least(F.lit(1.0), (F.lit(0.6) * similarity + F.lit(0.4) * graph_part) * weight)


def boosted(vector_hits: DataFrame, keyword_hits: DataFrame, key: str) -> DataFrame:
    """Vector hits with a keyword rise to 0.85 and weight 1.5; keyword hits alone follow with 0.7 and 1.2."""
    v, w = vector_hits.select(key, "similarity"), keyword_hits.select(key).withColumn("_kw", F.lit(True))
    j = v.join(w, key, "full")
    both = F.col("similarity").isNotNull() & F.col("_kw").isNotNull()
    alone = F.col("similarity").isNull()
    return j.select(key, F.when(both, F.greatest("similarity", F.lit(0.85))).when(alone, F.lit(0.7)).otherwise(F.col("similarity")).alias("similarity"), F.when(both, 1.5).when(alone, 1.2).otherwise(1.0).alias("weight"))


def within_budget(df: DataFrame, score: str, tokens: str, tie: str, budget: int) -> DataFrame:
    """The best rows until the first that overflows. For the candidates of one question, which ``k``
    and ``per_hop`` bound, so the ungrouped window holds few rows."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def retrieve(chunks: DataFrame, edges: DataFrame, query: Column, terms: list[str], knobs: Knobs) -> DataFrame:
    """``chunks``: id, text, embedding; ``edges``: src, dst. Scored context chunks within the token budget."""
    found = vectors.top_k(chunks, "embedding", query, knobs.k, "id").where(F.col("similarity") >= knobs.threshold).select("id", "similarity")
    hits = chunks.where(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains("text", t))).orderBy("id").limit(knobs.k) if terms else chunks.limit(0)
    # at most 2k rows, evaluated once for the hops and the scores
    best = boosted(found, hits, "id")
    seeds = chunks.sparkSession.createDataFrame(best.collect(), best.schema)
    reached = graph.expand(edges, seeds.select("id"), knobs.depth, knobs.per_hop) if knobs.depth else seeds.select("id", F.lit(0).alias("depth"))
    scored = reached.join(seeds, "id", "left")
    g = graph_score(F.col("depth"))
    s = scored.select("id", "depth", F.round(hybrid_score(F.coalesce("similarity", g * 0.7), g, F.coalesce("weight", F.lit(1.0))), 6).alias("score"))
    # the few rows that are left meet their texts before any is split
    tokens = F.floor(F.size(F.split(F.trim("text"), r"\s+")) * 1.3).cast("long").alias("tokens")
    text = chunks.select("id", "text").join(F.broadcast(s), "id").select("id", "depth", "score", tokens)  # ``k`` and ``per_hop`` bound them
    return within_budget(text, "score", "tokens", "id", knobs.budget).select("id", "depth", "score", "tokens")
