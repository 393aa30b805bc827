"""Retrieval: semantic, hybrid, four-signal and two-stage search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import confidence as C
from graphloom.operators import traverse as G
from graphloom.operators import vectors as V
from graphloom.operators.quantized import QuantizedIndex
from graphloom.runtime import cut


def semantic(entities: DataFrame, vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """entity_id, entity_type, name, similarity."""
    best = V.top_k(vectors, query, k)
    return best.join(entities.select(F.col("id").alias("entity_id"), "entity_type", "name"), "entity_id").select("entity_id", "entity_type", "name", "similarity")


def _near(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity_id, far): distinct depth-1 neighbours of the seeds, without themselves."""
    links = G.edges(relations, G.Direction.BOTH).select(F.col("node").alias("entity_id"), "far")
    return links.join(seeds.select("entity_id"), "entity_id").where("entity_id <> far").distinct()


def hybrid(entities: DataFrame, relations: DataFrame, vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """semantic, and context: the ascending ids of each result's depth-1 neighbours, joined by commas."""
    found = semantic(entities, vectors, query, k)
    around = _near(relations, found).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("far")), ",").alias("context"))
    return found.join(around, "entity_id", "left").select("entity_id", "similarity", F.coalesce("context", F.lit("")).alias("context"))


@dataclass(frozen=True)
class Weights:
    similarity: float = 0.5
    confidence: float = 0.2
    importance: float = 0.2
    temporal: float = 0.1


def smart(entities: DataFrame, vectors: DataFrame, dependencies: DataFrame, log: DataFrame, query: list[float], k: int, now: int, weights: Weights | None = None) -> DataFrame:
    """entity_id, similarity, confidence, importance, temporal, score: a weighted sum over a pool of max(3k, 20)."""
    w = weights or Weights()
    pool = cut(V.top_k(vectors, query, max(3 * k, 20)))
    members = entities.join(F.broadcast(pool.select(F.col("entity_id").alias("id"))), "id")  # the pool is max(3k, 20) rows
    live = C.live(members, log.join(F.broadcast(pool.select("entity_id")), "entity_id"), now)
    deps = C.dependency_indegree(dependencies.join(F.broadcast(pool.select(F.col("entity_id").alias("target_id"))), "target_id"))
    times = members.select(F.col("id").alias("entity_id"), C.temporal_validity(F.col("valid_from"), F.col("valid_until"), now).alias("temporal"))
    rows = cut(pool.join(live, "entity_id").join(times, "entity_id").join(deps, "entity_id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0))))
    most = rows.agg(F.max("dependents")).first()[0] or 0
    rows = rows.withColumn("importance", F.col("dependents") / F.lit(float(most)) if most else F.lit(0.0))
    score = w.similarity * F.col("similarity") + w.confidence * F.col("confidence") + w.importance * F.col("importance") + w.temporal * F.col("temporal")
    cols = [F.round(c, 6).alias(c) for c in ("confidence", "importance", "temporal")]
    return rows.select("entity_id", "similarity", *cols, F.round(score, 6).alias("score")).orderBy(F.desc("score"), "entity_id").limit(k)


@dataclass(frozen=True)
class RagConfig:
    stage1_k: int = 50
    stage2_k: int = 20
    min_vector: float = 0.3
    min_combined: float = 0.25
    graph_depth: int = 1
    vector_weight: float = 0.6
    graph_weight: float = 0.4
    context: int = 5
    bits: int = 3


def rag(entities: DataFrame, relations: DataFrame, vectors: DataFrame, query: list[float], k: int, config: RagConfig | None = None, index: QuantizedIndex | None = None, exact_stage1: bool = False) -> DataFrame:
    """entity_id, vector_score, graph_score, score, context.

    Quantized candidates, exact reranking, graph expansion of the pool, combined score, context. The pool
    is bounded by the configuration and the degrees of its stage2_k seeds.
    """
    c = config or RagConfig()
    if exact_stage1:
        first = V.top_k(vectors, query, c.stage1_k)
    else:
        index = index or QuantizedIndex(len(query), c.bits).build(vectors)
        first = index.search(query, c.stage1_k)
    first = first.where(F.col("similarity") >= c.min_vector).select("entity_id")
    exact = vectors.join(first, "entity_id").select("entity_id", F.round(V.cosine("vector", V.literal(query)), 6).alias("vector_score")).where(F.col("vector_score") >= c.min_vector)
    pool = cut(exact.orderBy(F.desc("vector_score"), "entity_id").limit(c.stage2_k))
    seeds = pool
    for _ in range(c.graph_depth):
        fresh = _near(relations, seeds).select(F.col("far").alias("entity_id")).distinct().join(pool.select("entity_id"), "entity_id", "left_anti")
        more = vectors.join(fresh, "entity_id").select("entity_id", F.round(V.cosine("vector", V.literal(query)), 6).alias("vector_score")).where(F.col("vector_score") >= c.min_vector)
        seeds = more
        pool = cut(pool.unionByName(more))
    n = pool.count()
    links = cut(_near(relations, pool))
    inside = links.join(pool.select(F.col("entity_id").alias("far")), "far").groupBy("entity_id").agg(F.count("*").alias("inside"))
    graph = F.coalesce("inside", F.lit(0)) / F.lit(float(max(n - 1, 1))) if n > 1 else F.lit(0.0)
    scored = pool.join(inside, "entity_id", "left").select("entity_id", "vector_score", F.round(graph, 6).alias("graph_score"))
    scored = scored.withColumn("score", F.round(c.vector_weight * F.col("vector_score") + c.graph_weight * F.col("graph_score"), 6)).where(F.col("score") >= c.min_combined)
    top = cut(scored.orderBy(F.desc("score"), "entity_id").limit(k))
    one = links.join(top.select("entity_id"), "entity_id").select("entity_id", "far", F.lit(1).alias("hop"))
    two = _near(relations, one.select(F.col("far").alias("entity_id")).distinct()).select(F.col("entity_id").alias("mid"), "far")
    two = one.select("entity_id", F.col("far").alias("mid")).join(two, "mid").where("entity_id <> far").select("entity_id", "far", F.lit(2).alias("hop"))
    both = one.unionByName(two).groupBy("entity_id", "far").agg(F.min("hop").alias("hop")).join(pool.select(F.col("entity_id").alias("far"), F.lit(0).alias("outside")), "far", "left")
    order = Window.partitionBy("entity_id").orderBy(F.coalesce("outside", F.lit(1)), "hop", "far")
    around = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= c.context)
    listed = around.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "far"))), lambda x: x["far"]), ",").alias("context"))
    return top.join(listed, "entity_id", "left").select("entity_id", "vector_score", "graph_score", "score", F.coalesce("context", F.lit("")).alias("context"))
