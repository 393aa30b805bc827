"""Exact vector search: cosine as column expressions in double precision, top-k without a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import EntityNotFound, InvalidVectorDimension


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for vectors of different lengths or of zero norm."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def vector_of(vectors: DataFrame, entity_id: int) -> list[float]:
    row = vectors.where(F.col("entity_id") == entity_id).select("vector").first()
    if row is None:
        raise EntityNotFound(entity_id)
    return [float(x) for x in row["vector"]]


def check_dimension(vectors: DataFrame, size: int) -> None:
    row = vectors.select(F.size("vector").alias("n")).first()
    if row is not None and row["n"] != size:
        raise InvalidVectorDimension(f"{size} instead of {row['n']}")


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """entity_id, similarity of the k most similar vectors; ties (after rounding to 6 places) go to the smaller id."""
    scored = vectors.select("entity_id", F.round(cosine("vector", literal(query)), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "entity_id").limit(max(k, 0))


def similar_entities(vectors: DataFrame, entity_id: int, k: int) -> DataFrame:
    """top_k for an entity's own vector, without the entity."""
    return top_k(vectors.where(F.col("entity_id") != entity_id), vector_of(vectors, entity_id), k)


def pairs(vectors: DataFrame, links: DataFrame) -> DataFrame:
    """source_id, target_id, similarity of linked entities."""
    a = vectors.select(F.col("entity_id").alias("source_id"), F.col("vector").alias("a"))
    b = vectors.select(F.col("entity_id").alias("target_id"), F.col("vector").alias("b"))
    return links.select("source_id", "target_id").join(a, "source_id").join(b, "target_id").select("source_id", "target_id", F.round(cosine("a", "b"), 6).alias("similarity"))


def fingerprint(vectors: DataFrame) -> DataFrame:
    """Count, id sum, and the sum of components weighted by their place, which a re-embedded entity changes; see content_hash."""
    weighted = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.size("vector")), lambda x, k: x.cast("double") * k), F.lit(0.0), lambda s, x: s + x)
    ids = F.sum(F.col("entity_id").cast("decimal(38,0)"))
    return vectors.agg(F.count("*").alias("vector_count"), F.coalesce(ids, F.lit(0)).cast("string").alias("id_sum"), F.round(F.coalesce(F.sum(weighted), F.lit(0.0)), 4).alias("content"))


def content_hash(vectors: DataFrame) -> int:
    """A sum of hashes of (id, components): the key under which an index of these vectors is kept."""
    return vectors.agg(F.coalesce(F.sum(F.xxhash64("entity_id", "vector").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()["h"]
