"""SQL functions over the graph: registered as SQL-bodied temporary functions, so that no Python runs per row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import __version__

_COSINE = """CASE WHEN size(a) = size(b)
  AND sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))) > 0
  THEN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)
   / (sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))))
  ELSE 0D END"""


def register(spark: SparkSession) -> None:
    """kg_cosine_similarity, kg_bit_count, kg_version, and the functions that describe an algorithm as JSON, for spark.sql.

    The algorithms' rows come from the views that KnowledgeGraph.publish makes.
    """
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} kg_cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {_COSINE}")
    spark.sql(f"{make} kg_bit_count(x BIGINT) RETURNS INT RETURN coalesce(bit_count(x), 0)")
    spark.sql(f"{make} kg_version() RETURNS STRING RETURN '{__version__}'")
    for name, arguments in _ALGORITHMS.items():
        declared = ", ".join(f"{a} {kind}" + (f" DEFAULT {default}" if default is not None else "") for a, kind, default in arguments)
        fields = ", ".join(f"'{a}', {a}" for a, _, _ in arguments)
        told = f"named_struct('algorithm', '{name}', {fields + ', ' if fields else ''}'rows', 'kg_{name}_result')"
        spark.sql(f"{make} kg_{name}({declared}) RETURNS STRING RETURN to_json({told})")


_ALGORITHMS = {
    "pagerank": [("damping", "DOUBLE", "0.85D"), ("max_iterations", "INT", "100"), ("tolerance", "DOUBLE", "1e-6D")],
    "louvain": [],
    "bfs": [("start_id", "BIGINT", None), ("max_depth", "INT", "3")],
    "shortest_path": [("from_id", "BIGINT", None), ("to_id", "BIGINT", None), ("max_depth", "INT", "10")],
    "connected_components": [],
}


def register_stats(spark: SparkSession) -> None:
    """kg_stats(): totals, degrees and density of the views kg_entities and kg_relations, as JSON, computed when it is called."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kg_stats() RETURNS STRING RETURN "
        "SELECT to_json(named_struct('total_entities', n, 'total_relations', m, 'avg_degree', round(if(n > 0, 2 * m / n, 0D), 6), 'max_degree', coalesce(most, 0), 'density', round(if(n > 1, m / (n * (n - 1)), 0D), 9))) "
        "FROM (SELECT count(*) n FROM kg_entities), (SELECT count(*) m FROM kg_relations), "
        "(SELECT max(greatest(o, i)) most FROM (SELECT sum(o) o, sum(i) i FROM (SELECT source_id id, 1 o, 0 i FROM kg_relations UNION ALL SELECT target_id, 0, 1 FROM kg_relations) GROUP BY id))"
    )


def bit_count(column: Column | str) -> Column:
    return F.coalesce(F.bit_count(column), F.lit(0))


def stats_json(entities: DataFrame, relations: DataFrame) -> str:
    from graphloom.operators.traverse import graph_stats

    return json.dumps(graph_stats(entities, relations).first().asDict())
