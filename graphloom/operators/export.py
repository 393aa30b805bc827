"""Exports: D3 nodes and links as JSON rows, Graphviz DOT lines. Rows stay distributed until they are written."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLORS = ("#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#76b7b2", "#edc948", "#b07aa1", "#9c755f")


def d3_nodes(entities: DataFrame) -> DataFrame:
    """id and its JSON object; missing properties are an empty object."""
    head = F.to_json(F.struct("id", "name", F.col("entity_type").alias("type")))
    rest = F.concat(F.lit(',"properties":'), F.coalesce("properties", F.lit("{}")), F.lit("}"))
    return entities.select("id", F.concat(F.left(head, F.length(head) - 1), rest).alias("json"))


def d3_links(relations: DataFrame) -> DataFrame:
    return relations.select("id", F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("rel_type").alias("type"), "weight")).alias("json"))


def d3_metadata(entities: DataFrame, relations: DataFrame, now: int | None = None) -> dict:
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))
    return {"node_count": entities.count(), "link_count": relations.count(), "exported_at": stamp}


def escape(label: Column) -> Column:
    """Backslash, quote and line feed, in this order."""
    return F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


@dataclass(frozen=True)
class DotConfig:
    """rankdir and node_shape of the graph; colour by type; max_nodes None is all nodes."""

    rankdir: str = "LR"
    node_shape: str = "ellipse"
    color_by_type: bool = True
    max_nodes: int | None = 100


def dot_lines(entities: DataFrame, relations: DataFrame, max_nodes: int | None = 100, color_by_type: bool = True) -> DataFrame:
    """(part, id, line): the first max_nodes nodes by id (all of them if None), and the edges between them.

    Types get colours by first appearance. The node limit is the feature; edges are cut by two semi joins.
    """
    nodes = entities.select("id", "entity_type", "name")
    nodes = nodes if max_nodes is None else nodes.orderBy("id").limit(max_nodes)
    head = [F.lit("  "), F.col("id").cast("string"), F.lit(' [label="'), escape(F.col("name"))]
    if color_by_type:
        kinds = nodes.groupBy("entity_type").agg(F.min("id").alias("first"))
        ranked = kinds.select("entity_type", (F.dense_rank().over(Window.orderBy("first")) - 1).alias("k"))  # a row for each type
        color = F.element_at(F.array(*map(F.lit, COLORS)), (F.col("k") % len(COLORS) + 1).cast("int"))
        nodes, head = nodes.join(ranked, nodes["entity_type"].eqNullSafe(ranked["entity_type"])).drop(ranked["entity_type"]), [*head, F.lit('", fillcolor="'), color]
    node_lines = nodes.select(F.lit(0).alias("part"), "id", F.concat(*head, F.lit('"];')).alias("line"))
    kept = relations
    if max_nodes is not None:
        ids = nodes.select("id")
        kept = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    edge = F.concat(F.lit("  "), F.col("source_id").cast("string"), F.lit(" -> "), F.col("target_id").cast("string"), F.lit(' [label="'), escape(F.col("rel_type")), F.lit('", weight='), F.format_string("%.4f", "weight"), F.lit("];"))
    return node_lines.unionByName(kept.select(F.lit(1).alias("part"), "id", edge.alias("line")))


def dot_text(entities: DataFrame, relations: DataFrame, config: DotConfig | None = None) -> str:
    """The whole DOT text. Its size is bounded by max_nodes and their edges; without that bound use write_dot."""
    c = config or DotConfig()
    rows = dot_lines(entities, relations, c.max_nodes, c.color_by_type).orderBy("part", "id").collect()
    return "\n".join([*_head(c), *(r["line"] for r in rows), "}"])


def _head(c: DotConfig) -> list[str]:
    return ["digraph G {", f"  rankdir={c.rankdir};", f"  node [shape={c.node_shape}, style=filled];"]


def write_dot(entities: DataFrame, relations: DataFrame, path: str, config: DotConfig | None = None) -> None:
    """Writes a graph of any size as text files that make one DOT text in the order of their names."""
    c, spark = config or DotConfig(), entities.sparkSession
    body = dot_lines(entities, relations, c.max_nodes, c.color_by_type)
    ends = spark.createDataFrame([(-1, k, t) for k, t in enumerate(_head(c))] + [(2, 0, "}")], "part int, id long, line string")
    body.unionByName(ends).repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)
