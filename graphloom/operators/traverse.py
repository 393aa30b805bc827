"""Level-synchronous traversal: neighbours, breadth-first search, paths, degree statistics.

A level is one join of the frontier with the edges and one aggregation that picks each new node's
winner: the smallest order key. A key is the parent's key followed by (direction, relation id), so the order in
which nodes are discovered needs no numbering of a whole level. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import cut, near
from graphloom.schema import EntityNotFound, check_depth


class Direction(Enum):
    OUTGOING = "out"
    INCOMING = "in"
    BOTH = "both"


def edges(relations: DataFrame, direction: Direction, rel_types: list[str] | None = None, min_weight: float | None = None) -> DataFrame:
    """(node, far, dir, rel_id, rel_type, weight); filters reach the scan."""
    r = relations
    if rel_types is not None:
        r = r.where(F.col("rel_type").isin(*rel_types))
    if min_weight is not None:
        r = r.where(F.col("weight") >= min_weight)
    out = r.select(F.col("source_id").alias("node"), F.col("target_id").alias("far"), F.lit(0).cast("long").alias("dir"), F.col("id").alias("rel_id"), "rel_type", "weight")
    back = r.select(F.col("target_id").alias("node"), F.col("source_id").alias("far"), F.lit(1).cast("long").alias("dir"), F.col("id").alias("rel_id"), "rel_type", "weight")
    return {Direction.OUTGOING: out, Direction.INCOMING: back, Direction.BOTH: out.unionByName(back)}[direction]


def levels(start: int, links: DataFrame, depth: int, among: DataFrame | None = None) -> Iterator[DataFrame]:
    """The nodes first reached at each depth: id, key, parent, rel_type, weight, depth; level 0 is the start.

    A level is checkpointed before the next one is planned, so plans don't grow with the depth; levels end
    early when nothing new is reached. Only links of the frontier are computed. With among (id), other nodes are
    not reached; just the new ones are looked up in it.
    """
    rows = 1
    frontier = links.sparkSession.range(1).select(
        F.lit(start).cast("long").alias("id"), F.array().cast("array<bigint>").alias("key"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("rel_type"), F.lit(None).cast("double").alias("weight"), F.lit(0).alias("depth")
    )
    yield frontier
    seen = frontier.select("id")
    for level in range(1, depth + 1):
        step = links.join(near(frontier.select(F.col("id").alias("node")), rows), "node", "left_semi").join(near(frontier.select(F.col("id").alias("node"), F.col("key").alias("pkey")), rows), "node")
        best = step.groupBy(F.col("far").alias("id")).agg(F.min(F.struct(F.concat("pkey", F.array("dir", "rel_id")).alias("key"), F.col("node").alias("parent"), "rel_type", "weight")).alias("w"))
        frontier = cut(best.join(seen, "id", "left_anti").select("id", "w.key", "w.parent", "w.rel_type", "w.weight", F.lit(level).alias("depth")), F.count("*").alias("n"))
        if among is not None:
            inside = cut(among.select("id").join(near(frontier.select("id"), frontier.told["n"]), "id", "left_semi"))
            frontier = cut(frontier.join(inside, "id", "left_semi"), F.count("*").alias("n"))
        rows = frontier.told["n"]
        yield frontier
        if level == depth or not rows:
            return
        seen = seen.unionByName(frontier.select("id"))


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(entities: DataFrame, entity_id: int) -> None:
    if entities.where(F.col("id") == entity_id).isEmpty():
        raise EntityNotFound(entity_id)


def neighbors(entities: DataFrame, relations: DataFrame, start: int, depth: int, among: DataFrame | None = None) -> DataFrame:
    """Nodes within depth undirected hops, each once with the relation that discovered it; the start is excluded."""
    check_depth(depth, 5)
    require(entities, start)
    reached = list(levels(start, edges(relations, Direction.BOTH), depth, among))[1:]
    if not reached:
        return entities.select(F.col("id").alias("entity_id"), "entity_type", "name").withColumns({"depth": F.lit(0), "rel_type": F.lit(""), "weight": F.lit(0.0)}).limit(0)
    return near(_union(reached), sum(r.told["n"] for r in reached)).join(entities.select("id", "entity_type", "name"), "id").select(F.col("id").alias("entity_id"), "entity_type", "name", "depth", "rel_type", "weight")


def bfs(entities: DataFrame, relations: DataFrame, start: int, direction: Direction = Direction.OUTGOING, depth: int = 3, rel_types=None, min_weight=None) -> DataFrame:
    """entity_id, entity_type, depth (hops); the start is included at depth 0."""
    require(entities, start)
    found = _union(levels(start, edges(relations, direction, rel_types, min_weight), depth))
    return found.join(entities.select("id", "entity_type"), "id").select(F.col("id").alias("entity_id"), "entity_type", "depth")


def context(entities: DataFrame, relations: DataFrame, start: int, depth: int) -> DataFrame:
    """The root, at depth 0, and its neighbours."""
    root = entities.where(F.col("id") == start).select(F.col("id").alias("entity_id"), "entity_type", "name", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("rel_type"), F.lit(None).cast("double").alias("weight"))
    return root.unionByName(neighbors(entities, relations, start, depth))


def find_related(entities: DataFrame, relations: DataFrame, start: int, threshold: float) -> DataFrame:
    """Depth-1 neighbours whose first relation weighs at least threshold; a weak first edge hides a stronger parallel one."""
    return neighbors(entities, relations, start, 1).where(F.col("weight") >= threshold).orderBy(F.desc("weight"), "entity_id")


def shortest_path(relations: DataFrame, source: int, target: int, depth: int) -> DataFrame:
    """step, from_id, to_id, rel_type, weight along a fewest-hops path of outgoing edges; no rows if there is none.

    Levels are expanded until the target is seen; then the path is read off the target's key, one bounded lookup.
    """
    spark = relations.sparkSession
    schema = "step int, from_id long, to_id long, rel_type string, weight double"
    if source == target:
        return spark.createDataFrame([], schema)
    links = edges(relations, Direction.OUTGOING)
    for level, frontier in enumerate(levels(source, links, depth)):
        if not level:
            continue
        row = frontier.where(F.col("id") == target).select("key").first()
        if row is not None:
            ids = row["key"][1::2]
            steps = spark.createDataFrame([(k + 1, i) for k, i in enumerate(ids)], "step int, id long")
            return relations.where(F.col("id").isin(ids)).join(F.broadcast(steps), "id").select("step", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "rel_type", "weight")
    return spark.createDataFrame([], schema)


def dfs(entities: DataFrame, relations: DataFrame, start: int, direction: Direction = Direction.OUTGOING, depth: int = 3) -> DataFrame:
    """entity_id, depth, position in a depth-limited preorder with a global visited set.

    The ball of the depth's radius is found by breadth-first search; only its edges are ordered by one task,
    as the result depends on the order of visits. Children go by relation id (neighbour id for both ways).
    """
    require(entities, start)
    links = edges(relations, direction)
    ball = _union(levels(start, links, depth)).select("id")
    inside = links.join(ball.select(F.col("id").alias("node")), "node", "left_semi").select("node", "far", "rel_id", F.lit(0).alias("one"))
    by_neighbour = direction is Direction.BOTH

    def visit(pdf):
        import pandas as pd

        order = pdf.sort_values(["node", "far" if by_neighbour else "rel_id", "rel_id"])
        children = {k: v.tolist() for k, v in order.groupby("node", sort=False)["far"]}
        seen, out, stack = {start}, [(start, 0)], [(start, 0, iter(children.get(start, ())))]
        while stack:
            node, level, rest = stack[-1]
            nxt = next((c for c in rest if c not in seen), None) if level < depth else None
            if nxt is None:
                stack.pop()
                continue
            seen.add(nxt)
            out.append((nxt, level + 1))
            stack.append((nxt, level + 1, iter(children.get(nxt, ()))))
        return pd.DataFrame([(e, d, k) for k, (e, d) in enumerate(out)], columns=["entity_id", "depth", "position"])

    spark = relations.sparkSession
    seeded = inside.unionByName(spark.createDataFrame([(start, start, -1, 0)], "node long, far long, rel_id long, one int"))
    return seeded.groupBy("one").applyInPandas(visit, "entity_id long, depth int, position int")


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: totals, average degree 2E/N, largest of out- and in-degrees, largest total degree, density."""
    n, m = entities.count(), relations.count()
    ends = relations.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(relations.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    top = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).agg(F.max(F.greatest("o", "i")).alias("max_degree"), F.max(F.col("o") + F.col("i")).alias("total_max_degree"))
    return top.select(
        F.lit(n).cast("long").alias("total_entities"), F.lit(m).cast("long").alias("total_relations"), F.lit(round(2 * m / n, 6) if n else 0.0).alias("avg_degree"),
        F.coalesce("max_degree", F.lit(0)).cast("long").alias("max_degree"), F.coalesce("total_max_degree", F.lit(0)).cast("long").alias("total_max_degree"), F.lit(round(m / (n * (n - 1)), 9) if n > 1 else 0.0).alias("density"),
    )
