"""Command line: python -m graphloom.cli <command> [--db FOLDER]; a graph is the folder that KnowledgeGraph.save wrote."""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.sources import imports
from graphloom.store import KnowledgeGraph


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom")
    top.add_argument("--db", default="kg", dest="top_db")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments, db: bool = True):
        sub = commands.add_parser(name)
        for names, kw in arguments:
            sub.add_argument(*names, **kw)
        if db:
            sub.add_argument("--db", default=None)

    number = lambda name, default: ((name,), {"type": int, "default": default})
    program = (("--embedder",), {"required": True, "help": "program that reads JSON strings and writes JSON lists, one a line"})
    size = number("--dimension", imports.DIMENSION)
    add("migrate", (("--source",), {"required": True, "help": "Parquet of papers"}), (("--skills",), {"required": True}), (("--target",), {"default": "kg"}), db=False)
    add("embed", program, size, (("--papers",), {"action": "store_true"}), (("--skills",), {"action": "store_true"}), (("--all",), {"action": "store_true"}), (("--force",), {"action": "store_true"}))
    add("search", (("query",), {}), number("--k", 10), program)
    add("stats")
    add("context", (("entity_id",), {"type": int}), number("--depth", 1))
    add("find-related", (("entity_id",), {"type": int}), (("--threshold",), {"type": float, "default": 0.5}))
    add("similar", (("entity_id",), {"type": int}), number("--k", 10))
    return top


def show(rows) -> None:
    """Rows as tab-separated lines under their names; every command's result is bounded by k or by a neighbourhood."""
    print("\t".join(rows.columns))
    for r in rows.collect():
        print("\t".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r))


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "migrate":
        kg = KnowledgeGraph.open(spark, a.target) if KnowledgeGraph.exists(spark, a.target) else KnowledgeGraph.in_memory(spark)
        made = kg.migrate_all(spark.read.parquet(a.source), a.skills)
        kg.save(a.target)
        for name, n in made.items():
            print(f"{name}\t{n}")
        return 0
    db = a.db or a.top_db
    if not KnowledgeGraph.exists(spark, db):
        print(f"no graph at {db}", file=sys.stderr)
        return 1
    kg = KnowledgeGraph.open(spark, db)
    if a.command in ("embed", "search"):
        embedder = imports.CommandEmbedder(shlex.split(a.embedder))
    if a.command == "embed":
        if not imports.check_dependencies(embedder.command):
            print("the embedder does not answer", file=sys.stderr)
            return 1
        kinds = [None] if a.all or a.papers == a.skills else ["paper"] if a.papers else ["skill"]
        for kind in kinds:
            for name, n in kg.generate_embeddings(embedder, kind, a.force, a.dimension).items():
                print(f"{name}\t{n}")
        kg.save(db)
    elif a.command == "search":
        found = kg.rag(a.query, embedder, a.k, folder=f"{db}/_index")
        show(found.join(kg.entities.select(F.col("id").alias("entity_id"), "entity_type", "name"), "entity_id").orderBy(F.desc("score"), "entity_id"))
    elif a.command == "stats":
        show(kg.stats())
        show(kg.entities.groupBy("entity_type").count().orderBy("entity_type"))
        utility = F.get_json_object("properties", "$.utility").cast("double")
        show(kg.entities.where("entity_type = 'paper'").select("id", "name", utility.alias("utility")).where("utility is not null").orderBy(F.desc("utility"), "id").limit(5))
    elif a.command == "context":
        show(kg.context(a.entity_id, a.depth).orderBy("depth", "entity_id"))
    elif a.command == "find-related":
        show(kg.find_related(a.entity_id, a.threshold))
    else:
        found = kg.similar_entities(a.entity_id, a.k)
        show(found.join(kg.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").orderBy(F.desc("similarity"), "entity_id"))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
