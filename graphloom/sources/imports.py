"""Imports: papers, skill directories, and the queue of entities that need an embedding."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import InvalidInput, InvalidVectorDimension, conform

PAPER_COLUMNS = ("file_path", "keywords", "utility", "skill_created", "last_accessed", "created_at", "notes")
DIMENSION = 384


def papers(table: DataFrame, first_id: int = 1) -> DataFrame:
    """kg_entities of type paper: named by title, non-null columns as properties, ids in order of arxiv_id.

    Ids continue a range-sorted order: partition sizes give each partition its first id, so nothing is
    numbered in one task.
    """
    props = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ("arxiv_id", *PAPER_COLUMNS)]))
    rows = numbered(table.select("arxiv_id", "title", props.alias("properties")), "arxiv_id", first_id)
    return conform(rows.select("id", F.lit("paper").alias("entity_type"), F.col("title").alias("name"), "properties"), "kg_entities")


def numbered(rows: DataFrame, order: str, first_id: int) -> DataFrame:
    """rows with consecutive ids by order; two passes over a range partitioning, no global window."""
    from pyspark.sql import Window

    from graphloom.runtime import cut

    placed = cut(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # a row a partition
    begin, total = {}, first_id
    for part in sorted(sizes):
        begin[part] = total
        total += sizes[part]
    starts = rows.sparkSession.createDataFrame(list(begin.items()), "_part int, _begin long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return placed.join(F.broadcast(starts), "_part").withColumn("id", F.col("_begin") + local - 1).drop("_part", "_begin")


def placeholders(entities: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """All-zero vectors, to be replaced when embeddings are made."""
    return conform(entities.select(F.col("id").alias("entity_id"), F.array_repeat(F.lit(0.0).cast("float"), dimension).alias("vector"), F.lit(dimension).alias("dimension"), "created_at"), "kg_vectors")


def description(content: Column | str) -> Column:
    """The first trimmed line that is neither empty nor a heading; empty if there is none."""
    lines = F.filter(F.transform(F.split(content, "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def skill_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of each directory's SKILL.md."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "SKILL.md").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)/SKILL\\.md$", 1).alias("name"), F.decode("content", "UTF-8").alias("content"))


def skills(files: DataFrame, first_id: int = 1) -> DataFrame:
    """kg_entities of type skill, with description and content as properties."""
    rows = numbered(files.select("name", F.to_json(F.struct(description("content").alias("description"), "content")).alias("properties")), "name", first_id)
    return conform(rows.select("id", F.lit("skill").alias("entity_type"), "name", "properties"), "kg_entities")


def needs_embedding(entities: DataFrame, vectors: DataFrame, kind: str | None = None, force: bool = False) -> DataFrame:
    """id and name of entities whose vector is missing or all zero (all of them if forced), by id."""
    rows = entities if kind is None else entities.where(F.col("entity_type") == kind)
    if not force:
        done = vectors.where(F.exists("vector", lambda x: x != 0)).select(F.col("entity_id").alias("id"))
        rows = rows.join(done, "id", "left_anti")
    return rows.select("id", "name").orderBy("id")


def embed(queue: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dimension: int = DIMENSION, batch: int = 100) -> DataFrame:
    """kg_vectors of the queue's names by a callable on batches of texts; line feeds count as blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                got = embedder([(t or "").replace("\n", " ") for t in part.column("name").to_pylist()])
                if any(len(v) != dimension for v in got):
                    raise InvalidVectorDimension(str(dimension))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got, pa.list_(pa.float32())), pa.array([dimension] * len(got), pa.int32())], ["entity_id", "vector", "dimension"])

    return conform(queue.select("id", "name").mapInArrow(run, "entity_id long, vector array<float>, dimension int"), "kg_vectors")


def embed_stats(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """entity_type, total, pending, done."""
    flag = entities.join(needs_embedding(entities, vectors).select("id", F.lit(1).alias("pending")), "id", "left")
    return flag.groupBy("entity_type").agg(F.count("*").alias("total"), F.count("pending").alias("pending"), (F.count("*") - F.count("pending")).alias("done"))


class FixedEmbedder:
    """Gives every text the same vector: for tests."""

    def __init__(self, vector: list[float]):
        self.vector = list(vector)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.vector for _ in texts]


class CommandEmbedder:
    """An external program: texts on its standard input, one JSON string a line; a JSON list of numbers a line comes back.

    It is started once a batch, on the executor that holds the rows.
    """

    def __init__(self, command: list[str], timeout: float = 600):
        self.command, self.timeout = list(command), timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        lines = "".join(json.dumps(t) + "\n" for t in texts)
        done = subprocess.run(self.command, input=lines, capture_output=True, text=True, timeout=self.timeout)
        if done.returncode:
            raise InvalidInput(f"the embedder ended with {done.returncode}: {done.stderr[-300:]}")
        got = [json.loads(line) for line in done.stdout.splitlines() if line.strip()]
        if len(got) != len(texts):
            raise InvalidInput(f"{len(got)} vectors for {len(texts)} texts")
        return got


def check_dependencies(command: list[str]) -> bool:
    """Whether the program of a CommandEmbedder can be started and answers one text."""
    try:
        return len(CommandEmbedder(command, 60)(["test"])) == 1
    except (OSError, ValueError, subprocess.SubprocessError, InvalidInput):
        return False
