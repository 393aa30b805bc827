"""The KnowledgeGraph facade: tables as immutable DataFrames, mutators that install new ones, atomic generations.

Bulk mutators are primary; single-row ones wrap them. Constraints that storage can't hold (endpoints,
weights, arity, dimensions, unique names) are checked by joins. ``save`` writes a generation directory and then
adds its name to the whole ones, which is the transaction boundary. Next ids are kept, so ids are never reused.
"""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import functions, schema
from graphloom.operators import algo, confidence, export, hyper, quantized, relate, retrieval, traverse, vectors, versioning
from graphloom.operators.traverse import Direction
from graphloom.runtime import cut
from graphloom.sources import imports
from graphloom.sources.mapping import Source

PARTITIONS = {"kg_entities": "entity_type", "kg_relations": "rel_type"}
_IDS = ("kg_entities", "kg_relations", "kg_hyperedges", "kg_dependencies", "kg_confidence_log", "kg_versions")


@dataclass
class KnowledgeGraph:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    next_id: dict[str, int] = field(default_factory=dict)
    weights: retrieval.Weights = field(default_factory=retrieval.Weights)
    cut_every: int = 4

    def __post_init__(self):
        for name in schema.TABLES:
            self.tables.setdefault(name, schema.empty(self.spark, name))
            self.tables[name] = schema.conform(self.tables[name], name)
        for name in _IDS:
            if name not in self.next_id:
                most = self.tables[name].agg(F.max("id")).first()[0]
                self.next_id[name] = (most or 0) + 1
        self._changes = dict.fromkeys(schema.TABLES, 0)
        self._indexes: dict[tuple, quantized.QuantizedIndex] = {}

    # opening, saving
    @classmethod
    def in_memory(cls, spark: SparkSession) -> KnowledgeGraph:
        return cls(spark)

    @classmethod
    def from_source(cls, source: Source) -> KnowledgeGraph:
        tables = {"kg_entities": source.entities(), "kg_relations": source.relations(), "kg_vectors": source.vectors(), "kg_hyperedges": source.hyperedges()}
        tables |= {"kg_dependencies": source.dependencies(), "kg_confidence_log": source.confidence_log(), "kg_versions": source.versions()}
        return cls(source.spark, tables)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KnowledgeGraph:
        """The last whole generation; tables of older schema versions are brought up to date."""
        done = _names(spark, f"{path}/_done")
        at = max(done, key=int) if done else _read(spark, f"{path}/_CURRENT").removeprefix("gen=")
        folder = f"{path}/gen={at}"
        state = json.loads(_read(spark, f"{folder}/_state.json"))
        tables = {}
        for t in state["tables"]:
            same = state["schema"] == schema.SCHEMA_VERSION
            df = spark.read.schema(schema.struct_type(t)).parquet(f"{folder}/{t}") if same else spark.read.parquet(f"{folder}/{t}")
            kind = PARTITIONS.get(t)
            tables[t] = df.withColumn(kind, F.coalesce(F.col(kind).cast("string"), F.lit(""))) if kind else df  # an empty name is written as null
        return cls(spark, tables, state["next_id"])

    def save(self, path: str) -> str:
        """Writes a new generation, relations by type and entities by kind, which filters on them prune by.

        Its name is added to _done last, by one rename to a name that isn't there yet; nothing is overwritten or
        removed, so that a crash at any point leaves the generation before as the last whole one.
        """
        done = _names(self.spark, f"{path}/_done")
        at = str(max([time.time_ns(), *(int(x) + 1 for x in done)]))
        for name, df in self.tables.items():
            writer = df.write.partitionBy(PARTITIONS[name]) if name in PARTITIONS else df.write
            writer.parquet(f"{path}/gen={at}/{name}")
        _write(self.spark, f"{path}/gen={at}/_state.json", json.dumps({"tables": list(self.tables), "next_id": self.next_id, "schema": schema.SCHEMA_VERSION}))
        _write(self.spark, f"{path}/_done/{at}", "")
        return f"gen={at}"

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        """Whether a whole generation is there."""
        return bool(_names(spark, f"{path}/_done"))

    @staticmethod
    def schema_version(spark: SparkSession, path: str) -> int:
        at = max(_names(spark, f"{path}/_done"), key=int)
        return json.loads(_read(spark, f"{path}/gen={at}/_state.json"))["schema"]

    def register_views(self) -> None:
        """Temp views of all tables and of the bridge, and the SQL functions, for spark.sql."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        hyper.bridge(self.hyperedges).createOrReplaceTempView("kg_hyperedge_entities")
        functions.register(self.spark)
        functions.register_stats(self.spark)

    def publish(self, algorithm: str, *args, **kw) -> DataFrame:
        """Runs an algorithm and makes its rows the view kg_<algorithm>_result, for SQL: the names of kg_<algorithm>()."""
        run = {"pagerank": self.pagerank, "louvain": self.louvain, "bfs": self.bfs, "shortest_path": self.shortest_path, "connected_components": self.connected_components}
        if algorithm not in run:
            raise schema.InvalidInput(algorithm)
        rows = cut(run[algorithm](*args, **kw))
        rows.createOrReplaceTempView(f"kg_{algorithm}_result")
        return rows

    def sql(self, text: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(text)

    @contextmanager
    def transaction(self):
        """Undoes every change of the block if it raises."""
        tables, ids = dict(self.tables), dict(self.next_id)
        try:
            yield self
        except BaseException:
            self.tables, self.next_id = tables, ids
            raise

    # tables
    entities = property(lambda self: self.tables["kg_entities"])
    relations = property(lambda self: self.tables["kg_relations"])
    vectors = property(lambda self: self.tables["kg_vectors"])
    hyperedges = property(lambda self: self.tables["kg_hyperedges"])
    dependencies = property(lambda self: self.tables["kg_dependencies"])
    log = property(lambda self: self.tables["kg_confidence_log"])
    versions = property(lambda self: self.tables["kg_versions"])

    def _install(self, name: str, df: DataFrame) -> None:
        self._changes[name] += 1
        df = schema.conform(df, name)
        self.tables[name] = cut(df) if self._changes[name] % self.cut_every == 0 else df

    def _add(self, name: str, rows: DataFrame) -> None:
        self._install(name, self.tables[name].unionByName(schema.conform(rows, name)))

    def _ids(self, name: str, n: int) -> range:
        first = self.next_id[name]
        self.next_id[name] = first + n
        return range(first, first + n)

    def _rows(self, rows: list[dict], table: str) -> DataFrame:
        kind = schema.struct_type(table)
        defaults = {c: d for c, (_, d) in schema.TABLES[table].items()}
        full = [tuple(r.get(f.name, None if defaults[f.name] is None else _typed(defaults[f.name], f.dataType)) for f in kind) for r in rows]
        return self.spark.createDataFrame(full, kind)

    # entities
    def insert_entities(self, rows: list[dict], now: int | None = None) -> list[int]:
        """rows of entity_type, name and optional properties (dict) and other columns; returns the new ids."""
        now = int(time.time()) if now is None else now
        ids = list(self._ids("kg_entities", len(rows)))
        full = [{"created_at": now, "updated_at": now, **r, "id": i, "properties": json.dumps(r.get("properties") or {}, sort_keys=True)} for i, r in zip(ids, rows, strict=True)]
        self._add("kg_entities", self._rows(full, "kg_entities"))
        return ids

    def insert_entity(self, entity_type: str, name: str, properties: dict | None = None, **more) -> int:
        return self.insert_entities([{"entity_type": entity_type, "name": name, "properties": properties, **more}])[0]

    def insert_entities_df(self, rows: DataFrame) -> None:
        """Bulk insert of a DataFrame that has ids above every known one."""
        self._add("kg_entities", rows)
        self.next_id["kg_entities"] = max(self.next_id["kg_entities"], (self.entities.agg(F.max("id")).first()[0] or 0) + 1)

    def get_entity(self, entity_id: int):
        row = self.entities.where(F.col("id") == entity_id).first()
        if row is None:
            raise schema.EntityNotFound(entity_id)
        return row

    def get_entities_by_ids(self, ids: list[int]) -> DataFrame:
        return self.entities.join(self._id_rows(ids), "id", "left_semi")

    def _id_rows(self, ids, name: str = "id") -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in ids], f"{name} long")

    def list_entities(self, entity_type: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self.entities if entity_type is None else self.entities.where(F.col("entity_type") == entity_type)
        rows = rows.orderBy(F.desc("created_at"), F.desc("id"))
        return rows if limit is None else rows.limit(limit)

    def get_property(self, entity_id: int, key: str):
        return json.loads(self.get_entity(entity_id)["properties"] or "{}").get(key)

    def set_property(self, entity_id: int, key: str, value, now: int | None = None) -> None:
        row = self.get_entity(entity_id)
        self.update_entity(entity_id, row["entity_type"], row["name"], json.loads(row["properties"] or "{}") | {key: value}, now)

    def update_entity(self, entity_id: int, entity_type: str, name: str, properties: dict | None = None, now: int | None = None) -> None:
        self.get_entity(entity_id)
        new = {"entity_type": entity_type, "name": name, "properties": json.dumps(properties or {}, sort_keys=True), "updated_at": int(time.time()) if now is None else now}
        hit = F.col("id") == entity_id
        self._install("kg_entities", self.entities.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()}))

    def delete_entities(self, ids: list[int]) -> None:
        """Removes entities and all that hangs on them; hyperedges lose the members, and go below two."""
        out = lambda df, col: df.join(self._id_rows(ids, col), col, "left_anti")
        self._install("kg_entities", out(self.entities, "id"))
        self._install("kg_relations", out(out(self.relations, "source_id"), "target_id"))
        self._install("kg_vectors", out(self.vectors, "entity_id"))
        self._install("kg_dependencies", out(out(self.dependencies, "source_id"), "target_id"))
        self._install("kg_confidence_log", out(self.log, "entity_id"))
        hit = hyper.bridge(self.hyperedges).join(self._id_rows(ids, "entity_id"), "entity_id", "left_semi").groupBy(F.col("hyperedge_id").alias("id")).agg(F.collect_set("entity_id").alias("_gone"))
        left = self.hyperedges.join(hit, "id", "left").withColumn("entity_ids", F.when(F.col("_gone").isNull(), F.col("entity_ids")).otherwise(F.filter("entity_ids", lambda x: ~F.array_contains("_gone", x))))
        self._install("kg_hyperedges", left.withColumn("arity", F.size("entity_ids")).where("arity >= 2"))

    def delete_entity(self, entity_id: int) -> None:
        self.get_entity(entity_id)
        self.delete_entities([entity_id])

    # relations
    def insert_relations(self, rows: list[dict], now: int | None = None) -> list[int]:
        for r in rows:
            schema.check_weight(r.get("weight", 1.0))
        ends = {r[c] for r in rows for c in ("source_id", "target_id")}
        self._require(ends)
        ids = list(self._ids("kg_relations", len(rows)))
        now = int(time.time()) if now is None else now
        full = [{"created_at": now, "weight": 1.0, **r, "id": i, "properties": json.dumps(r.get("properties") or {}, sort_keys=True)} for i, r in zip(ids, rows, strict=True)]
        self._add("kg_relations", self._rows(full, "kg_relations"))
        return ids

    def insert_relation(self, source_id: int, target_id: int, rel_type: str, weight: float = 1.0, properties: dict | None = None) -> int:
        return self.insert_relations([{"source_id": source_id, "target_id": target_id, "rel_type": rel_type, "weight": weight, "properties": properties}])[0]

    def _require(self, ids: set[int]) -> None:
        missing = self._id_rows(ids).join(self.entities.select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
        if missing is not None:
            raise schema.EntityNotFound(missing)

    def get_relations_by_source(self, entity_id: int) -> DataFrame:
        return self.relations.where(F.col("source_id") == entity_id)

    # hyperedges
    def insert_hyperedge(self, entity_ids: list[int], hyperedge_type: str, weight: float = 1.0, properties: dict | None = None, now: int | None = None) -> int:
        self._check_hyperedge(entity_ids, weight)
        now = int(time.time()) if now is None else now
        new = self._ids("kg_hyperedges", 1)[0]
        row = {"id": new, "hyperedge_type": hyperedge_type, "entity_ids": entity_ids, "weight": float(weight), "arity": len(entity_ids), "properties": json.dumps(properties or {}), "created_at": now, "updated_at": now}
        self._add("kg_hyperedges", self._rows([row], "kg_hyperedges"))
        return new

    def _check_hyperedge(self, entity_ids: list[int], weight: float) -> None:
        if len(entity_ids) < 2:
            raise schema.InvalidArity(len(entity_ids))
        if len(set(entity_ids)) != len(entity_ids):
            raise schema.InvalidInput("a member twice")
        schema.check_weight(weight)
        self._require(set(entity_ids))

    def get_hyperedge(self, hyperedge_id: int):
        row = self.hyperedges.where(F.col("id") == hyperedge_id).first()
        if row is None:
            raise schema.HyperedgeNotFound(hyperedge_id)
        return row

    def list_hyperedges(self, *args, **kw) -> DataFrame:
        return hyper.list_hyperedges(self.hyperedges, *args, **kw)

    def update_hyperedge(self, hyperedge_id: int, entity_ids: list[int], hyperedge_type: str, weight: float, now: int | None = None) -> None:
        self.get_hyperedge(hyperedge_id)
        self._check_hyperedge(entity_ids, weight)
        hit = F.col("id") == hyperedge_id
        members = F.array(*[F.lit(i).cast("long") for i in entity_ids])
        new = {"entity_ids": members, "hyperedge_type": F.lit(hyperedge_type), "weight": F.lit(float(weight)), "arity": F.lit(len(entity_ids)), "updated_at": F.lit(int(time.time()) if now is None else now)}
        self._install("kg_hyperedges", self.hyperedges.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}))

    def delete_hyperedge(self, hyperedge_id: int) -> None:
        self.get_hyperedge(hyperedge_id)
        self._install("kg_hyperedges", self.hyperedges.where(F.col("id") != hyperedge_id))

    def get_higher_order_neighbors(self, entity_id: int, min_arity: int = 2, max_arity: int = 100) -> DataFrame:
        return hyper.neighbors(self.hyperedges, entity_id, min_arity, max_arity)

    def get_entity_hyperedges(self, entity_id: int) -> DataFrame:
        return hyper.entity_hyperedges(self.hyperedges, entity_id)

    def higher_order_bfs(self, start: int, depth: int, min_arity: int = 2, max_arity: int | None = 100) -> DataFrame:
        self._require({start})
        return hyper.bfs(self.hyperedges, start, depth, min_arity, max_arity)

    def higher_order_shortest_path(self, source: int, target: int, depth: int) -> DataFrame:
        self._require({source, target})
        return hyper.path(self.hyperedges, source, target, depth)

    def hyperedge_degree(self) -> DataFrame:
        return hyper.degree(self.hyperedges)

    def hypergraph_entity_pagerank(self, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
        return hyper.pagerank(self.hyperedges, damping, iterations, tolerance)

    # traversal and algorithms
    def get_neighbors(self, entity_id: int, depth: int = 1) -> DataFrame:
        return traverse.neighbors(self.entities, self.relations, entity_id, depth)

    def context(self, entity_id: int, depth: int = 1) -> DataFrame:
        traverse.require(self.entities, entity_id)
        return traverse.context(self.entities, self.relations, entity_id, depth)

    def find_related(self, entity_id: int, threshold: float) -> DataFrame:
        return traverse.find_related(self.entities, self.relations, entity_id, threshold)

    def bfs(self, start: int, direction: Direction = Direction.OUTGOING, depth: int = 3, **filters) -> DataFrame:
        return traverse.bfs(self.entities, self.relations, start, direction, depth, **filters)

    def dfs(self, start: int, direction: Direction = Direction.OUTGOING, depth: int = 3) -> DataFrame:
        return traverse.dfs(self.entities, self.relations, start, direction, depth)

    def shortest_path(self, source: int, target: int, depth: int = 10) -> DataFrame:
        return traverse.shortest_path(self.relations, source, target, depth)

    def stats(self) -> DataFrame:
        return traverse.graph_stats(self.entities, self.relations)

    def pagerank(self, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
        return algo.pagerank(self.relations, damping, iterations, tolerance).orderBy(F.desc("score"), "entity_id")

    def louvain(self) -> DataFrame:
        return algo.louvain(self.entities, self.relations)

    def connected_components(self) -> DataFrame:
        return algo.weak_components(self.entities, self.relations)

    def strongly_connected_components(self) -> DataFrame:
        return algo.strong_components(self.relations)

    def analyze(self) -> DataFrame:
        return algo.analyze(self.entities, self.relations)

    # vectors and retrieval
    def insert_vectors(self, rows: list[tuple[int, list[float]]], now: int | None = None) -> None:
        """Inserts or replaces; all must have the stored dimension."""
        if not rows:
            return
        size = len(rows[0][1])
        if any(len(v) != size for _, v in rows):
            raise schema.InvalidVectorDimension("mixed dimensions")
        vectors.check_dimension(self.vectors, size)
        self._require({i for i, _ in rows})
        now = int(time.time()) if now is None else now
        new = self._rows([{"entity_id": i, "vector": [float(x) for x in v], "dimension": size, "created_at": now} for i, v in rows], "kg_vectors")
        kept = self.vectors.join(self._id_rows({i for i, _ in rows}, "entity_id"), "entity_id", "left_anti")
        self._install("kg_vectors", kept.unionByName(new))

    def insert_vector(self, entity_id: int, vector: list[float]) -> None:
        self.insert_vectors([(entity_id, vector)])

    def get_vector(self, entity_id: int) -> list[float]:
        return vectors.vector_of(self.vectors, entity_id)

    def search_vectors(self, query: list[float], k: int) -> DataFrame:
        return vectors.top_k(self.vectors, query, k)

    def semantic_search(self, query: list[float], k: int) -> DataFrame:
        return retrieval.semantic(self.entities, self.vectors, query, k)

    def similar_entities(self, entity_id: int, k: int) -> DataFrame:
        return vectors.similar_entities(self.vectors, entity_id, k)

    def hybrid_search(self, text: str, query: list[float], k: int) -> DataFrame:
        """The text takes no part in the ranking, as in the interface that this follows."""
        return retrieval.hybrid(self.entities, self.relations, self.vectors, query, k)

    def smart_search(self, query: list[float], k: int, now: int | None = None) -> DataFrame:
        return retrieval.smart(self.entities, self.vectors, self.dependencies, self.log, query, k, int(time.time()) if now is None else now, self.weights)

    def rag_search(self, query: list[float], k: int, config: retrieval.RagConfig | None = None) -> DataFrame:
        return retrieval.rag(self.entities, self.relations, self.vectors, query, k, config)

    def build_index(self, bits: int = 3, seed: int = 42) -> quantized.QuantizedIndex:
        row = self.vectors.select(F.size("vector").alias("n")).first()
        return quantized.QuantizedIndex(row["n"] if row else imports.DIMENSION, bits, seed).build(self.vectors)

    def index(self, bits: int = 3, seed: int = 42, folder: str | None = None) -> quantized.QuantizedIndex:
        """The quantized index of the vectors as they are now, kept under their content hash, and in a folder if one is named."""
        key = (bits, seed, str(vectors.content_hash(self.vectors)))
        if key not in self._indexes:
            at = None if folder is None else f"{folder}/index-{bits}-{seed}-{key[2]}"
            if at is not None and _names(self.spark, f"{at}/spec"):
                self._indexes[key] = quantized.QuantizedIndex.load(self.spark, at)
            else:
                made = self.build_index(bits, seed)
                if at is not None:
                    made.save(at)
                    made = quantized.QuantizedIndex.load(self.spark, at)
                else:
                    made.codes = cut(made.codes)
                self._indexes = {k: v for k, v in self._indexes.items() if k[2] == key[2]} | {key: made}
        return self._indexes[key]

    def rag(self, text: str, embedder, k: int, config: retrieval.RagConfig | None = None, folder: str | None = None) -> DataFrame:
        """rag_search for a text: embedded by a callable on a list of texts, with the kept index."""
        query = [float(x) for x in embedder([text])[0]]
        vectors.check_dimension(self.vectors, len(query))
        c = config or retrieval.RagConfig()
        return retrieval.rag(self.entities, self.relations, self.vectors, query, k, c, self.index(c.bits, folder=folder))

    # confidence
    def dependents_of(self, entity_id: int) -> DataFrame:
        return confidence.dependents_of(self.dependencies, entity_id)

    def add_dependency(self, source_id: int, target_id: int, dep_type: str = "depends_on", now: int | None = None) -> int:
        self._require({source_id, target_id})
        new = self._ids("kg_dependencies", 1)[0]
        row = {"id": new, "source_id": source_id, "target_id": target_id, "dep_type": dep_type, "created_at": int(time.time()) if now is None else now}
        self._add("kg_dependencies", self._rows([row], "kg_dependencies"))
        return new

    def get_confidence(self, entity_id: int, now: int | None = None) -> float:
        self.get_entity(entity_id)
        rows = confidence.live(self.entities.where(F.col("id") == entity_id), self.log, int(time.time()) if now is None else now)
        return rows.first()["confidence"]

    def update_confidence(self, entity_id: int, feedback: float, now: int | None = None) -> float:
        """Logs the actual change of the clamped feedback and refreshes the cached value."""
        now = int(time.time()) if now is None else now
        old = self.get_confidence(entity_id, now)
        self._log(entity_id, old, old + feedback, "feedback", now)
        new = self.get_confidence(entity_id, now)
        last = self.next_id["kg_confidence_log"] - 1
        self._install("kg_confidence_log", self.log.withColumn("new_value", F.when(F.col("id") == last, F.lit(new)).otherwise(F.col("new_value"))))
        self._install("kg_entities", self.entities.withColumn("confidence", F.when(F.col("id") == entity_id, F.lit(new)).otherwise(F.col("confidence"))))
        return new

    def _log(self, entity_id: int, old: float, new: float, reason: str, now: int) -> None:
        row = {"id": self._ids("kg_confidence_log", 1)[0], "entity_id": entity_id, "old_value": float(old), "new_value": float(new), "reason": reason, "created_at": now}
        self._add("kg_confidence_log", self._rows([row], "kg_confidence_log"))

    def propagate_ripple(self, origin: int, penalty: float, now: int | None = None) -> DataFrame:
        """Applies the penalties to the cached confidences and logs them; returns the log rows."""
        self.get_entity(origin)
        now = int(time.time()) if now is None else now
        change = cut(confidence.ripple_log(self.entities, confidence.ripple(self.dependencies, origin, penalty)))
        joined = self.entities.join(change.select(F.col("entity_id").alias("id"), "new_value"), "id", "left")
        self._install("kg_entities", joined.withColumn("confidence", F.coalesce("new_value", "confidence")))
        rows = imports.numbered(change, "entity_id", self.next_id["kg_confidence_log"])
        self.next_id["kg_confidence_log"] += change.count()
        self._add("kg_confidence_log", rows.select("id", "entity_id", "old_value", "new_value", F.lit("ripple").alias("reason"), F.lit(now).alias("created_at")))
        return change

    def record_access(self, ids: list[int], now: int | None = None) -> None:
        hit = F.col("id").isin(ids)
        now = int(time.time()) if now is None else now
        self._install("kg_entities", self.entities.withColumn("access_count", F.col("access_count") + F.when(hit, 1).otherwise(0)).withColumn("last_accessed", F.when(hit, F.lit(now)).otherwise(F.col("last_accessed"))))

    # versions
    def create_version(self, name: str, branch: str = "main", parent_id: int | None = None, description: str | None = None, now: int | None = None, is_merged: bool = False) -> int:
        new = self.next_id["kg_versions"]
        made = versioning.create(self.versions, new, name, int(time.time()) if now is None else now, branch, parent_id, description, is_merged)
        self._install("kg_versions", made)
        self.next_id["kg_versions"] += 1
        return new

    def _slot(self, version_id: int) -> int:
        return versioning.find(self.versions, version_id)["bit_slot"]

    def delete_version(self, version_id: int) -> None:
        slot = self._slot(version_id)
        for t in ("kg_entities", "kg_relations"):
            self._install(t, versioning.unmark(self.tables[t], slot))
        rest = self.versions.where(F.col("id") != version_id)
        self._install("kg_versions", rest.withColumn("parent_id", F.when(F.col("parent_id") != version_id, F.col("parent_id"))))

    def get_version(self, version_id: int):
        return versioning.find(self.versions, version_id)

    def ensure_version(self, name: str, **more) -> int:
        """The id of the version of that name, created if there is none."""
        row = self.versions.where(F.col("name") == name).select("id").first()
        return self.create_version(name, **more) if row is None else row["id"]

    def list_versions(self) -> DataFrame:
        return versioning.listed(self.versions)

    def version_add(self, version_id: int, entity_ids: list[int] = (), relation_ids: list[int] = ()) -> None:
        self._membership(version_id, entity_ids, relation_ids, versioning.mark)

    def version_remove(self, version_id: int, entity_ids: list[int] = (), relation_ids: list[int] = ()) -> None:
        self._membership(version_id, entity_ids, relation_ids, versioning.unmark)

    def _membership(self, version_id, entity_ids, relation_ids, change) -> None:
        slot = self._slot(version_id)
        for t, ids, error in (("kg_entities", entity_ids, schema.EntityNotFound), ("kg_relations", relation_ids, schema.RelationNotFound)):
            if ids:
                missing = self._id_rows(set(ids)).join(self.tables[t].select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
                if missing is not None:
                    raise error(missing)
                marked = self.tables[t].join(self._id_rows(set(ids)).withColumn("_hit", F.lit(True)), "id", "left")
                self._install(t, change(marked, slot, F.coalesce("_hit", F.lit(False))))

    def snapshot(self, version_id: int) -> None:
        slot = self._slot(version_id)
        for t in ("kg_entities", "kg_relations"):
            self._install(t, versioning.mark(self.tables[t], slot))

    def version_entities(self, version_id: int, entity_type: str | None = None) -> DataFrame:
        return versioning.version_entities(self.entities, self._slot(version_id), entity_type)

    def version_relations(self, version_id: int, rel_type: str | None = None, source: int | None = None, target: int | None = None) -> DataFrame:
        return versioning.version_relations(self.relations, self._slot(version_id), rel_type, source, target)

    def version_neighbors(self, version_id: int, entity_id: int, depth: int = 1) -> DataFrame:
        return versioning.version_neighbors(self.entities, self.relations, self._slot(version_id), entity_id, depth)

    def version_compare(self, first: int, second: int) -> tuple[DataFrame, DataFrame]:
        a, b = self._slot(first), self._slot(second)
        return versioning.diff(self.entities, a, b), versioning.diff(self.relations, a, b)

    def version_entity_history(self, entity_id: int) -> DataFrame:
        self.get_entity(entity_id)
        return versioning.history(self.entities, self.versions, entity_id)

    def version_merge(self, version_ids: list[int], name: str, strategy: versioning.MergeStrategy, now: int | None = None) -> int:
        if len(version_ids) < 2:
            raise schema.InvalidMerge("two versions at least")
        slots = [self._slot(v) for v in version_ids]
        new = self.create_version(name, "main", version_ids[0], None, now, is_merged=True)
        e, r = versioning.merge(self.entities, self.relations, slots, self._slot(new), strategy)
        self._install("kg_entities", e)
        self._install("kg_relations", r)
        return new

    # import, relation building, export
    def migrate_papers(self, table: DataFrame) -> int:
        rows = cut(imports.papers(table, self.next_id["kg_entities"]))
        self.insert_entities_df(rows)
        self._add("kg_vectors", imports.placeholders(rows))
        return rows.count()

    def migrate_skills(self, folder: str) -> int:
        rows = cut(imports.skills(imports.skill_files(self.spark, folder), self.next_id["kg_entities"]))
        self.insert_entities_df(rows)
        return rows.count()

    def migrate_all(self, papers: DataFrame, skills_folder: str, threshold: float = 0.3) -> dict[str, int]:
        """Papers, skills, then the relations between them; how many of each."""
        with self.transaction():
            return {"papers": self.migrate_papers(papers), "skills": self.migrate_skills(skills_folder), "relations": self.build_relationships(threshold)}

    def count_entities(self, entity_type: str | None = None) -> int:
        return self.list_entities(entity_type).count()

    def generate_embeddings(self, embedder, kind: str | None = None, force: bool = False, dimension: int = imports.DIMENSION) -> dict[str, int]:
        """embed_missing; total, processed and skipped entities."""
        total = self.count_entities(kind)
        made = self.embed_missing(embedder, kind, force, dimension)
        return {"total": total, "processed": made, "skipped": total - made}

    def build_relationships(self, threshold: float = 0.3) -> int:
        """derived_from, related_by_keywords and similar_to relations; returns how many."""
        papers, skills = self.entities.where("entity_type = 'paper'"), self.entities.where("entity_type = 'skill'")
        made = relate.derived_from(papers, skills).select("source_id", "target_id", F.lit("derived_from").alias("rel_type"), F.lit(1.0).alias("weight"))
        for rows, kind, tokens in (
            (papers, "related_by_keywords", relate.keyword_set(F.get_json_object("properties", "$.keywords"))),
            (skills, "similar_to", relate.word_set(F.get_json_object("properties", "$.description"))),
        ):
            pairs = relate.jaccard_pairs(rows.select("id", tokens.alias("tokens")), threshold)
            made = made.unionByName(pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit(kind).alias("rel_type"), F.col("similarity").alias("weight")))
        made = cut(made.withColumn("order", F.struct("rel_type", "source_id", "target_id")))
        rows = imports.numbered(made, "order", self.next_id["kg_relations"]).drop("order")
        n = made.count()
        self._add("kg_relations", rows)
        self.next_id["kg_relations"] += n
        return n

    def embed_missing(self, embedder, kind: str | None = None, force: bool = False, dimension: int = imports.DIMENSION) -> int:
        queue = cut(imports.needs_embedding(self.entities, self.vectors, kind, force))
        new = cut(imports.embed(queue, embedder, dimension))
        self._install("kg_vectors", self.vectors.join(queue.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").unionByName(new))
        return new.count()

    def export_d3(self, path: str, now: int | None = None) -> dict:
        """Writes nodes and links as JSON lines, in id order; returns the metadata."""
        export.d3_nodes(self.entities).orderBy("id").select("json").write.mode("overwrite").text(f"{path}/nodes")
        export.d3_links(self.relations).orderBy("id").select("json").write.mode("overwrite").text(f"{path}/links")
        return export.d3_metadata(self.entities, self.relations, now)

    def export_dot(self, config: export.DotConfig | None = None) -> str:
        return export.dot_text(self.entities, self.relations, config)

    def stats_json(self) -> str:
        return functions.stats_json(self.entities, self.relations)


def _typed(text: str, kind):
    from pyspark.sql import types as T

    if isinstance(kind, T.DoubleType):
        return float(text)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(text)
    return text == "true" if isinstance(kind, T.BooleanType) else text


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> str:
    files, at = _file(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder but for those that begin with a dot or underscore or end in .new; none if it isn't there."""
    files, at = _file(spark, path)
    if not files.exists(at):
        return []
    names = [str(f.getPath().getName()) for f in files.listStatus(at)]
    return [n for n in names if n[0] not in "._" and not n.endswith(".new")]


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new file beside its place and renames it there."""
    files, at = _file(spark, path)
    _, temp = _file(spark, path + ".new")
    out = files.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(temp, at):
        raise OSError(f"{path} can't be written")
