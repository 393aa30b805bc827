"""Scalar-quantized search: rotate, quantize each coordinate, rank by cosine in code space.

A random orthogonal rotation (QR of a seeded Gaussian matrix) makes coordinates of unit vectors near N(0, 1/d); a
Lloyd codebook of 2**bits centroids, started at quantiles, is fitted to that distribution. The matrix and the
codebook are driver-side and their sizes depend on the dimension alone. Codes are made by matrix
products over Arrow batches and kept as a table; ties go to the smaller id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import vectors as exact
from graphloom.schema import InvalidInput, InvalidVectorDimension


def lloyd(bits: int, sigma: float, seed: int, samples: int = 50_000, rounds: int = 60) -> np.ndarray:
    x = np.sort(np.random.default_rng(seed).normal(0, sigma, samples))
    c = np.quantile(x, (np.arange(1 << bits) + 0.5) / (1 << bits))
    for _ in range(rounds):
        at = np.searchsorted((c[1:] + c[:-1]) / 2, x)
        sums, counts = np.bincount(at, weights=x, minlength=len(c)), np.bincount(at, minlength=len(c))
        c = np.where(counts > 0, sums / np.maximum(counts, 1), c)
    return c


def _quantize(x: np.ndarray, rotation: np.ndarray, edges: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.searchsorted(edges, x / np.where(norm > 0, norm, 1) @ rotation).astype(np.uint8)


@dataclass
class QuantizedIndex:
    dimension: int
    bits: int = 3
    seed: int = 42

    def __post_init__(self):
        if not 1 <= self.bits <= 8:
            raise InvalidInput("bits must be 1 to 8")
        q, r = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(self.dimension, self.dimension)))
        self.rotation = q * np.sign(np.diag(r))
        self.codebook = lloyd(self.bits, 1 / np.sqrt(self.dimension), self.seed)
        self.edges = (self.codebook[1:] + self.codebook[:-1]) / 2
        self.codes: DataFrame | None = None

    def quantize(self, x: np.ndarray) -> np.ndarray:
        return _quantize(x, self.rotation, self.edges)

    def dequantize(self, codes: np.ndarray) -> np.ndarray:
        return self.codebook[codes]

    def build(self, vectors: DataFrame) -> QuantizedIndex:
        """Codes of all vectors: (entity_id, codes, norm)."""
        dimension, rotation, edges = self.dimension, self.rotation, self.edges

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = np.asarray(batch.column("vector").flatten(), np.float64)
                if len(flat) != batch.num_rows * dimension:
                    raise InvalidVectorDimension(str(dimension))
                x = flat.reshape(-1, dimension)
                yield pa.RecordBatch.from_arrays([batch.column("entity_id"), pa.array([c.tobytes() for c in _quantize(x, rotation, edges)], pa.binary()), pa.array(np.linalg.norm(x, axis=1))], ["entity_id", "codes", "norm"])

        self.codes = vectors.select("entity_id", "vector").mapInArrow(run, "entity_id long, codes binary, norm double")
        return self

    def add(self, vectors: DataFrame) -> QuantizedIndex:
        """Codes of more vectors; those of ids that are there already replace them."""
        if self.codes is None:
            return self.build(vectors)
        old = self.codes
        new = self.build(vectors).codes
        self.codes = old.join(new.select("entity_id"), "entity_id", "left_anti").unionByName(new)
        return self

    def __len__(self) -> int:
        return 0 if self.codes is None else self.codes.count()

    def _scored(self, queries: list[list[float]]) -> DataFrame:
        """query, entity_id, similarity of every row and query: one scan, a matrix product a batch."""
        if any(len(q) != self.dimension for q in queries):
            raise InvalidVectorDimension(str(self.dimension))
        q = self.dequantize(self.quantize(np.array(queries, np.float64).reshape(-1, self.dimension)))
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q, dimension, codebook = q / np.where(norm > 0, norm, 1), self.dimension, self.codebook

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = codebook[np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, dimension)]
                n = np.linalg.norm(x, axis=1)
                found = np.where(n > 0, q @ x.T / np.where(n > 0, n, 1), 0.0)
                ids = pa.array(np.tile(np.asarray(batch.column("entity_id")), len(q)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), len(x))), ids, pa.array(found.reshape(-1))], ["query", "entity_id", "similarity"])

        scored = self.codes.select("entity_id", "codes").mapInArrow(run, "query int, entity_id long, similarity double")
        return scored.withColumn("similarity", F.round("similarity", 6))

    def search(self, query: list[float], k: int) -> DataFrame:
        """entity_id, similarity: cosine of the dequantized codes of query and rows."""
        return self._scored([query]).drop("query").orderBy(F.desc("similarity"), "entity_id").limit(max(k, 0))

    def search_batch(self, queries: list[list[float]], k: int) -> DataFrame:
        """query, entity_id, similarity for each query of a list; the k best of a partition are picked before the shuffle."""
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "entity_id"))
        return self._scored(queries).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")

    def remove(self, entity_ids: list[int]) -> QuantizedIndex:
        self.codes = self.codes.join(self.codes.sparkSession.createDataFrame([(int(i),) for i in entity_ids], "entity_id long"), "entity_id", "left_anti")
        return self

    def clear(self) -> QuantizedIndex:
        self.codes = self.codes.limit(0)
        return self

    def stats(self) -> DataFrame:
        size = F.count("*")
        return self.codes.agg(
            size.alias("vector_count"), F.lit(self.dimension).alias("dimension"), F.lit(self.bits).alias("bits"), (size * self.dimension).alias("code_bytes"), F.lit(round(32 / self.bits, 6)).alias("nominal_ratio")
        )

    def save(self, path: str) -> None:
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        spec = json.dumps({"dimension": self.dimension, "bits": self.bits, "seed": self.seed})
        self.codes.sparkSession.createDataFrame([(spec,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")

    @classmethod
    def load(cls, spark, path: str) -> QuantizedIndex:
        index = cls(**json.loads(spark.read.text(f"{path}/spec").first()["value"]))
        index.codes = spark.read.parquet(f"{path}/codes")
        return index

    def to_bytes(self) -> bytes:
        """The index as one Arrow stream; it is collected, so for indexes that the driver can hold."""
        table = self.codes.toArrow()
        spec = json.dumps({"dimension": self.dimension, "bits": self.bits, "seed": self.seed})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema.with_metadata({"spec": spec})) as stream:
            stream.write_table(table.replace_schema_metadata({"spec": spec}))
        return out.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, spark, data: bytes) -> QuantizedIndex:
        table = pa.ipc.open_stream(data).read_all()
        index = cls(**json.loads(table.schema.metadata[b"spec"]))
        index.codes = spark.createDataFrame(table.replace_schema_metadata(None), "entity_id long, codes binary, norm double")
        return index


class LinearScanIndex:
    """The exact index: all vectors, ranked by cosine in double precision."""

    def __init__(self, spark, dimension: int):
        self.dimension = dimension
        self.vectors = spark.createDataFrame([], "entity_id long, vector array<float>")

    def add(self, vectors: DataFrame) -> LinearScanIndex:
        new = vectors.select(F.col("entity_id").cast("long").alias("entity_id"), F.col("vector").cast("array<float>").alias("vector"))
        if not new.where(F.size("vector") != self.dimension).isEmpty():
            raise InvalidVectorDimension(str(self.dimension))
        self.vectors = self.vectors.join(new.select("entity_id"), "entity_id", "left_anti").unionByName(new)
        return self

    def search(self, query: list[float], k: int) -> DataFrame:
        if len(query) != self.dimension:
            raise InvalidVectorDimension(str(len(query)))
        return exact.top_k(self.vectors, query, k)

    def clear(self) -> LinearScanIndex:
        self.vectors = self.vectors.limit(0)
        return self

    def __len__(self) -> int:
        return self.vectors.count()

    def stats(self) -> DataFrame:
        n = F.count("*")
        return self.vectors.agg(n.alias("vector_count"), F.lit(self.dimension).alias("dimension"), (n * self.dimension * 4).alias("vector_bytes"))
