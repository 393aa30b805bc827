"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables hashes a vector to ``floor((a_i . x + b_i) / w)`` for ``functions`` Gaussian (2-stable)
projections. A query visits its own bucket and perturbed ones, sets of -1 / +1 steps in the order of their
estimated success (the template of expected squared distances to the cell borders, applied
to the query's own order of borders). Candidates of all tables are merged and ranked by exact Euclidean distance in
double precision. Distances are computed for the rows of visited buckets only.

The width w, the number of functions and the number of probes are fitted on ``calibration`` queries (a documented bound:
the valid vectors with the smallest hashes of their ids), whose true neighbours in the whole table are computed.
Functions start at one more than the bits of the number of rows, so that a bucket stays small as
the table grows. The fewest probes that reach ``recall`` on the calibration queries are taken; if ``PROBES``
don't reach it, fewer functions are tried; with few functions all neighbouring cells are visited.
If even that misses it, the queries are searched exactly. All rows are indexed.

Distribution: the first ``coarse`` functions of a table name a group of buckets, so that most perturbed buckets of a
query lie in few groups, at most as many as its probes, however large the table. A group
with more than ``PART`` rows is split by a hash of the id, hot buckets included. A query is sent once to each part of each group it visits,
with the codes of the buckets it visits there. A part keeps k results a query, so no pair list is made and nothing is
capped. Of rows with the same vector only the k + 1 smallest ids are stored, as no other can be among k
results: that is exact, and copies don't fill a bucket. Queries that found fewer than k are searched exactly, in blocks.

Vectors that are null, zero, of another length than the usual one, or hold null or non-finite components take no
part, as are null ids. Rows that share an id are one candidate, at its smallest distance; a query's own id
is never its result. Ties go to the smaller id. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PART, BLOCK = 4096, 2048
PROBES = (1, 2, 4, 8, 16, 25, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900, 1024)


@lru_cache(4)
def template(functions: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Perturbation sets over the sorted border distances, in ascending order of their expected squared sums."""
    m = functions
    j = np.arange(1, 2 * m + 1)
    near, far = j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, near, far).tolist()
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - x in chosen for x in chosen):  # not both steps of one function
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return tuple(out)


class Hashes:
    """The functions of all tables; a code has the group (the first coarse functions) and the bucket (all functions)."""

    def __init__(self, dims: int, tables: int, functions: int, width: float, coarse: int = 0, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables, self.functions, self.width, self.coarse = tables, functions, width, coarse
        self.a = rng.normal(size=(tables, dims, functions))
        self.b = rng.uniform(0, 1, (tables, functions))
        self.mult = rng.integers(1, 1 << 62, (tables, functions), dtype=np.int64)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return np.clip(x @ self.a[table] / self.width + self.b[table], -1e9, 1e9)

    def _mults(self, table: int) -> np.ndarray:
        """Multipliers of the bucket's and the group's code, functions x 2."""
        return np.stack([self.mult[table], np.where(np.arange(self.functions) < self.coarse, self.mult[table], 0)], 1)

    def _grouped(self, code: np.ndarray, table: int) -> np.ndarray:
        return C.mix(code.view(np.uint64) + np.uint64(table + 1)).view(np.int64)

    def codes(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(group, bucket) of each row."""
        both = np.floor(self.cells(x, table)).astype(np.int64) @ self._mults(table)
        return self._grouped(np.ascontiguousarray(both[:, 1]), table), np.ascontiguousarray(both[:, 0])

    def probes(self, x: np.ndarray, table: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(group, bucket) that each query visits, in order: queries x at most count."""
        f = self.cells(x, table)
        h = np.floor(f)
        part = f - h
        m = self.functions
        order = np.argsort(np.concatenate([part, 1 - part], 1), 1, kind="stable")
        mults = self._mults(table)
        step = np.concatenate([-mults, mults])[order]
        base = h.astype(np.int64) @ mults
        sets = template(m, count)
        mask = np.zeros((len(sets), 2 * m), np.int64)
        for k, chosen in enumerate(sets):
            mask[k, list(chosen)] = 1
        group, bucket = (base[:, None, i] + step[:, :, i] @ mask.T for i in (1, 0))
        return self._grouped(np.ascontiguousarray(group), table), bucket


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), np.float64)
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest distinct ids; squares are summed in the order of the components."""
    d = np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])
    order = np.lexsort((ids, d))
    _, first = np.unique(ids[order], return_index=True)  # the nearest row of each id
    kept = order[np.sort(first)[:k]]
    return ids[kept], d[kept]


def _rank(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, d2: np.ndarray, slack: float, k: int):
    """_nearest among the given rows of x but the query's own; d2, right up to a slack and a constant, narrows them down."""
    fine = ids[rows] != q_id
    rows, d2 = rows[fine], d2[fine]
    if len(rows) > 4 * k:
        few = d2 <= np.partition(d2, 4 * k - 1)[4 * k - 1] + slack
        names, which = np.unique(ids[rows[few]], return_inverse=True)
        if len(names) < k:  # repeated rows of few ids fill the first places
            few = np.ones(len(rows), bool)
            names, which = np.unique(ids[rows], return_inverse=True)
        rows, d2 = rows[few], d2[few]
        if len(names) > k:
            each = np.full(len(names), np.inf)
            np.minimum.at(each, which, d2)
            rows = rows[d2 <= np.partition(each, k - 1)[k - 1] + slack]
    return _nearest(q, x[rows], ids[rows], k)


def _slack(norms: np.ndarray, q: np.ndarray) -> float:
    return 1e-9 * (1 + float(q @ q) + float(norms.max(initial=0.0)))


def _all_ranked(query: np.ndarray, query_id: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query, id, distance) of the k nearest ids of each query among all rows."""
    norms, rows, v_ids, dist = (x**2).sum(1), np.arange(len(ids)), [], []
    for lo in range(0, len(query) if len(ids) else 0, 256):
        d2 = norms - 2 * (query[lo : lo + 256] @ x.T)
        for q, i, d in zip(query[lo : lo + 256], query_id[lo : lo + 256].tolist(), d2, strict=True):
            v, e = _rank(q, i, x, ids, rows, d, _slack(norms, q), k)
            v_ids.append(v)
            dist.append(e)
    if not v_ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(query_id, [len(v) for v in v_ids]), np.concatenate(v_ids), np.concatenate(dist)


_RESULT = "query_id long, vec_id long, score double"


def _found(q, v, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best distinct rows of each query."""
    distinct = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, ids: np.ndarray, query: np.ndarray, k: int) -> DataFrame:
    """Brute force of a bounded block of queries over all vectors, a pass without shuffle but for k rows a partition."""
    told = vectors.sparkSession.sparkContext.broadcast((ids, query))  # at most BLOCK queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = told.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, v = _matrix(part.column("vec")), np.asarray(part.column("vec_id"))
                yield _found(*_all_ranked(q, qid, x, v, k))

    return best(vectors.mapInArrow(run, _RESULT), k)


def valid(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (usual["n"] if usual else -1))


class Index:
    """Fitted hashes: their functions, and the probes of a query in each table; probes is 0 where only exact search will do."""

    def __init__(self, hashes: Hashes, probes: int, reached: float):
        self.hashes, self.probes, self.reached = hashes, probes, reached


def fit(vectors: DataFrame, count: int, k: int, tables: int, recall: float, calibration: int) -> Index | None:
    """An index for valid vectors, count of them, fitted on at most calibration of them against all."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration).collect()
    if not some:
        return None
    cal_id, cal = np.array([r["vec_id"] for r in some]), np.array([r["vec"] for r in some])
    true = exact(vectors, cal_id, cal, k).join(vectors.select("vec_id", "vec"), "vec_id").dropDuplicates(["query_id", "vec_id"]).select("query_id", "score", "vec").collect()
    apart = [r["score"] for r in true if r["score"] > 0]
    width = 2.9 * float(np.median(apart)) if apart else 1.0
    bits = max(1, count.bit_length())
    coarse = max(0, (count // PART).bit_length())
    if not true:
        return Index(Hashes(cal.shape[1], tables, bits + 1, width, coarse), 1, 1.0)
    first = {int(i): n for n, i in enumerate(cal_id)}
    at, near = np.array([first[r["query_id"]] for r in true]), np.array([r["vec"] for r in true])
    for functions in range(bits + 1, 0, -3):
        hashes = Hashes(cal.shape[1], tables, functions, width, min(coarse, functions))
        step = np.full(len(true), PROBES[-1])
        for t in range(tables):
            asked, bucket = hashes.probes(cal, t, PROBES[-1])[1], hashes.codes(near, t)[1]
            for lo in range(0, len(at), 64):
                seen = asked[at[lo : lo + 64]] == bucket[lo : lo + 64, None]
                step[lo : lo + 64] = np.minimum(step[lo : lo + 64], np.where(seen.any(1), seen.argmax(1), PROBES[-1]))
        for probes in PROBES:
            if (got := float((step < probes).mean())) >= recall:
                return Index(hashes, probes, got)
    return Index(hashes, 0, 1.0)


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())


def search(table: DataFrame, is_query, k: int = 10, tables: int = 8, recall: float = 0.95, calibration: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows where is_query(vec_id) holds, against all rows."""
    vectors = valid(table, id_col, vector)
    kind = "<f4" if table.schema[vector].dataType.simpleString() == "array<float>" else "<f8"  # as exact as the column
    count = vectors.count()
    index = fit(vectors, count, k, tables, recall, calibration)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = vectors.where(is_query(F.col("vec_id")))
    got = C.stored(_indexed(vectors, queries, index, k, kind), "neighbours") if index.probes else None
    others = vectors.select("vec_id").distinct().limit(k + 1).count() - 1
    few = queries
    if got is not None:
        done = got.groupBy("query_id").count().where(F.col("count") >= min(k, others)).select(F.col("query_id").alias("vec_id"))
        few = queries.join(done, "vec_id", "left_anti")
    few = C.stored(few.groupBy("vec_id").agg(F.min("vec").alias("vec")), "few") if others else None
    if few is not None and not few.isEmpty():
        blocks = -(-few.count() // BLOCK) * 2
        for n in range(blocks):
            block = few.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()  # about BLOCK / 2
            if block:
                more = exact(vectors, np.array([r["vec_id"] for r in block]), np.array([r["vec"] for r in block]), k)
                got = more if got is None else got.join(more.select("query_id").distinct(), "query_id", "left_anti").unionByName(more)
    if got is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _indexed(vectors: DataFrame, queries: DataFrame, index: Index, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates in the visited buckets."""
    hashes, probes, tables = index.hashes, index.probes, index.hashes.tables
    alike = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    held = C.stored(vectors.distinct().withColumn("n", alike).where(F.col("n") <= k + 1).select("vec_id", "vec"), "held")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for t in range(tables if len(x) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.codes(x, t)[0])], ["grp"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            packed = _packed(x, kind)
            for t in range(tables if len(x) else 0):
                group, bucket = hashes.codes(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(group), batch.column("vec_id"), packed, pa.array([c.tobytes() for c in bucket], pa.binary())], ["grp", "id", "vec", "codes"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                x = _matrix(batch.column("vec"))
                packed = _packed(x, kind)
                for t in range(tables):
                    group, bucket = hashes.probes(x, t, probes)
                    rows, group, bucket = np.repeat(np.arange(len(x)), group.shape[1]), group.reshape(-1), bucket.reshape(-1)
                    order = np.lexsort((group, rows))
                    rows, group, bucket = rows[order], group[order], bucket[order]
                    cut = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(group, prepend=group[0]) != 0))
                    codes = [c.tobytes() for c in np.split(bucket, cut[1:])]
                    who = pa.array(rows[cut])
                    yield pa.RecordBatch.from_arrays([pa.array(group[cut]), batch.column("vec_id").take(who), packed.take(who), pa.array(codes, pa.binary())], ["grp", "id", "vec", "codes"])

    shape = "grp long, id long, vec binary, codes binary"
    placed = held.mapInArrow(place, shape)
    large = C.stored(held.mapInArrow(groups, "grp long").groupBy("grp").count().where(F.col("count") > PART).select("grp", F.ceil(F.col("count") / PART).alias("parts")), "large")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    stored = placed.join(large, "grp", "left").select("grp", F.pmod(F.xxhash64("id"), parts).alias("part"), F.lit(0).alias("ask"), "id", "vec", "codes")
    asked = queries.mapInArrow(ask, shape).join(large, "grp", "left")
    asked = asked.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(1).alias("ask"), "id", "vec", "codes")
    rows = stored.unionByName(asked).repartition("grp", "part").sortWithinPartitions("grp", "part", "ask")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for whole in batches:
            grp, part, ask_ = (np.asarray(whole.column(c)) for c in ("grp", "part", "ask"))
            cut = [0, *(np.flatnonzero((np.diff(grp) != 0) | (np.diff(part) != 0) | (np.diff(ask_) != 0)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if (grp[a], part[a]) != key:
                    key, held, ready = (grp[a], part[a]), [], None
                piece = whole.slice(a, b - a)
                if not ask_[a]:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if ready is None:
                    codes = np.concatenate([_flat(p.column("codes"), "<i8") for p in held])
                    order = np.argsort(codes, kind="stable")
                    x = np.concatenate([_flat(p.column("vec"), kind) for p in held]).reshape(len(codes), -1).astype(float)[order]
                    ready = (x, (x**2).sum(1), np.concatenate([np.asarray(p.column("id")) for p in held])[order], codes[order])
                x, norms, ids, codes = ready
                q_ids, v_ids, dist = [], [], []
                for q_id, vec, asked in zip(piece.column("id").to_pylist(), piece.column("vec").to_pylist(), piece.column("codes").to_pylist(), strict=True):
                    visit = np.frombuffer(asked, "<i8")
                    lo, hi = np.searchsorted(codes, visit, "left"), np.searchsorted(codes, visit, "right")
                    some = hi > lo
                    if not some.any():
                        continue
                    lo, n = lo[some], (hi - lo)[some]
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    q = np.frombuffer(vec, kind).astype(float)
                    v, d = _rank(q, q_id, x, ids, at, norms[at] - 2 * (x[at] @ q), _slack(norms, q), k)
                    q_ids.append(np.full(len(v), q_id))
                    v_ids.append(v)
                    dist.append(d)
                if q_ids:
                    yield _found(np.concatenate(q_ids), np.concatenate(v_ids), np.concatenate(dist))

    return best(rows.mapInArrow(rank, _RESULT), k)


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)
