"""Shared helpers: byte-level text kernels, the shared folder, bounded labelled samples.

Texts are handled as one numpy byte buffer per chunk of rows, so that every kernel is a
handful of vectorised passes and no Python loop runs per word. Chunks hold about
``CHUNK_BYTES`` of text; a longer text forms a chunk of its own and is still taken whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one is made only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage.

    The shuffle files of the write are removed at its end; nothing reads them again. Rows of whole texts go to
    Python in smaller batches, which keeps the memory beside the heap low.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}/{name}"
    for_now = {_CLEANUP: "true", _BATCH: str(min(2000, int(spark.conf.get(_BATCH))))}
    before = {k: spark.conf.get(k, None) for k in for_now}
    try:
        for k, v in for_now.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Removes the files of a stored table on which nothing depends any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold at most limit bytes of text (or one longer text) and at most rows rows."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column)
    sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)) + 16
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, "right"))), start + rows)
        yield start, stop
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 row offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


class Spans:
    """64-bit hashes of byte spans, from prefix sums of a polynomial modulo 2**64 that are built once for a buffer."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = _BYTE):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * _powers(_P, len(buf)), out=self.sums[1:])
        self.back = _powers(_P_INV, len(buf) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """The hash of the bytes of each span; spans in order are taken in blocks of about block bytes, which bounds the memory of long texts."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + block, "right")))
        at = int(starts[a])
        out[a:b] = Spans(buf[at : int(ends[b - 1])]).hash(starts[a:b] - at, ends[a:b] - at)
        a = b
    return out


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-zero kind; a run never crosses a row's end."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = kinds[at[:-1]] != 0
    return at[:-1][keep], at[1:][keep]


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each span starts in."""
    return np.searchsorted(offsets, starts, "right") - 1


def word_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, the index of its first span; one more entry for the end."""
    return np.searchsorted(starts, offsets, "left")


def kinds_table(word: bytes = b"", other: bytes = b"", high: int = 1) -> np.ndarray:
    """A byte -> kind table: word bytes 1, other bytes 2, bytes from 0x80 on high, the rest 0."""
    table = np.zeros(256, np.uint8)
    table[list(word)] = 1
    table[list(other)] = 2
    table[128:] = high
    return table


ALNUM = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = 0


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, modulus: int, held: int, class_bytes: int = 32 << 20):
    """A bounded training sample and the class counts over all labelled training rows.

    Of every class at most per_class labelled ids are taken, those with the smallest hash of
    the id, one text each (the smallest, if an id has several), and of these, in that order, as many as hold class_bytes. Rows of
    the held fold, null or contradicting labels take no part. Returns (DataFrame of text and label, {label: count}).
    """
    known = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", modulus) != held))
        .groupBy("doc_id")
        .agg(F.min(target).alias("label"), F.max(target).alias("_most"))
        .where("label = _most")
        .select("doc_id", "label")
    )
    counts = {int(r["label"]): int(r["count"]) for r in known.groupBy("label").count().collect()}
    picked = None
    for label in sorted(counts):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = known
    # at most per_class rows a class: a proven bound for the broadcast
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")
    sizes = texts.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("label", F.xxhash64("doc_id"), "doc_id").collect()  # per_class short rows a class
    total: dict[int, int] = {}
    chosen = []
    for r in sizes:
        total[r["label"]] = total.get(r["label"], 0) + r["n"]
        if total[r["label"]] <= class_bytes or total[r["label"]] == r["n"]:
            chosen.append((r["doc_id"],))
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long")
    return texts.join(F.broadcast(ids), "doc_id").select("text", "label"), counts
