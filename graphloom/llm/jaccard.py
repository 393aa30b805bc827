"""N-gram Jaccard join of whole texts by chosen paths.

A text's set is its distinct ``ngram``-word shingles (words as runs of non-space bytes, A-Z folded; a shorter
text is one shingle). Texts with equal sets form one class; classes, not copies, are joined.

Chosen path: a class's set is represented by ``COORDS`` min-hash samples of its tokens. From a run's root,
each path picks ``BRANCH`` sample positions by hashing itself; a class follows each picked position with
its token there, so that classes that agree on it share the longer path. Buckets of two to ``LIMIT``
classes are compared by brute force on 4-bit sketches; larger ones are split recursively, up to ``DEPTH``
levels, unless their members are alike on average: such buckets, and what is larger still at the last
level, are compared in square blocks of ``BLOCK`` classes, in parallel tasks, so that no bucket is
gathered into one task and none is capped. Runs are repeated
until the computed recall of a pair at the threshold, after DEPTH levels, reaches ``recall``.

Candidates are verified on their whole shingle sets: exact Jaccard similarity, at least ``threshold``.
Sets are sent to blocks of pairs with a common neighbour, each set about once, not once a pair.

Result: one row a document: class_id (smallest doc_id with the same set), group_id (smallest doc_id of
the connected component under links) and n_links (other classes that the class is linked to).
No pair list of copies is made. A null or empty text has no set: it is a class and a group of its own without
links. Null doc_ids keep their rows; ids in ties go to the smallest. Repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import run_hashes

COORDS, BRANCH, LIMIT, DEPTH, BLOCK = 64, 3, 256, 4, 512
_rng = np.random.default_rng(90210)
_MULT = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_SAME = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


def runs_needed(threshold: float, recall: float) -> int:
    """Runs after which a pair of the threshold's similarity is found with the wanted probability, DEPTH levels deep."""
    q = 1.0
    for _ in range(DEPTH):
        q = 1 - (1 - threshold * q) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def shingle_sets(texts: pa.Array, ngram: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; empty for texts without words."""
    buf, offs = C.raw(texts)
    buf = C.LOWER[buf]
    starts, ends = C.runs(C.NOT_SPACE[buf], offs)
    h = C.spans_hash(buf, starts, ends)
    bounds = C.word_bounds(starts, offs)
    grams = run_hashes(h, ngram)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= ngram:
            out.append(np.unique(grams[a : b - ngram + 1]))
        else:
            out.append(C.mix(h[a:b].sum(keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS 32-bit min-hashes of a set."""
    best = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        best = np.minimum(best, (shingles[k : k + 4096, None] * _MULT + _ADD).min(0))
    return (C.mix(best) >> np.uint64(32)).astype("<u4")


def _picked(paths: np.ndarray) -> np.ndarray:
    """The BRANCH sample positions that each path chooses."""
    h = C.mix(paths[:, None] + np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.argpartition(h, BRANCH, axis=1)[:, :BRANCH]


def _follow(paths: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """For each row, the BRANCH longer paths."""
    at = _picked(paths)
    token = np.take_along_axis(sigs, at, 1).astype(np.uint64)
    return C.mix(paths[:, None] * np.uint64(0xC2B2AE3D27D4EB4F) + (at.astype(np.uint64) << np.uint64(32)) + token)


def _fixed(column: pa.Array, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _paths(classes: DataFrame, rooted: bool, runs: int = 0) -> DataFrame:
    """(path, cls, sketch) one level down, from (cls, sig) or (path, cls, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                sigs = _fixed(batch.column("sig"), COORDS, "<u4")
                cls = np.asarray(batch.column("cls"))
                nib = sigs & 15
                sketch = (nib[:, ::2] | nib[:, 1::2] << 4).astype(np.uint8)
                packed = pa.array([s.tobytes() for s in sketch], pa.binary())
                roots = [np.asarray(batch.column("path")).view(np.uint64)] if rooted else [np.full(len(cls), 1000003 * (k + 1), np.uint64) for k in range(runs)]
                for root in roots:
                    new = _follow(root, sigs)
                    at = np.repeat(np.arange(len(cls)), BRANCH)
                    yield pa.RecordBatch.from_arrays([pa.array(new.reshape(-1).view(np.int64)), pa.array(cls[at]), packed.take(pa.array(at))], ["path", "cls", "sketch"])

    return classes.mapInArrow(run, "path long, cls long, sketch binary")


def _alike(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x = sketches[i[k : k + (1 << 16)]] ^ sketches[j[k : k + (1 << 16)]]
        out[k : k + (1 << 16)] = _SAME[x].sum(1, dtype=np.int32) >= least
    return out


def _bucket_pairs(buckets: DataFrame, least: int, cross: bool) -> DataFrame:
    """(a, b), a < b, of the alike classes of each bucket; with cross, members have a side (0 or 1, 2 for both)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                lists = whole.slice(lo, 1024).column("members")
                counts = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                if not len(flat):
                    continue
                cls = np.asarray(flat.field("cls"))
                sk = _fixed(flat.field("sketch"), COORDS // 2, "u1")
                side = np.asarray(flat.field("side")) if cross else None
                first = np.cumsum(counts) - counts
                begin = 0
                for a, n in zip(first.tolist(), counts.tolist(), strict=True):
                    begin = a
                    i, j = np.triu_indices(n, 1) if not cross else (None, None)
                    if cross:
                        left, right = np.flatnonzero(side[a : a + n] != 1), np.flatnonzero(side[a : a + n] != 0)
                        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                    i, j = i + begin, j + begin
                    ok = (cls[i] != cls[j]) & _alike(sk, i, j, least)
                    x, y = cls[i[ok]], cls[j[ok]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Distinct pairs of classes that share a chosen path and look alike; classes has cls and sig."""
    least = max(1, int(COORDS * (threshold + (1 - threshold) / 16 - 0.22)))  # about 3.5 deviations below a pair at the threshold
    rows = _paths(classes, False, runs_needed(threshold, recall))
    found, spent = [], []
    for level in range(1, DEPTH + 1):
        sizes = C.stored(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{level}")
        shared = C.stored(_by_path(rows, sizes), f"level-{level}")
        C.discard(sizes)
        small = shared.where(F.col("n") <= LIMIT).groupBy("path").agg(F.collect_list(F.struct("cls", "sketch")).alias("members"))  # at most LIMIT
        found.append(C.stored(_bucket_pairs(small.select("members"), least, False), f"pairs-{level}"))
        spent.append(shared)
        large = shared.where(F.col("n") > LIMIT)
        if large.isEmpty():
            break
        sparse = None
        if level < DEPTH:
            judged = C.stored(_dense(large, threshold), f"dense-{level}")
            sparse = large.join(judged.where("not dense"), "path").select("path", "cls")
            large = large.join(judged.where("dense"), "path").select("path", "cls", "sketch", "n")
        side = F.ceil(F.col("n") / BLOCK)
        mine = F.pmod(F.xxhash64("cls"), side)
        spread = large.select("path", "cls", "sketch", mine.alias("me"), F.explode(F.sequence(F.lit(0), (side - 1).cast("int"))).alias("other"))
        lo, hi = F.least("me", "other"), F.greatest("me", "other")
        squares = spread.groupBy("path", lo.alias("lo"), hi.alias("hi")).agg(
            F.collect_list(F.struct("cls", "sketch", F.when(F.col("me") == F.col("other"), 2).when(F.col("me") < F.col("other"), 0).otherwise(1).alias("side"))).alias("members")
        )  # about 2 * BLOCK: classes are hashed to the sides of the squares
        found.append(C.stored(_bucket_pairs(squares.select("members"), least, True).distinct(), f"squares-{level}"))
        if sparse is None:
            break
        rows = C.stored(_paths(sparse.join(classes, "cls"), True), f"paths-{level}")
        C.discard(spent.pop())
        spent.append(rows)
        if rows.isEmpty():
            break
    pairs = C.stored(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    for table in found + spent:
        C.discard(table)
    return pairs


def _by_path(rows: DataFrame, sizes: DataFrame, most: int = 50_000) -> DataFrame:
    """rows.join(sizes, "path"), paths of more than most rows apart.

    Their table has at most a row for most rows; Spark broadcasts it if it is below its threshold and else splits
    the skewed partitions of a sorted join.
    """
    hot = C.stored(sizes.where(F.col("n") > most), "hot")
    if hot.isEmpty():
        return rows.join(sizes, "path")
    return rows.join(hot, "path", "left_anti").join(sizes.where(F.col("n") <= most), "path").unionByName(rows.join(hot, "path"))


def _dense(large: DataFrame, threshold: float) -> DataFrame:
    """(path, dense): whether a large bucket's members are alike on average, by about 16 of them.

    Splitting such a bucket would only repeat its pairs on many paths, so it is compared at once, in squares.
    """
    some = large.where(F.pmod(F.xxhash64("cls", "path"), F.ceil(F.col("n") / 16)) == 0).groupBy("path").agg(F.collect_list("sketch").alias("some"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = []
            for members in batch.column("some").to_pylist():
                s = np.frombuffer(b"".join(members[:64]), np.uint8).reshape(-1, COORDS // 2)
                i, j = np.triu_indices(len(s), 1)
                dense.append(bool(len(i)) and float(_SAME[s[i] ^ s[j]].sum(1).mean()) / COORDS >= threshold / 2)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(dense, pa.bool_())], ["path", "dense"])

    known = some.mapInArrow(run, "path long, dense boolean")
    return large.select("path").distinct().join(known, "path", "left").select("path", F.coalesce("dense", F.lit(False)).alias("dense"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, per_block: int = 4000) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold; sets has cls and grams (sorted, 64-bit)."""
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
    root = both.groupBy("v").agg(F.min("w").alias("w")).select(F.col("v").alias("a"), F.least("v", "w").alias("block"))
    placed = pairs.join(root, "a")
    load = placed.groupBy("block").agg(F.ceil(F.sqrt(F.count("*") / per_block)).alias("cut"))
    placed = C.stored(
        placed.join(load, "block").select("a", "b", F.xxhash64("block", F.pmod(F.xxhash64("a"), "cut"), F.pmod(F.xxhash64("b"), "cut")).alias("block")), "blocks"
    )
    needed = placed.select("block", F.col("a").alias("cls")).unionByName(placed.select("block", F.col("b").alias("cls"))).distinct()
    sent = needed.join(sets, "cls").select("block", "cls", F.lit(None).cast("long").alias("b"), "grams")
    asked = placed.select("block", F.col("a").alias("cls"), "b", F.lit(None).cast("binary").alias("grams"))
    rows = sent.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, have = None, {}
        for batch in batches:
            a_, b_ = [], []
            for k, cls, b, grams in zip(*(batch.column(c).to_pylist() for c in ("block", "cls", "b", "grams")), strict=True):
                if k != block:
                    block, have = k, {}
                if b is None:
                    have[cls] = np.frombuffer(grams, np.uint64)
                    continue
                x, y = have[cls], have[b]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    a_.append(cls)
                    b_.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of each vertex's component, by label propagation with pointer jumping."""
    edges = C.stored(links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w"))), "edges")
    label = C.stored(edges.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    while True:
        near = edges.join(label.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("near"))
        best = label.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # a row for each label that still stands: the join's other side, which may have most rows at one label, is streamed
        jump = best.select("root").distinct().join(label.select(F.col("v").alias("root"), F.col("root").alias("far")), "root")
        new = C.stored(best.join(jump, "root", "left").select("v", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        moved = new.where("old != root").isEmpty()
        label = new.select("v", "root")
        if moved:
            return label


def _smaller(told: DataFrame) -> DataFrame:
    """The signatures' table without the signatures, once the classes hold them."""
    small = C.stored(told.drop("sig"), "members")
    C.discard(told)
    return small


def _mostly(rows: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """The rows whose _key may be wanted, by one bit of a table of 2**bits: a broadcast of at most 2**(bits - 6) rows.

    It keeps most other texts out of a shuffle; rows let through by chance go in the join that follows.
    """
    bit = F.pmod("_key", F.lit(1 << bits))
    words = wanted.select(F.shiftright(bit, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(_key, {1 << bits}) & 63 as int))").alias("m")).groupBy("_word").agg(F.bit_or("m").alias("_bits"))
    hit = F.expr(f"(shiftright(_bits, cast(pmod(_key, {1 << bits}) & 63 as int)) & 1) = 1")
    return rows.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(words), "_word").where(hit).drop("_word", "_bits")


def _verdicts(docs: DataFrame, threshold: float, ngram: int, recall: float, text: str, id_col: str) -> DataFrame:
    """doc_id, _key, cls, class_id, group_id, n_links, first_key (the key of its group's first row) of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("_text"), ngram)
                cls = [None if not len(s) else int((C.mix(s).sum(keepdims=True) ^ C.mix(np.array([len(s)], np.uint64))).view(np.int64)[0]) for s in sets]
                sig = [None if not len(s) else signature(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_key"), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "_key", "cls", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("_key"), F.col(text).alias("_text"))
    told = C.stored(rows.mapInArrow(sketch, "doc_id long, _key long, cls long, sig binary"), "signatures")
    some = told.where("cls is not null")
    classes = C.stored(some.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig"), F.min(_first()).alias("first")), "classes")
    told = _smaller(told)
    pairs = candidates(classes.select("cls", "sig"), threshold, recall)
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(classes.select("cls", F.col("first._key").alias("_key")), "cls")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([s.tobytes() for s in shingle_sets(part.column("_text"), ngram)], pa.binary())], ["cls", "grams"])

    sets = _mostly(rows.select("_key", "_text"), wanted).join(wanted, "_key").select("cls", "_text").mapInArrow(grams, "cls long, grams binary")
    links = C.stored(_verified(pairs, sets, threshold).distinct(), "links")
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    known = classes.select("cls", "class_id", "first")
    root = components(links).select(F.col("v").alias("cls"), "root")
    member = known.join(root, "cls").join(degree, "cls")
    group = member.groupBy("root").agg(F.min("class_id").alias("group_id"), F.min("first").alias("group_first"))
    verdict = known.join(member.join(group, "root").select("cls", "group_id", "group_first", "n_links"), "cls", "left")
    told = told.select("doc_id", "_key", "cls")
    worded = told.where("cls is not null").join(verdict, "cls", "left")
    bare = told.where("cls is null")  # texts without words, which may be many, don't meet at one key
    return worded.unionByName(bare, allowMissingColumns=True).select(
        "doc_id",
        "_key",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("group_id", "class_id", "doc_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_first._key", "first._key", "_key").alias("first_key"),
        F.col("cls").isNotNull().alias("worded"),
    )


def _first():
    """What orders the rows of a class or group: the smallest id, null ids last, then the smallest key."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_key")


def near_duplicates(docs: DataFrame, threshold: float = 0.5, ngram: int = 2, recall: float = 0.99, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, class_id, group_id, n_links of every row."""
    return _verdicts(docs, threshold, ngram, recall, text, id_col).select("doc_id", "class_id", "group_id", "n_links")


def first_of_group(docs: DataFrame, threshold: float = 0.5, ngram: int = 2, recall: float = 0.99, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of every group, with all its columns: the smallest id's; texts without words all stay, each a group of its own.

    Only rows that may have to go, by one bit of their key, are shuffled with their texts: those of later members of
    groups and repeated rows.
    """
    key = "_kept"
    while key in docs.columns or f"{key}_word" in docs.columns:
        key += "_"
    told = _verdicts(docs, threshold, ngram, recall, text, id_col).where("worded")
    judged = told.groupBy(F.col("_key").alias(key)).agg(F.max(F.col("_key") == F.col("first_key")).alias("stays"), F.count("*").alias("n"))
    judged = C.stored(judged.where("not stays OR n > 1").select(key, "stays"), "judged")
    bits = 24  # a broadcast of at most 2**18 rows
    place = lambda k: F.pmod(k, F.lit(1 << bits))
    mask = f"shiftleft(1L, cast(pmod(`{key}`, {1 << bits}) & 63 as int))"
    words = judged.select(F.shiftright(place(F.col(key)), 6).alias(f"{key}_word"), F.expr(mask).alias("m")).groupBy(f"{key}_word").agg(F.bit_or("m").alias("bits"))
    words = C.stored(words, "bits").withColumnRenamed("bits", f"{key}_bits")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text)))
    keyed = keyed.withColumn(f"{key}_word", F.shiftright(place(F.col(key)), 6)).join(F.broadcast(words), f"{key}_word", "left")
    maybe = F.coalesce(F.expr(f"(`{key}_bits` & {mask}) <> 0"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sure = keyed.where(~maybe).select(columns)
    asked = keyed.where(maybe).select(*columns, F.col(key)).join(judged.withColumnRenamed("stays", f"{key}_stays"), key, "left")
    by_chance = asked.where(F.col(f"{key}_stays").isNull()).select(columns)
    one = asked.where(F.col(f"{key}_stays")).dropDuplicates([key]).select(columns)
    return sure.unionByName(by_chance).unionByName(one)
