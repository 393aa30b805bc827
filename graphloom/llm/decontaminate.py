"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

Words are runs of ``[0-9a-z]`` (A-Z folded) and of bytes from 0x80 on. A window is ``n`` consecutive words of an
item (all words of a shorter one). To occur, a window needs all its words, so one of them is a sufficient
prefix: the rarest in the corpus, whose counts of the benchmark's words are taken in a pass of their own (longer words first on ties, then the smaller
hash, then the first place). Document words are joined with the prefix words; a match at offset k of the window must start k words
earlier and end before the document does (positional and length bounds); what is left is compared by a hash of the window,
then byte by byte, all in vectors.

The windows are compiled once on the driver, as arrays of about 40 bytes a window, and broadcast in blocks of items of at most about ``block_bytes`` of text:
that is the bound of the broadcast, some 120 MB. A benchmark larger than
one block is scanned block after block, the state of each document (hit words, items) written to the shared
folder in between; documents are never shuffled. Whole texts are scanned.

Null texts have no words. Items without words or with a null id take no part; items that share an
id count once, windows that several items share count for each. Ties and repeated rows are judged row by
row. An empty benchmark hits nothing; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .bpe import SpanTable
from .repeats import _gather, _slide, run_hashes

_KINDS = C.kinds_table(C.ALNUM)


def words_of(texts: pa.Array):
    """(buffer in lower case, starts, ends, hashes, row bounds) of the words of the texts."""
    buf, offs = C.raw(texts)
    buf = C.LOWER[buf]
    starts, ends = C.runs(_KINDS[buf], offs)
    return buf, starts, ends, C.spans_hash(buf, starts, ends), C.word_bounds(starts, offs)


class Windows:
    """The distinct windows of some items, with their prefix words and the items of each, as arrays.

    counts has hashes of words, sorted, and their numbers in the corpus; without it, the items' own numbers count.
    """

    STEP = 1 << 17

    def __init__(self, items: list[tuple[str, str]], n: int, counts: tuple[np.ndarray, np.ndarray] | None = None):
        items = [(i, t) for i, t in items if i is not None and t]
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        self.buf, starts, ends, h, bounds = words_of(pa.array([t for _, t in items], pa.string()))
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        self.vocabulary, place, own = np.unique(h, return_inverse=True, return_counts=True)
        if counts is not None and len(counts[0]):
            at = np.minimum(np.searchsorted(counts[0], self.vocabulary), len(counts[0]) - 1)
            own = np.where(counts[0][at] == self.vocabulary, counts[1][at], 0)
        words = np.diff(bounds)
        size = np.minimum(words, n)
        many = np.where(words > 0, words - size + 1, 0)
        row = np.repeat(np.arange(len(many)), many)
        begin, size = _gather(bounds[:-1], many), size[row]
        order = np.lexsort((np.arange(len(h)), h, starts - ends, own[place]))  # rarest first
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        code, first = np.zeros(len(row), np.uint64), np.zeros(len(row), np.int64)
        for k in np.unique(size).tolist():
            of = np.flatnonzero(size == k)
            code[of] = run_hashes(h, k)[begin[of]] + np.uint64(k)
            first[of] = order[_slide(rank, k, np.minimum)[begin[of]]]
        self.code, one, same = np.unique(code, return_index=True, return_inverse=True)
        owner = np.unique(same * max(len(self.ids), 1) + np.array([number[i] for i, _ in items], np.int64)[row]) if len(row) else np.zeros(0, np.int64)
        self.owner = (owner % max(len(self.ids), 1)).astype(np.int32)
        self.owners = np.searchsorted(owner // max(len(self.ids), 1), np.arange(len(one) + 1))
        self.begin, self.size, self.offset = begin[one].astype(np.int32), size[one].astype(np.int16), (first - begin)[one].astype(np.int16)
        prefix = h[first[one]]
        keys = np.unique(prefix)
        self.table = SpanTable(keys, np.arange(len(keys), dtype=np.int32))
        key = np.searchsorted(keys, prefix)
        self.windows = np.argsort(key, kind="stable").astype(np.int32)
        self.first = np.searchsorted(key[self.windows], np.arange(len(keys) + 1))

    def _candidates(self, pos: np.ndarray, key: np.ndarray, bounds: np.ndarray):
        """(window, start) of the windows whose prefix words are at pos, within positional and length bounds."""
        many = self.first[key + 1] - self.first[key]
        w = self.windows[_gather(self.first[key], many)]
        pos = np.repeat(pos, many)
        start, row = pos - self.offset[w], np.searchsorted(bounds, pos, "right") - 1
        ok = (start >= bounds[row]) & (start + self.size[w] <= bounds[row + 1])
        return w[ok], start[ok]

    def _equal(self, w: np.ndarray, start: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the words from start on are those of the window, byte by byte."""
        size = self.size[w].astype(np.int64)
        mine, there = _gather(self.begin[w].astype(np.int64), size), _gather(start, size)
        length = (ends[there] - starts[there]).astype(np.int64)
        wrong = length != self.ends[mine] - self.starts[mine]
        length = np.where(wrong, 0, length)
        differs = buf[_gather(starts[there], length)] != self.buf[_gather(self.starts[mine].astype(np.int64), length)]
        at = np.concatenate([[0], np.cumsum(differs)])
        ends_at = np.cumsum(length)
        wrong |= at[ends_at] > at[ends_at - length]
        total = np.concatenate([[0], np.cumsum(wrong)])
        last = np.cumsum(size)
        return total[last] == total[last - size]

    def scan(self, texts: pa.Array):
        """(row bounds in words, hit mask of the words, rows and item numbers of the distinct pairs, sorted)."""
        buf, starts, ends, h, bounds = words_of(texts)
        hit, pairs = np.zeros(len(h) + 1, np.int64), np.zeros(0, np.int64)
        if len(h) and len(self.code):
            key = self.table.get(h)
            at = np.flatnonzero(key >= 0)
            load = np.cumsum((self.first[1:] - self.first[:-1])[key[at]])
            runs: dict[int, np.ndarray] = {}
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + self.STEP, "right")))
                w, start = self._candidates(at[lo:hi], key[at[lo:hi]], bounds)
                lo = hi
                code = np.zeros(len(w), np.uint64)
                for k in np.unique(self.size[w]).tolist():
                    if k not in runs:
                        runs[k] = run_hashes(h, k)
                    of = np.flatnonzero(self.size[w] == k)
                    code[of] = runs[k][start[of]] + np.uint64(k)
                ok = code == self.code[w]
                w, start = w[ok], start[ok]
                if not len(w):
                    continue
                ok = self._equal(w, start, buf, starts, ends)
                w, start = w[ok], start[ok]
                np.add.at(hit, start, 1)
                np.subtract.at(hit, start + self.size[w], 1)
                row, many = np.searchsorted(bounds, start, "right") - 1, self.owners[w + 1] - self.owners[w]
                items = self.owner[_gather(self.owners[w], many)]
                pairs = np.unique(np.concatenate([pairs, np.repeat(row, many) * len(self.ids) + items]))
        return bounds, np.cumsum(hit[:-1]) > 0, pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)


def corpus_counts(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted, and numbers in all texts) of the words of a vocabulary, which bounds what is collected."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = told.value
        table, seen = SpanTable(words, np.arange(len(words), dtype=np.int32)), np.zeros(len(words), np.int64)
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                at = table.get(words_of(batch.slice(a, b - a).column("_text"))[3])
                seen += np.bincount(at[at >= 0], minlength=len(words))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(words[some].view(np.int64)), pa.array(seen[some])], ["word", "n"])

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    words, n = np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(words)
    return words[order], n[order]


def _compiled(docs: DataFrame, items: list[tuple[str, str]], n: int, text: str):
    """The broadcast windows of some items, with prefixes by the corpus's counts."""
    words = np.unique(words_of(pa.array([t for i, t in items if i is not None and t], pa.string()))[3])
    counts = corpus_counts(docs, words, text) if len(words) else None
    return docs.sparkSession.sparkContext.broadcast(Windows(items, n, counts))


def _scanned(rows: DataFrame, items: list[tuple[str, str]], n: int, keep: list[str], carry: bool, first: bool) -> DataFrame:
    told = _compiled(rows, items, n, "_text")
    state = [T.StructField("_text", T.StringType()), T.StructField("_mask", T.BinaryType())] if carry else []
    schema = T.StructType([rows.schema[c] for c in keep] + state + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = told.value
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                bounds, hit, hit_rows, hit_items = windows.scan(part.column("_text"))
                found: list[list[str]] = [[] for _ in range(b - a)] if first else [list(x) for x in part.column("items").to_pylist()]
                for r, i in zip(hit_rows.tolist(), hit_items.tolist(), strict=True):
                    found[r].append(windows.ids[i])
                if not first:
                    for r, mask in enumerate(part.column("_mask").to_pylist()):
                        x, y = bounds[r], bounds[r + 1]
                        hit[x:y] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=y - x).astype(bool)
                sums = np.concatenate([[0], np.cumsum(hit)])[bounds]
                cols = [part.column(c) for c in keep]
                if carry:
                    cols += [part.column("_text"), pa.array([np.packbits(hit[x:y]).tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())]
                cols += [pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(sums), pa.int64()), pa.array([sorted(set(f)) for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, schema=None, names=schema.names)

    return rows.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """(whether it is the last, items) of each block of the benchmark, of about block_bytes at most."""
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    total = bench.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    for k in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield k == blocks - 1, [(r["i"], r["t"]) for r in part.distinct().collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = 8, text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The columns keep, n_words, n_hit and items (ids as strings, sorted, of items with an occurring window)."""
    rows, first = docs.select(*keep, F.col(text).alias("_text")), True
    for last, items in _blocks(benchmark, block_bytes):
        rows = _scanned(rows, items, n, keep, carry=not last, first=first)
        first = False
        if not last:
            rows = C.stored(rows, "decontaminate")
    return rows


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 8, text: str = "text", block_bytes: int = 8 << 20, items: int = 1) -> DataFrame:
    """The rows, with all their columns, in which windows of fewer than ``items`` items occur; two passes for each block, no shuffle.

    With one item, the default, any window drops a text, those of items of one word included; ``contamination`` counts them.
    """
    if items != 1:
        key, found = "_contaminated", contamination(docs.withColumn("_row", F.struct(*docs.columns)), benchmark, ["_row"], n, text, block_bytes)
        return found.withColumn(key, F.size("items") >= items).where(~F.col(key)).select("_row.*")
    for last, part in _blocks(benchmark, block_bytes):
        told = _compiled(docs, part, n, text)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in C.chunks(batch, text):
                    part = batch.slice(a, b - a)
                    fine = np.ones(b - a, bool)
                    fine[told.value.scan(part.column(text))[2]] = False
                    yield part.filter(pa.array(fine))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = C.stored(docs, "decontaminate")
    return docs
