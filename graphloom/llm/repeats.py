"""Substring deduplication: words covered by a window of words that also starts elsewhere in the corpus.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return, unchanged. Suffixes start at words. The suffixes of the corpus are split by prefixes of variable length:

1. Every window of ``window`` words holds, as the smallest hash among its runs of ``PREFIX`` words, one
   anchor; equal windows hold the same anchor at the same place. Anchors (about one word in 14) are
   counted over all texts with partial aggregation. One that occurs once can't lie in a repeat.
2. For each repeated anchor, the stretch of text in which windows around it may lie goes to the group of the anchor. Groups
   are sized by the bytes of their stretches. One of more than ``budget`` bytes is split before
   anything is gathered: the starts of its windows, counted from the anchor, are halved, and all windows of a half
   share a longer run of words (8, 22, 29, 32, 34, 35 of 35), by which they are grouped anew, as prefixes are
   prolonged in a partitioned suffix tree. Groups of one stretch are dropped, large ones are split again; a half of one start is a whole
   window, whose group is counted and never gathered.
3. A group's suffixes, those that start a window, are sorted word by word by prefix doubling, and the longest common prefixes of neighbours are read off the
   doubling's ranks: the suffix tree of the group as suffix and LCP array. The inner nodes of depth ``window`` or more are its intervals
   of LCPs that large; the leaves below them are the repeated windows. ``inner_nodes`` gives the nodes, ``maximal`` those
   that are maximal repeats of the group's stretches.
4. The flags go back to their texts, which are joined a second time, and the covered words are dropped.

A text is known by a 64-bit key of its id and content; anchors sent back to a text are checked against
its words. Suffixes are compared by 64-bit hashes of their words. Large groups' keys are joined apart from the
others: their table is small (at most the table's bytes divided by the budget) and is broadcast if Spark finds it
below its threshold, else joined by sorting.

Defined results: a null text has no words; a text shorter than a window loses none; repeated rows are
copies of each other, ties of them included; very long texts are taken whole. Kept words are joined by one blank. Nothing is capped,
an empty table gives no rows, and other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIX = 8
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _pow(k: int) -> np.uint64:
    return np.uint64(pow(int(_Q), k, 1 << 64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size words, by prefix doubling (level by level down the tree)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, total, done = words, 1, None, 0
    while True:
        if size & width:
            part = level[done : done + n] * _pow(done)
            total = part if total is None else total + part
            done += width
        if done == size:
            return C.mix(total)
        level = level[:-width] + level[width:] * _pow(width)
        width *= 2


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """op (minimum or maximum) over each run of size values."""
    width = 1
    while 2 * width <= size:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def anchors(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every anchor: the smallest run of PREFIX words of some window within one row."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = run_hashes(words, min(PREFIX, window)) | np.uint64(1)
    span = window - min(PREFIX, window) + 1
    least = _slide(runs, span, np.minimum)  # for each window, in order of its start
    left = np.zeros(n + 1, np.int64)
    left[bounds[1:-1]] = 1
    row = np.cumsum(left[:n])
    least[row[: len(least)] != row[window - 1 : window - 1 + len(least)]] = 0  # windows across rows don't exist
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    best = _slide(padded, span, np.maximum)[: len(runs)]
    at = np.flatnonzero(best == runs)
    return at, runs[at]


def _words(texts: pa.Array):
    buf, offs = C.raw(texts)
    starts, ends = C.runs(C.NOT_SPACE[buf], offs)
    return buf, starts, ends, C.spans_hash(buf, starts, ends), C.word_bounds(starts, offs)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _parted(rows: DataFrame, key: str, budget: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that occur more than once: (those of up to budget bytes, those of more; None if there are none)."""
    many = C.stored(rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where("n > 1").select(key, "b"), "many")
    large = C.stored(many.where(F.col("b") > budget).select(key), "large")
    if large.isEmpty():
        return rows.join(many.select(key), key, "left_semi"), None
    small = rows.join(large, key, "left_anti").join(many.where(F.col("b") <= budget).select(key), key, "left_semi")
    return small, rows.join(large, key, "left_semi")


_STRETCH = "prefix long, _key long, first int, skip int, near int, far int, stretch binary, bytes int"


def _sent(prefix, key, first, skip, near, far, starts, ends, lo, hi, raw) -> pa.RecordBatch:
    """Stretches: words lo to hi, the anchor skip words after lo; windows start near to far words before the anchor."""
    text = [bytes(raw[x:y]) for x, y in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True)]
    ints = [pa.array(np.asarray(x).astype(np.int32)) for x in (first, skip, near, far)]
    return pa.RecordBatch.from_arrays([_i64(prefix), _i64(key), *ints, pa.array(text, pa.binary()), pa.array((ends[hi - 1] - starts[lo]).astype(np.int32))], [c.split()[0] for c in _STRETCH.split(", ")])


def repeated_windows(rows: DataFrame, window: int, budget: int) -> DataFrame:
    """(_key, _ats): word positions of a text at which a window starts that also starts elsewhere; rows has _key and _text."""
    size = min(PREFIX, window)
    back = window - size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                _, starts, ends, h, bounds = _words(part.column("_text"))
                at, anchor = anchors(h, bounds, window)
                row = np.searchsorted(bounds, at, "right") - 1
                keys = np.asarray(part.column("_key"))[row]
                lo, hi = np.maximum(at - back, bounds[row]), np.minimum(at + window, bounds[row + 1])
                length = pa.array((ends[hi - 1] - starts[lo]).astype(np.int32) if len(at) else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([_i64(anchor), _i64(keys), pa.array((at - bounds[row]).astype(np.int32)), length], ["anchor", "_key", "at", "bytes"])

    marks = C.stored(rows.mapInArrow(emit, "anchor long, _key long, at int, bytes int"), "anchors")
    small, large = _parted(marks, "anchor", budget)
    spot = lambda part, is_large: part.select("_key", F.struct("at", "anchor", F.lit(is_large).alias("large")).alias("spot"))
    spots = spot(small, False) if large is None else spot(small, False).unionByName(spot(large, True))
    spots = C.stored(spots.groupBy("_key").agg(F.collect_set("spot").alias("spots")), "spots")  # at most one for each word of one text
    C.discard(marks)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(batch, "_text", 1 << 18):  # a stretch and more for each 14 words
                part = batch.slice(a, b - a)
                buf, starts, ends, h, bounds = _words(part.column("_text"))
                runs = run_hashes(h, size) | np.uint64(1)
                lists = part.column("spots")
                counts = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                row = np.repeat(np.arange(b - a), counts)
                at = np.asarray(flat.field("at")).astype(np.int64) + bounds[row]
                anchor = np.asarray(flat.field("anchor")).view(np.uint64)
                is_large = np.asarray(flat.field("large").to_numpy(zero_copy_only=False), bool)
                ok = (at >= 0) & (at < np.minimum(bounds[row + 1], len(runs)))
                ok[ok] = runs[at[ok]] == anchor[ok]
                row, at, anchor, is_large = row[ok], at[ok], anchor[ok], is_large[ok]
                if not len(at):
                    continue
                lo, hi = np.maximum(at - back, bounds[row]), np.minimum(at + window, bounds[row + 1])
                near, far = np.where(is_large, -1, 0), np.full(len(at), back)  # -1: to be split
                yield _sent(anchor, np.asarray(part.column("_key"))[row], lo - bounds[row], at - lo, near, far, starts, ends, lo, hi, memoryview(buf.tobytes()))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                buf, starts, ends, h, bounds = _words(part.column("stretch"))
                skip, first, near, far = (np.asarray(part.column(c)).astype(np.int64) for c in ("skip", "first", "near", "far"))
                near, mid = np.maximum(near, 0), (np.maximum(near, 0) + far) // 2
                key, raw = np.asarray(part.column("_key")), memoryview(buf.tobytes())
                for low, high in ((near, mid), (mid + 1, far)):
                    at = bounds[:-1] + skip
                    lo, hi = np.maximum(at - high, bounds[:-1]), np.minimum(at - low + window, bounds[1:])
                    has = np.flatnonzero((low <= high) & (hi - lo >= window))  # a whole window starts there
                    if not len(has):
                        continue
                    prefix = np.zeros(len(has), np.uint64)
                    wide = high[has] - low[has]
                    for w in np.unique(wide).tolist():  # all windows of the half share window - w words
                        of = np.flatnonzero(wide == w)
                        prefix[of] = run_hashes(h, window - w)[(at - low)[has[of]]]
                    prefix = C.mix(prefix + (low[has] * 1000 + high[has] + 1).astype(np.uint64) * _Q)
                    yield _sent(prefix, key[has], (first + lo - bounds[:-1])[has], (at - lo)[has], low[has], high[has], starts, ends, lo[has], hi[has], raw)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            prefix = np.asarray(table.column("prefix"))
            cut = int(np.searchsorted(prefix, prefix[-1], "left"))  # the last prefix may go on in the next batch
            if cut:
                yield from _deep(table.slice(0, cut), window)
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from _deep(held, window)

    sent = C.stored(rows.join(spots, "_key").mapInArrow(stretches, _STRETCH), "stretches")
    C.discard(spots)
    columns = ["prefix", "_key", "first", "skip", "stretch"]
    gathered, whole, spent = sent.where("near = 0").select(columns), [], [sent]
    if large is not None:
        rest = sent.where("near < 0")
        while rest is not None:
            rest = C.stored(rest.mapInArrow(halves, _STRETCH), "halves")
            spent.append(rest)
            small, large = _parted(rest, "prefix", budget)
            gathered = gathered.unionByName(small.where("near < far").select(columns))
            at = [F.col("_key"), (F.col("first") + F.col("skip") - F.col("near")).alias("_at")]
            whole.append(small.where("near = far").select(*at))  # groups of equal windows
            if large is not None:
                whole.append(large.where("near = far").select(*at))
                large = large.where("near < far")
                large = None if large.isEmpty() else large
            rest = large
    found = gathered.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(trees, "_key long, _at int")
    for part in whole:
        found = found.unionByName(part)
    flags = C.stored(found.groupBy("_key").agg(F.collect_set("_at").alias("_ats")), "flags")  # at most one for each word of one text
    for table in spent:
        C.discard(table)
    return flags


class Suffixes:
    """The sorted suffixes of some rows of words, and the longest common prefixes of neighbours: suffix trees as arrays.

    starts are the suffixes' first words; only suffixes of the same group are neighbours. order has the suffixes
    sorted by group, then word by word; lcp[k] is what order[k] shares with order[k - 1], 0 where their groups differ.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray, starts: np.ndarray, group: np.ndarray):
        n = len(words)
        end = np.repeat(bounds[1:], np.diff(bounds))
        at, longest = np.arange(n), int(np.diff(bounds).max(initial=0))
        ranks, width = [np.unique(words, return_inverse=True)[1].astype(np.int32) + 1], 1
        while width < longest:
            r = ranks[-1]
            after = np.where(at + width < end, r[np.minimum(at + width, n - 1)], 0)  # 0: the row ends
            ranks.append(np.unique(r * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32) + 1)
            width *= 2
        self.order = np.lexsort((ranks[-1][starts], group))
        self.starts = starts[self.order]
        x, y, g = self.starts[1:], self.starts[:-1], group[self.order]
        same, both = g[1:] == g[:-1], np.zeros(len(x), np.int64)
        left = np.minimum(end[x] - x, end[y] - y)
        for k in range(len(ranks) - 1, -1, -1):
            r = ranks[k]
            fits = same & (both + (1 << k) <= left)
            more = fits & (r[np.minimum(x + both, n - 1)] == r[np.minimum(y + both, n - 1)])
            both[more] += 1 << k
        self.lcp = np.concatenate([[0], both]) if len(starts) else np.zeros(0, np.int64)

    def below(self, depth: int) -> np.ndarray:
        """The indices of the suffixes below an inner node of at least that depth."""
        deep = np.concatenate([self.lcp >= depth, [False]]) if len(self.lcp) else np.zeros(1, bool)
        return self.order[deep[:-1] | deep[1:]]

    def inner_nodes(self, depth: int) -> list[tuple[int, int, int]]:
        """(depth, first, last place in order) of every inner node of at least that depth, by the intervals of the LCPs."""
        out, stack = [], []
        for k, l in enumerate([*self.lcp.tolist(), 0]):
            first = k - 1
            while stack and stack[-1][0] > l:
                d, first = stack.pop()
                out.append((d, first, k - 1))
            if l >= depth and (not stack or stack[-1][0] < l):
                stack.append((l, first))
        return sorted(out, key=lambda node: (node[1], -node[2]))

    def maximal(self, depth: int, before: np.ndarray) -> list[tuple[int, list[int]]]:
        """(length, suffixes) of the maximal repeats: inner nodes whose leaves differ in the word before them (0: none there)."""
        found = []
        for d, a, b in self.inner_nodes(depth):
            leaves = self.order[a : b + 1]
            if len(set(before[leaves].tolist())) > 1 or not before[leaves].all():
                found.append((d, sorted(leaves.tolist())))
        return found


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of runs of sizes elements from starts on, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _deep(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Suffixes of the stretches that lie below an inner node of depth window or more of their group's tree.

    Equal stretches of a group, by a hash of their words, are in the tree once: its leaves stand for as many places.
    """
    table = table.combine_chunks()
    _, _, _, h, bounds = _words(table.column("stretch").chunk(0))
    key, first, skip = (np.asarray(table.column(c)).astype(np.int64) for c in ("_key", "first", "skip"))
    size = np.diff(bounds)
    at = np.arange(len(h)) - np.repeat(bounds[:-1], size)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _Q)]))
    text = C.mix(np.add.reduceat(h * powers[at], bounds[:-1])) + size.astype(np.uint64)
    prefix = np.unique(np.asarray(table.column("prefix")), return_inverse=True)[1]
    _, one, same, copies = np.unique(text * _Q + C.mix((prefix * 1000 + skip).astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
    h, bounds = h[_gather(bounds[one], size[one])], np.concatenate([[0], np.cumsum(size[one])])
    n = np.maximum(size[one] - window + 1, 0)
    row, offset = np.repeat(np.arange(len(one)), n), _gather(np.zeros(len(n), np.int64), n)
    # equal windows hold their anchor at the same place, so a tree is of one prefix and one place
    tree = Suffixes(h, bounds, bounds[row] + offset, prefix[one][row] * (1 << 20) + (skip[one][row] - offset + (1 << 19)))
    deep = copies[row] > 1
    deep[tree.below(window)] = True
    offset, many = offset[deep], np.bincount(row[deep], minlength=len(one))
    row, found = np.repeat(np.arange(len(same)), many[same]), _gather((np.cumsum(many) - many)[same], many[same])
    yield pa.RecordBatch.from_arrays([_i64(key[row]), pa.array((first[row] + offset[found]).astype(np.int32))], ["_key", "_at"])


def remove_repeats(docs: DataFrame, keep: list[str], window: int = 35, budget: int = 2 << 20, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The columns keep, n_words, n_removed and kept (the words left, joined by one blank) of every row."""
    rows = docs.select(*keep, F.xxhash64(F.col(id_col), F.col(text)).alias("_key"), F.col(text).alias("_text"))
    flags = repeated_windows(rows.select("_key", "_text"), window, budget)
    joined = rows.join(flags, "_key", "left").select(*keep, "_text", "_ats")
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in keep)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                n, gone, kept = [], [], []
                for t, ats in zip(part.column("_text").cast(pa.binary()), part.column("_ats"), strict=True):
                    words = (t.as_py() or b"").split()
                    n.append(len(words))
                    if not ats.is_valid:
                        gone.append(0)
                        kept.append(b" ".join(words))
                        continue
                    at = np.asarray(ats.values)
                    edge = np.bincount(at, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(np.minimum(at + window, len(words)), minlength=len(words) + 1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join([words[i] for i in left]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(drop, f"{schema}, n_words long, n_removed long, kept string")
