"""BPE encoding and decoding by speculation and verification.

For every distinct word: (1) speculate - a vectorised greedy longest match over all words in lockstep
proposes tokens; (2) verify - each adjacent pair of proposed tokens is tested, all at once, for
compatibility: walking both tokens' merge trees inward, no merge across the seam may come before
the merges that built them. A split whose pairs are all compatible is the BPE split; (3) only words with
a failing pair, or longer than ``LONG`` bytes, undergo exact merging in rank order.

A text with code points that Python's Unicode tables don't know is left to the tokenizers library.

The tokenizer file supplies vocabulary, merges, special tokens and the normaliser; nothing is
trained. Results equal the tokenizers library's encode(text, add_special_tokens=False) and
decode(ids, skip_special_tokens=False). Null counts as the empty text: no ids, decoded "".
Repeated rows and ties need no rule (a row's result depends on its text alone). Very long texts and words
are taken whole. Columns other than the text and the kept ones are never read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .pretoken import NOT_LATIN, WordCache, doubtful, split

LONG = 200


def byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class SpanTable:
    """64-bit key -> small int, by levels of direct-mapped tables; a key that collides moves to the next level."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 19):
        self.bits, self.levels = bits, []
        while len(keys):
            shift = np.uint64(64 - bits - 7 * len(self.levels))
            at = ((keys >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
            _, first = np.unique(at, return_index=True)
            key, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            key[at[first]], value[at[first]] = keys[first], values[first]
            self.levels.append((shift, key, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        for shift, key, value in self.levels:
            at = ((keys >> shift) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            hit = key[at] == keys
            out[hit] = value[at[hit]]
        return out


_END = np.uint64(0xA5A5F00D12345677)


class WordBpe:
    """Vocabulary and merges of one tokenizer file, ranked: base symbols first, then merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in self.vocab if t not in made]
        self.names = base + [a + b for a, b in merges]
        rank = {t: i for i, t in enumerate(self.names)}
        if len(self.names) > 65536:
            raise ValueError("pairs of ranks are kept as 16 bits each: at most 65,536 tokens")
        if len(rank) != len(self.names):
            raise ValueError("a token is made by two merges")
        self.ids = np.array([self.vocab[t] for t in self.names], np.uint32)
        n = len(self.names)
        left, right = np.arange(n), np.arange(n)
        for i, (a, b) in enumerate(merges):
            left[len(base) + i], right[len(base) + i] = rank[a], rank[b]
        self.left, self.right = left, right
        self.merge = {(rank[a], rank[b]): len(base) + i for i, (a, b) in enumerate(merges)}
        keys = np.array([C.mix(np.array([a * 65536 + b + 1], np.uint64))[0] for a, b in self.merge], np.uint64)
        self.pairs = SpanTable(keys, np.fromiter(self.merge.values(), np.int32, len(self.merge)))
        back = {c: b for b, c in byte_chars().items()}
        self.base: dict[tuple[int, bool], int] = {}
        spans, finals, ranks = [], [], []
        for t, r in rank.items():
            final = bool(self.suffix) and t.endswith(self.suffix) and t != self.suffix
            body = t[: -len(self.suffix)] if final else t
            if not body or any(c not in back for c in body):
                continue
            raw = bytes(back[c] for c in body)
            spans.append(raw)
            finals.append(final)
            ranks.append(r)
            if len(raw) == 1:
                self.base[raw[0], final] = r
        sizes = np.array([len(s) for s in spans])
        ends = np.cumsum(sizes)
        h = C.spans_hash(np.frombuffer(b"".join(spans), np.uint8), ends - sizes, ends)
        self.tokens = SpanTable(h ^ np.where(finals, _END, np.uint64(0)), np.array(ranks, np.int32))
        self.longest = int(sizes.max())
        shown = [t.encode() + b" " for t in self.names]
        self.names_flat = np.frombuffer(b"".join(shown), np.uint8)
        self.name_at = np.concatenate([[0], np.cumsum([len(t) for t in shown])])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the two tokens, side by side, stay as they are under merging."""
        ok = np.ones(len(a), bool)
        todo = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(todo):
            joined = self.pairs.get(C.mix((a * 65536 + b + 1).astype(np.uint64)))
            bad = (joined >= 0) & (joined < limit)
            ok[todo[bad]] = False
            # undo the later of the two merges that built the tokens and look across the seam again
            undo_a = a > b
            na, nb = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            limit = np.where(undo_a, a, b + 1)
            stuck = np.where(undo_a, na == a, nb == b)
            # a base symbol can't be undone: undo the other
            fa, fb = np.where(stuck & ~undo_a, self.right[a], na), np.where(stuck & undo_a, self.left[b], nb)
            limit = np.where(stuck, np.where(undo_a, b + 1, a), limit)
            done = bad | stuck & np.where(undo_a, fb == b, fa == a)
            go = ~done
            todo, a, b, limit = todo[go], fa[go], fb[go], limit[go]
        return ok

    def exact(self, word: bytes) -> list[int]:
        """Ranks of the word's tokens by merging the lowest-ranked pair first, leftmost on ties."""
        last = len(word) - 1
        sym = [self.base[c, bool(self.suffix) and i == last] for i, c in enumerate(word)]
        nxt, prv, alive = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1)), [True] * len(sym)
        heap = [(m, i, sym[i], sym[i + 1]) for i in range(last) if (m := self.merge.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j > last or sym[i] != x or sym[j] != y:
                continue
            sym[i], alive[j], nxt[i] = m, False, nxt[j]
            if nxt[j] <= last:
                prv[nxt[j]] = i
                if (k := self.merge.get((m, sym[nxt[j]]))) is not None:
                    heapq.heappush(heap, (k, i, m, sym[nxt[j]]))
            if prv[i] >= 0 and (k := self.merge.get((sym[prv[i]], m))) is not None:
                heapq.heappush(heap, (k, prv[i], sym[prv[i]], m))
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in lockstep: ranks and n + 1 offsets."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(words), np.uint8)
        spans = C.Spans(buf)
        at, active = ends - sizes, np.arange(len(words))
        got_word, got_rank = [], []
        while len(active):
            found = np.full(len(active), -1, np.int32)
            step = np.zeros(len(active), np.int64)
            for size in range(self.longest, 0, -1):
                left = ends[active] - at[active]
                open_ = np.flatnonzero((found < 0) & (left >= size))
                if not len(open_):
                    continue
                s = at[active[open_]]
                h = spans.hash(s, s + size)
                h ^= np.where((left[open_] == size) & bool(self.suffix), _END, np.uint64(0))
                r = self.tokens.get(h)
                hit = r >= 0
                found[open_[hit]] = r[hit]
                step[open_[hit]] = size
            got_word.append(active)
            got_rank.append(found)
            at[active] += np.maximum(step, 1)
            active = active[(found >= 0) & (at[active] < ends[active])]
        word, rank = np.concatenate(got_word), np.concatenate(got_rank)
        order = np.argsort(word, kind="stable")
        return rank[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ranks of each word's tokens."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        out: list = [None] * len(words)
        if short:
            rank, offs = self.speculate([words[i] for i in short])
            word = np.repeat(np.arange(len(short)), np.diff(offs))
            bad = np.zeros(len(short), bool)
            bad[word[rank < 0]] = True
            inner = np.flatnonzero(word[1:] == word[:-1])
            inner = inner[(rank[inner] >= 0) & (rank[inner + 1] >= 0)]
            pair, back = np.unique(rank[inner].astype(np.int64) << 20 | rank[inner + 1], return_inverse=True)
            fine = self.compatible(pair >> 20, pair & ((1 << 20) - 1))[back]
            bad[word[inner[~fine]]] = True
            for k, i in enumerate(short):
                if not bad[k]:
                    out[i] = rank[offs[k] : offs[k + 1]]
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = np.array(self.exact(w), np.int32)
        return out

    def entries(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the words, and the bytes of their decoded tokens, each with one blank after it; with their sizes."""
        ranks = self.encode_words(words)
        sizes = np.fromiter(map(len, ranks), np.int64, len(ranks))
        flat = np.concatenate(ranks)
        width = self.name_at[flat + 1] - self.name_at[flat]
        at = np.repeat(self.name_at[flat] - (np.cumsum(width) - width), width)
        at += np.arange(len(at))
        return [(self.ids[flat], sizes), (self.names_flat[at], np.add.reduceat(width, np.cumsum(sizes) - sizes))]


class Codec:
    """Whole texts to (ids, decoded text), as the tokenizers library has them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = WordBpe(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache = WordCache(self.bpe.entries, (np.uint32, np.uint8), limit=250_000)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.specials, key=len, reverse=True))) + ")") if self.bpe.specials else None

    def run(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Little-endian 32-bit ids, and UTF-8 decoded text, of every text."""
        parts, owner, specials, unsure = [], [], [], {}
        for i, text in enumerate(texts):
            text = text or ""
            pieces = self.cut.split(text) if self.cut and "<|" in text else (text,)
            for k, piece in enumerate(pieces):
                special = self.bpe.specials[piece] if k % 2 else -1
                if not k % 2 and not piece.isascii():
                    if not NOT_LATIN.search(piece):
                        piece = piece.lower()  # composed Latin letters are in NFC
                    elif not doubtful(piece):
                        piece = self.library.normalizer.normalize_str(piece)
                    else:
                        unsure[len(parts)] = self.library.encode(piece, add_special_tokens=False).ids
                        piece = ""
                parts.append("" if k % 2 else piece)
                owner.append(i)
                specials.append(special)
        buf, offs = C.raw(pa.array(parts, pa.large_string()))
        buf = C.LOWER[buf]
        starts, ends = split(buf, offs, spaced=False)
        slots = self.cache.lookup(buf, starts, ends)
        ids, id_at = self.cache.gather(slots, 0)
        dec, dec_at = self.cache.gather(slots, 1)
        bounds = C.word_bounds(starts, offs)
        id_at, dec_at = id_at[bounds].tolist(), dec_at[bounds].tolist()
        ids, dec = ids.astype("<u4").tobytes(), dec.tobytes()
        if len(parts) == len(texts) and not unsure:
            return [ids[4 * a : 4 * b] for a, b in zip(id_at, id_at[1:])], [dec[a : max(a, b - 1)] for a, b in zip(dec_at, dec_at[1:])]
        names = {v: k.encode() + b" " for k, v in self.bpe.specials.items()}
        out_ids, out_dec = [b""] * len(texts), [b""] * len(texts)
        for k, (i, special) in enumerate(zip(owner, specials, strict=True)):
            if k in unsure:
                out_ids[i] += np.array(unsure[k], "<u4").tobytes()
                out_dec[i] += b"".join([self.library.id_to_token(t).encode() + b" " for t in unsure[k]])
                continue
            out_ids[i] += ids[4 * id_at[k] : 4 * id_at[k + 1]] if special < 0 else special.to_bytes(4, "little")
            out_dec[i] += dec[dec_at[k] : dec_at[k + 1]] if special < 0 else names[special]
        return out_ids, [d[:-1] for d in out_dec]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec, with its cache, for each worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, n_tokens, ids (binary, little-endian 32-bit) and decoded (string). One pass, no shuffle."""
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                ids, dec = c.run(part.column("_text").to_pylist())
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(dec, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *cols], [*keep, "n_tokens", "ids", "decoded"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
