"""Vectorised pre-tokenisation and a word cache, shared by the two tokenisers.

``split`` finds the pieces of the two public byte-pair patterns on whole UTF-8 buffers: character
classes by table, runs by comparison, then the contraction and white-space rules as mask updates.
``WordCache`` maps a piece to what was computed for it before; only pieces not seen by this worker are
encoded again. A piece is known by a 64-bit hash, its length and its first eight bytes. The
cache is emptied when it is full, so that a worker's memory does not grow with the corpus.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
from . import common as C

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def class_of(code: int) -> int:
    """The class of a code point, by its general category; unassigned ones are OTHER here (see ``doubtful``)."""
    if code in _SPACES:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], OTHER)


_SPACES = {*map(ord, "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"), *range(0x2000, 0x200B)}
_LATIN = np.array([class_of(c) for c in range(0x250)], np.uint8)


def classes_of(codes: np.ndarray) -> np.ndarray:
    """The class of every code point; those beyond Latin are looked up once for each distinct one."""
    out = _LATIN[np.minimum(codes, 0x24F)]
    far = np.flatnonzero(codes > 0x24F)
    if len(far):
        distinct, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([class_of(c) if c <= sys.maxunicode else OTHER for c in distinct.tolist()], np.uint8)[at]
    return out


#: Beyond Latin letters the Unicode versions of two libraries may differ: texts with such characters are looked at closer.
NOT_LATIN = re.compile("[^\x00-\u024f]")


def doubtful(text: str) -> bool:
    """Whether the text holds a code point that this Python's Unicode tables don't assign."""
    return any(unicodedata.category(c) == "Cn" for c in set(NOT_LATIN.findall(text)))


def kinds_of(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each UTF-8 byte belongs to."""
    kinds = _LATIN[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
        b0, b1, b2, b3 = (pad[lead + k] for k in range(4))
        two, three = b0 < 0xE0, b0 < 0xF0
        code = np.where(
            two,
            (b0 & 31) << 6 | (b1 & 63),
            np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63), (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | (b3 & 63)),
        )
        kind = classes_of(code)
        kinds[lead] = kind
        kinds[lead + 1] = kind
        for k, more in ((2, ~two), (3, ~three)):
            kinds[lead[more] + k] = kind[more]
    return kinds


def split(buf: np.ndarray, offs: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, in order.

    spaced: the pattern that keeps white space and joins one blank to the piece after it; else
    the one that drops white space and takes every number character by itself.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = kinds_of(buf)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:n])
    edge[offs] = True
    is_row = np.zeros(n + 1, bool)
    is_row[offs] = True
    if not spaced:
        edge[:n] |= (kinds == NUMBER) & ((buf & 0xC0) != 0x80)
    else:
        # the last character of a run of white space, when more text follows in the row, stands apart
        before = np.flatnonzero(edge[1:n] & (kinds[:-1] == SPACE) & ~is_row[1:n])  # last byte of the run
        start = before.copy()
        for _ in range(3):
            start -= (buf[start] & 0xC0) == 0x80
        edge[start] = True
    # contractions: a lone apostrophe at a piece's start, then s t m d re ve ll
    q = np.flatnonzero((buf[:-1] == 0x27) & edge[: n - 1] & edge[1:n] & ~is_row[1:n])
    if spaced:
        q = q[~((q > 0) & (buf[np.maximum(q - 1, 0)] == 0x20) & ~is_row[q])]
    if len(q):
        a = buf[q + 1]
        b = np.where((q + 2 < n) & ~is_row[np.minimum(q + 2, n)], buf[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        edge[q[one] + 1] = edge[q[two] + 1] = False
        edge[q[one] + 2] = edge[q[two] + 3] = True
    if spaced:
        # a blank joins the piece after it
        blank = np.flatnonzero((buf[:-1] == 0x20) & edge[: n - 1] & edge[1:n] & ~is_row[1:n] & (kinds[1:] != SPACE))
        edge[blank + 1] = False
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    if not spaced:
        keep = kinds[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class WordCache:
    """Piece -> rows of one or more ragged pools, by open addressing over 64-bit hashes.

    encode gives, for each pool, the entries of the new pieces one after the other, and their sizes.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], dtypes: tuple, bits: int = 20, limit: int = 500_000):
        self.encode, self.dtypes, self.bits, self.limit = encode, dtypes, bits, limit
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.check = np.zeros(self.limit, np.uint64)  # pages that are never touched take no memory
        self.starts = [np.zeros(self.limit + 1, np.int64) for _ in self.dtypes]
        self.pools = [np.zeros(1 << 20, d) for d in self.dtypes]

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.int64((1 << self.bits) - 1)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.hash[at]
        out = np.where(seen == h, self.slot[at], -1)
        todo = np.flatnonzero((seen != h) & (seen != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            seen = self.hash[at]
            hit = seen == h[todo]
            out[todo[hit]] = self.slot[at[hit]]
            more = ~hit & (seen != 0)
            todo, at = todo[more], at[more]
        return out

    def _insert(self, h: np.ndarray, slots: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = np.flatnonzero(self.hash[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.hash[at[won]] = h[todo[won]]
            self.slot[at[won]] = slots[todo[won]]
            lost = np.ones(len(todo), bool)
            lost[won] = False
            todo, at = todo[lost], (at[lost] + 1) & mask

    def _place(self, made: list[tuple[np.ndarray, np.ndarray]], check: np.ndarray) -> np.ndarray:
        """Stores encoded pieces; their slots."""
        n = len(check)
        more = self.n + n - len(self.check)
        if more > 0:
            self.check = np.concatenate([self.check, np.zeros(more, np.uint64)])
            self.starts = [np.concatenate([x, np.zeros(more, np.int64)]) for x in self.starts]
        for k, pool in enumerate(self.pools):
            flat, sizes = made[k]
            begin = self.starts[k][self.n]
            total = int(begin + sizes.sum())
            if total > len(pool):
                pool = self.pools[k] = np.concatenate([pool, np.zeros(max(total - len(pool), len(pool)), pool.dtype)])
            if total > begin:
                pool[begin:total] = flat
            self.starts[k][self.n + 1 : self.n + 1 + n] = begin + np.cumsum(sizes)
        slots = np.arange(self.n, self.n + n)
        self.check[slots] = check
        self.n += n
        return slots

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of every piece; pieces that are new are encoded and stored first."""
        h = C.spans_hash(buf, starts, ends)
        h |= np.uint64(1)
        size = ends - starts
        pad = np.concatenate([buf, np.zeros(8, np.uint8)])
        first = np.ndarray((len(buf) + 1,), "<u8", pad.data, strides=(1,))[starts]
        first = first & ~np.where(size >= 8, np.uint64(0), ~np.uint64(0) << (np.minimum(size, 7) * 8).astype(np.uint64))
        check = first * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        out = self._find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            _, at = np.unique(h[new], return_index=True)
            fresh = new[at]
            if self.n + len(fresh) > self.limit:
                self.clear()
                _, fresh = np.unique(h, return_index=True)
                if len(fresh) > self.limit // 2:
                    self.limit, self.bits = 2 * len(fresh), max(self.bits, int(4 * len(fresh)).bit_length())
                    self.clear()
            raw = buf.tobytes()
            made = self.encode([raw[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
            slots = self._place(made, check[fresh])
            self._insert(h[fresh], slots)
            out = self._find(h)
        wrong = np.flatnonzero(self.check[out] != check)
        if len(wrong):  # another piece has the hash: this one gets a slot outside the table
            raw = buf.tobytes()
            made = self.encode([raw[a:b] for a, b in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)])
            out = out.astype(np.int64)
            out[wrong] = self._place(made, check[wrong])
        return out

    def gather(self, slots: np.ndarray, pool: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated pool entries of the slots, and the n + 1 offsets of each."""
        begin = self.starts[pool]
        sizes = begin[slots + 1] - begin[slots]
        offs = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(sizes, out=offs[1:])
        at = np.repeat(begin[slots] - offs[:-1], sizes)
        at += np.arange(len(at))
        return self.pools[pool][at], offs
