"""Adaptive context-mixing range coder for token ids, vectorised over the lanes of a block.

A block holds up to ``LANES * STEPS`` ids. It is cut into lanes of consecutive ids that are coded in
lockstep, one id of every lane a step, under one adaptive model which the whole block shares and which
starts empty in every block. The model mixes three id predictions:

* order 2: the id that last followed this lane's two previous ids (hashed table) with its confidence,
* order 1: the id that last followed the previous id, with its confidence,
* order 0: the frequencies of all ids of the block so far, every id at least once.

A gate, adaptive counts for each pair of confidences, gives the share of the code space that each
prediction gets: the mixing weights. A 64-bit carry-less range coder per lane writes 16-bit words. The decoder
runs the same model on the ids it has decoded. Blocks are independent and carry the CRC-32 of
their payload and of their ids, so that damage is found and confined to one block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 8192, 256
BLOCK = LANES * STEPS
_GATE, _BITS0 = 8, 20  # bits of the gate's and the order-0 distribution
_TOTAL = np.uint64(_GATE + _BITS0)
_TABLE2 = 18
_CONF = 7
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 40)
_U = np.uint64
_HEAD = struct.Struct("<4sIIIIII")
MAGIC = b"GLB1"


class Damaged(ValueError):
    """A block's checksum doesn't hold."""


class _Mixer:
    """The shared model of a block. A context's entry is its predicted id, shifted by 3 bits, and its confidence."""

    def __init__(self, vocab: int, lanes: int):
        self.vocab = vocab
        self.count = np.zeros(vocab, np.int64)
        self.seen = self.due = 0
        self.new: list[np.ndarray] = []
        self.t1, self.t2 = np.zeros(vocab + 1, np.int32), np.zeros(1 << _TABLE2, np.int32)
        self.gate = np.tile(np.array([1, 1, 2], np.int64), ((_CONF + 1) ** 2, 1))
        self.prev1, self.prev2 = np.full(lanes, vocab, np.int32), np.full(lanes, vocab, np.int32)
        self._order0()

    def _order0(self) -> None:
        scale = (1 << _BITS0) - self.vocab
        for ids in self.new:
            self.count += np.bincount(ids, minlength=self.vocab)
        self.new = []
        freq = 1 + (self.count * scale // max(self.seen, 1))
        freq[int(freq.argmax())] += (1 << _BITS0) - int(freq.sum())
        self.freq = freq
        self.cum = np.cumsum(freq) - freq
        self.slots = None

    def slot_ids(self) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.vocab, dtype=np.int32), self.freq)
        return self.slots

    def predict(self, n: int):
        """For the first n lanes: order-2 id, order-1 id, and the first two of the gate's three shares (of 2**_GATE)."""
        a = self.prev1[:n]
        self.at2 = (a * np.int32(-1640531535) ^ self.prev2[:n] * np.int32(-2048144777)).view(np.uint32) >> np.uint32(32 - _TABLE2)
        self.e1, self.e2 = self.t1[a], self.t2[self.at2]
        self.kind = (self.e2 & _CONF) * (_CONF + 1) + (self.e1 & _CONF)
        total = self.gate.sum(1)
        shares = 1 + self.gate[:, :2] * ((1 << _GATE) - 3) // total[:, None]
        both = (shares[:, 0] << 10 | shares[:, 1])[self.kind]
        return self.e2 >> 3, self.e1 >> 3, both >> 10, both & 1023

    def update(self, n: int, ids: np.ndarray, source: np.ndarray) -> None:
        a = self.prev1[:n].copy()
        ids = ids.astype(np.int32)
        for e, table, at in ((self.e1, self.t1, a), (self.e2, self.t2, self.at2)):
            k = e & _CONF
            miss = np.where(k > 1, e - k, ids << 3) | k >> 1
            # of equal contexts in a step the last lane counts
            table[at] = np.where(e >> 3 == ids, e + (k < _CONF), miss)
        self.gate += np.bincount(self.kind * 3 + source, minlength=self.gate.size).reshape(self.gate.shape)
        self.prev2[:n] = a
        self.prev1[:n] = ids
        self.new.append(ids)
        self.seen += n
        if self.seen >= self.due:
            self.due = self.seen + max(self.seen // 4, 4 * LANES)
            self._order0()


def _shape(n: int) -> tuple[int, int]:
    steps = min(STEPS, max(64, -(-n // LANES)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray) -> bytes:
    """One block of 1 to BLOCK ids below 2**19."""
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    if not 0 < n <= BLOCK:
        raise ValueError("a block holds 1 to %d ids" % BLOCK)
    vocab = int(ids.max()) + 1
    if vocab > 1 << 19 or ids.min() < 0:
        raise ValueError("ids must lie in 0 to 2**19 - 1")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    last = n - (lanes - 1) * steps
    model = _Mixer(vocab, lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0), np.uint64)
    who, words = [], []
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        x = grid[t, :m]
        y2, y1, s2, s1 = model.predict(m)
        source = np.where(y2 == x, 0, np.where(y1 == x, 1, 2))
        s0 = (1 << _GATE) - s2 - s1
        base = np.where(source == 0, 0, np.where(source == 1, s2, s2 + s1)) << _BITS0
        cum = base + np.where(source == 2, s0 * model.cum[x], 0)
        freq = np.where(source == 0, s2 << _BITS0, np.where(source == 1, s1 << _BITS0, s0 * model.freq[x]))
        r = rng[:m] >> _TOTAL
        low[:m] += cum.astype(np.uint64) * r
        rng[:m] = freq.astype(np.uint64) * r
        todo = None
        while True:
            lo, ra = (low[:m], rng[:m]) if todo is None else (low[todo], rng[todo])
            same = (lo ^ (lo + ra)) < _TOP
            go = np.flatnonzero(same | (ra < _BOT))
            if not len(go):
                break
            lo, ra, same = lo[go], ra[go], same[go]
            todo = go if todo is None else todo[go]
            ra = np.where(same, ra, (~lo + _U(1)) & (_BOT - _U(1)))
            who.append(todo.astype(np.uint16))
            words.append((lo >> _U(48)).astype(np.uint16))
            low[todo], rng[todo] = lo << _U(16), ra << _U(16)
        model.update(m, x, source)
    end = (low + (_BOT - _U(1))) & ~(_BOT - _U(1))
    for shift in (48, 32):
        who.append(np.arange(lanes, dtype=np.uint16))
        words.append((end >> _U(shift)).astype(np.uint16))
    who, words = np.concatenate(who), np.concatenate(words)
    payload = np.bincount(who, minlength=lanes).astype("<u2").tobytes() + words[np.argsort(who, kind="stable")].astype("<u2").tobytes()
    crc_ids = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEAD.pack(MAGIC, n, vocab, len(payload), zlib.crc32(payload), crc_ids, 0) + payload


def decode_block(data: bytes) -> np.ndarray:
    """The ids of one block; raises Damaged where a checksum doesn't hold."""
    try:
        magic, n, vocab, size, crc, crc_ids, _ = _HEAD.unpack_from(data)
    except struct.error as e:
        raise Damaged("block header cut short") from e
    payload = data[_HEAD.size : _HEAD.size + size]
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != crc:
        raise Damaged("block checksum")
    lanes, steps = _shape(n)
    counts = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, "<u2", offset=2 * lanes), np.zeros(1, np.uint16)]).astype(np.uint64)
    stop = np.cumsum(counts)
    at = stop - counts
    none = len(words) - 1
    last = n - (lanes - 1) * steps
    model = _Mixer(vocab, lanes)
    low, rng, code = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0), np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _U(16) | words[np.where(at < stop, at, none)]
        at += 1
    grid = np.zeros((steps, lanes), np.int64)
    full = (1 << (_GATE + _BITS0)) - 1
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        y2, y1, s2, s1 = model.predict(m)
        r = rng[:m] >> _TOTAL
        v = np.minimum(((code[:m] - low[:m]) // r).astype(np.int64), full)
        part = v >> _BITS0
        both = s2 + s1
        source = (part >= s2).astype(np.int64) + (part >= both)
        s0 = (1 << _GATE) - both
        x = np.where(source == 0, y2, y1).astype(np.int64)
        esc = np.flatnonzero(source == 2)
        cum = np.where(source == 1, s2, 0) << _BITS0
        freq = np.where(source == 0, s2, s1) << _BITS0
        if len(esc):
            e0 = s0[esc]
            sym = model.slot_ids()[(v[esc] - (both[esc] << _BITS0)) // e0]
            x[esc] = sym
            cum[esc] = (both[esc] << _BITS0) + e0 * model.cum[sym]
            freq[esc] = e0 * model.freq[sym]
        low[:m] += cum.astype(np.uint64) * r
        rng[:m] = freq.astype(np.uint64) * r
        todo = None
        while True:
            lo, ra = (low[:m], rng[:m]) if todo is None else (low[todo], rng[todo])
            same = (lo ^ (lo + ra)) < _TOP
            go = np.flatnonzero(same | (ra < _BOT))
            if not len(go):
                break
            lo, ra, same = lo[go], ra[go], same[go]
            todo = go if todo is None else todo[go]
            ra = np.where(same, ra, (~lo + _U(1)) & (_BOT - _U(1)))
            w = at[todo]
            code[todo] = code[todo] << _U(16) | words[np.where(w < stop[todo], w, none)]
            at[todo] = w + 1
            low[todo], rng[todo] = lo << _U(16), ra << _U(16)
        model.update(m, x, source)
        grid[t, :m] = x
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise Damaged("decoded ids don't match their checksum")
    return ids
