"""Token files: whole texts as ids, in ascending document order, in range-coded blocks.

A file is ``GLTF`` and a version, blocks of rangecoder, an index (document ids, ids per document,
block places; compressed, with CRC-32) and a tail with the index's size. Documents are range-partitioned by id,
one file a partition, so the files in order hold the corpus in order; a document may span blocks.

Writing goes to the shared folder: every attempt writes its own temporary name and moves it into place, so
that a lost executor costs only its task. The driver sees one row a file (its totals), not the data.
The files are read back a file a task, block by block.

Null texts count as empty and still get the end id; null document ids come first; equal ids are ordered
by text. An empty table gives no file or an empty one, and no rows. Other columns are never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .pretoken import NOT_LATIN, WordCache, doubtful, split
from .rangecoder import BLOCK, Damaged, decode_block, encode_block

_TAIL = struct.Struct("<QII4s")
_HEAD = b"GLTF\x01\0\0\0"


class LibraryEncoder:
    """Whole texts to ids by the tokenizers library, which sees each distinct piece once for each worker.

    For byte-level BPE files without a normaliser: pieces are independent there.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        vocab = self.library.get_vocab()
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character for every byte
        for token, i in vocab.items():
            self.widths[i] = len(token)
        self.cache = WordCache(self._words, (np.uint32,), bits=22, limit=2_000_000)

    def _words(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of new pieces. Pieces of a blank and letters go to the library 256 in a row, which splits them again."""
        texts = [w.decode() for w in words]
        plain = np.array([t[0] == " " and t[1:].isalpha() for t in texts], bool)
        rows, odd = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        groups = [rows[k : k + 256] for k in range(0, len(rows), 256)]
        got = self.library.encode_batch_fast(["".join([texts[i] for i in g]) for g in groups] + [texts[i] for i in odd], add_special_tokens=False)
        lists = [e.ids for e in got]
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        # words in the library's order; a word ends where the bytes of its tokens do
        order = np.array(rows + odd, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))[order]
        last = np.searchsorted(np.cumsum(self.widths[flat]), np.cumsum(size)) + 1
        counts = np.diff(last, prepend=0)
        sizes = np.zeros(len(words), np.int64)
        sizes[order] = counts
        begin = np.cumsum(sizes) - sizes
        out = np.empty(len(flat), np.uint32)
        out[np.repeat(begin[order] - (last - counts), counts) + np.arange(len(flat))] = flat
        return [(out, sizes)]

    def run(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number for each text; end closes each text."""
        parts, owner, odd = [], [], {}
        for i, text in enumerate(texts):
            text = text or ""
            pieces = self.cut.split(text) if self.cut and "<|" in text else (text,)
            for k, piece in enumerate(pieces):
                if k % 2:
                    odd[len(parts)] = np.array([self.specials[piece]], np.uint32)
                elif not piece.isascii() and NOT_LATIN.search(piece) and doubtful(piece):
                    odd[len(parts)] = np.array(self.library.encode(piece, add_special_tokens=False).ids, np.uint32)
                parts.append("" if len(parts) in odd else piece)
                owner.append(i)
        buf, offs = C.raw(pa.array(parts, pa.large_string()))
        starts, ends = split(buf, offs, spaced=True)
        ids, at = self.cache.gather(self.cache.lookup(buf, starts, ends))
        at = at[C.word_bounds(starts, offs)]
        if odd:
            ids = [odd[k] if k in odd else ids[a:b] for k, (a, b) in enumerate(zip(at, at[1:]))]
            sizes = np.array([len(x) for x in ids])
            ids = np.concatenate(ids)
        else:
            sizes = np.diff(at)
        counts = np.bincount(np.array(owner), weights=sizes, minlength=len(texts)).astype(np.int64)
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            counts += 1
        return ids, counts


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


class Writer:
    """One token file; ids may be added in any portions."""

    def __init__(self, uri: str, block: int = BLOCK):
        self.fs, path = fs.FileSystem.from_uri(uri)
        self.path, self.block = path, block
        self.temp = f"{path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(_HEAD)
        self.held, self.n_held, self.docs, self.counts, self.blocks, self.tokens = [], 0, [], [], [], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.extend(doc_ids)
        self.counts.append(counts)
        self.held.append(ids)
        self.n_held += len(ids)
        self.tokens += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= self.block or last and at < len(ids):
            data = encode_block(ids[at : at + self.block])
            self.blocks.append((self.out.tell(), len(data)))
            self.out.write(data)
            at += self.block
        self.held, self.n_held = [ids[at:]], max(0, len(ids) - at)

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        counts = np.concatenate(self.counts).astype("<i8") if self.counts else np.zeros(0, "<i8")
        index = zlib.compress(np.array([len(docs), len(self.blocks)], "<i8").tobytes() + nulls.tobytes() + docs.tobytes() + counts.tobytes() + np.array(self.blocks, "<i8").tobytes(), 1)
        self.out.write(index)
        self.out.write(_TAIL.pack(len(index), zlib.crc32(index), 0, b"GLTF"))
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    """Reads a token file document by document, a block at a time."""

    def __init__(self, uri: str):
        self.fs, path = fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        if size < _TAIL.size:
            raise Damaged("file cut short")
        length, crc, _, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        index = self.file.read_at(length, size - _TAIL.size - length) if magic == b"GLTF" else b""
        if magic != b"GLTF" or zlib.crc32(index) != crc:
            raise Damaged("file index checksum")
        index = zlib.decompress(index)
        n, blocks = np.frombuffer(index, "<i8", 2)
        self.nulls = np.frombuffer(index, np.uint8, n, 16).astype(bool)
        self.docs = np.frombuffer(index, "<i8", n, 16 + n)
        self.counts = np.frombuffer(index, "<i8", n, 16 + 9 * n)
        self.blocks = np.frombuffer(index, "<i8", 2 * blocks, 16 + 17 * n).reshape(-1, 2)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, one past the last, their ids) for the documents that end in each block."""
        ends = np.cumsum(self.counts)
        done, base, rest = 0, 0, np.zeros(0, "<u4")
        for at, size in self.blocks.tolist():
            rest = np.concatenate([rest, decode_block(self.file.read_at(size, at))])
            stop = int(np.searchsorted(ends, base + len(rest), "right"))
            if stop > done:
                used = int(ends[stop - 1]) - base
                yield done, stop, rest[:used]
                rest, base, done = rest[used:], base + used, stop
        if done < len(self.docs):
            if base + len(rest) != (int(ends[-1]) if len(ends) else 0):
                raise Damaged("ids are missing")
            yield done, len(self.docs), rest


def write(docs: DataFrame, folder: str, path: str, end: int = 2, id_col: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Encodes and writes every document; returns (file, documents, ids) in corpus order, a row a file."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    ordered = rows.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:08d}.gltf"
        out = None
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                out = out or Writer(uri)
                piece = batch.slice(a, b - a)
                ids, counts = enc.run(piece.column("_text").to_pylist(), end)
                out.add(piece.column("_id").to_pylist(), ids, counts)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "docs": [len(out.docs)], "tokens": [out.tokens]})

    got = ordered.mapInArrow(run, "part long, file string, docs long, tokens long").collect()
    return [(r["file"], r["docs"], r["tokens"]) for r in sorted(got, key=lambda r: r["part"])]


def read(spark: SparkSession, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian 32-bit) of every document in the files."""
    begins, total = [], 0
    for _, _, tokens in files:
        begins.append(total)
        total += tokens
    names = [f for f, _, _ in files]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                reader = Reader(names[k])
                base = begins[k]
                for a, b, ids in reader:
                    counts = reader.counts[a:b]
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    bounds = list(zip((4 * (ends - counts)).tolist(), (4 * ends).tolist(), strict=True))
                    cols = [
                        pa.array(reader.docs[a:b], pa.int64(), mask=reader.nulls[a:b]),
                        pa.array(base + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(raw[x:y]) for x, y in bounds], pa.int64()),
                    ]
                    if with_ids:
                        cols.append(pa.array([bytes(raw[x:y]) for x, y in bounds], pa.binary()))
                    base += int(ends[-1]) if len(ends) else 0
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, schema)
