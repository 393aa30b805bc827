"""Language identification: blended-spectrum string kernels, Nystroem landmarks, kernel ridge regression.

The kernel of two pieces is the mean over n = 2..4 of the cosine of their byte n-gram presence
sets (letters folded for ASCII, digits and punctuation one separator), the n-grams hashed into one table of ``2**BITS`` places per n. A text
of more than ``PIECE`` bytes is cut into equal pieces, as its grams would fill the table, and its output is their mean: every byte counts. ``landmarks`` training texts, or one a language if there are more
languages, span the Nystroem space, drawn from the languages in turn; one-versus-rest kernel ridge regression is solved in that space on a bounded
sample of at most ``per_class`` training texts per language. A score is a product of a batch's kernel
matrix with the dual weights. The broadcast model is landmarks x 3 x 2**BITS bits at most and
languages x landmarks numbers: bounded by parameters and the number of languages, not by the rows.

The languages are all those of the training rows; null texts and texts without a letter are ``und``
with score 0. Ties go to the smaller language name. Training rows with null lang are ignored.
A corpus without training rows answers ``und`` throughout. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS, ORDERS, PIECE, ROWS = 13, (2, 3, 4), 4096, 256
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, shares, offsets, buffer) of at most ROWS pieces at a time: a text longer than PIECE bytes is cut into equal ones."""
    buf, offs = C.raw(texts)
    size = np.diff(offs)
    many = np.maximum(-(-size // PIECE), 1)
    row = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    cut = np.append(offs[row] + size[row] * nth // many[row], offs[-1])
    for a in range(0, len(row), ROWS):
        b = min(a + ROWS, len(row))
        yield row[a:b], 1 / many[row[a:b]], cut[a : b + 1] - cut[a], buf[cut[a] : cut[b]]


def presence(offs: np.ndarray, buf: np.ndarray) -> list[np.ndarray]:
    """For each n, a rows x 2**BITS boolean matrix of the n-grams that a row's bytes hold, none across rows."""
    n_rows = len(offs) - 1
    rows = np.repeat(np.arange(n_rows, dtype=np.int64), np.diff(offs))
    b = _FOLD[buf]
    keep = np.ones(len(b), bool)  # runs of separators count once
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (rows[1:] != rows[:-1])
    b, rows = b[keep].astype(np.uint32), rows[keep] << BITS
    out = []
    for n in ORDERS:
        m = np.zeros((n_rows, 1 << BITS), bool)
        if len(b) >= n:
            last = len(b) - n + 1
            h = b[:last].copy()
            for k in range(1, n):
                h = h * np.uint32(257) + b[k : last + k]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            at = rows[:last]
            if n > 1:
                ok = at == rows[n - 1 :]
                at, h = at[ok], h[ok]
            m.reshape(-1)[at | h] = True
        out.append(m)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float32)
    return m / np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))


@dataclass
class Model:
    langs: list[str]
    landmarks: list[np.ndarray]  # for each n: landmarks x 2**BITS booleans
    dual: np.ndarray  # landmarks x languages
    offset: np.ndarray  # languages

    def kernel(self, m: list[np.ndarray], z: list[np.ndarray]) -> np.ndarray:
        return sum(_unit(a) @ b for a, b in zip(m, z, strict=True)) / len(ORDERS)


def fit(docs: DataFrame, modulus: int = 5, held: int = 0, per_class: int = 1000, landmarks: int = 96, ridge: float = 1e-2) -> Model:
    """Trains on texts outside the held fold, at most per_class a language, the smallest id hashes first."""
    blank = Model([], [], np.zeros((0, 0)), np.zeros(0))
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (C.fold_of("doc_id", modulus) != held)).select("doc_id", "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = train.withColumn("_n", place).where(F.col("_n") <= per_class).groupBy(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).agg(F.min("_n").alias("_n"))
    # at most per_class short rows a language
    picked = C.stored(docs.join(F.broadcast(ids), (docs["doc_id"] == ids["_id"]) & (docs["lang"] == ids["_lang"])).select("lang", "text", "_n"), "picked")
    count = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}
    langs = sorted(count)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_n", "text"))
    marks = picked.where(F.col("text").rlike(r"\pL")).groupBy("lang", "text").agg(F.min("_n").alias("_n")).withColumn("_turn", turn)
    marks = [r["text"] for r in marks.where(F.col("_turn") <= landmarks).orderBy("_turn", "lang").limit(max(landmarks, len(langs))).collect()]
    if not marks:
        return blank
    points = [np.concatenate(x) for x in zip(*(presence(*_middle(m)) for m in marks), strict=True)]
    told = docs.sparkSession.sparkContext.broadcast((points, langs, count))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, langs, count = told.value
        z = [_unit(x).T.copy() for x in points]
        at = {lang: n for n, lang in enumerate(langs)}
        a, b = np.zeros((z[0].shape[1], z[0].shape[1])), np.zeros((z[0].shape[1], len(langs)))
        for batch in batches:
            for lo, hi in C.chunks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                langs_ = part.column("lang").to_pylist()
                for row, share, offs, buf in pieces(part.column("text")):
                    k = blank.kernel(presence(offs, buf), z).astype(float)
                    lang = [langs_[r] for r in row]
                    w = k * (share / np.array([count[x] for x in lang]))[:, None]  # languages count alike, texts too
                    a += k.T @ w
                    np.add.at(b.T, [at[x] for x in lang], w)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    sums = picked.select("lang", "text").mapInArrow(moments, "a binary, b binary").collect()
    m = len(marks)
    a = sum(np.frombuffer(r["a"]).reshape(m, m) for r in sums)
    b = sum(np.frombuffer(r["b"]).reshape(m, len(langs)) for r in sums)
    k_mm = blank.kernel(points, [_unit(x).T for x in points]).astype(float)
    mean = np.array([count[x] for x in langs]) / sum(count.values())
    a = a + ridge * k_mm / len(langs) + 1e-6 * np.eye(m)
    return Model(langs, points, np.linalg.solve(a, b - np.outer(b.sum(1), mean)), mean)


def _middle(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A landmark is a piece of a training text: the middle one, so that a long text's grams don't fill the table."""
    cut = [(offs, buf) for _, _, offs, buf in pieces(pa.array([text], pa.string()))]
    offs, buf = cut[len(cut) // 2]
    k = (len(offs) - 1) // 2
    return offs[k : k + 2] - offs[k], buf[offs[k] : offs[k + 1]]


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, lang_pred and score (0 to 1: the winner's share of the clipped outputs)."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        z = [_unit(x).T.copy() for x in m.landmarks]
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for a, b in C.chunks(batch, "_text", 1 << 20):
                part = batch.slice(a, b - a)
                letters = _has_letter(part.column("_text"))
                if m.langs:
                    out = np.zeros((b - a, len(m.langs))) + m.offset
                    for row, share, offs, buf in pieces(part.column("_text")):
                        np.add.at(out, row, m.kernel(presence(offs, buf), z) @ m.dual * share[:, None])
                    best = out.argmax(1)
                    share = np.clip(out, 0, None)
                    score = share[np.arange(len(best)), best] / np.maximum(share.sum(1), 1e-12)
                else:
                    best, score, letters = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a, bool)
                best, score = np.where(letters, best, len(m.langs)), np.where(letters, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text holds a letter of any script (Unicode categories L*)."""
    found = pc.match_substring_regex(texts, r"\pL").fill_null(False)
    return np.asarray(found, bool)
