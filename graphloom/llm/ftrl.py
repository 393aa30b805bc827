"""FTRL-proximal logistic regression over hashed word n-grams (quality, toxicity).

A text's features are the distinct hashed n-grams of its whole token sequence (presence, not
counts); tokens are runs of letters, digits and non-ASCII bytes, or runs of punctuation.
A token equal to the one before it is written as one repetition mark, so that a stutter gives
the same n-gram whatever word stutters. Skip-grams join a token with the one two places on.

Training is per-coordinate follow-the-regularised-leader (McMahan et al. 2013) with L1 and L2 on
a sample of at most ``per_class`` labelled texts of each class, a documented bound; all rest, the
class counts included, covers every row. The sample is balanced, so the intercept is shifted by
the prior log odds of the counts over all labelled training rows. L1 leaves a few thousand weights,
which is what is broadcast: at most 2**bits numbers, whatever the corpus.

Defined results: a null or empty text has no n-grams and gets the intercept's score; without any
training row of both classes every score is the prior (0 when there are no labels at all).
Repeated rows are scored alike, each on its own; columns other than text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_PUNCT = bytes(b for b in range(33, 127) if b not in C.ALNUM)
_KINDS = C.kinds_table(C.ALNUM, _PUNCT)
_REPEAT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Features:
    """What is hashed: n-gram lengths, whether skip-grams count, case folding, table bits."""

    ngrams: int = 2
    skips: bool = False
    lower: bool = True
    bits: int = 20

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every n-gram occurrence in the texts, duplicates included."""
        buf, offs = C.raw(texts)
        starts, ends = C.runs(_KINDS[buf], offs)
        words = C.spans_hash(C.LOWER[buf] if self.lower else buf, starts, ends)
        rows = C.row_of(starts, offs)
        if len(words):
            same = np.zeros(len(words), bool)
            same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
            words = np.where(same, _REPEAT, words)
        found_rows, found = [rows], [words]
        gram = words
        for n in range(2, self.ngrams + 1):
            if len(words) < n:
                break
            gram = C.mix(gram[:-1] * np.uint64(3) + words[n - 1 :] + np.uint64(n))
            ok = rows[: len(gram)] == rows[n - 1 :]
            found_rows.append(rows[: len(gram)][ok])
            found.append(gram[ok])
        if self.skips and len(words) > 2:
            gram = C.mix(words[:-2] * np.uint64(5) + words[2:] + np.uint64(77))
            ok = rows[:-2] == rows[2:]
            found_rows.append(rows[:-2][ok])
            found.append(gram[ok])
        return np.concatenate(found_rows), (np.concatenate(found) >> np.uint64(64 - self.bits)).astype(np.int64)


@dataclass
class Model:
    features: Features
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << self.features.bits, np.float32)
        table[self.index] = self.weight
        return table

    def score(self, texts: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
        """Probability of label 1 for each text: a sparse dot product over its distinct features."""
        table = self.table() if table is None else table
        rows, feats = self.features.of(texts)
        kept = table[feats] != 0
        key = np.unique(rows[kept] << self.features.bits | feats[kept])
        dots = np.bincount(key >> self.features.bits, weights=table[key & ((1 << self.features.bits) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(dots + self.bias, -35, 35)))


def fit_ftrl(examples: list[np.ndarray], labels: np.ndarray, dims: int, epochs=4, alpha=0.15, beta=1.0, l1=1.0, l2=1.0):
    """Weights and intercept by FTRL-proximal; one pass over the examples an epoch, in a fixed shuffled order."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at = np.append(examples[i], dims)
            zi, ni = z[at], n[at]
            w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
            w[np.abs(zi) <= l1] = 0.0
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha + l2)  # the intercept is not penalised by L1
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0.0
    w[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha + l2)
    return w[:-1], float(w[-1])


SELECT = {"epochs": 3, "alpha": 2.0, "l1": 6.0, "l2": 0.0}
POLISH = {"epochs": 15, "alpha": 1.0, "l1": 0.0, "l2": 0.0}


def fit(docs: DataFrame, labels: DataFrame, target: str, features: Features, modulus: int, held: int, per_class: int = 3000, min_df: int = 3, select: dict = SELECT, polish: dict = POLISH) -> Model:
    """Trains on at most per_class labelled texts of each class outside the held fold.

    First with strong L1, which selects the coordinates, then on those alone without L1, which
    undoes its shrinkage. N-grams of fewer than min_df sampled texts are left out.
    """
    sample, counts = C.labelled_sample(docs, labels, target, per_class, modulus, held)
    if len(counts) < 2:
        bias = -35.0 if not counts or max(counts) != 1 else 35.0
        return Model(features, np.zeros(0, np.int64), np.zeros(0, np.float32), bias)
    bits = features.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(batch, "text"):
                part = batch.slice(a, b - a)
                rows, feats = features.of(part.column("text"))
                key = np.unique(rows << bits | feats)
                at = np.searchsorted(key >> bits, np.arange(b - a + 1))
                packed = (key & ((1 << bits) - 1)).astype("<i4")
                out = [packed[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(out, pa.binary())], ["label", "feats"])

    got = sample.mapInArrow(extract, "label int, feats binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["feats"])))
    x = [np.frombuffer(r["feats"], "<i4").astype(np.int64) for r in got]
    y = np.array([float(r["label"] == 1) for r in got])
    if len(set(y.tolist())) < 2:
        return Model(features, np.zeros(0, np.int64), np.zeros(0, np.float32), 35.0 if len(y) and y[0] else -35.0)
    common = np.bincount(np.concatenate(x), minlength=1 << bits) >= min_df
    x = [v[common[v]] for v in x]
    w, _ = fit_ftrl(x, y, 1 << bits, **select)
    x = [v[w[v] != 0] for v in x]
    w, bias = fit_ftrl(x, y, 1 << bits, **polish)
    pos, neg = float(counts[1]), float(sum(c for k, c in counts.items() if k != 1))
    bias += np.log(pos / neg) - np.log(y.sum() / (len(y) - y.sum()))
    keep = np.flatnonzero(w)
    return Model(features, keep, w[keep].astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and a double column score; a null keep column stays null. One pass, no shuffle."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = told.value, told.value.table()
        for batch in batches:
            for a, b in C.chunks(batch, "_text"):
                part = batch.slice(a, b - a)
                s = m.score(part.column("_text"), table)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score at least this much. One pass, no shuffle."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = told.value, told.value.table()
        for batch in batches:
            for a, b in C.chunks(batch, text):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(m.score(part.column(text), table) >= least))

    return docs.mapInArrow(run, docs.schema)


#: Quality keeps the case (shouting is a sign); toxicity folds it and adds skip-grams.
QUALITY = Features(ngrams=2, skips=False, lower=False)
TOXICITY = Features(ngrams=2, skips=True, lower=True)


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels, "quality", QUALITY, modulus=4, held=2)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels, "toxic", TOXICITY, modulus=3, held=1)


def classified(docs: DataFrame, model: Model, modulus: int, held: int) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7 on) of every row."""
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (C.fold_of("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
