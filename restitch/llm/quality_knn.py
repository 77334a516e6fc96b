"""A quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become vectors of hashed word counts and word shapes, weighted by rarity, and are projected onto the main
singular directions of a bounded labelled sample.  The sample's vectors travel to every task; each document is
compared with all of them in blocks, exactly, and its nearest neighbours vote with the power of their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.llm.sample import least_hashes
from restitch.llm.textscan import Scan, U, chunks, mix

#: At most so many labelled ids (those with the least hash) are voters; their vectors take
#: MAX_VOTERS * DIMENSIONS * 4 bytes, whatever the size of the corpus.
MAX_VOTERS = 4096
WORDS, SHAPES, EXTRA = 2048, 256, 32
WIDTH = WORDS + SHAPES + EXTRA
DIMENSIONS, NEIGHBOURS, POWER, DIGITS = 64, 24, 8, 5
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)
for _bit, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", bytes(range(65, 91)), b"0123456789", b"#*$%&<>@~^_=+", b"|", b".,;:?", b"!", bytes(range(128, 256))]):
    _CLASS[np.frombuffer(_chars, np.uint8)] |= 1 << _bit


def raw_vectors(texts: list[bytes]) -> np.ndarray:
    """Shares of hashed words, of word shapes and of doc-wide measures (each block of unit length), a row a text."""
    s = Scan(texts, lower=False)
    n = s.n
    out = np.zeros((n, WIDTH), np.float32)
    if len(s.starts):
        shape = np.bitwise_or.reduceat(_CLASS[s.buf], s.starts)
        low = Scan(texts, lower=True).word_hash()
        word = (low >> U(20)).astype(np.int64) % WORDS
        doc = s.doc_of_word
        words = np.sqrt(np.bincount(doc * WORDS + word, minlength=n * WORDS).reshape(n, WORDS))
        shapes = np.sqrt(np.bincount(doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES))
        out[:, :WORDS], out[:, WORDS : WORDS + SHAPES] = words, shapes
        order = np.argsort(low ^ mix(doc), kind="stable")
        key = (low ^ mix(doc))[order]
        kinds = np.bincount(doc[order[np.concatenate(([True], key[1:] != key[:-1]))]], minlength=n)
        total = np.maximum(s.n_words, 1)
        size = np.minimum(np.log2(total).astype(np.int64), 15)
        fresh = np.minimum((15.99 * kinds / total).astype(np.int64), 15)
        full = np.flatnonzero(s.n_words)
        out[full, WORDS + SHAPES + size[full]] = 1
        out[full, WORDS + SHAPES + 16 + fresh[full]] = 1
    for a, b, weight in ((0, WORDS, 1.0), (WORDS, WORDS + SHAPES, 1.5), (WORDS + SHAPES, WIDTH, 0.5)):
        norm = np.linalg.norm(out[:, a:b], axis=1, keepdims=True)
        out[:, a:b] *= weight / np.maximum(norm, 1e-9)
    return out


class Model:
    def __init__(self, weights: np.ndarray, basis: np.ndarray, voters: np.ndarray, labels: np.ndarray):
        self.weights, self.basis, self.voters, self.labels = weights, basis, voters, labels
        self.prior = float(labels.mean())

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        """Rarity weights, the leading right singular vectors (by a seeded random range finder) and the voters."""
        have = (x > 0).mean(0)
        weights = np.log1p(1 / np.maximum(have, 1 / len(x))).astype(np.float32)
        y = x * weights
        d = min(dimensions, *y.shape)
        q = np.linalg.qr(y.T @ np.random.default_rng(0).standard_normal((len(y), d + 8)).astype(np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(y.T @ (y @ q))[0]
        basis = q @ np.linalg.svd(y @ q, full_matrices=False)[2].T[:, :d]
        return Model(weights, basis.astype(np.float32), _unit(y @ basis), labels.astype(np.float32))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The share of label 1 among the neighbours, weighted by cosine; a text without words scores the prior.

        Cosines that agree in DIGITS digits are alike, as of copies of a text; of these the voters of least id come first.
        """
        out = []
        k = min(NEIGHBOURS, len(self.voters))
        for run in chunks(texts, 1 << 20):
            for a in range(0, len(run), 256):
                v = _unit((raw_vectors(run[a : a + 256]) * self.weights) @ self.basis)
                cosine = np.round(v @ self.voters.T, DIGITS)
                near = nearest(cosine, k)
                weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
                total = weight.sum(1)
                vote = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
                out.append(np.clip(np.where(total > 1e-12, vote, self.prior), 0, 1))
        return np.concatenate(out) if out else np.empty(0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest values; of values alike the first columns, which are the voters of least id."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(1, keepdims=True)
    for r in np.flatnonzero((cosine >= least).sum(1) > k):  # a tie at the last place
        above, alike = np.flatnonzero(cosine[r] > least[r]), np.flatnonzero(cosine[r] == least[r])
        near[r] = np.concatenate((above, alike[: k - len(above)]))
    return near


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_voters: int = MAX_VOTERS) -> Model | None:
    """Fit on labelled rows that aren't held out; None where there are none.

    An id is one voter, with its largest label and, of several rows, the least text.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    named = named.join(F.broadcast(least_hashes(named, max_voters)), "doc_id").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [raw_vectors(run) for run in chunks(b["text"])]
            x = np.concatenate(x) if x else np.empty((0, WIDTH), np.float32)
            sparse = [(np.flatnonzero(r), r[r != 0]) for r in x]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "at": [i.astype(np.int32) for i, _ in sparse], "value": [v for _, v in sparse]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(named), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = rows.mapInPandas(vectors, "doc_id long, quality int, at array<int>, value array<float>").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    x = np.zeros((len(got), WIDTH), np.float32)
    for r, (at, value) in enumerate(zip(got["at"], got["value"], strict=True)):
        x[r, at] = value
    return Model.fit(x, got["quality"].to_numpy())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    A null or empty text scores the share of label 1 among the voters, a very long one by all its words; without
    labelled rows every text scores 0.5; of voters that are alike at the last place those of least id vote.  Only the text is read, whatever other columns there are; repeated rows and
    ids score by their own text; a null id isn't held out; an empty table gives no rows.
    """

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)) if model is not None else np.full(len(texts), 0.5), dtype=float)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit("")).cast("binary")).alias("score"))
    return rows.select("*", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, max_voters: int = MAX_VOTERS) -> DataFrame:
    """``predict`` with a model trained on the labelled rows of ``docs`` that aren't held out."""
    return predict(docs, train(docs, labels, max_voters))
