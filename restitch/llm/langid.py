"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary of byte strings.  A word (with the
blank before it) scores the sum, over all its segmentations into pieces, of the product of their probabilities:
a forward pass over its bytes.  A text scores the product over its words, and Bayes' rule gives the language.
Probabilities are fitted by expectation maximisation on word counts of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.llm import textscan
from restitch.llm.bpe import read_ranks
from restitch.llm.sample import least_hashes
from restitch.llm.session import Scratch
from restitch.llm.textscan import Scan, U, chunks, settle

#: So many labelled texts of each language (those with the least hash of their id), with all their words, fit the
#: probabilities, in so many rounds.
MAX_TEXTS, ROUNDS = 1500, 3
#: Probabilities are scaled by this for each byte.
_SCALE = 8.0
#: Words side by side (fewer for more than eight languages), and places of their bytes held at a time.
_BLOCK, _PLACES = 4096, 1 << 16
#: Longer pieces are looked up only where their first bytes are those of one.
_SHORT = 12
_KNOWN = 600_000


class Vocabulary:
    """Pieces by length, as sorted hashes with their numbers."""

    def __init__(self, path: str):
        pieces = sorted(read_ranks(path))
        self.n = len(pieces)
        self.lengths = np.array([len(t) for t in pieces])
        hashed = _Hashes(np.frombuffer(b"".join(pieces), np.uint8))
        ends = np.cumsum(self.lengths)
        h = hashed.span(ends - self.lengths, ends)
        self.longest = int(self.lengths.max())
        self.by_length = {}
        for k in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == k)
            own = own[np.argsort(h[own])]
            self.by_length[int(k)] = (h[own], own)
        at = (ends - self.lengths)[self.lengths > _SHORT]
        self.heads = np.unique(hashed.span(at, at + _SHORT))

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """The number of the piece of length k with each hash, or n where there is none."""
        if k not in self.by_length:
            return np.full(len(h), self.n)
        table, number = self.by_length[k]
        at = np.searchsorted(table, h)
        at[at == len(table)] = 0
        return np.where(table[at] == h, number[at], self.n)

    def matches(self, hashes: _Hashes, start: np.ndarray, least: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (number in ``start``, length, piece) of pieces that begin at ``start`` and are of ``least`` to ``room`` bytes."""
        out = []
        near = np.arange(len(start))
        for k, (table, _) in self.by_length.items():
            if k > _SHORT and len(self.heads):
                if out and out[-1][3] <= _SHORT:  # the first of the long ones
                    near = near[room[near] >= _SHORT]
                    head = hashes.span(start[near], start[near] + _SHORT)
                    near = near[self.heads[np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)] == head]
            near = near[room[near] >= k]
            if not len(near):
                break
            fits = near[least[near] <= k]
            piece = self.find(k, hashes.span(start[fits], start[fits] + k))
            have = np.flatnonzero(piece < self.n)
            out.append((fits[have], np.full(len(have), k), piece[have], k))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in list(zip(*out, strict=True))[:3])


class _Hashes:
    def __init__(self, buf: np.ndarray):
        power, self.inverse = textscan._powers(len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, U)
        np.cumsum(textscan._BYTE[buf] * power[: len(buf)], out=self.sum[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sum[ends] - self.sum[starts]) * self.inverse[starts]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Runs:
    """Words, each with a blank before it."""

    def __init__(self, words: list[bytes] | tuple[np.ndarray, np.ndarray, np.ndarray]):
        if isinstance(words, list):
            lens = np.fromiter(map(len, words), np.int64, len(words))
            source = np.frombuffer(b"".join(words), np.uint8)
            starts = np.cumsum(lens) - lens
        else:
            source, starts, ends = words
            lens = ends - starts
        buf = np.full(int((lens + 1).sum()), 32, np.uint8)
        self.size = lens + 1
        self.start = np.cumsum(self.size) - self.size
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        buf[inner + np.repeat(self.start + 1, lens)] = source[inner + np.repeat(starts, lens)]
        self.hashes = _Hashes(buf)
        self.n = len(lens)

    def blocks(self, langs: int) -> Iterator[np.ndarray]:
        """Numbers of words, a block at a time, the longest first."""
        order = np.argsort(-self.size, kind="stable")
        step, a = max(256, _BLOCK * 8 // max(8, langs)), 0
        while a < len(order):
            n = step if self.size[order[a]] <= 64 else step // 8  # long ones have more places to carry on
            yield order[a : a + n]
            a += n


class _Part:
    """The places after a + 1 to b bytes of a block's words, by number of bytes and then by word, and the
    pieces that end there.  Places of the last bytes up to a that a piece can reach back to lie before them."""

    def __init__(self, v: Vocabulary, runs: Runs, own: np.ndarray, many: np.ndarray, a: int, b: int):
        self.a, self.b, self.low = a, b, max(0, a + 1 - v.longest)
        self.many = many[self.low : b + 1]  # words that have so many bytes
        self.at = np.concatenate(([0], np.cumsum(self.many)))
        t = np.repeat(np.arange(self.low, b), self.many[:-1])  # a piece begins here
        word = np.arange(len(t)) - np.repeat(self.at[:-2], self.many[:-1])
        first, k, piece = v.matches(runs.hashes, runs.start[own[word]] + t, a + 1 - t, np.minimum(runs.size[own[word]], b) - t)
        end = self.at[t[first] + k - self.low] + word[first]
        order = np.argsort(end, kind="stable")
        self.first, self.end, self.piece = first[order], end[order], piece[order]
        self.bounds = np.searchsorted(self.end, self.at)

    def places(self, t: int) -> slice:
        return slice(self.at[t - self.low], self.at[t - self.low + 1])

    def ending(self, t: int) -> slice:
        """Of the pieces, those that end after t bytes."""
        return slice(self.bounds[t - self.low], self.bounds[t - self.low + 1])

    def forward(self, carried: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Logs of the sums over all segmentations of the bytes before each place; ``carried``: those up to a."""
        out = np.full((self.at[-1], logp.shape[1]), -np.inf)
        out[: len(carried)] = carried
        for t in range(self.a + 1, self.b + 1):
            e = self.ending(t)
            if e.start == e.stop:
                continue
            x = out[self.first[e]] + logp[self.piece[e]]
            end = self.end[e]
            heads = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
            top = np.maximum.reduceat(x, heads)
            top[np.isneginf(top)] = 0
            x = np.exp(x - np.repeat(top, np.diff(np.append(heads, len(end))), axis=0))
            with np.errstate(divide="ignore"):
                out[end[heads]] = top + np.log(np.add.reduceat(x, heads))
        return out

    def carry(self, v: Vocabulary, alpha: np.ndarray) -> np.ndarray:
        """What the next part needs of this one's."""
        return alpha[self.at[max(0, self.b + 1 - v.longest) - self.low] :]


def _parts(runs: Runs, own: np.ndarray, langs: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many of a block's words have at least t bytes, for each t; and (a, b] of t with a bounded number of places."""
    size = runs.size[own]
    many = len(own) - np.searchsorted(size[::-1], np.arange(int(size[0]) + 1))
    total, limit, cuts = np.cumsum(many), _PLACES * 8 // max(8, langs), [0]
    while cuts[-1] < size[0]:
        a = cuts[-1]
        cuts.append(max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1))
    return many, list(zip(cuts, cuts[1:], strict=False))


def word_scores(v: Vocabulary, runs: Runs, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language; ``p`` has scaled probabilities, a row a piece."""
    out = np.empty((runs.n, p.shape[1]))
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    for own in runs.blocks(p.shape[1]):
        size = runs.size[own]
        many, parts = _parts(runs, own, p.shape[1])
        carried = np.zeros((len(own), p.shape[1]))
        for a, b in parts:
            part = _Part(v, runs, own, many, a, b)
            alpha = part.forward(carried, logp)
            done = np.flatnonzero((size > a) & (size <= b))
            out[own[done]] = alpha[part.at[size[done] - part.low] + done]
            carried = part.carry(v, alpha)
    return out - (runs.size * np.log(_SCALE))[:, None]


def expected(v: Vocabulary, runs: Runs, weights: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words seen ``weights`` times, a column a language.

    Of the segmentations that pass a place, the share that comes to it by each piece follows from the forward
    sums alone; the weight of a word flows back from its end by these shares.  Parts are made anew on the way back.
    """
    langs = p.shape[1]
    out = np.zeros((v.n, langs))
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    for own in runs.blocks(langs):
        size = runs.size[own]
        many, parts = _parts(runs, own, langs)
        carried, last = [np.zeros((len(own), langs))], None
        for a, b in parts:
            last = _Part(v, runs, own, many, a, b)
            alpha = last.forward(carried[-1], logp)
            carried.append(last.carry(v, alpha))
        back = np.zeros((0, langs))
        for (a, b), before in zip(parts[::-1], carried[-2::-1], strict=True):
            part = last
            if b < parts[-1][1]:
                part = _Part(v, runs, own, many, a, b)
                alpha = part.forward(before, logp)
            mass = np.zeros_like(alpha)
            mass[len(mass) - len(back) :] = back
            done = np.flatnonzero((size > a) & (size <= b))
            end = part.at[size[done] - part.low] + done
            mass[end] += np.where(np.isneginf(alpha[end]), 0, weights[own[done]])
            flows = np.zeros((len(part.piece), langs))
            for t in range(b, a, -1):
                e = part.ending(t)
                first, end = part.first[e], part.end[e]
                total = alpha[end]
                share = np.exp(alpha[first] + logp[part.piece[e]] - np.where(np.isneginf(total), 0, total))
                flows[e] = mass[end] * share
                mass[first] += flows[e]
            for c in range(langs):
                out[:, c] += np.bincount(part.piece, flows[:, c], v.n)
            back = mass[: len(before)]
    return out


class Model:
    """Languages, their prior and scaled piece probabilities."""

    def __init__(self, path: str, langs: list[str], prior: np.ndarray, p: np.ndarray):
        self.path, self.langs, self.prior, self.p = path, langs, prior, p

    @staticmethod
    def fresh(path: str, langs: list[str], texts: np.ndarray) -> Model:
        """All pieces alike; ``texts``: labelled texts of each language."""
        v = vocabulary(path)
        p = np.full((v.n, len(langs)), 1 / v.n) * _SCALE ** v.lengths[:, None]
        return Model(path, langs, np.log((texts + 1) / (texts + 1).sum()), p)

    def learned(self, count: np.ndarray) -> Model:
        """The M step, from expected counts of pieces; a fiftieth of the mass follows all languages together."""
        every = count.sum(1, keepdims=True) + 0.1
        own = count / np.maximum(count.sum(0), 1e-9)
        p = (0.98 * own + 0.02 * every / every.sum()) * _SCALE ** vocabulary(self.path).lengths[:, None]
        return Model(self.path, self.langs, self.prior, p)

    @staticmethod
    def fit(path: str, words: list[bytes], weights: np.ndarray, langs: list[str], texts: np.ndarray, rounds: int = ROUNDS) -> Model:
        """``weights``: how often each word was seen in each language; ``texts``: labelled texts of each."""
        model, v, runs = Model.fresh(path, langs, texts), vocabulary(path), Runs(words)
        for _ in range(rounds if words else 0):
            model = model.learned(expected(v, runs, weights, model.p))
        return model


def _lowered(column: pa.Array) -> list[bytes]:
    return pc.utf8_lower(column).cast(pa.binary()).to_pylist()


class Scorer:
    """Scores texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.v = model, vocabulary(model.path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.scores = np.empty(0, U), np.empty((0, len(self.model.langs)), np.float32)

    def scores_of(self, texts: list[bytes]) -> np.ndarray:
        """Log probability of each lower-cased text in each language, the prior included."""
        out = []
        for run in chunks(texts, 2 << 20):
            s = Scan(run)
            uniq, first, inverse = np.unique(s.word_hash(), return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, uniq)
            at[at == len(self.known)] = 0
            new = self.known[at] != uniq if len(self.known) else np.ones(len(uniq), bool)
            if new.any():
                runs = Runs((s.buf, s.starts[first[new]], s.ends[first[new]]))
                fresh = word_scores(self.v, runs, self.model.p).astype(np.float32)
                own = np.empty((len(uniq), fresh.shape[1]), np.float32)
                own[new] = fresh
                own[~new] = self.scores[at[~new]]
                if len(self.known) + int(new.sum()) > _KNOWN:
                    self.known, self.scores = uniq, own
                else:
                    known, scores = np.concatenate((self.known, uniq[new])), np.concatenate((self.scores, fresh))
                    order = np.argsort(known)
                    self.known, self.scores = known[order], scores[order]
            else:
                own = self.scores[at]
            total = np.zeros((s.n, len(self.model.langs)))
            full = np.flatnonzero(s.n_words)
            if len(full):
                total[full] = np.add.reduceat(own[inverse].astype(float), s.first[:-1][full], axis=0)
            out.append(total + self.model.prior)
        return np.concatenate(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by language, and texts of each language as the empty word."""
    for b in batches:
        count: dict[tuple[str, bytes], int] = {}
        for lang, text in zip(b.column(0).to_pylist(), _lowered(b.column(1)), strict=True):
            for w in [b"", *text.split()]:
                count[lang, w] = count.get((lang, w), 0) + 1
        if count:
            lang, word = zip(*count, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(count.values(), pa.int64())], names=["lang", "word", "n"])
    settle()


_COUNTS = "piece int, lang int, n long"
#: Expected counts are summed as multiples of this, so that sums don't depend on their order.
_UNIT = 2.0**-32


def _expected(path: str, langs: list[str], shared):
    """The E step over a share of the words: how often each piece is expected in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p, at = vocabulary(path), shared.value, {x: i for i, x in enumerate(langs)}
        total = np.zeros((v.n, len(langs)))
        for b in batches:
            words, inverse = np.unique(np.array(b.column(1).to_pylist(), object), return_inverse=True)
            weights = np.zeros((len(words), len(langs)))
            np.add.at(weights, (inverse, [at[x] for x in b.column(0).to_pylist()]), b.column(2).to_numpy())
            total += expected(v, Runs(list(words)), weights, p)
        n = np.round(total / _UNIT).astype(np.int64)
        piece, lang = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(n[piece, lang], pa.int64())], names=["piece", "lang", "n"])
        settle()

    return run


def train(docs: DataFrame, vocabulary_path: str, max_texts: int = MAX_TEXTS, rounds: int = ROUNDS) -> Model | None:
    """Fit on rows with text and lang that aren't held out; None where there are none.

    Of each language the ``max_texts`` ids with the least hashes are used, each once (of several rows the least
    text).  All words of these texts count; they stay in Spark, and a round of expectation maximisation brings a
    number for each piece and language to the driver, whatever the number of texts and words.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = least_hashes(rows, max_texts, "lang")
    rows = rows.where("text is not null").join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    counts = rows.select("lang", "text").mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    scratch, mark = Scratch(docs.sparkSession), Scratch.mark() - 1
    counts = scratch.table(counts.sortWithinPartitions("word", "lang"))
    texts = {r["lang"]: r["n"] for r in counts.where("word = X''").collect()}  # a row a language
    if not texts:
        Scratch.release(mark)
        return None
    langs = sorted(texts)
    words = counts.where("word <> X''")
    model = Model.fresh(vocabulary_path, langs, np.array([texts[x] for x in langs], float))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model.p)
        found = words.mapInArrow(_expected(vocabulary_path, langs, shared), _COUNTS).groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        count = np.zeros_like(model.p)
        count[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy() * _UNIT
        model = model.learned(count)
        shared.destroy()
    Scratch.release(mark)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior) of each row of ``docs``.

    A null text, or one without a letter, is und with score 0, and so is every text without a model.  Ties go to
    the first language by name.  Only the text is read, whatever other columns there are, and a very long one whole; a
    null id isn't held out; repeated rows and ids score by their own text; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if model is not None else None
        for texts in batches:
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            have = np.flatnonzero([isinstance(t, str) and any(map(str.isalpha, t)) for t in texts])
            if scorer is not None and len(have):
                s = scorer.scores_of(_lowered(pa.array(texts.iloc[have], pa.string())))
                best = s.argmax(1)
                lang[have] = np.array(model.langs, object)[best]
                score[have] = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        settle()

    told = F.pandas_udf(run, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), told("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def identify(docs: DataFrame, vocabulary_path: str, max_texts: int = MAX_TEXTS) -> DataFrame:
    """``predict`` with a model trained on the rows of ``docs`` that aren't held out."""
    return predict(docs, train(docs, vocabulary_path, max_texts))
