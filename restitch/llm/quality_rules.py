"""Quality rules: text statistics and a decision list learned from labels by sequential covering.

The list is a sequence of conjunctions of thresholds on ratios of the statistics.  Each conjunction is grown on
two thirds of the labelled rows by the gain in information about the rejected class, pruned on the last third,
and added while its precision there holds; rows that it covers leave the training set.  The list is emitted as
ordered conditional SQL expressions over the statistics, so that verdicts are computed inside Spark's codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.llm.sample import least_hashes
from restitch.llm.session import quoted
from restitch.llm.textscan import Scan, chunks, mix, windows

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_stops", "n_bars", "n_bangs"]
#: Ratios on which thresholds are set, as SQL over the statistics (never a division by zero).
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
#: At most so many labelled rows, chosen by a hash of their id, train the list.
MAX_TRAIN = 20_000


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(b"0123456789")
_STOP, _BAR, _BANG = _flags(b".?"), _flags(b"|"), _flags(b"!")
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def scan_stats(texts: list[bytes]) -> np.ndarray:
    """A row of STATS for each text."""
    s = Scan(texts)
    buf, n = s.buf, s.n
    out = {"n_words": s.n_words, "word_chars": s.per_doc(_LEAD[buf] & ~s.space)}
    for name, flag in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_stops", _STOP), ("n_bars", _BAR), ("n_bangs", _BANG)):
        out[name] = s.per_doc(flag[buf])
    out["n_chars"] = s.per_doc(_LEAD[buf]) - 1  # the separator
    # lines
    feeds = np.flatnonzero(buf == 10)
    start, end = np.concatenate(([0], feeds[:-1] + 1)), feeds
    word_bytes = np.concatenate(([0], np.cumsum(~s.space)))
    full = word_bytes[end] > word_bytes[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(s.doc_start, start, "right") - 1
    _, at = np.unique(s.span_hash(start, end) ^ mix(doc), return_index=True)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[at], minlength=n)
    # words in windows of three that occur again
    out["n_repeat_words"] = np.zeros(n, np.int64)
    three = windows(s.word_hash(), 3)
    inside = np.flatnonzero(s.doc_of_word[:-2] == s.doc_of_word[2:]) if len(three) else np.empty(0, np.int64)
    if len(inside):
        key = three[inside] ^ mix(s.doc_of_word[inside])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        hit = np.zeros(len(s.starts), bool)
        for i in range(3):
            hit[inside[again] + i] = True
        out["n_repeat_words"] = np.bincount(s.doc_of_word[hit], minlength=n)
    return np.column_stack([out[k] for k in STATS]).astype(np.int64)


@F.pandas_udf(T.StructType([T.StructField(k, T.LongType()) for k in STATS]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    parts = [scan_stats(run) for run in chunks(texts)]
    return pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, len(STATS)), np.int64), columns=STATS)


def stats(text: Column) -> Column:
    """A struct of STATS of a string column; a null text has no words, lines or characters."""
    return _stats(F.coalesce(text, F.lit("")).cast("binary"))


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return F.expr(f"{n_words} < 50 or 100 * {n_repeat_words} > 50 * {n_words}")


@dataclass(frozen=True)
class Rule:
    """Reject a document for which all (feature, is_upper_bound, threshold) conditions hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def sql(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'<=' if low else '>='} {t!r}D" for f, low, t in self.conditions)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, low, t in self.conditions:
            out &= x[f] <= t if low else x[f] >= t
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_covered: int = 3, max_conditions: int = 4) -> list[Rule]:
    """Sequential covering.  ``x``: feature values, ``bad``: True for rows that the list should reject."""
    x = {k: np.asarray(v, float) for k, v in x.items()}
    bad, rules, turn = np.asarray(bad, bool), [], 0
    left = np.ones(len(bad), bool)
    if not bad.any() or bad.all():
        return []
    third = np.arange(len(bad)) % 3
    while (bad & left).sum() >= min_covered:
        prune = left & (third == turn % 3)
        rule = _prune(_grow(x, bad, left & ~prune, max_conditions), x, bad, prune)
        hit = rule.covers(x) & left if rule.conditions else np.zeros(len(bad), bool)
        ok = hit.sum() >= min_covered and bad[hit].mean() >= min_precision and (not (hit & prune).any() or bad[hit & prune].mean() >= min_precision)
        if ok:
            rules.append(rule)
            left &= ~hit
        turn += 1
        if not ok and turn >= 3 + len(rules):
            break
    return rules


def _grow(x: dict, bad: np.ndarray, rows: np.ndarray, most: int) -> Rule:
    conditions: list[tuple[str, bool, float]] = []
    rows = np.flatnonzero(rows)
    while len(conditions) < most and len(rows):
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, v in x.items():
            order = rows[np.argsort(v[rows], kind="stable")]
            value, pos = v[order], np.cumsum(bad[order])
            cut = np.flatnonzero(value[1:] > value[:-1])
            p, n = pos[cut], cut + 1 - pos[cut]
            for low, p, n in ((True, p, n), (False, p0 - p, n0 - n)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1)
                if len(gain) and gain[i := int(gain.argmax())] > best[0]:
                    best = (gain[i], (f, low, float((value[cut[i]] + value[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        f, low, t = best[1]
        conditions.append(best[1])
        rows = rows[x[f][rows] <= t if low else x[f][rows] >= t]
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: dict, bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Drop last conditions while that raises (p - n) / (p + n) on the pruning rows."""

    def worth(r: Rule) -> float:
        hit = r.covers(x) & rows
        return (2 * bad[hit].mean() - 1) if hit.any() else -1.0

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        if worth(shorter := Rule(rule.conditions[:k])) > worth(best):
            best = shorter
    return best


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[Rule]:
    """The decision list for ``labels.quality`` (1 keeps, 0 rejects; nulls are ignored).

    ``max_train`` bounds the labelled ids used: they are those with the least hash.  An id counts once, with its
    largest label and, of several rows, the least text.  Features (ten numbers an id) are all that reaches the driver.
    """
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    named = labels.join(F.broadcast(least_hashes(labels, max_train)), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "quality", stats(F.col("text")).alias("s")).select("doc_id", "quality", "s.*")
    got = rows.select("doc_id", "quality", base_failed().alias("failed"), *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]).toPandas()
    # not a filter in Spark: that would be pushed below the join, and statistics made of every document
    got = got[~got["failed"].astype(bool)].sort_values(["doc_id", *FEATURES], kind="stable")
    return learn({k: got[k].to_numpy() for k in FEATURES}, got["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """True where the ordered rules keep a row: the first rule that holds rejects it, else it is kept."""
    out = F
    for r in rules:
        out = out.when(F.expr(r.sql()), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judge(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, STATS, base_failed and kept for every row of ``docs``.

    A null or empty text has no words and fails the base; a very long one is measured whole.  Repeated rows and ids
    are judged by their own text; without labels, or with labels of one class only, the list is empty and the base
    alone decides.  Other columns, whatever their names, are ignored.
    """
    rules = train(docs, labels, max_train)
    rows = docs.select("doc_id", stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever their names."""
    rules = train(docs, labels, max_train)
    rows = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), stats(F.col("text")).alias("s")).select("row", "s.*")
    return rows.where(~base_failed() & verdict(rules)).select("row.*")
