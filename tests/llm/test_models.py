"""Language ID and the quality classifier: brute force on small cases, held-out accuracy on the tables."""

from __future__ import annotations

import math
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from restitch.llm import langid, quality_knn, sample
from tests.llm.test_core import clashing, frame, odd_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"


def whole_score(word: bytes, pieces: dict[bytes, float]) -> float:
    """The log of the sum over all segmentations of a word with a blank before it; nothing is cut or left out."""
    word, longest = b" " + word, max(map(len, pieces))
    alpha = [0.0]
    for t in range(1, len(word) + 1):
        x = [alpha[t - k] + math.log(pieces[word[t - k : t]]) for k in range(1, min(t, longest) + 1) if word[t - k : t] in pieces]
        alpha.append(max(x) + math.log(sum(math.exp(y - max(x)) for y in x)))
    return alpha[-1]


def test_forward_sums_all_segmentations():
    v = langid.vocabulary(RANKS)
    pieces = sorted(langid.read_ranks(RANKS))
    p = np.random.default_rng(0).random((v.n, 2))
    p /= p.sum(0)
    words = [b"the", b"a", "über".encode(), b"x" * 60, b"information", b"\xff\xfe", b"of"]
    got = langid.word_scores(v, langid.Runs(words), p * langid._SCALE ** v.lengths[:, None])
    for c in range(2):
        own = dict(zip(pieces, p[:, c], strict=True))
        assert np.allclose(got[:, c], [whole_score(w, own) for w in words])


def test_expected_counts_are_those_of_all_segmentations():
    v = langid.vocabulary(RANKS)
    p = np.full((v.n, 1), 1 / v.n) * langid._SCALE ** v.lengths[:, None]
    count = langid.expected(v, langid.Runs([b"the", b"cat"]), np.array([[2.0], [3.0]]), p)
    assert np.isclose((count[:, 0] * v.lengths).sum(), 2 * 4 + 3 * 4)


def test_scores_do_not_depend_on_the_cache(monkeypatch):
    model = langid.Model.fit(RANKS, [b"the", b"der", b"und"], np.array([[9.0, 0], [0, 9], [0, 9]]), ["en", "de"], np.array([1.0, 1]))
    texts = [b"the und the", b"", b"der der", b"other words the"] * 3
    want = langid.Scorer(model).scores_of(texts)
    monkeypatch.setattr(langid, "_KNOWN", 2)
    own = langid.Scorer(model)
    assert np.allclose(np.concatenate([own.scores_of([t]) for t in texts]), want)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, RANKS).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(out) > 200 and np.mean(out) > 0.97


def test_trained_in_spark_as_in_memory(spark):
    """All words of the sampled texts count, however rare; an id counts once."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'xy'[i % 2]}{rng.integers(3000)}" for _ in range(40)) for i in range(60)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [(0, texts[0] + " z", "a")] * 5 + [(70, None, "a"), (None, "x1", "a"), (71, "x1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    used = [r for r in rows[:60] if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    words = sorted({w for _, t, _ in used for w in t.split()})
    weights = np.array([[sum(t.split().count(w) for _, t, x in used if x == lang) for lang in "ab"] for w in words], float)
    want = langid.Model.fit(RANKS, [w.encode() for w in words], weights, ["a", "b"], np.array([sum(x == lang for *_, x in used) for lang in "ab"], float))
    got = langid.train(docs, RANKS)
    assert got.langs == want.langs and np.allclose(got.p, want.p, rtol=1e-4, atol=1e-9) and np.allclose(got.prior, want.prior)
    few = langid.train(docs, RANKS, max_texts=5)
    assert np.allclose(np.exp(few.prior), [0.5, 0.5])


def test_samples(spark):
    rows = spark.range(20_000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "case when id < 300 then 'rare' else 'often' end as lang")
    got = sample.least_hashes(rows, 500)
    again = sample.least_hashes(rows.repartition(7), 500)
    assert got.count() == 500 == got.distinct().count() and got.exceptAll(again).count() == 0
    by = {r["lang"]: r["count"] for r in sample.least_hashes(rows, 400, "lang").groupBy("lang").count().collect()}
    assert by["often"] == 400 and by["rare"] == 200
    nothing = spark.createDataFrame([(None, None)], "doc_id long, lang string")
    assert sample.least_hashes(nothing, 5).count() == 0 == sample.least_hashes(nothing, 5, "lang").count()


def test_odd_texts_and_no_languages(spark):
    rows = list(enumerate([*odd_texts(), "123 456 !", "١٢", "½ ² Ⅷ"]))
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in langid.identify(docs, RANKS).collect()}
    assert len(got) == len(rows) and {r.lang_pred for r in got.values()} == {"und"}
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    got = {r.doc_id: r for r in langid.identify(docs, RANKS).collect()}
    letters = {i: bool(t) and any(c.isalpha() for c in t) for i, t in rows}
    assert all((got[i].lang_pred == "und") == (not letters[i]) for i, _ in rows)
    assert langid.identify(frame(spark, []), RANKS).count() == 0


def test_votes_like_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'ab'[i % 2]}{rng.integers(40)}" for _ in range(30)).encode() for i in range(120)]
    labels = np.array([i % 2 for i in range(120)])
    model = quality_knn.Model.fit(np.concatenate([quality_knn.raw_vectors([t]) for t in texts[:100]]), labels[:100])
    got = model.score(texts[100:] + [b""])
    for t, s in zip(texts[100:], got, strict=False):
        v = (quality_knn.raw_vectors([t])[0] * model.weights) @ model.basis
        cosine = model.voters @ (v / np.linalg.norm(v))
        near = np.argsort(-np.round(cosine, quality_knn.DIGITS), kind="stable")[: quality_knn.NEIGHBOURS]
        w = np.maximum(cosine[near], 0).astype(float) ** quality_knn.POWER
        assert abs(s - (w * model.labels[near]).sum() / w.sum()) < 1e-4
    assert ((got[:20] > 0.5) == labels[100:]).mean() > 0.9 and abs(got[20] - 0.5) < 1e-6


def test_voters_alike_at_the_last_place():
    rng = np.random.default_rng(3)
    for k in (1, 5, 24):
        cosine = np.round(rng.random((200, 60)), rng.integers(1, 3)).astype(np.float32)
        want = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        assert (np.sort(quality_knn.nearest(cosine, k), 1) == np.sort(want, 1)).all()
    copies = [b"one two three four"] * 40 + [b"five six seven"] * 10
    labels = np.array([k < 10 for k in range(50)]).astype(int)
    model = quality_knn.Model.fit(quality_knn.raw_vectors(copies), labels)
    assert abs(model.score([b"one two three four"])[0] - 10 / 24) < 1e-3


def test_quality_of_long_texts_and_other_columns(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, f"{'good clear words' if i % 2 else '$$ ## buy!!'} {i} " * 20) for i in range(60)]
    rows += [(1000, "good clear words " * 200_000), (1001, "$$ ## buy!! " * 200_000), (1002, "x" * 2_000_000)]
    plain = frame(spark, rows)
    whole = {r.doc_id: r for r in quality_knn.classify(plain, labels).collect()}
    assert len(whole) == len(rows) and whole[1000].predicted == 1 and whole[1001].predicted == 0
    assert quality_knn.classify(clashing(plain), labels).exceptAll(quality_knn.classify(plain, labels)).count() == 0


def test_languages_with_other_columns(spark):
    rows = spark.createDataFrame([(i, f"{'the cat and the dog' if i % 2 else 'der Hund und die Katze'} {i}", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.identify(clashing(rows), RANKS).exceptAll(langid.identify(rows, RANKS)).count() == 0


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_knn.classify(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    out = got.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.93


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_knn.classify(frame(spark, [(1, None), (1, "x")]), empty).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality_knn.classify(frame(spark, [(2, "good words"), (7, ""), (None, None)]), one).collect()}
    assert set(got.values()) == {1.0}
    assert quality_knn.classify(frame(spark, []), one).count() == 0


LONG = [b"the", b"internationalization", "превосходительство".encode(), "これは日本語の文章です".encode() * 40, b"=" * 300, b"ab" * 3000, b"-" * 64, b"a"]


def test_long_words_and_pieces_are_scored_whole(monkeypatch):
    v = langid.vocabulary(RANKS)
    assert v.n == len(langid.read_ranks(RANKS)) and v.longest == 128
    p = np.random.default_rng(3).random((v.n, 2)) ** 4 + 1e-9
    p /= p.sum(0)
    want = [[whole_score(w, dict(zip(sorted(langid.read_ranks(RANKS)), p[:, c], strict=True))) for c in range(2)] for w in LONG]
    scaled = p * langid._SCALE ** v.lengths[:, None]
    assert np.allclose(langid.word_scores(v, langid.Runs(LONG), scaled), want, rtol=1e-9)
    weights = np.arange(1.0, 2 * len(LONG) + 1).reshape(-1, 2)
    count = langid.expected(v, langid.Runs(LONG), weights, scaled)
    assert np.allclose((count * v.lengths[:, None]).sum(0), [sum(w[c] * (len(x) + 1) for w, x in zip(weights, LONG, strict=True)) for c in range(2)])
    monkeypatch.setattr(langid, "_PLACES", 150)
    assert np.allclose(langid.word_scores(v, langid.Runs(LONG), scaled), want, rtol=1e-9)
    assert np.allclose(langid.expected(v, langid.Runs(LONG), weights, scaled), count)


def test_expected_counts_like_the_change_of_the_sum():
    v = langid.vocabulary(RANKS)
    numbers = {t: i for i, t in enumerate(sorted(langid.read_ranks(RANKS)))}
    p = np.random.default_rng(4).random((v.n, 1)) * langid._SCALE ** v.lengths[:, None]
    runs = langid.Runs([b"international" * 3, b"information"])
    count = langid.expected(v, runs, np.ones((2, 1)), p)
    for t in (b"international", b" inter", b"information", b"a"):
        more = p.copy()
        more[numbers[t]] *= 1 + 1e-6
        change = (langid.word_scores(v, runs, more) - langid.word_scores(v, runs, p)).sum() / 1e-6
        assert np.isclose(count[numbers[t], 0], change, rtol=1e-3, atol=1e-6)
