"""Decontamination against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from restitch.llm import decontamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size=10):
    wanted: dict = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), size)
        for s in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for s in range(len(w)):
            for n in {len(k) for k in wanted}:
                found = wanted.get(tuple(w[s : s + n])) if s + n <= len(w) else None
                if found:
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(spark, docs, items, size=10):
    return sorted(map(tuple, decontamination.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), size).collect()), key=repr)


def made(seed, vocabulary=12, n_docs=60):
    """Few words, so that windows overlap, repeat and share terms."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("ABCDEFGH") + f"w{rng.randrange(vocabulary)}" * rng.randrange(1, 3) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 9, 10, 11, 30]))) for i in range(12)]
    docs = []
    for i in range(n_docs):
        text = say(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w))
            text += " " + "-".join(w[a : a + rng.randrange(1, 25)]) + ", " + say(rng.randrange(5))
        docs.append((i, text))
    return docs, items


@pytest.mark.parametrize(("seed", "size"), [(1, 10), (2, 10), (3, 3), (4, 1)])
def test_like_plain_windows(spark, seed, size):
    docs, items = made(seed)
    assert got(spark, docs, items, size) == brute(docs, items, size)


def test_larger_tables_are_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs, items = made(5)
    assert got(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    ten = "a b c d e f g h i j"
    items = [(1, ten), (1, ten), (1, "x y"), (2, ten + " k"), (None, "lone"), (3, None), (4, ""), (5, "... !!"), (6, "the the the"), (7, "éÉ 日本")]
    docs = [(1, ten), (1, ten), (1, "A-B_c D\u0000e f;g h i J k"), (None, None), (None, "lone lone"), (2, ""), (3, "the the the the"), (4, "éÉ 日本"), (5, "éé 日本"), (6, "x, Y"), (7, f"{ten} {ten} x")]
    docs += [(9, "z " * 50_000 + ten + " z" * 50_000), (10, "the " * 20_000)]
    assert got(spark, docs, items) == brute(docs, items)


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"q{i} {passage} r{i}" if i % 2 else f"s{i} t") for i in range(300)] + [(1, f"q1 {passage} r1")] * 50
    items = [(1, passage), (2, "p0 " + passage), (3, "s2")]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = made(6, n_docs=10)
    assert got(spark, [], items) == [] and got(spark, docs, []) == brute(docs, [])
    more = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as a", "2 as b", "3 as term", "4 as place", "5 as `w.x`", "6 as n_words", "7 as item_id")
    test = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as doc_id", "2 as item", "3 as name", "4 as place", "5 as n")
    assert sorted(map(tuple, decontamination.contamination(more, test).collect()), key=repr) == brute(docs, items)


def test_phrases_and_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"x {item} y"), (2, "one two three four five moved six seven eight nine ten eleven"), (3, "one three two four five six seven eight nine ten"), (4, "ten nine eight seven six five four three two one")]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, item)], ITEMS)
    runs = {(r.item_id, r.doc_start, r.item_start, r.length) for r in decontamination.phrases(d, t).collect()}
    assert runs == {("5", 2, 0, 11)}
    number = {(r.a, r.b): r.doc_id for r in d.selectExpr("doc_id", "xxhash64(doc_id, text) a", "xxhash64(1, text, 2, doc_id) b").collect()}
    near = {(number[r.a, r.b], r.item_start, r.exact) for r in decontamination.proximity(d, t, slop=1).collect()}
    assert near >= {(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, False), (3, 0, False)} and all(i != 4 for i, *_ in near)
    assert {(number[r.a, r.b], r.item_start) for r in decontamination.proximity(d, t, slop=0).collect()} == {(1, 0), (1, 1)}


def test_no_python_workers(spark):
    docs, items = made(7)
    plan = decontamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
