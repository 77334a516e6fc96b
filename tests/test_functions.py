"""Scalar and lattice columns against plain Python."""

from __future__ import annotations

import itertools
import math
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from restitch.functions import lattice, text
from restitch.operators import rules


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, up = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
    return row[-1]


def test_accuracy(spark):
    cases = [("abc", "abc"), ("a b\tc", "abd"), ("", "ab"), ("é", "e"), ("日本", "日"), ("x" * 7, "x" * 9), ("abcdefgh", "a")]
    rows = spark.createDataFrame(cases, "a string, b string").select("a", "b", text.accuracy(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        a, b = "".join(r.a.split()), "".join(r.b.split())
        assert r.x == round(100 - edits(a, b) * 100 / len(b))
    assert one(spark, text.accuracy(F.col("a"), F.col("b")), a="x", b=" \n") is None


def test_naive_fix_and_templates(spark):
    assert one(spark, text.naive_fix(F.col("a")), a="--x-- '' ,, '''") == '__x__ " " "\''
    assert one(spark, text.fill_template(F.col("a"), F.col("b")), a="{}\nf({x})", b="{1: 2}") == "{1: 2}\nf({x})"
    assert one(spark, text.indented(F.col("a"), F.lit(2)), a="x") == "    x"


def test_literals(spark):
    words = ["true", "tru", "fa1se", "flse", "none", "non", "nonsense", "truth"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.restore_literal(F.col("w")).alias("x")).collect()
    want = lambda w: "True" if edits(w, "true") <= 1 else "False" if edits(w, "false") <= 2 else "None" if edits(w, "none") <= 1 else w
    assert [r.x for r in rows] == [want(r.w) for r in rows]


def test_split_args(spark):
    cases = {"": [], "  ": [], "a": ["a"], " a , b(c, d) ,(e,(f, g))": ["a", "b(c, d)", "(e,(f, g))"], "a,": ["a", ""], ",": ["", ""]}
    rows = spark.createDataFrame([(c,) for c in cases], "a string").select("a", text.split_args(F.col("a")).alias("x")).collect()
    assert {r.a: r.x for r in rows} == cases


def test_haskell_reports(spark):
    err = "Main.hs:3:14: error:\n    Not in scope: x\r\nOther.hs:10:1: warning: unused\nnothing"
    got = one(spark, text.haskell_reports(F.col("a")), a=err)
    assert [tuple(r) for r in got] == [(3, 14, "error", "Not in scope: x"), (10, 1, "warning", "unused")]
    assert one(spark, text.haskell_reports(F.col("a")), a="") == []


def test_candidates(spark):
    scores = [[1.0, 3.0, 3.0, -2.0], [0.0, 0.0, 0.0, 0.0], [5.0, 1.0, 4.9, 0.0]]
    points = F.array(*[F.lit(ord(c)) for c in "Aab?"])
    rows = spark.createDataFrame([(s,) for s in scores], "s array<double>").select(
        lattice.softmax(F.col("s")).alias("p")
    ).select("p", lattice.candidates(F.col("p"), points).alias("c"), lattice.top_char(F.col("p"), points).alias("t")).collect()
    for s, r in zip(scores, rows, strict=True):
        total = sum(map(math.exp, s))
        order = sorted(range(4), key=lambda i: (-r.p[i], -i))
        want = list(dict.fromkeys("Aab?"[i].lower() for i in order if math.exp(s[i]) / total > 0.025))
        assert r.c == want and r.t == "Aab?"[order[0]]


def brute_readings(lat):
    return ["".join(reversed(x)) for x in itertools.product(*reversed(lat))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc1"), min_size=1, max_size=4), max_size=6))
def test_python_readings(lat):
    kept = rules.capped(lat)
    assert kept == [c[:3] for c in lat]
    assert [rules.reading(kept, i) for i in range(math.prod(map(len, kept)))] == brute_readings(kept)


def test_cap_from_the_left():
    lat = [["a", "b", "c", "d"]] * 13 + [["x"]]
    kept = rules.capped(lat)
    assert [len(c) for c in kept] == [1, 1, 1] + [3] * 10 + [1] and math.prod(map(len, kept)) == 59_049


def test_lattice_columns(spark):
    lats = [[], [["a"]], [["a", "b"], ["c"], ["d", "e", "f", "g"]], [["a", "b", "c", "d"]] * 13]
    df = spark.createDataFrame([(x,) for x in lats], "c array<array<string>>")
    rows = df.select("c", lattice.capped(F.col("c")).alias("k"), lattice.reading_count(F.col("c")).alias("n"), lattice.ambiguous_places(F.col("c")).alias("m")).collect()
    for r in rows:
        assert r.k == rules.capped(r.c)
        assert r.n == math.prod(min(len(c), 3) for c in r.c) and r.m == sum(len(c) > 1 for c in r.c)
    small = df.where("size(c) < 5").select("c", lattice.readings(lattice.capped(F.col("c"))).alias("r")).collect()
    assert all(r.r == brute_readings(rules.capped(r.c)) for r in small)
    one = spark.createDataFrame([(i, x) for i, x in enumerate([[["a"], []], None, *lats])], "i int, c array<array<string>>")
    told: dict = {}
    for r in lattice.with_readings(one, "c", "no", "text").collect():
        told.setdefault(r.i, {})[r.no] = r.text
    assert set(told) == {2, 3, 4, 5}
    for i, x in enumerate(lats, 2):
        want = brute_readings(rules.capped(x))
        assert told[i] == dict(enumerate(want))
    words = spark.createDataFrame([([[["a"], ["b", "c"]], [["d"]]],)], "w array<array<array<string>>>")
    assert words.select(lattice.join_words(F.col("w")).alias("x")).first().x == [["a"], ["b", "c"], [" "], ["d"]]


def test_scaled_pixels(spark):
    got = spark.createDataFrame([([0, 51, 255],)], "p array<int>").select(lattice.scaled_pixels(F.col("p")).alias("x")).first().x
    assert [round(v, 6) for v in got] == [0, 0.2, 1]


def test_many_arguments(spark):
    """Cut in time proportional to their number; what nests deeper than one pass goes the other way."""
    texts = ["f(a, b), " * 40_000 + "x", "a," * 200_000, "((((((((a, b)))))))), c", "(a, b", "a), b, c", "f(g(h(i(j(k(1, 2), 3)))), 4), (5, 6)", "(" * 3000 + ")" * 3000 + ",a"]
    df = spark.createDataFrame(enumerate(texts), "i int, t string")
    start = time.time()
    got = {r.i: r.a for r in df.select("i", text.split_args(F.col("t")).alias("a")).collect()}
    assert time.time() - start < 30
    assert len(got[0]) == 40_001 and got[0][0] == "f(a, b)" and got[0][-1] == "x" and len(got[1]) == 200_001
    assert got[2] == ["((((((((a, b))))))))", "c"] and got[3] == ["(a, b"] and got[4] == ["a), b, c"] and got[5] == ["f(g(h(i(j(k(1, 2), 3)))), 4)", "(5, 6)"]
    assert got[6] == ["(" * 3000 + ")" * 3000, "a"]
