"""Rule classification as a plan against the matcher of single lattices, which enumeration checks."""

from __future__ import annotations

import random

import pytest

from restitch.operators import automaton, rules
from restitch.plans import registry

LINES = [
    "import math", "import numpy as np", "from a import b", "for i in range(10):", "for x in items:", "if x == y:", "elif a:", "return a + b", "foo(a, b)", "a.b(c)", "self.f(x)", "else:", "brake",
    "x = 1", "let a = 2", "f x y = x", "continue", "class foo:", "def foo(a, b):", "while x:", "assert y", "del z", "raise e", "pass", "12", "", "not x", "global a", "\u00e9a = \u00fc", "true", "falze",
]


def lattices(n: int) -> list:
    rng = random.Random(n)
    out = []
    for k in range(n):
        line = list(LINES[k % len(LINES)])
        for _ in range(rng.randrange(4)):
            if line:
                line[rng.randrange(len(line))] = rng.choice("abcxyz1:( \u00e9")
        if line and rng.random() < 0.3:
            line.pop(rng.randrange(len(line)))
        out.append([list(dict.fromkeys([c] + [rng.choice("abc(:1r\u00e9") for _ in range(rng.randrange(4))])) if rng.random() < 0.25 else [c] for c in line])
    return [*out, [["a", "b", "c"]] * 14 + [["="]], [["a", "b", "c", "d"]] * 30, [["x"]] * 3000]


@pytest.mark.parametrize(("language", "level"), [("python3", "line"), ("python3", "expr"), ("haskell", "line")])
def test_classified_like_single_lattices(spark, language, level):
    lats = lattices(250)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(lats)], "i int, cand array<array<string>>")
    got = {r.i: r.match for r in automaton.classified(df, language, level).collect()}
    own = rules.rules(language, level)
    for i, lat in enumerate(lats):
        m = rules.classify(lat, own)
        assert (got[i] and tuple(got[i])) == (m and (m.rule.number, m.rule.template, m.errors, m.number, m.text)), lat


def test_unreadable_lattices(spark):
    rows = [(1, None), (2, []), (3, [["a"], []]), (4, [["a"], None]), (5, [["p"], ["a"], ["s"], ["s"]]), (5, [["p"], ["a"], ["s"], ["s"]])]
    df = spark.createDataFrame(rows, "i int, cand array<array<string>>").selectExpr("*", "1 as _best", "2 as _c")
    got = sorted((r.i, r.match and (r.match.template, r.match.text)) for r in automaton.classified(df).collect() if r.i != 3 and r.i != 4)
    assert got == [(1, None), (2, ("(.*)", "")), (5, ("pass", "pass")), (5, ("pass", "pass"))]
    assert all(r.match is None for r in automaton.classified(df).where("i in (3, 4)").collect())
    assert automaton.classified(df.limit(0)).count() == 0


def test_templates_that_do_not_fit():
    rule = rules.compiled((("a" * 80, 1, "x"),))
    with pytest.raises(ValueError, match="at most"):
        automaton.packed(rule)
    with pytest.raises(ValueError, match="between two groups"):
        automaton.packed(rules.compiled((("(.*)(PARAMETERS)", 1, "x"),)))


def test_no_python_workers_and_every_rule(spark, sf_dir):
    df = registry.fuzzy_rule_class(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
    assert {r.rule for r in df.select("rule").distinct().collect()} == set(range(len(rules.PYTHON_LINES)))
