"""Rules, dictionaries and repair against enumeration and plain Python."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from restitch.functions import lattice
from restitch.operators import dictionary, ordered, repair, rules
from restitch.operators.diagnostics import diagnose
from restitch.plans import registry
from tests.test_functions import brute_readings, edits


def brute_nearest(lat, terms):
    best, term = 0.25, None
    for r in brute_readings(rules.capped(lat)):
        for t in terms:
            d = edits(r, t) / (len(t) or 1)
            if d < best:
                best, term = d, t
    return (rules.reading(rules.capped(lat), 0), 0.25) if term is None else (term, best)


def test_nearest_like_enumeration():
    rng = random.Random(1)
    terms = ["print", "range", "sorted", "len", "isinstance", "enumerate", "abs", "frozenset", "printer"]
    for _ in range(400):
        word = rng.choice(terms)
        lat = [list(dict.fromkeys([rng.choice("abcdeilnoprst"), c])) if rng.random() < 0.3 else [c] for c in word]
        if rng.random() < 0.4:
            lat.pop(rng.randrange(len(lat)))
        assert rules.nearest(lat, terms) == brute_nearest(lat, terms)
    assert rules.nearest([], ["abc"]) == ("", 0.25) and rules.nearest([["a"], ["b"]], []) == ("ab", 0.25)


def brute_classify(lat, own):
    best, chosen = None, None
    for rule in own:
        for number, r in enumerate(brute_readings(rules.capped(lat))):
            m = rule.pattern.match(r)
            if m:
                told = (sum(m.fuzzy_counts) - rule.budget, rule.rank, number)
                if best is None or told < best:
                    best, chosen = told, rule
    return None if chosen is None else (chosen.number, best[0] + chosen.budget, best[2])


@pytest.mark.parametrize("language", ["python3", "haskell"])
def test_classify_like_enumeration(language):
    rng = random.Random(3)
    lines = ["import math", "for i in range(10):", "if x == y:", "return a + b", "foo(a, b)", "a.b(c)", "self.f(x)", "else:", "brake", "x = 1", "let a = 2", "f x y = x", "continue", "class foo:", "from a import b", "12", "", "not x", "global a"]
    own = rules.rules(language)
    for _ in range(150):
        line = list(rng.choice(lines))
        for _ in range(rng.randrange(3)):
            if line:
                line[rng.randrange(len(line))] = rng.choice("abcxyz1:( ")
        lat = [[c, rng.choice("abc(:1")] if rng.random() < 0.08 else [c] for c in line]
        lat = [list(dict.fromkeys(c)) for c in lat]
        got = rules.classify(lat, own)
        want = brute_classify(lat, own)
        assert (got and (got.rule.number, got.errors, got.number)) == want, lat


def test_rule_ranks_and_budgets():
    own = rules.rules("python3")
    assert [r.budget for r in own] == sorted((r.budget for r in own), reverse=True)
    assert {r.template: r.budget for r in own}["pass"] == 1 and own[-1].template == "(.*)" and own[-1].budget == 0
    with pytest.raises(ValueError, match="no candidate"):
        rules.classify([["a"], []], own)


@pytest.mark.parametrize("pieces", [False, True])
def test_dictionary_join_like_brute_force(spark, pieces):
    rng = random.Random(4)
    terms = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    tokens = [None, "", *terms[:20]]
    for t in terms:
        w = list(t)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("abcdex")
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), "z")
        tokens.append("".join(w))
    td = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, ord int")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id int, token string")
    got = {r.id: (r.repaired, round(r.ratio, 9)) for r in dictionary.repair(rows, "token", td, pieces=pieces).collect()}
    for i, t in enumerate(tokens):
        best = min(((edits(t, x) / len(x), k, x) for k, x in enumerate(terms) if edits(t, x) / len(x) < 0.25), default=None) if t is not None else None
        assert got[i] == ((best[2], round(best[0], 9)) if best else (t, 0.25))


@pytest.mark.parametrize("pieces", [False, True])
def test_lattice_join_like_brute_force(spark, pieces):
    rng = random.Random(6)
    terms = ["".join(rng.choice("abcd\u00e9") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    lats = [[], [["a"]], *[[[c] for c in t] for t in terms[:10]]]
    for t in terms * 2:
        w = list(t)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abcdex")
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), "z")
        lats.append([list(dict.fromkeys([rng.choice("abcdez\u00e9"), c, rng.choice("abx")])) if rng.random() < 0.3 else [c] for c in w])
    td = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, ord int")
    rows = spark.createDataFrame([*enumerate(lats), (-1, None)], "id int, cand array<array<string>>")
    got = {r.id: (r.term, round(r.ratio, 9)) for r in dictionary.nearest_readings(rows, "cand", td, pieces).collect()}
    assert got.pop(-1) == (None, 0.25)
    for i, lat in enumerate(lats):
        term, ratio = rules.nearest(lat, terms)
        assert got[i] == (term, round(ratio, 9)), lat


def test_large_lattice_dictionary_is_met_by_pieces(spark):
    """40,000 terms and lattices: pairs that share a length alone would be hundreds of millions."""
    n = 40_000
    word = F.substring(F.md5(F.col("id").cast("string")), 1, 12)
    terms = spark.range(n).select(word.alias("term"), F.col("id").cast("int").alias("ord"))
    rows = spark.range(n).select("id", word.alias("w")).withColumn("noisy", F.overlay("w", F.lit("x"), (F.col("id") % 12 + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("cand", lattice.spell(F.col("noisy"), {"0": ["0", "o"], "x": ["x", "y"]}))
    found = dictionary.nearest_readings(rows, "cand", terms)
    assert found.where("term = w and abs(ratio - 1 / 12D) < 1e-9").count() == n


def test_dictionary_plan_has_no_nested_loop(spark):
    td = spark.createDataFrame([("alpha", 0), ("beta", 1)], "term string, ord int")
    rows = spark.createDataFrame([("alpga",), ("beto",)], "token string")
    plan = dictionary.repair(rows, "token", td, pieces=False)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def program(spark, code, noise=None):
    lines = [(1, k, (len(x) - len(x.lstrip())) // 2, x.strip()) for k, x in enumerate(code.split("\n"))]
    df = spark.createDataFrame(lines, "doc_id long, line_no int, indent int, line string")
    return df.withColumn("cand", lattice.spell(F.col("line"), noise or {"~": ["~"]}))


GOLDEN = [
    "def fib(n):\n  if n == 1:\n    return 1\n  return fib(n-1) + fib(n-2)",
    "class foo:\n  def bar(self):\n    pass\nfoo = foo()\nfoo.bar()",
    "def test(k):\n  for k in range(k):\n    print(k)\ntest(10)",
    "if true:\n  print(6)\nelse:\n  print(5)",
    "import os\ndef main():\n  print(os)\nmain()",
    "def add(x,y):\n  return x+y\nprint(add(1,3))",
]


def test_corrupted_programs_are_repaired(spark):
    """Three in a hundred characters misread: the repaired text is nearer to the golden one, and above the gate of 80 %."""
    rng = random.Random(5)
    total = fixed = length = 0
    for code in GOLDEN * 3:
        bad = "\n".join("".join(rng.choice("lioe01") if c.isalpha() and rng.random() < 0.06 else c for c in line) if not line.startswith(" ") else line for line in code.split("\n"))
        row = repair.repaired_code(program(spark, bad)).first()
        want = "".join(code.split())
        total += edits("".join(row.code.split()), want)
        fixed += edits("".join(row.fixed_code.lower().split()), want)
        length += len(want)
    assert fixed <= total and 100 - 100 * fixed / length > 80


def test_scopes_and_names(spark):
    code = "import colections\ncount = 1\ndef f(x):\n  total = 2\n  print(tota1)\nprimt(coumt)\ncollection.floor(coumt)\nraise error\nx = [a for a in range(coumt)]\nglobal coun\nself.go(count)"
    got = repair.repaired_code(program(spark, code)).first().fixed_code.split("\n")
    assert got == [
        "import collections", "count = 1", "def f(x):", "  total = 2", "  print(tota1)", "print(count)", "collections.floor(count)", "raise error", "x = [a for a in range(count)]",
        "global count", "self.go(count)",
    ]


def test_and_or_operands(spark):
    code = "first_name = 1\nother_name = 2\nx = first_nane and other_nane or not first_nome"
    got = repair.repaired_code(program(spark, code)).first().fixed_code.split("\n")[-1]
    assert got == "x = first_name and other_name or not first_name"


def test_exports_are_data(spark):
    code = "import math\nimport random as r\nmath.isfinitee(4)\nr.shufle(x)\nmath.shufle(r.isfinitee, 'math.isfinitee')\nmath = 1\nmath.isfinitee(4)"
    exports = spark.createDataFrame([("math", "floor", 0), ("math", "isfinite", 1), ("random", "shuffle", 0), ("random", "shuffled", 1)], "module string, term string, ord int")
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(code.split("\n"))] + [(2, 0, "math.isfinitee(4)"), (2, 1, None), (None, 0, "import math")], "doc_id long, line_no int, fixed string")
    got = {(r.doc_id, r.line_no): r.fixed for r in repair.with_exports(lines, exports).collect()}
    assert [got[1, k] for k in range(7)] == ["import math", "import random as r", "math.isfinite(4)", "r.shuffle(x)", "math.shufle(r.isfinitee, 'math.isfinitee')", "math = 1", "math.isfinitee(4)"]
    assert (got[2, 0], got[2, 1], got[None, 0]) == ("math.isfinitee(4)", None, "import math")
    assert repair.repaired_code(program(spark, "import math\nmath.isfinitee(4)"), exports=exports).first().fixed_code.endswith("math.isfinite(4)")
    assert repair.repaired_code(program(spark, "import math\nmath.isfinitee(4)")).first().fixed_code.endswith("math.isfinitee(4)")
    assert repair.with_exports(lines, exports.limit(0)).exceptAll(lines).count() == 0


@pytest.mark.parametrize("pieces", [False, True])
def test_nearest_term_within_a_key_like_brute_force(spark, pieces):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 14)))
    terms = [(rng.choice("xyz"), word(), k) for k in range(200)]
    tokens = [(rng.choice("xyz"), w if rng.random() < 0.2 else w[:2] + rng.choice("abc") + w[3:]) for _, w, _ in terms]
    best = {}
    for key, token in tokens:
        near = [(edits(token, t) / len(t), k, t) for of, t, k in terms if of == key and (token == t or edits(token, t) < 0.25 * len(t))]
        if near:
            best[key, token] = min(near)[0], min(near)[2]
    got = dictionary.matches(spark.createDataFrame(tokens, "of string, token string"), spark.createDataFrame(terms, "of string, term string, ord int"), pieces, ["of"]).collect()
    assert len(got) == len(best) and {(r.of, r.token): (r.ratio, r.term) for r in got} == best


def test_haskell(spark):
    got = repair.repaired_code(program(spark, "lt a = 1\nf  x   y = x\nmain a"), "haskell").first().fixed_code
    assert got == "let a = 1\nf x y = x\nmain a"


def test_unreadable_line(spark):
    df = spark.createDataFrame([(1, 0, 0, [["p"], []]), (1, 1, 0, [["p"], ["a"], ["s"], ["s"]])], "doc_id long, line_no int, indent int, cand array<array<string>>")
    got = {r.line_no: r.fixed for r in repair.repaired_lines(df).collect()}
    assert got == {0: None, 1: "pass"}


def test_arguments():
    assert [x for x in itertools.starmap(lambda a, b: "a, (b, c), d"[a:b].strip(), repair.arguments("a, (b, c), d"))] == ["a", "(b, c)", "d"]
    assert repair.arguments(" ") == [] and repair.arguments("a,") == [(0, 1), (2, 2)]


def test_registered_rules_reach_tasks(spark):
    """A rule of a new language, registered on the driver, classifies and rewrites lines in tasks."""
    try:
        rules.register("basic", "line", "goto (.*)", 5, "goto {1}")
        rules.register("basic", "line", "(.*)", 0, "{1}")
        lines = spark.createDataFrame([(1, 0, 0, [["g"], ["0", "o"], ["t"], ["0"], [" "], ["1"], ["2"]]), (1, 1, 0, [["x"]])], "doc_id long, line_no int, indent int, cand array<array<string>>")
        got = {r.line_no: r.fixed for r in repair.repaired_lines(lines, "basic").collect()}
        assert got == {0: "goto 12", 1: "x"}
    finally:
        for level in ("line", "expr"):
            rules.CATALOGUE.pop(("basic", level), None)


def test_more_diagnostics():
    told = lambda code: [(d[3], d[6]) for d in diagnose(code)]
    assert told("def f(a, b=1): return a\nf()\nf(1, 2, 3)\nf(1)\nf(*x)") == [(2, "no-value-for-parameter"), (3, "too-many-function-args"), (5, "undefined-variable")]
    assert told("class A:\n  def f(): pass\n  def g(x): pass\n  def g(self): return 1\n  @staticmethod\n  def h(): pass") == [(2, "no-method-argument"), (3, "no-self-argument"), (4, "function-redefined")]
    assert told("return 1\nbreak\nwhile True:\n  if 1:\n    continue\nfor x in []:\n  def f():\n    break") == [(1, "return-outside-function"), (2, "not-in-loop"), (8, "not-in-loop")]
    assert told("f = 1\ndef g(*a, **k): return lambda: a\ng(1, 2, z=3)") == []


def test_lattices_are_matched_once_and_lines_dealt_by_document(spark):
    """No column of lattices is sorted with a document's lines, and their partitions aren't joined by the small size of what is shuffled."""
    lines = program(spark, "import math\nx = 1\nx = 1\nprint(x)").withColumn("expected", F.col("line_no") * 2)
    plan = repair.repaired_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not [x for x in plan.split("\n") if " Sort [" in x and "cand" in x and "doc_id" not in x]
    assert "BroadcastHashJoin" not in plan
    got = repair.repaired_lines(lines, kept=("expected",)).orderBy("line_no").collect()
    assert [(r.expected, r.fixed) for r in got] == [(0, "import math"), (2, "x = 1"), (4, "x = 1"), (6, "print(x)")]


def test_expected_lines_go_along(spark, sf_dir):
    """A small file makes many lines, so that its size would have them broadcast from the driver."""
    plan = registry.QUERIES["repaired_code_accuracy"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_lines_of_a_frequent_lattice_do_not_meet(spark, sf_dir):
    """a join by the lattice would put all lines of "pass" in one task; lines are matched where they lie, and only what they bind is sorted, once."""
    plan = registry.QUERIES["bound_symbols"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.split("Initial Plan")[-1].count(" Sort [") == 1
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "doc_id" not in x]


def test_references_read_their_lines_once(spark):
    """F8: names used and names bound come from one reading of the lines, dealt by document."""
    told = repair.references(program(spark, "import math\nx = 1\nprint(x, y)\ndef f(x):\n  x = 2\nfrom a import x, b\nprint(x, b)"))
    plan = told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1 and "Exchange hashpartitioning" in plan
    got = {(r.line_no, r.term): (r.bound.line_no, r.bound.kind) if r.bound else None for r in told.collect()}
    assert got == {(2, "print"): None, (2, "x"): (1, "variable"), (2, "y"): None, (6, "print"): None, (6, "x"): (5, "import"), (6, "b"): (5, "import")}


def test_a_document_is_sorted_once(spark):
    """scopes are found while a document's lines are read, not by windows of their own."""
    lines = program(spark, "count = 1\ndef f(x):\n  total = 2\nprint(coumt, tota1)")
    plan = repair.repaired_lines(lines)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and "Window" not in plan and plan.count(" Sort [") == 1
    assert [r.fixed for r in repair.repaired_lines(lines).orderBy("line_no").collect()] == ["count = 1", "def f(x):", "total = 2", "print(count, tota1)"]


@pytest.mark.parametrize("kinds", [1, 2])
def test_scopes_in_one_reading_like_windows(spark, kinds):
    rng = random.Random(kinds)
    rows = [(rng.choice([1, 2, None]), k, rng.choice([0, 1, 2, None]), rng.random() < 0.2, rng.random() < 0.2) for k in range(200)]
    table = spark.createDataFrame(rows, "g long, k long, indent int, a boolean, b boolean")
    want = ordered.in_scope(ordered.in_scope(table, ["g"], ["k"], "indent", F.col("a"), "in_a"), ["g"], ["k"], "indent", F.col("b"), "in_b")
    opens = dict(list({"in_a": "a", "in_b": "b"}.items())[:kinds])
    got = ordered.in_scopes(table, "g", "k", "indent", opens)
    assert sorted(map(repr, got.select("k", *opens).collect())) == sorted(map(repr, want.select("k", *opens).collect()))


def test_all_rules_at_once_like_one_by_one():
    rng = random.Random(9)
    own = rules.rules("python3")
    for _ in range(300):
        line = rng.choice(["import math", "for x in range(3):", "print(a)", "self.go(x)", "x = 1", "else:", "from a import b", "return x"])
        lat = [[c] if rng.random() < 0.7 else rng.sample([c, rng.choice("abil01: ("), "e"], 3)[: rng.choice([1, 2, 3])] for c in line if rng.random() < 0.95]
        lat = rules.capped(lat)
        each = [(got[0] - r.budget, r.rank, *got) for r in own if (got := rules.fit(r, lat)) is not None]
        m = rules.classify(lat, own)
        assert (m.errors - m.rule.budget, m.rule.rank, m.errors, m.number) == min(each)
