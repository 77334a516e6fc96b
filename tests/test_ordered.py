"""Scans of large groups in parts, and as-of bindings, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from restitch.operators import ordered, repair
from tests.test_repair import program

SCHEMA = "g string, ts long, id long, indent int, opens boolean, name string"


def rows(seed: int, n: int = 400) -> list:
    """One group holds most rows, another none to speak of; places repeat, and a name may be null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["b", None]), rng.randrange(60), i, rng.randrange(4), rng.random() < 0.05, rng.choice(["x", "y", "z", None, f"n{rng.randrange(40)}"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [10, 1000])
def test_scans_in_parts(spark, seed, most):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    scoped = {r.id: r.inside for r in ordered.in_scope(df, ["g"], ["ts", "id"], "indent", F.col("opens"), "inside", most=most).collect()}
    seen = {r.id: (r.n_visible, r.is_visible) for r in ordered.seen_before(df, ["g"], ["ts", "id"], "name", most=most).collect()}
    for g in {r[0] for r in data}:
        start, low, names = None, None, set()
        for _, _, i, indent, opens, name in sorted((r for r in data if r[0] == g), key=lambda r: r[1:3]):
            start, low = (indent, indent) if opens else (start, low if low is None else min(low, indent))
            assert scoped[i] == (start is not None and low >= start)
            assert seen[i] == (len(names), name in names)
            names.add(name)
    assert len(scoped) == len(seen) == len(data)
    empty = df.limit(0)
    assert ordered.in_scope(empty, ["g"], ["ts", "id"], "indent", F.col("opens"), "inside", most=most).count() == 0


def test_a_hot_group_is_spread(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    parts = ordered.in_parts(df, ["g"], ["ts", "id"], 50).groupBy("g", "_part").count().where("g = 'hot'").collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in parts) < 120
    with pytest.raises(ValueError, match="number or a time"):
        ordered.in_parts(df, ["g"], ["name"], 50)


@pytest.mark.parametrize("most", [10, 1000])
def test_latest_before(spark, most):
    data = rows(4)
    df = spark.createDataFrame(data, SCHEMA)
    uses = df.where("not opens").select("g", "ts", "name", "id")
    bound = df.where("opens or indent = 0").select("g", "ts", "name", F.col("id").alias("at"), "indent")
    got = {r.id: r.bound for r in ordered.latest_before(uses, bound, ["g"], ["ts"], "name", most=most).collect()}
    for g, ts, i, _, opens, name in data:
        if not opens:
            told = [r for r in data if (r[4] or r[3] == 0) and r[0] == g and r[5] == name and r[1] < ts]
            want = max(((r[1], r[1], r[2], r[3]) for r in told), default=None)
            assert (got[i] and (got[i].at, got[i].indent)) == (want and want[2:]), (g, ts, i, name)
    assert len(got) == sum(not r[4] for r in data)


def test_references(spark):
    code = "import math\nx = 1\nprint(x)\nimport os as x\nprint(x, math, y)\nx = 2\nprint(x)\ndef f(a):\n  x = 3\n  print(x)"
    got = {(r.line_no, r.term): r.bound and (r.bound.line_no, r.bound.kind) for r in repair.references(program(spark, code)).collect() if r.term != "print"}
    assert got == {(2, "x"): (1, "variable"), (4, "x"): (3, "import"), (4, "math"): (0, "import"), (4, "y"): None, (6, "x"): (5, "variable"), (9, "x"): (5, "variable")}


def test_cuts_are_found_once(spark, monkeypatch):
    """Quantiles of many rows may come out otherwise each time: all readers of a group go by the same ones."""
    some = F.udf(lambda xs: sorted(random.Random().sample(xs, 3)), "array<bigint>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda x, _: some(F.collect_list(x)))
    test_scans_in_parts(spark, 5, 10)
    test_latest_before(spark, 10)
