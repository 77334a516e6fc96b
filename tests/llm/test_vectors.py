"""Product codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from restitch.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    first: dict = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[part(v, p) for v in list(first.values())[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e)) for p in range(4)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(far(part(v, p), books[p][c[p]]) for p in range(4)) for (_, v, _), c in zip(kept, codes, strict=True)]
    labels: dict = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for k in c), e, labels[label], told) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=repr)


def coded(df, **kw):
    out = vector_codes.with_label_errors(vector_codes.compress(df, **kw)).withColumn("code", vector_codes.hexed("code"))
    return sorted(map(tuple, out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(seed, n, dim=8):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.choice([-1, 0, 1, 2]) + rng.gauss(0, 0.2))) for _ in range(dim)], rng.choice([None, 0, 1])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("entries", "n"), [(256, 300), (5, 120), (16, 10)])
def test_like_plain_lloyd(spark, entries, n):
    rows = vectors(entries, n)
    hot = [(1000 + i, rows[0][1], 7) for i in range(n)]  # one vector in half the rows
    bad = [(-1, None, 0), (-2, [1.0, None] * 4, 0), (-3, [float("nan")] * 8, 0), (-4, [float("inf")] + [0.0] * 7, None)]
    got = coded(spark.createDataFrame(rows + hot + bad, SCHEMA).repartition(3), entries=entries)
    assert got == brute(rows + hot, entries)


def test_repeated_ids_nulls_and_ties(spark):
    rows = [(1, [0.0] * 4, 1), (1, [1.0] * 4, 1), (None, [0.5] * 4, None), (2, [-0.0001, 0.0001, 0.9999, -1.0], None), (3, [0.0] * 4, 1), (3, [0.0] * 4, 1)]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_clashing_and_other_lengths(spark):
    df = spark.createDataFrame(vectors(3, 40), SCHEMA)
    more = df.selectExpr("*", "1 as v", "2 as code", "3 as `a.b`", "4 as n", "5 as was", "6 as _label", "'x' as error")
    assert coded(more) == coded(df)
    assert coded(df.limit(0)) == []
    odd = spark.createDataFrame([(100, [1.0] * 4, 1), (101, [1.0] * 7, 1), (102, [], 1)], SCHEMA)
    assert coded(df.union(odd)) == coded(df)
    with pytest.raises(ValueError, match="fit a long"):
        vector_codes.compress(spark.createDataFrame([(1, [3e30] * 8, 1)], SCHEMA))


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(vectors(4, 60), SCHEMA)
    want = coded(df)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert coded(df) == want


def test_only_moved_parts_are_shipped():
    run = vector_codes._moves(4, 8, 1)
    v = pa.array([[10, 20, 30, 40]] * 3, pa.list_(pa.int64()))
    was, now = [[0, 1, 2, 3], [0, 1, 2, 3], [-1, -1, -1, -1]], [[0, 1, 2, 3], [0, 1, 2, 4], [5, 1, 2, 3]]
    b = pa.RecordBatch.from_arrays([v, *(pa.array(x, pa.list_(pa.int32())) for x in (was, now))], names=["v", "was", "code"])
    got = {(r["part"], r["entry"]): (r["n"], r["s0"]) for out in run(iter([b])) for r in out.to_pylist()}
    assert got == {(0, 5): (1, 10), (1, 1): (1, 20), (2, 2): (1, 30), (3, 4): (1, 40), (3, 3): (0, 0)}


def test_wide_components_are_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(1 << 28), 1 << 28, (50, 4)), rng.integers(-(1 << 28), 1 << 28, (9, 4))
    at, off = vector_codes.nearest(x, c)
    for a, o, row in zip(at.tolist(), off.tolist(), x.tolist(), strict=True):
        far = [sum((int(p) - int(q)) ** 2 for p, q in zip(row, e, strict=True)) for e in c.tolist()]
        assert o == min(far) and a == far.index(o)
