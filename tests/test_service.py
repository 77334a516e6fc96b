"""Diagnostics, the network's forward pass, requests and the command line."""

from __future__ import annotations

import json
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from restitch.functions import convnet, lattice
from restitch.operators.diagnostics import diagnose, diagnostics
from restitch.plans import service


def test_diagnose():
    assert diagnose("x = 1\nprint(x)") == [] and diagnose("") == []
    assert [(d[3], d[6], d[8]) for d in diagnose("x = (\n")] == [(1, "syntax-error", "E0001")]
    got = diagnose("import os\nclass A:\n  def f(self):\n    return os, yy\nfor i in range(3): print(i, zz)")
    assert [(d[2], d[3], d[7]) for d in got] == [("A.f", 4, "Undefined variable 'yy'"), ("", 5, "Undefined variable 'zz'")]
    assert diagnose("from os import *\npath") == [] and diagnose("a\0b")[0][6] == "syntax-error"


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, "y"), (2, None), (3, "x = 1")], "doc_id long, code string")
    assert [(r.doc_id, r.line, r.symbol) for r in diagnostics(df).collect()] == [(1, 1, "undefined-variable")]


def brute_forward(weights, image):
    x = image.reshape(28, 28, 1)
    for k in range(1, 5):
        kernel, bias = weights[f"conv{k}"], weights[f"conv{k}_bias"]
        h = x.shape[0] - 2
        x = np.array([[[max(0.0, float((x[i : i + 3, j : j + 3] * kernel[..., c]).sum() + bias[c])) for c in range(kernel.shape[-1])] for j in range(h)] for i in range(h)])
        if k % 2 == 0:
            x = np.array([[x[i : i + 2, j : j + 2].max(axis=(0, 1)) for j in range(0, h, 2)] for i in range(0, h, 2)])
    x = np.maximum(x.reshape(-1) @ weights["dense1"] + weights["dense1_bias"], 0) @ weights["dense2"] + weights["dense2_bias"]
    e = np.exp(x - x.max())
    return e / e.sum()


def test_forward():
    assert convnet.parameter_count() == 351_550
    weights = convnet.random_weights(1)
    pixels = np.random.default_rng(0).random((3, 784))
    got = convnet.forward(weights, pixels)
    assert got.shape == (3, convnet.CLASSES) and np.allclose(got.sum(1), 1)
    assert np.allclose(got[0], brute_forward(weights, pixels[0]), atol=1e-4)


def test_requests_and_responses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"key": "k", "code": "print(1)", "template": "{}\\nmain()"}\n{"key": "m", "code": "print("}\n')
    rows = service.requests(spark, str(tmp_path / "in"))
    cached, blobs = spark.createDataFrame([("k", b"1")], "key string, content binary"), spark.createDataFrame([("m", b"2")], "key string, content binary")
    got = {r.key: r for r in service.resubmit(rows, cached, blobs).collect()}
    assert got["k"].program == "print(1)\nmain()" and got["k"].found_in == "cache" and got["k"].errors == []
    assert got["m"].program is None and got["m"].found_in == "blob" and got["m"].errors[0].symbol == "syntax-error"
    told = [json.loads(r.response) for r in service.responses(service.resubmit(rows, cached, blobs), "key", "errors").collect()]
    assert {t["key"]: len(t["errors"]) for t in told} == {"k": 0, "m": 1}
    stream = service.requests(spark, str(tmp_path / "in"), stream=True)
    assert stream.isStreaming and stream.columns == rows.columns


def test_store_template(spark):
    df = spark.createDataFrame([("t", "[]"), (None, "[]"), ("t", None), ("t", "no json")], "template string, cases string")
    told = [json.loads(r.response) for r in service.store_template(df).collect()]
    assert [(t["success"], t["error"]) for t in told] == [(True, ""), (False, "Files Missing"), (False, "Files Missing"), (False, "File Upload Failed")]
    assert told[0]["id"] and told[1]["id"] == ""


def test_submit(spark):
    lines = spark.createDataFrame([(1, 0, 0, "x = 1"), (1, 1, 0, "primt(y)")], "doc_id long, line_no int, indent int, line string").withColumn("cand", lattice.spell(F.col("line"), {"~": ["~"]}))
    boxes = lines.select("doc_id", "line_no", F.lit(5.0).alias("x"), (F.col("line_no") * 10.0).alias("y"), F.lit(50.0).alias("width"), F.lit(8.0).alias("height"))
    r = service.submit(lines, boxes).first()
    assert r.unfixed == "x = 1\nprimt(y)" and r.fixed == "x = 1\nprint(y)" and [e.symbol for e in r.errors] == ["undefined-variable"]
    told = json.loads(r.overlay)
    assert told["bbox"] == {"min_x": 5.0, "min_y": 0.0, "max_x": 55.0, "max_y": 18.0} and told["errors"] == [{"line": {"x": 5.0, "y": 10.0, "width": 50.0, "height": 8.0}}]


def test_command_line(tmp_path):
    (tmp_path / "code.txt").write_text("x = 1\nprimt(x)")
    run = subprocess.run([sys.executable, "-m", "restitch", "--repair", str(tmp_path / "code.txt")], capture_output=True, text=True, timeout=120, check=True)
    assert run.stdout.strip().endswith("x = 1\nprint(x)")


def test_requests_that_come_again(spark):
    """Each is answered with its errors once, however often code, key, cache or store repeat it."""
    rows = [("k", "foo(", "t{}"), ("k", "foo(", "t{}"), ("j", "foo(", None), ("k", "x = 1", "t{}"), (None, None, "t{}")]
    held = [("k", b"1"), ("k", b"1"), ("j", b"2")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    cache, blobs = df(held[:2], "key string, content binary"), df(held, "key string, content binary")
    got = sorted((str(r.key), str(r.code), len(r.errors), str(r.found_in), r.program) for r in service.resubmit(df(rows, service.REQUEST), cache, blobs).collect())
    assert got == [("None", "None", 0, "None", None), ("j", "foo(", 1, "blob", None), ("k", "foo(", 1, "cache", None), ("k", "foo(", 1, "cache", None), ("k", "x = 1", 0, "cache", "tx = 1")]


def test_forward_is_bounded():
    """A batch needs the memory of a few pictures, not of all its patches."""
    import tracemalloc

    import numpy as np

    from restitch.functions import convnet

    weights, pixels = convnet.random_weights(), np.random.default_rng(1).random((1024, 784), np.float32)
    tracemalloc.start()
    got = convnet.forward(weights, pixels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (1024, 94) and peak < 200_000_000
    assert np.allclose(got[100:110], convnet.forward(weights, pixels[100:110]), atol=1e-5)


def test_equal_code_and_joins_of_lines(spark, sf_dir):
    """What small files make many rows of is never broadcast from the driver; equal code has equal diagnostics."""
    from restitch.operators.diagnostics import diagnostics
    from restitch.plans import registry

    plan = registry.QUERIES["submitted_pictures"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    df = spark.createDataFrame([(i, "x = y" if i % 2 else "x = 1") for i in range(6)], "doc_id long, code string").coalesce(1)
    assert sorted((r.doc_id, r.symbol) for r in diagnostics(df).collect()) == [(i, "undefined-variable") for i in (1, 3, 5)]
