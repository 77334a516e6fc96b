"""Ordered state, evaluation, storage, sources and streams against plain Python."""

from __future__ import annotations

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from restitch.operators import evaluate, ordered, store
from restitch.plans import registry
from restitch.sources import containers, files
from restitch.streaming import cache


def test_in_scope_is_the_state_machine(spark):
    rng = random.Random(0)
    rows = [(d, k, rng.randrange(4), rng.random() < 0.25) for d in range(60) for k in range(25)]
    df = spark.createDataFrame(rows, "doc int, k int, indent int, opens boolean")
    got = {(r.doc, r.k): r.inside for r in ordered.in_scope(df, ["doc"], ["k"], "indent", F.col("opens"), "inside").collect()}
    for d in range(60):
        level = None
        for _, k, indent, opens in (r for r in rows if r[0] == d):
            if level is not None and indent < level:
                level = None
            if opens:
                level = indent
            assert got[d, k] == (level is not None), (d, k)


def test_seen_before(spark):
    rng = random.Random(1)
    rows = [(d, k, rng.choice("abcde")) for d in range(20) for k in range(15)]
    got = {(r.doc, r.k): (r.n_visible, r.is_visible) for r in ordered.seen_before(spark.createDataFrame(rows, "doc int, k int, name string"), ["doc"], ["k"], "name").collect()}
    for d in range(20):
        seen: set = set()
        for _, k, name in (r for r in rows if r[0] == d):
            assert got[d, k] == (len(seen), name in seen)
            seen.add(name)


def test_indent_levels(spark):
    rng = random.Random(2)
    rows = [(d, k, rng.choice([0, 20, 40, 60]) + rng.uniform(-9, 9)) for d in range(80) for k in range(12)]
    got = {(r.doc, r.k): r.indent for r in ordered.indent_levels(spark.createDataFrame(rows, "doc int, k int, x double"), ["doc"], ["k"], "x", 10.0).collect()}
    for d in range(80):
        levels: list = []
        for _, k, x in (r for r in rows if r[0] == d):
            means = [sum(v) / len(v) for v in levels]
            if not levels or x > means[-1] + 10 and not x < means[0] - 10:
                levels.append([])
                at = len(levels) - 1
            elif x < means[0] - 10:
                at = 0
            else:
                at = min(range(len(means)), key=lambda i: (abs(means[i] - x), i))
            levels[at].append(x)
            assert got[d, k] == at


def test_ordered_concat(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "d int, k int, t string")
    assert {r.d: r.text for r in ordered.ordered_concat(df, ["d"], ["k"], "t", "\n").collect()} == {1: "a\nb\nc", 2: "z"}


def test_weighted_accuracy(spark):
    rows = [("abcd", "abcd", "abcd"), ("abxd", "abcd", "abcd"), ("zz", "zz", "abcdefgh")]
    scored = evaluate.score(spark.createDataFrame(rows, "raw string, fixed string, expected string"), "raw", "fixed", "expected")
    r = evaluate.weighted(scored).first()
    assert (r.accuracy, r.accuracy_fixed, r.length, r.improvement) == (round((100 * 4 + 75 * 4 + 0) / 16, 2), round(800 / 16, 2), 16, round(50 - 43.75, 2))
    assert evaluate.weighted(scored.limit(0)).first().accuracy == 0.0


def test_box_of_nothing_and_overlay(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "x double, y double, w double, h double")
    args = [F.col(c) for c in "xywh"]
    assert tuple(evaluate.bounding_box(df.limit(0), [], *args).first()) == (float(evaluate.FAR), float(evaluate.FAR), 0.0, 0.0)
    box = evaluate.bounding_box(df, [], *args)
    told = json.loads(evaluate.overlay_json(box, F.lit(640), F.lit(480), F.array(F.struct(F.lit(3).alias("line")))).first().overlay)
    assert told == {"dimensions": {"width": 640, "height": 480}, "bbox": {"min_x": 1.0, "min_y": 2.0, "max_x": 4.0, "max_y": 6.0}, "errors": [{"line": 3}]}


def test_locate_errors(spark):
    errors = spark.createDataFrame([(1, 2), (1, 1), (9, 1)], "line int, column int")
    lines = spark.createDataFrame([(1, 10.0, 11.0)], "line int, x double, y double")
    chars = spark.createDataFrame([(1, 1, 5.0, 6.0)], "line int, column int, x double, y double")
    got = {(r.line, r.column): (r.line_x, r.char_x) for r in evaluate.locate_errors(errors, lines, chars).collect()}
    assert got == {(1, 2): (10.0, 5.0), (1, 1): (10.0, None), (9, 1): (None, None)}


def test_cases_and_results(spark):
    js = '[{"input": "0", "output": "1", "hint": "add"}, {"input": "2", "output": "3"}, {}]'
    cases = evaluate.test_cases(spark.createDataFrame([("k", js)], "key string, cases string"), "cases").select("key", "case_no", "input", "expected", "hint")
    assert [tuple(r)[1:] for r in cases.orderBy("case_no").collect()] == [(0, "0", "1", "add"), (1, "2", "3", ""), (2, "", "", "")]
    outputs = spark.createDataFrame([("k", 0, "1"), ("k", 1, "4")], "key string, case_no int, output string")
    assert {r.case_no: r.passed for r in evaluate.test_results(cases, outputs, ["key", "case_no"]).collect()} == {0: True, 1: False, 2: False}


def test_dispatch_and_status(spark):
    df = spark.createDataFrame([("Haskell", ""), ("python3", "x"), ("cobol", None)], "lang string, out string")
    told = evaluate.by_language(F.col("lang"), {"python3": F.lit(1), "haskell": F.lit(2)}, F.lit(1))
    assert [r.x for r in df.select(told.alias("x")).collect()] == [2, 1, 1]
    strict = evaluate.by_language(F.col("lang"), {"python3": F.lit(1), "haskell": F.lit(2)})
    try:
        df.select(strict.alias("x")).collect()
        raise AssertionError("an unknown language went through")
    except Exception as e:
        assert "unknown language: cobol" in str(e)
    assert [r.x for r in df.select(evaluate.output_or_default(F.col("out")).alias("x")).collect()] == [evaluate.NO_OUTPUT, "x", evaluate.NO_OUTPUT]


def test_store(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 5)], "key string, n int")
    there = spark.createDataFrame([("c",)], "key string")
    assert sorted(tuple(r) for r in store.insert_if_absent(rows, there, "key", "n").collect()) == [("a", 1), ("b", 2)]
    assert store.with_parent(rows, there, "key").count() == 1 and store.without_parent(rows, there, "key").count() == 3
    new = spark.createDataFrame([("b", 9), ("d", 1)], "key string, n int")
    assert sorted(tuple(r) for r in store.upsert(rows.where("n < 4 and key <> 'a'"), new, "key", "n").collect()) == [("b", 9), ("d", 1)]
    cached, blobs = spark.createDataFrame([("a", "x")], "key string, v string"), spark.createDataFrame([("a", "y"), ("b", "z")], "key string, v string")
    got = {r.key: (r.v, r.found_in) for r in store.read_through(rows.select("key").distinct(), cached, blobs, "key", "v").collect()}
    assert got == {"a": ("x", "cache"), "b": ("z", "blob"), "c": (None, None)}


def test_sources_and_sinks(spark, tmp_path):
    images = tmp_path / "images"
    images.mkdir()
    for name, content in {"one.png": b"abc", "two.x.png": b"x", ".hidden.png": b"no"}.items():
        (images / name).write_bytes(content)
    notes = tmp_path / "annotations"
    notes.mkdir()
    (notes / "one.txt").write_text("Print(1)\n\tX")
    (notes / ".dot.txt").write_text("no")
    got = {r.stem: (r.key, r.size) for r in files.images(spark, f"{images}/*").collect()}
    assert got == {"one": (hashlib.md5(b"abc").hexdigest(), 3), "two": (hashlib.md5(b"x").hexdigest(), 1)}
    told = files.with_annotation(files.images(spark, f"{images}/*"), files.annotations(spark, f"{notes}/*"))
    assert {r.stem: r.expected for r in told.collect()} == {"one": "print(1)\n\tx", "two": None}
    (tmp_path / "t.py").write_text("{}\n")
    (tmp_path / "t.json").write_text('[{"input": "0", "output": "1"}]')
    rows = files.templates(spark, str(tmp_path / "t.py"), str(tmp_path / "t.json"))
    assert [tuple(r) for r in files.template_cases(rows).collect()] == [(hashlib.md5(b"{}\n").hexdigest(), 0, "0", "1", "")]

    path = str(tmp_path / "blobs")
    at = datetime(2024, 1, 1)
    shots = spark.createDataFrame([(b"abc", at), (b"abc", at + timedelta(1)), (b"d", at)], "content binary, ts timestamp")
    files.save_images(shots, path)
    files.save_images(shots, path)
    assert files.blobs(spark, path).count() == 2
    key = hashlib.md5(b"abc").hexdigest()
    code = spark.createDataFrame([(key, b"x", at), ("nobody", b"y", at)], "key string, content binary, ts timestamp")
    assert [(r.key, bytes(r.content)) for r in files.save_code(code, path).collect()] == [(key, b"x")]


def test_predicted_scores(spark):
    def model():
        return lambda pixels: pixels[:, :3] * 2

    df = spark.createDataFrame([([float(i)] * 784,) for i in range(5)], "pixels array<float>")
    assert [r.scores[0] for r in files.predicted_scores(df, model).collect()] == [0.0, 2.0, 4.0, 6.0, 8.0]


def events(spark):
    rng = random.Random(3)
    at = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        at += timedelta(seconds=rng.choice([1, 60, 600, 1800]))
        rows.append((i, rng.randrange(5), at))
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")


def test_stream_of_cache_status_is_the_batch(spark, tmp_path):
    df = events(spark)
    for k in range(4):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = cache.cache_status(stream)
    got = {(r.event_id, r.status) for r in cache.replay(spark, told, told._jdf.schema().toDDL()).collect()}
    want = {(r.event_id, r.status) for r in store.cache_status(df, "user_id", "ts", ["event_id"]).collect()}
    assert got == want and {s for _, s in want} == {"first", "hit", "expired"}


def test_stream_of_first_uploads_and_store(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("a", b"1", at), ("a", b"1", at + timedelta(minutes=5)), ("b", b"2", at)]
    df = spark.createDataFrame(rows, "key string, content binary, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    first = cache.first_uploads(stream)
    assert sorted(r.key for r in cache.replay(spark, first, first._jdf.schema().toDDL()).collect()) == ["a", "b"]
    cache.save_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "blobs"), str(tmp_path / "state")).awaitTermination()
    assert files.blobs(spark, str(tmp_path / "blobs")).count() == 2


def test_expired_keys_leave_no_state(spark, tmp_path):
    """Statuses as by plain Python, over batches; late events are left out, and what is left in the state is what could still be hit."""
    rng = random.Random(5)
    at = datetime(2024, 1, 1)
    batches = [[(k * 100 + i, f"u{rng.randrange(12)}", at + timedelta(seconds=k * 900 + rng.randrange(900))) for i in range(30)] for k in range(6)]
    batches.append([(900, "u0", at), (901, "new", at + timedelta(hours=9))])  # too late, and far ahead
    df = lambda rows: spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp")
    for rows in batches:
        df(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df(batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with cache.timers(spark):
        told = cache.expiring_status(stream, delay="10 minutes")
        query = told.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.event_id: r.status for r in spark.table("expiring").collect()}
    last: dict = {}
    want = {}
    for rows in batches[:-1]:
        for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i] = "hit" if key in last and t - last[key] <= timedelta(seconds=1800) else "miss"
            last[key] = max(t, last.get(key, t))
    want[901] = "miss"
    assert got == want and set(want.values()) == {"hit", "miss"}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) >= 12 and states[-1] <= 2, states


def test_store_in_buckets(spark, tmp_path):
    """A batch rewrites the buckets that it touches only; tried again it changes nothing; code without an image is refused."""
    path, at = str(tmp_path / "store"), datetime(2024, 1, 1)
    df = lambda rows: spark.createDataFrame(rows, "key string, content binary, ts timestamp")
    keys = [f"k{i}" for i in range(40)]
    assert containers.read(spark, path, ["images"]).count() == 0
    containers.insert_absent(df([(k, b"i", at) for k in keys]), path, "images", 8)
    containers.insert_absent(df([("k1", b"other", at), ("k1", b"x", at), (None, b"x", at)]), path, "images", 8)
    first = df([(k, b"1", at) for k in keys] + [("nobody", b"1", at)])
    containers.save_code(first, path, buckets=8)
    files_of = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in (tmp_path / "store" / "container=code").rglob("*.parquet")}
    rows = lambda: {r.key: bytes(r.content) for r in containers.read(spark, path, ["code"]).collect()}
    assert rows() == {k: b"1" for k in keys}
    before = files_of()
    later = df([("k3", b"2", at + timedelta(1)), ("k3", b"0", at), ("k3", b"3", at + timedelta(1))])
    containers.save_code(later, path, buckets=8)
    want = {k: b"1" for k in keys} | {"k3": b"3"}
    assert rows() == want
    changed = {f.split("/")[1] for f in set(files_of()) ^ set(before)}
    assert len(changed) == 1
    for batch in (first, later, first):
        containers.save_code(batch, path, buckets=8)
        assert rows() == want
    asked = containers.read(spark, path, ["code", "images"], df([("k3", b"", at), ("zz", b"", at)]), 8)
    assert sorted((r.container, r.key, bytes(r.content)) for r in asked.collect()) == [("code", "k3", b"3"), ("images", "k3", b"i")]
    assert "PartitionFilters: [container" in asked._jdf.queryExecution().executedPlan().toString()
    containers.save_code(df([]), path, buckets=8)
    assert rows() == want


@pytest.mark.parametrize("name", ["stored_by_stream", "ttl_cache_stream", "ttl_cache_expiring"])
def test_streams_of_tables_in_parts(spark, tmp_path, sf_dir, name):
    """A table may be a folder, whose files have names of their own."""
    for t in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(50).repartition(2).write.parquet(str(tmp_path / f"{t}.parquet"))
    columns = registry.QUERIES[name](spark, sf_dir).columns
    got = registry.QUERIES[name](spark, str(tmp_path))
    table = "documents" if name == "stored_by_stream" else "events"
    rows = spark.read.parquet(str(tmp_path / f"{table}.parquet"))
    assert got.columns == columns and got.count() == (rows.select("text").where("text is not null").distinct().count() if table == "documents" else 50)
