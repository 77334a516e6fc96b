"""Vector compression by product codes: each part of a vector becomes the number of its codebook's nearest entry.

Codebooks are fitted by Lloyd's rounds whose work is kept up by deltas: the vectors with the entries that they were given
last are a table of their own, and so are the sums and counts of every entry.  A round gives each part its nearest
entry again and ships, of the parts that moved, their components once with a plus for the new entry and once with a
minus for the old one, added up inside the task before they are shuffled.  All is done in integers, so that sums
taken away leave no rest and the order of additions changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.llm.session import Scratch
from restitch.llm.textscan import settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Label sums of at most so many labels (under 4 MB) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Distances of so many parts are told at once.
BLOCK = 4096


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``points`` the row of ``entries`` at the least squared distance, the first of equals, and that distance.

    Exact: products of whole numbers are told in doubles only where no sum can reach 2 ** 53.
    """
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    c = entries.astype(kind)
    own = (c * c).sum(1)
    at, off = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    for a in range(0, len(points), BLOCK):
        x = points[a : a + BLOCK].astype(kind)
        far = own - 2 * (x @ c.T)
        k = far.argmin(1)
        at[a : a + BLOCK] = k
        off[a : a + BLOCK] = far[np.arange(len(k)), k] + (x * x).sum(1)
    return at, off


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1), kind))


def clean(rows: DataFrame) -> DataFrame:
    """vec_id, label and ``v``, the components as whole numbers, of the rows whose vector has none that is null, NaN or infinite.

    Exact for floats and doubles, as SCALE is a power of two.
    """
    usual = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull()).where(usual)
    return told.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"))


def _assign(books: np.ndarray):
    """Each vector with the entry of every part, as told by ``books``, beside the one it had (``was``), and its distance."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), parts * width)
            got = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = _lists(np.column_stack([g[0] for g in got]), pa.int32())
            error = pa.array(sum(g[1] for g in got), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, code, error], names=["vec_id", "label", "v", "was", "code", "error"])
        settle()

    return run


def _moves(parts: int, entries: int, width: int):
    """What the moved parts of a task add to and take from each entry: part, entry, n and a column for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), np.int64)
        touched = np.zeros(parts * entries, bool)
        for b in batches:
            x, was, now = _matrix(b.column(0), parts * width), _matrix(b.column(1), parts), _matrix(b.column(2), parts)
            for p in range(parts):
                moved = np.flatnonzero(was[:, p] != now[:, p])
                rows = np.column_stack((np.ones(len(moved), np.int64), x[moved, p * width : (p + 1) * width]))
                left = was[moved, p] >= 0
                for at, change in ((now[moved, p], rows), (was[moved[left], p], -rows[left])):
                    np.add.at(sums, p * entries + at, change)
                    touched[p * entries + at] = True
        k = np.flatnonzero(touched)
        if len(k):
            columns = [pa.array(k // entries, pa.int32()), pa.array(k % entries, pa.int32()), *[pa.array(sums[k, i], pa.int64()) for i in range(width + 1)]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", *_sums(width)])
        settle()

    return run


def _sums(width: int) -> list[str]:
    return ["n", *[f"s{i}" for i in range(width)]]


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (array of int), error (long) and codebooks_sha256 of each row of ``rows`` that has a vector.

    ``rows`` has vec_id, embedding and label; other columns are ignored.  A row whose embedding is null or holds a null,
    NaN or infinite component has no vector.  Codebooks start as the vectors of the ``entries`` least ids (fewer, if there
    are fewer; null ids come last); of rows that share an id the least vector counts there, while all of them are
    coded.  A vector's length is that of the first of these; rows of another length, or whose length ``parts`` doesn't
    divide, have no vector either.  Copies of a vector get the same code; of entries at the same distance the first is
    taken.  An empty table gives no rows.  Components of 2 ** 17 and more make errors that may not fit a long: an error.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    given = clean(rows).where(F.size("v") % parts == 0)
    first = given.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()  # at most ``entries`` rows
    dim = len(first[0]["v"]) if first else 0
    start = [r["v"] for r in first if len(r["v"]) == dim]
    width = dim // parts
    state = given.where(F.size("v") == dim).withColumn("code", F.array(*[F.lit(-1)] * parts))  # none yet
    state, seen = scratch.counted(state, most="max(array_max(transform(v, x -> abs(x))))")
    if 4 * dim * seen["most"] ** 2 >= 1 << 62:
        raise ValueError("vectors have components whose squared distances don't fit a long")
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    sums = None
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([*state.schema.fields[:3], T.StructField("was", numbers), T.StructField("code", numbers), T.StructField("error", T.LongType())])
    for turn in range(rounds + 1):
        after = state.select("vec_id", "label", "v", "code").mapInArrow(_assign(books), schema)
        if turn == rounds:
            break
        after = scratch.table(after)
        scratch.drop(state)
        state = after
        moved = state.where("was <> code").select("v", "was", "code").mapInArrow(_moves(parts, len(start), width), ", ".join(["part int", "entry int", *[f"{c} long" for c in _sums(width)]]))
        sums = moved if sums is None else sums.unionByName(moved)
        sums = scratch.table(sums.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in _sums(width)]))
        for part, entry, n, *total in sums.where("n > 0").collect():  # a row an entry
            books[part, entry] = [s // n for s in total]
    scratch.drop_others(state)
    told = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return after.select("vec_id", "label", "code", "error").withColumn("codebooks_sha256", F.lit(told))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows with the same label, of nulls together."""
    scratch = Scratch(coded.sparkSession)
    coded = scratch.table(coded)
    of, seen = scratch.counted(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    of = F.broadcast(of) if seen["rows"] <= BROADCAST_LABELS else of
    return coded.join(of, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def hexed(code: str) -> Column:
    """An array of numbers below 256 as two hex digits each."""
    return F.array_join(F.transform(code, lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")


def oracle_sql() -> str:
    """The same codes in DuckDB: every distance of every round."""
    squares = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    near = lambda k: f"SELECT i, p, any_value(v) AS v, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT i, p, v, e, {squares} AS d FROM parts JOIN book{k} USING (p)) GROUP BY i, p"
    rounds = "".join(f"""
        , near{k} AS ({near(k)})
        , mean{k} AS (SELECT p, e, list(floor(s / n) ORDER BY pos) AS c FROM (
            SELECT p, e, pos, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near{k}) GROUP BY ALL) GROUP BY p, e)
        , book{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""" for k in range(ROUNDS))  # fmt: skip
    return f"""
        WITH vectors AS (
            SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT i, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM vectors, range({PARTS}) t(p)
        ), book0 AS (
            SELECT p, e, v AS c FROM parts JOIN (SELECT i, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM vectors QUALIFY e < {ENTRIES}) USING (i)
        ){rounds}
        , final AS ({near(ROUNDS)})
        , codes AS (
            SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY i
        ), told AS (
            SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS codebooks_sha256
            FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM book{ROUNDS})
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM vectors JOIN codes USING (i) CROSS JOIN told"""
