"""Ordered state over rows of a document: scopes, imports seen so far, indentation, ordered concatenation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.streaming.cache import work_dir


def ordered_concat(rows: DataFrame, by: list[str], order: list[str], text: str, separator: str, out: str = "text") -> DataFrame:
    """One row a group: the texts in order, joined.  Ties in the order go by the text."""
    told = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(text).alias("_t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(told, lambda s: s["_t"]), separator).alias(out))


#: Of a table whose groups may be large, a group of more rows is read in parts, each in a task of its own, with what came before as a carry.
MOST_ROWS = 1_000_000


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its key columns renamed, and the condition that keys are the same, nulls too."""
    names = {c: f"_k{i}" for i, c in enumerate(by)}
    return right.withColumnsRenamed(names), reduce(Column.__and__, [left[c].eqNullSafe(F.col(k)) for c, k in names.items()])


def _with(rows: DataFrame, told: DataFrame, by: list[str], few: bool = True) -> DataFrame:
    """``rows`` with the columns of a table that has a row for some of their keys; ``few`` if it has a row for each part of a large group at most."""
    told, same = _same(rows, told, by)
    return rows.join(F.broadcast(told) if few else told, same, "left").drop(*[f"_k{i}" for i in range(len(by))])


def _number(rows: DataFrame, column: str) -> Column:
    kind = rows.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{column} must be a number or a time")
    return F.col(column)


def in_parts(rows: DataFrame, by: list[str], order: list[str], most: int | None) -> DataFrame:
    """``rows`` with ``_part``, which cuts groups of more than ``most`` rows along their order, and ``_large``, which groups these are.

    Cuts are quantiles of the first order column, so rows with the same value there lie in one part; there are as many as
    Spark shuffles to.  A part of a lesser number holds rows that come before.  Large groups are at most a ``most``-th as
    many as there are rows.  Without ``most`` all groups are whole, as those of documents may be: each is a text.  ``rows``
    are read several times, so they are best a table; the cuts are found once and lie in the shared folder.
    """
    if most is None:
        return rows.withColumns({"_part": F.lit(0), "_large": F.lit(False)})
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n")
    right, same = _same(rows, large, by)
    cuts = rows.join(F.broadcast(right), same, "left_semi").groupBy(*by).agg(F.percentile_approx(_number(rows, order[0]), [k / parts for k in range(1, parts)]).alias("_cuts"))
    # found once: quantiles are approximate and may come out otherwise when they are found again for another reader of the same rows
    path = f"{work_dir(rows.sparkSession)}/cuts"
    cuts.write.parquet(path)
    told = _with(rows, rows.sparkSession.read.schema(cuts.schema).parquet(path), by)
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < _number(rows, order[0]))), F.lit(0))
    return told.withColumns({"_part": F.when(F.col("_cuts").isNull(), 0).otherwise(part), "_large": F.col("_cuts").isNotNull()}).drop("_cuts")


def in_scope(rows: DataFrame, by: list[str], order: list[str], indent: str, opens: Column, out: str, most: int | None = None) -> DataFrame:
    """Whether each row lies in the scope of the latest opener: no row since it is indented less than it.

    The opener itself is in its scope; a row before any opener is in none.  A group of more than ``most`` rows is read in
    parts: each hands on the indent of its last opener, and the least since.
    """
    rows = in_parts(rows.withColumn("_opens", opens), by, order, most)
    part = [*by, "_part"]
    rows = rows.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(Window.partitionBy(*part).orderBy(*order)))
    runs = rows.where("_large").groupBy(*part, "_run").agg(F.min(indent).alias("low"), F.min_by(indent, F.struct(*order)).alias("start"))
    last = F.max(F.struct(F.coalesce("_run", F.lit(0)).alias("run"), "start", "low")).alias("l")
    ends = runs.groupBy(*part).agg(last).select(*part, (F.col("l.run") > 0).alias("opened"), F.col("l.start").alias("start"), F.col("l.low").alias("low"))
    before = Window.partitionBy(*by).orderBy("_part")
    ends = ends.withColumn("since", F.sum(F.col("opened").cast("int")).over(before))
    since = Window.partitionBy(*by, "since").orderBy("_part")
    ends = ends.withColumns({"start": F.last(F.when(F.col("opened"), F.col("start")), True).over(before), "low": F.min("low").over(since)})
    carry = ends.select(*part, F.lag("start").over(before).alias("_start"), F.lag("low").over(before).alias("_low"))
    rows = _with(rows, carry, part)
    run = Window.partitionBy(*part, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.min(indent).over(run)
    inside = F.when(F.col("_run") > 0, here >= F.first(indent).over(run)).otherwise(F.coalesce(F.least("_low", here) >= F.col("_start"), F.lit(False)))
    return rows.withColumn(out, inside).drop("_opens", "_run", "_part", "_large", "_start", "_low")


class Scope:
    """The scope of the latest opener of a group's rows, which come in order: its indent, and the least since."""

    def __init__(self):
        self.opened, self.start, self.low = False, None, None

    def add(self, indent, opens: bool) -> bool | None:
        """Whether the row is in scope; null if the opener's indent isn't known."""
        if opens:
            self.opened, self.start, self.low = True, indent, indent
        elif indent is not None and (self.low is None or indent < self.low):
            self.low = indent
        return (None if self.start is None else self.low >= self.start) if self.opened else False


def in_scopes(rows: DataFrame, by: str, order: str, indent: str, opens: dict[str, str]) -> DataFrame:
    """``in_scope`` for several kinds of openers at once, as columns by name: ``opens`` names the column that tells each.

    Rows are sorted once and read in order, and of the group at hand a task holds two numbers a kind.  They are dealt by group to
    as many tasks as Spark shuffles to, as the size of what is shuffled tells little of what a task holds.
    """
    told = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by, order)
    given = rows.columns
    schema = T.StructType([*told.schema.fields, *[T.StructField(out, T.BooleanType()) for out in opens]])
    at = [given.index(c) for c in (by, indent, *opens.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, scopes = object(), []
        for b in batches:
            got = [[] for _ in opens]
            for g, x, *each in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if g != group:
                    group, scopes = g, [Scope() for _ in opens]
                for out, scope, opened in zip(got, scopes, each, strict=True):
                    out.append(scope.add(x, opened))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.bool_()) for x in got]], names=schema.names)

    return told.mapInArrow(run, schema)


def seen_before(rows: DataFrame, by: list[str], order: list[str], name: str, most: int | None = None) -> DataFrame:
    """``rows`` with ``n_visible``, the distinct names in earlier rows of the group, and ``is_visible``, whether the row's own is one.

    A name counts where it comes first, so the state of a row is a number, not a list that grows with the group.  A group
    of more than ``most`` rows is read in parts: each hands on how many names came first in it.
    """
    rows = in_parts(rows, by, order, most)
    part = [*by, "_part"]
    earliest = rows.where("_large").groupBy(*by, name).agg(F.min("_part").alias("_least"))
    rows = _with(rows, earliest, [*by, name], few=False)
    own = F.row_number().over(Window.partitionBy(*part, name).orderBy(*order)) == 1
    rows = rows.withColumn("_first", own & (F.col("_part") == F.coalesce("_least", F.col("_part"))))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.where("_large").groupBy(*part).agg(F.sum(F.col("_first").cast("long")).alias("n")).select(*part, F.sum("n").over(before).alias("_n"))
    rows = _with(rows, carry, part)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    visible = F.coalesce(F.sum(F.col("_first").cast("long")).over(w), F.lit(0)) + F.coalesce("_n", F.lit(0))
    return rows.withColumn("n_visible", visible).withColumn("is_visible", ~F.col("_first")).drop("_first", "_part", "_large", "_least", "_n")


def latest_before(uses: DataFrame, bindings: DataFrame, by: list[str], order: list[str], name: str, out: str = "bound", most: int | None = None) -> DataFrame:
    """``uses`` with the latest binding of their name that comes before them in their group, as a struct of ``bindings``' other columns, or null.

    Both tables have ``by``, ``order`` and ``name``; a binding at the same place as a use doesn't count, and of bindings of
    a name at one place the greatest does.  An as-of join: both are read in one order, and of each name only its last
    binding is held.  The rows of a name are cut into parts, if there are more than ``most``, each with the last binding before.
    """
    keys = [*by, name]
    told = F.struct(*[F.col(c) for c in bindings.columns if c not in keys])
    given = F.struct(*[F.col(c) for c in uses.columns])
    left = uses.select(*keys, *order, F.lit(0).alias("_turn"), given.alias("_use"), F.lit(None).cast(bindings.select(told.alias("b")).schema["b"].dataType).alias("_bound"))
    right = bindings.select(*keys, *order, F.lit(1).alias("_turn"), F.lit(None).cast(uses.select(given.alias("u")).schema["u"].dataType).alias("_use"), told.alias("_bound"))
    rows = in_parts(left.unionByName(right), keys, order, most)
    part, place = [*keys, "_part"], [*order, "_turn", "_bound"]
    last = rows.where("_large and _turn = 1").groupBy(*part).agg(F.max(F.struct(*order, "_bound"))["_bound"].alias("b"))
    # a part without a binding hands on what it was handed
    parts = _with(rows.where("_large").select(*part).distinct(), last, part)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with(rows, parts.select(*part, F.last("b", True).over(before).alias("_carry")), part)
    w = Window.partitionBy(*part).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.last("_bound", True).over(w), "_carry"))
    return rows.where("_turn = 0").select("_use.*", out)


class Levels:
    """Indentation levels of the positions of one group, clustered as they come.

    The first x opens level 0.  An x below the mean of level 0 by more than the threshold joins level 0; one
    above the mean of the last level by more opens the next; any other joins the level of the nearest mean, the
    first of equals.  A position that isn't known has no level.
    """

    def __init__(self, threshold: float):
        self.threshold, self.sums, self.sizes = threshold, [], []

    def add(self, x: float) -> int | None:
        if x is None or x != x:
            return None
        mean = lambda i: self.sums[i] / self.sizes[i]
        n = len(self.sums)
        if not n or x > mean(n - 1) + self.threshold:
            level = n
        elif x < mean(0) - self.threshold:
            level = 0
        else:
            level = min(range(n), key=lambda i: abs(mean(i) - x))
        if level == n:
            self.sums.append(0.0)
            self.sizes.append(0)
        self.sums[level] += x
        self.sizes[level] += 1
        return level


def indent_levels(rows: DataFrame, by: list[str], order: list[str], x: str, threshold: float, out: str = "indent") -> DataFrame:
    """``by``, ``order`` and the indentation level of each row.

    Rows are read in order, and of the group at hand a task holds a sum and a size for each level, however many rows it has.
    """
    keys = [*by, *order]
    told = rows.select(*keys, F.col(x).cast("double").alias("_x")).repartition(*by).sortWithinPartitions(*keys)
    schema = T.StructType([*told.schema.fields[:-1], T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = object(), None
        for b in batches:
            got = []
            for *key, v in zip(*(b.column(i).to_pylist() for i in (*range(len(by)), b.num_columns - 1)), strict=True):
                if key != at:
                    at, levels = key, Levels(threshold)
                got.append(levels.add(v))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.int32())], names=[*keys, out])

    return told.mapInArrow(run, schema)
