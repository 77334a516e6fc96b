"""Accuracy, bounding boxes, error coordinates, diagnostics and test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.functions.text import accuracy, compact

#: What an empty set of lines gives for the least coordinates, and what a silent run prints.
FAR = 9223372036854775807
NO_OUTPUT = "Program did not generate any output!"


def score(rows: DataFrame, raw: str, fixed: str, expected: str) -> DataFrame:
    """``rows`` with accuracy, accuracy_fixed, improvement and length of the expected text."""
    a, b = accuracy(F.lower(raw), F.lower(expected)), accuracy(F.lower(fixed), F.lower(expected))
    return rows.withColumns({"accuracy": a, "accuracy_fixed": b, "improvement": b - a, "length": F.length(compact(F.col(expected))).cast("long")})


def weighted(scored: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The mean of both accuracies weighted by length, rounded half to even to two places; 0 where there is no length."""
    mean = lambda c: F.when(F.sum("length") > 0, F.bround(F.sum(F.col(c) * F.col("length")) / F.sum("length"), 2)).otherwise(0.0)
    out = scored.groupBy(*by).agg(mean("accuracy").alias("accuracy"), mean("accuracy_fixed").alias("accuracy_fixed"), F.sum("length").alias("length"))
    return out.withColumn("improvement", F.bround(F.col("accuracy_fixed") - F.col("accuracy"), 2))


def bounding_box(rows: DataFrame, by: list[str], x: Column, y: Column, width: Column, height: Column) -> DataFrame:
    """The box around all rows; of no rows the one that nothing has been put in."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.min(x), F.lit(float(FAR))).alias("min_x"), F.coalesce(F.min(y), F.lit(float(FAR))).alias("min_y"),
        F.coalesce(F.max(x + width), F.lit(0.0)).alias("max_x"), F.coalesce(F.max(y + height), F.lit(0.0)).alias("max_y"),
    )


def locate_errors(errors: DataFrame, lines: DataFrame, chars: DataFrame) -> DataFrame:
    """``errors`` (line, column) with the x, y of their lines (line, x, y) and of their characters (line, column, x, y).

    The character meant is that of the column before; either place is null where there is none.
    """
    at = lines.select(F.col("line"), F.col("x").alias("line_x"), F.col("y").alias("line_y"))
    own = chars.select(F.col("line"), (F.col("column") + 1).alias("column"), F.col("x").alias("char_x"), F.col("y").alias("char_y"))
    return errors.join(at, "line", "left").join(own, ["line", "column"], "left")


def overlay_json(box: DataFrame, width: Column, height: Column, errors: Column) -> DataFrame:
    """What a viewer draws: dimensions, box and error places, as JSON in ``overlay``."""
    told = F.struct(
        F.struct(width.alias("width"), height.alias("height")).alias("dimensions"),
        F.struct("min_x", "min_y", "max_x", "max_y").alias("bbox"),
        errors.alias("errors"),
    )
    return box.withColumn("overlay", F.to_json(told))


TEST_CASES = "array<struct<input:string,output:string,hint:string>>"


def test_cases(rows: DataFrame, json: str) -> DataFrame:
    """One row a case: case_no and its input, expected output and hint; what a case lacks is empty."""
    each = rows.select("*", F.posexplode(F.from_json(json, TEST_CASES)).alias("case_no", "_c"))
    blank = lambda k: F.coalesce(F.col(f"_c.{k}"), F.lit(""))
    return each.withColumns({"input": blank("input"), "expected": blank("output"), "hint": blank("hint")}).drop("_c")


def test_results(cases: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Each case with ``passed``: its output is there and is what was expected."""
    out = cases.join(outputs, keys, "left")
    return out.withColumn("passed", F.coalesce(F.col("output") == F.col("expected"), F.lit(False)))


def output_or_default(output: Column) -> Column:
    return F.when(F.length(F.coalesce(output, F.lit(""))) == 0, F.lit(NO_OUTPUT)).otherwise(output)


def by_language(language: Column, choices: dict[str, Column], otherwise: Column | None = None) -> Column:
    """The choice of a language; an error for another, unless there is a choice for it."""
    out = F
    for name, value in choices.items():
        out = out.when(F.lower(language) == name, value)
    return out.otherwise(otherwise if otherwise is not None else F.raise_error(F.concat(F.lit("unknown language: "), language)))
