"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Replacements made in a repaired line, in this order.
LINE_REPLACEMENTS = [("--", "__"), ("''", '"'), (",,", '"')]
#: Fixed value: what stands for the code in a test template.
HOLE = "{}"


def compact(text: Column) -> Column:
    """``text`` without white space."""
    return F.regexp_replace(text, r"\s+", "")


def accuracy(found: Column, expected: Column) -> Column:
    """Percent of ``expected`` that ``found`` gets right by edit distance, white space aside; null where nothing is expected."""
    want = compact(expected)
    return F.bround(F.lit(100.0) - F.levenshtein(compact(found), want) * F.lit(100.0) / F.nullif(F.length(want), F.lit(0)), 0).cast("long")


def naive_fix(line: Column) -> Column:
    for find, put in LINE_REPLACEMENTS:
        line = F.replace(line, F.lit(find), F.lit(put))
    return line


def fill_template(template: Column, code: Column) -> Column:
    """The template with the code in its hole, whatever braces either holds."""
    return F.replace(template, F.lit(HOLE), code)


def indented(code: Column, depth: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth), code)


def restore_literal(token: Column) -> Column:
    """true, false and none with at most one, two and one edits as Python writes them; else the token."""
    near = lambda word, most: (F.levenshtein(token, F.lit(word), most) >= 0)
    return F.when(near("true", 1), "True").when(near("false", 2), "False").when(near("none", 1), "None").otherwise(token)


def split_args(args: Column) -> Column:
    """Arguments at top-level commas (parentheses nest), trimmed; none of a blank string.  A trailing comma adds an empty one.

    A parenthesis that closes none, and one that is left open, make the rest one argument.  One pass of an expression cuts
    what has no or closed parentheses, NESTED deep at most; what is nested deeper is cut at every comma, and a piece goes on
    with the next while more parentheses are open than closed.
    """
    flat = rf"^(?:[^()]|{_nested(NESTED)})*+$"
    pieces = F.regexp_extract_all(F.concat(args, F.lit(",")), F.lit(rf"((?:[^(),]|{_nested(NESTED)})*+),"), F.lit(1))
    whole = F.when(args.rlike(flat), pieces).otherwise(_split_deep(args))
    return F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.transform(whole, lambda p: F.trim(p)))


#: How deep parentheses nest for arguments to be cut in one pass.
NESTED = 6


def _nested(depth: int) -> str:
    """An expression for a pair of parentheses with such pairs inside."""
    return r"\([^()]*+\)" if depth == 1 else rf"\((?:[^()]|{_nested(depth - 1)})*+\)"


def _split_deep(args: Column) -> Column:
    pieces = F.split(args, ",", -1)
    count = lambda p, c: F.length(p) - F.length(F.replace(p, F.lit(c), F.lit("")))
    open_after = running_sum(F.transform(pieces, lambda p: count(p, "(") - count(p, ")")))
    marked = F.array_join(F.zip_with(pieces, open_after, lambda p, d: F.concat(p, F.when(d == 0, F.lit("\1")).otherwise(F.lit(",")))), "")
    return F.split(F.substr(marked, F.lit(1), F.length(marked) - 1), "\1", -1)


def running_sum(numbers: Column) -> Column:
    """The sums of an array of int up to each place."""
    start = F.struct(F.lit(0).alias("sum"), F.lit("").alias("told"))
    told = F.aggregate(numbers, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["told"], (a["sum"] + x).cast("string"), F.lit(",")).alias("told")))
    return F.transform(F.split(F.rtrim(told["told"], F.lit(",")), ","), lambda x: x.cast("int"))


def trimmed(text: Column, start: Column) -> Column:
    """(text, start, end) of a text that begins at ``start``, without blanks at its ends."""
    inner = F.trim(text)
    first = start + F.length(text) - F.length(F.ltrim(text))
    return F.struct(inner.alias("text"), first.alias("start"), (first + F.length(inner)).alias("end"))


def comma_names(names: Column) -> Column:
    return F.transform(F.split(names, ","), lambda n: F.trim(n))


#: Fixed value: how the Haskell compiler reports a position and a message.
HASKELL_REPORT = r"hs:(\d+):(\d+): (\w+):\W+([^\r\n]+)"


def haskell_reports(stderr: Column) -> Column:
    """An array of (line, column, type, message) of compiler output."""
    got = [F.regexp_extract_all(stderr, F.lit(HASKELL_REPORT), F.lit(k)) for k in range(1, 5)]
    # zipped, so that each pattern is applied once and not for every match
    return F.transform(
        F.arrays_zip(*got), lambda s: F.struct(s["0"].cast("int").alias("line"), s["1"].cast("int").alias("column"), s["2"].alias("type"), s["3"].alias("message"))
    )
