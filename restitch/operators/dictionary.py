"""Nearest-dictionary repair: an edit-distance join that is an equi-join underneath.

A term of length m is near at a ratio below 0.25, so within k = ceil(m / 4) - 1 edits, and lengths differ by k at
most.  Distinct tokens are joined once: equal ones by the token itself, the rest either by length (a dictionary
of checked size, broadcast once for each length it can match), or, for a large dictionary, by pieces: of a term's
k + 1 pieces one is untouched, and stands in the token shifted by k at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.functions import lattice
from restitch.operators import rules

#: Fixed value: the ratio of edits to a term's length must be less.
TOLERANCE = 0.25
#: Dictionaries of at most so many terms are joined by length; others by pieces.
SMALL = 5000


def edits_allowed(length: Column) -> Column:
    return F.greatest(F.ceil(length * TOLERANCE) - 1, F.lit(0)).cast("int")


def _by_length(tokens: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    reach = F.sequence(F.greatest(F.length("term") - F.col("k"), F.lit(0)), F.length("term") + F.col("k"))
    return tokens.withColumn("n", F.length("token")).join(F.broadcast(terms.withColumn("n", F.explode(reach))), [*by, "n"])


def _pieces(terms: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(term, ord, k, m, i, at, piece) and ``by``: each term of length m cut into k + 1 pieces."""
    m, k = F.length("term"), F.col("k")
    cut = lambda i: F.floor(i * m / (k + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), cut(i).alias("at"), F.col("term").substr(cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    return terms.select(*by, "term", "ord", "k", m.alias("m"), F.explode(pieces).alias("p")).select(*by, "term", "ord", "k", "m", "p.*")


def _probes(tokens: DataFrame, told: DataFrame, n: Column) -> DataFrame:
    """``tokens`` with m, i, start and size of every place where a piece of a term of length m may stand; n is a token's length."""
    shapes = told.groupBy("m", "i").agg(F.max("k").alias("k"), F.max("at").alias("at"), F.max(F.length("piece")).alias("size"))
    shapes = shapes.groupBy().agg(F.collect_list(F.struct("m", "i", "k", "at", "size")).alias("shapes"))  # as many as terms have lengths and pieces
    probes = tokens.withColumn("_n", n).crossJoin(F.broadcast(shapes)).select(*tokens.columns, "_n", F.explode(F.filter("shapes", lambda s: F.abs(s["m"] - F.col("_n")) <= s["k"])).alias("s"))
    starts = F.sequence(F.greatest(F.col("s.at") - F.col("s.k"), F.lit(0)), F.col("s.at") + F.col("s.k"))
    probes = probes.select(*tokens.columns, "_n", "s.m", "s.i", "s.size", F.explode(starts).alias("start"))
    return probes.where(F.col("start") + F.col("size") <= F.col("_n")).drop("_n")


def _by_pieces(tokens: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    told = _pieces(terms, by)
    probes = _probes(tokens, told, F.length("token")).select(*by, "token", "m", "i", F.col("token").substr(F.col("start") + 1, F.col("size")).alias("piece")).distinct()
    return probes.join(told, [*by, "m", "i", "piece"]).select(*by, "token", "term", "ord", "k").distinct()


def matches(tokens: DataFrame, terms: DataFrame, pieces: bool | None = None, by: list[str] | None = None) -> DataFrame:
    """(token, term, ratio) of the nearest term of each distinct ``token``, where one is near enough.

    ``terms`` has ``term`` and ``ord``; of terms at the same ratio the one with the least ord wins.  Both tables may have
    columns ``by``, such as a module: a token then meets the terms of its own key only, and the rows tell the key.
    ``pieces`` chooses the join; by default the size of the dictionary does.
    """
    by = by or []
    terms = terms.groupBy(*by, "term").agg(F.min("ord").alias("ord")).withColumn("k", edits_allowed(F.length("term")))
    tokens = tokens.select(*by, "token").where("token is not null").distinct()
    if pieces is None:
        pieces = terms.limit(SMALL + 1).count() > SMALL
    same = tokens.join(terms.withColumn("token", F.col("term")), [*by, "token"]).select(*by, "token", "term", F.lit(0.0).alias("ratio"))
    rest = tokens.join(same, [*by, "token"], "left_anti")
    fuzzy = terms.where("k > 0")
    pairs = (_by_pieces if pieces else _by_length)(rest, fuzzy, by)
    near = pairs.withColumn("d", F.levenshtein("token", "term")).where(F.col("d") <= F.col("k"))
    near = near.select(*by, "token", "term", "ord", (F.col("d") / F.length("term")).alias("ratio"))
    best = near.groupBy(*by, "token").agg(F.min_by(F.struct("term", "ratio"), F.struct("ratio", "ord")).alias("b"))
    return same.union(best.select(*by, "token", "b.term", "b.ratio"))


def repair(rows: DataFrame, token: str, terms: DataFrame, term_out: str = "repaired", ratio_out: str = "ratio", pieces: bool | None = None) -> DataFrame:
    """``rows`` with the nearest term of a column and its ratio; where none is near, the token itself and 0.25."""
    found = matches(rows.select(F.col(token).alias("token")), terms, pieces).toDF("_token", "_term", "_ratio")
    out = rows.join(found, rows[token] == found["_token"], "left")
    return out.withColumns({term_out: F.coalesce("_term", token), ratio_out: F.coalesce("_ratio", F.lit(TOLERANCE))}).drop("_token", "_term", "_ratio")


def _lattices_by_length(lattices: DataFrame, terms: DataFrame) -> DataFrame:
    reach = terms.withColumn("n", F.explode(F.sequence(F.greatest(F.length("term") - F.col("k"), F.lit(0)), F.length("term") + F.col("k"))))
    return lattices.withColumn("n", F.size("_cand")).join(F.broadcast(reach), "n").select("_cand", "term", "ord")


def _lattices_by_pieces(lattices: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs of a lattice and a term of which a piece stands, as it is, in some reading.

    A piece has four characters at most, so a place of it has at most KEPT ** 4 readings; a lattice is told by a number while
    pieces are met.
    """
    told = _pieces(terms)
    lattices = lattices.withColumn("_no", F.xxhash64("_cand")).withColumn("_c", lattice.capped(F.col("_cand")))
    probes = _probes(lattices.select("_no", "_c"), told, F.size("_c"))
    probes = probes.select("_no", "m", "i", F.explode(lattice.readings(F.slice("_c", F.col("start") + 1, F.col("size")))).alias("piece")).distinct()
    pairs = probes.join(told, ["m", "i", "piece"]).select("_no", "term", "ord").distinct()
    return pairs.join(lattices.select("_no", "_cand"), "_no").select("_cand", "term", "ord")


def nearest_readings(rows: DataFrame, cand: str, terms: DataFrame, pieces: bool | None = None) -> DataFrame:
    """``rows`` with ``term`` and ``ratio``: the nearest term of any reading of a lattice, else its first reading and 0.25.

    Each distinct lattice meets the terms of a length that can match, of a dictionary of checked size that is broadcast once
    for each length, or, for a larger one, the terms of which it can read a piece.  ``pieces`` chooses the join; by default the
    size of the dictionary does.  A small function tells the distance and reading of one lattice and one term; of equal
    ratios the lower reading wins, then the term with the least ord.
    """
    terms = terms.groupBy("term").agg(F.min("ord").alias("ord")).withColumn("k", edits_allowed(F.length("term")))
    if pieces is None:
        pieces = terms.limit(SMALL + 1).count() > SMALL
    lattices = rows.select(F.col(cand).alias("_cand")).where(F.col("_cand").isNotNull()).distinct()
    pairs = (_lattices_by_pieces if pieces else _lattices_by_length)(lattices, terms)

    @F.pandas_udf("struct<edits:int,reading:long>")
    def fit(cands: pd.Series, words: pd.Series) -> pd.DataFrame:
        got = [rules.distance([list(c) for c in cand], w) for cand, w in zip(cands, words, strict=True)]
        return pd.DataFrame(got, columns=["edits", "reading"]).astype({"edits": "Int32", "reading": "Int64"})

    found = pairs.select("_cand", "term", "ord", fit("_cand", "term").alias("d")).where(F.col("d.edits").isNotNull())
    found = found.withColumn("ratio", F.col("d.edits") / F.greatest(F.length("term"), F.lit(1)))
    best = found.groupBy("_cand").agg(F.min_by(F.struct("term", "ratio"), F.struct("ratio", "d.reading", "ord")).alias("_b"))
    out = rows.join(best.withColumnRenamed("_cand", "_of"), F.col(cand) == F.col("_of"), "left")
    first = F.array_join(F.transform(cand, lambda c: F.get(c, F.lit(0))), "")
    return out.withColumns({"term": F.coalesce("_b.term", first), "ratio": F.coalesce("_b.ratio", F.lit(TOLERANCE))}).drop("_of", "_b")


def repair_as_variable_or_import(rows: DataFrame, token: str, variables: DataFrame, imports: DataFrame) -> DataFrame:
    """``rows`` with ``repaired``, ``ratio`` and ``kind``: the nearer of a variable and an import, a variable if alike."""
    out = repair(repair(rows, token, variables, "_v", "_dv"), token, imports, "_i", "_di")
    local = F.col("_dv") <= F.col("_di")
    return out.withColumns(
        {"repaired": F.when(local, F.col("_v")).otherwise(F.col("_i")), "ratio": F.least("_dv", "_di"), "kind": F.when(local, "variable").otherwise("import")}
    ).drop("_v", "_dv", "_i", "_di")


def concat_dictionaries(*dictionaries: DataFrame) -> DataFrame:
    """One dictionary from several, each after the other: (scope, term)."""
    out = dictionaries[0]
    for d in dictionaries[1:]:
        out = out.unionByName(d)
    return out
