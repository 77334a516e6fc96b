"""URL filters: host and path rules, and association rules for the urls that no such rule fits.

Urls that a rule fits are labelled by its verdict.  FP-growth finds the token combinations that are frequent
among them, of any number of tokens; those that go with one verdict at a high confidence become association rules,
the specific ones only where they are surer than all the general.  Rules are indexed by their rarest token, so a url is compared with
the few rules of its own tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.llm.session import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the contract of the filter: (verdict, host, path).
HOST_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
#: So many tokens of a row, those that tell most, make combinations of three and more in FP-growth; ``_longer`` makes the others.
MAX_WIDTH = 16


def host_of(url: Column) -> Column:
    """What lies between the first "://" and the next "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F, F
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: labels of its host by place, segments of its path with digits as #, its query's keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    steps = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_distinct(F.concat(tag("host", labels), tag("path", steps), tag("query", names)))


@dataclass(frozen=True)
class TokenRule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: int

    def order(self) -> tuple:
        """The rule that is first in this order decides."""
        return (-self.confidence, -self.support, len(self.tokens), self.verdict != "block", self.tokens)


def _alike(labelled: DataFrame, min_support: float, n: int) -> list:
    """(token, n, most, verdict, two sums) of each frequent token; tokens of the same rows have the same sums.

    A token is in one of 1 / min_support rows at least, so there are at most 1 / min_support times as many as a row has on average.
    """
    mark = F.xxhash64("tokens", "verdict")
    marks = [F.pmod(mark, F.lit(1 << 30)).alias("x"), F.pmod(F.shiftright(mark, 30), F.lit(1 << 30)).alias("y")]
    each = labelled.select("verdict", *marks, F.explode("tokens").alias("t")).groupBy("t", "verdict").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    told = each.groupBy("t").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("verdict", "n").alias("verdict"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return told.where(F.col("n") >= math.ceil(min_support * n)).collect()


def _pairs(labelled: DataFrame, have: Column, names: Column, least: int) -> DataFrame:
    """own, alone, verdict and freq of the frequent pairs of all tokens, whatever the width of their rows."""
    after = lambda h: F.transform(h, lambda x, i: F.transform(F.slice(h, i + 2, F.size(h)), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    each = labelled.select("verdict", have.alias("h")).select("verdict", F.inline(F.flatten(after(F.col("h")))))
    each = each.groupBy("x", "y", "verdict").agg(F.count("*").alias("freq"))
    by = each.groupBy("x", "y").agg(F.sum("freq").alias("alone"), F.collect_list(F.struct("verdict", "freq")).alias("by"))  # a row a verdict
    own = F.array_sort(F.array(F.element_at(names, F.col("x") + 1), F.element_at(names, F.col("y") + 1)))
    by = by.where(F.col("alone") >= least).select(own.alias("own"), "alone", F.inline("by"))
    return by.where(F.col("freq") >= least).select("own", "alone", F.concat(F.lit("="), "verdict").alias("verdict"), "freq")


def _longer(labelled: DataFrame, have: Column, names: Column, first: int, least: int, scratch: Scratch) -> DataFrame | None:
    """own, alone, verdict and freq of the frequent combinations of three and more tokens with one of the ``first``, whatever the width of their rows.

    Level by level, by joins: a combination grows by a later token of the rows that hold it, while its rows go with more than
    one verdict, so that a longer one can be surer, and are fewer than those of the combination that it grew from.  What it
    holds lies in Spark's tables; there are as many levels as the longest such combination has tokens.
    """
    rows = labelled.select("verdict", have.alias("h")).where(F.size("h") > 2).groupBy("verdict", "h").agg(F.count("*").alias("n"))
    level = scratch.table(rows.select("*", F.array().cast("array<int>").alias("s"), F.lit(None).cast("long").alias("before")))
    told: list[DataFrame] = []
    width = 0
    while True:
        width += 1
        later = F.filter("h", lambda x: x < first) if width == 1 else F.filter("h", lambda x: x > F.element_at("s", -1))
        grown = level.select("verdict", "h", "n", "s", "before", F.explode(later).alias("x")).select("verdict", "h", "n", F.concat("s", F.array("x")).alias("s"), "before")
        each = grown.groupBy("s", "verdict").agg(F.sum("n").alias("freq"), F.first("before").alias("before"))
        by = each.groupBy("s").agg(F.sum("freq").alias("alone"), F.max("freq").alias("most"), F.collect_list(F.struct("verdict", "freq")).alias("by"), F.first("before").alias("before"))
        by, n = scratch.counted(by.where((F.col("most") >= least) & (F.col("before").isNull() | (F.col("alone") < F.col("before")))))
        if not n["rows"]:
            break
        if width > 2:
            own = F.array_sort(F.transform("s", lambda k: F.element_at(names, k + 1)))
            each = by.select(own.alias("own"), "alone", F.inline("by")).where(F.col("freq") >= least)
            told.append(each.select("own", "alone", F.concat(F.lit("="), "verdict").alias("verdict"), "freq"))
        mixed = by.where(F.col("most") < F.col("alone")).select("s", F.col("alone").alias("before"))
        last, level = level, scratch.table(grown.drop("before").join(mixed, "s"))
        scratch.drop(last)
    return reduce(DataFrame.unionByName, told) if told else None


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, whole: bool = False) -> tuple[list[TokenRule], dict[str, str]]:
    """Rules of a table with ``tokens`` (distinct strings) and ``verdict``, and the token that stands for each.

    What can't add a rule isn't mined: tokens of the same rows are one (the first of them stands for all); a token
    that goes with one verdict always, or is in all rows, makes a rule by itself and none with others that is surer.
    Pairs are made of all tokens.  Of a row with more than MAX_WIDTH other tokens those that tell most of the verdict make
    longer combinations, so no row yields more than 2 ** MAX_WIDTH of these; if the rules are to be ``whole``, combinations with
    a token that some row has beyond these are made level by level (``_longer``), and FP-growth makes those without.
    Combinations and their confidence stay in Spark; confident ones come to the driver
    one by one, short ones first, and only those that no shorter rule makes needless are held.
    """
    labelled = labelled.where("size(tokens) > 0 and verdict is not null")
    total = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # a row a verdict
    n = sum(total.values())
    if not n:
        return [], {}
    least = max(1, math.ceil(min_support * n))
    frequent = sorted(_alike(labelled, min_support, n), key=lambda r: r["t"])
    first: dict[tuple, str] = {}
    stands = {r["t"]: first.setdefault((r["n"], r["x"], r["y"]), r["t"]) for r in frequent}
    own = [r for r in frequent if stands[r["t"]] == r["t"]]
    kept = [TokenRule((r["t"],), r["verdict"], r["most"] / r["n"], r["most"]) for r in own if r["most"] >= least and r["most"] / r["n"] >= min_confidence]
    of: dict[tuple[str, str], list[TokenRule]] = {}  # kept rules by first token and verdict
    for r in kept:
        of.setdefault((r.tokens[0], r.verdict), []).append(r)
    base = max(total.values()) / n
    tells = lambda r: -abs(r["most"] / r["n"] - base) * math.sqrt(r["n"])
    mined = [r["t"] for r in sorted((r for r in own if r["most"] < r["n"] < n), key=lambda r: (tells(r), r["t"]))]
    if len(mined) < 2:
        return sorted(kept, key=TokenRule.order), stands

    def places(told: list[str]) -> tuple[Column, Column]:
        place = F.create_map(*[F.lit(x) for k, t in enumerate(told) for x in (t, k)])
        return F.array(*map(F.lit, told)), F.array_sort(F.array_compact(F.transform("tokens", lambda t: F.element_at(place, t))))

    names, every = places(mined)
    wide = labelled.agg(F.max(F.size(every)).alias("w")).first()["w"] > MAX_WIDTH
    have, beyond = F.slice(every, 1, MAX_WIDTH), 0
    if wide and whole:
        cut = {r["k"] for r in labelled.select(F.explode(F.slice(every, MAX_WIDTH + 1, len(mined))).alias("k")).distinct().collect()}  # a row a frequent token at most
        mined = [t for k, t in enumerate(mined) if k in cut] + [t for k, t in enumerate(mined) if k not in cut]
        beyond, (names, every) = len(cut), places(mined)
        have = F.filter(every, lambda k: k >= beyond)
    items = F.concat(F.transform(have, lambda k: F.element_at(names, k + 1)), F.array(F.concat(F.lit("="), "verdict")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(labelled.select(items.alias("items")))
    told = lambda x: x.startswith("=")
    rest, verdict = F.array_sort(F.filter("items", lambda x: ~told(x))), F.get(F.filter("items", told), F.lit(0))
    sets = model.freqItemsets.select(rest.alias("own"), verdict.alias("verdict"), "freq").where("size(own) > 1")
    by = F.collect_list(F.when(F.col("verdict").isNotNull(), F.struct("verdict", "freq")))  # a row a verdict
    sets = sets.groupBy("own").agg(F.sum(F.when(F.col("verdict").isNull(), F.col("freq"))).alias("alone"), by.alias("by"))
    sets = sets.select("own", "alone", F.explode("by").alias("by")).select("own", "alone", "by.verdict", "by.freq")
    scratch = Scratch(labelled.sparkSession)
    if wide:
        sets = sets.where("size(own) > 2").unionByName(_pairs(labelled, every, names, least))
        longer = _longer(labelled, every, names, beyond, least, scratch) if beyond else None
        sets = sets if longer is None else sets.unionByName(longer)
    sure = sets.where(F.col("freq").cast("double") / F.col("alone") >= min_confidence).orderBy(F.size("own"))
    for r in sure.toLocalIterator():
        rule = TokenRule(tuple(sorted(r["own"])), r["verdict"][1:], r["freq"] / r["alone"], r["freq"])
        have = set(rule.tokens)
        if not any(g.confidence >= rule.confidence and have.issuperset(g.tokens) for t in rule.tokens for g in of.get((t, rule.verdict), ())):
            kept.append(rule)
            of.setdefault((rule.tokens[0], rule.verdict), []).append(rule)
    scratch.drop_others()
    return sorted(kept, key=TokenRule.order), stands


class Index:
    """Rules by their rarest token (by the number of rules that have it)."""

    def __init__(self, rules: list[TokenRule], stands: dict[str, str] | None = None):
        self.stands = stands or {}
        n: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                n[t] = n.get(t, 0) + 1
        self.rules = rules
        self.of: dict[str, list[int]] = {}
        for k, r in enumerate(rules):  # in order, so the lowest number that fits decides
            self.of.setdefault(min(r.tokens, key=lambda t: (n[t], t)), []).append(k)

    def verdict(self, tokens: list[str]) -> str | None:
        have, best = {self.stands.get(t, t) for t in tokens}, len(self.rules)
        for t in have:
            for k in self.of.get(t, ()):
                if k >= best:
                    break
                if have.issuperset(self.rules[k].tokens):
                    best = k
                    break
        return self.rules[best].verdict if best < len(self.rules) else None


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = HOST_RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule, mined or default) of each row of ``pages``.

    A null url, or one without "://", has an empty host and path and no tokens: no rule fits, and the default
    verdict is allow.  Rows that repeat an id or a url are judged alike, a very long url by all its tokens.  Where no url
    has a label, nothing is mined and the default decides; an empty table gives no rows; other columns, whatever their
    names, are ignored.
    """
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    at = at.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("told"), tokens_of(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    index = Index(*mine(at.select("tokens", F.col("told").alias("verdict")), min_support, min_confidence, whole=True))

    @F.pandas_udf(T.StringType())
    def mined(tokens: pd.Series) -> pd.Series:
        return pd.Series([index.verdict(list(t)) for t in tokens], dtype=object)

    out = at.select("page_id", "host", "path", "rule", "told", mined("tokens").alias("mined"))
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("told", "mined", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("told").isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias("by"),
    )


def oracle_sql() -> str:
    """The same for DuckDB, with the frequent combinations counted by joins; rules of more than two tokens are beyond it."""
    host = f"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    ordered = sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"{f} '{h + p}'" for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    told = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    tag = lambda kind, xs: f"list_transform(list_filter({xs}, lambda x: x <> ''), lambda x: '{kind}:' || x)"
    query = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^?#]*\\?([^#]*)', 1)"
    tokens = (
        "list_distinct("
        + tag("host", "string_split(host, '.')")
        + " || "
        + tag("path", "string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/')")
        + " || "
        + tag("query", f"list_transform(string_split({query}, '&'), lambda x: string_split(x, '=')[1])")
        + ")"
    )
    return f"""
        WITH parts AS (
            SELECT row_number() OVER () AS r, page_id, url, {host} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
        ), pages_at AS (
            SELECT r, page_id, host, path, {rule} AS rule, {told} AS told, {tokens} AS tokens FROM parts
        ), single AS (
            SELECT r, told, unnest(tokens) AS t FROM pages_at
        ), combos AS (
            SELECT r, told, t AS a, NULL AS b FROM single
            UNION ALL SELECT x.r, x.told, x.t, y.t FROM single x JOIN single y ON x.r = y.r AND x.t < y.t
        ), least AS (
            SELECT ceil({MIN_SUPPORT} * count(*)) AS n FROM pages_at WHERE told IS NOT NULL AND len(tokens) > 0
        ), alone AS (
            SELECT a, b, count(*) AS n FROM combos WHERE told IS NOT NULL GROUP BY a, b
        ), sure AS (
            SELECT c.a, c.b, c.told, count(*) AS n, count(*) / any_value(alone.n) AS confidence
            FROM combos c JOIN alone ON c.a = alone.a AND c.b IS NOT DISTINCT FROM alone.b WHERE c.told IS NOT NULL GROUP BY c.a, c.b, c.told
            HAVING count(*) >= (SELECT n FROM least) AND count(*) / any_value(alone.n) >= {MIN_CONFIDENCE}
        ), pruned AS (
            SELECT * FROM sure s WHERE b IS NULL OR NOT EXISTS (
                SELECT 1 FROM sure g WHERE g.b IS NULL AND (g.a = s.a OR g.a = s.b) AND g.told = s.told AND g.confidence >= s.confidence)
        ), ranked AS (
            SELECT *, row_number() OVER (ORDER BY confidence DESC, n DESC, b IS NOT NULL, told <> 'block', a, b) AS k FROM pruned
        ), mined AS (
            SELECT c.r, arg_min(ranked.told, k) AS told FROM combos c JOIN ranked ON c.a = ranked.a AND c.b IS NOT DISTINCT FROM ranked.b GROUP BY c.r
        )
        SELECT page_id, host, path, rule, coalesce(p.told, m.told, '{DEFAULT}') AS verdict,
               CASE WHEN p.told IS NOT NULL THEN 'rule' WHEN m.told IS NOT NULL THEN 'mined' ELSE 'default' END AS by
        FROM pages_at p LEFT JOIN mined m USING (r)"""
