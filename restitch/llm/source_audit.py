"""Source divergence audit: how far the words of one source of a language lie from those of each other source.

The sum over all kept terms of a function of a term's two counts needs no walk over terms for each pair of sources: it
is the same for all terms with the same two counts.  So each pair of sources has a joint histogram, of how many terms
have which two counts; cells where both are above zero are tallied from the terms, those with a zero follow from
each source's own histogram and the number of terms.  The function is then told once a cell, times its terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restitch.llm.session import Scratch
from restitch.llm.textscan import settle, values

#: A language keeps the terms of so many of its documents; ranks of terms that are told; parts of a share.
MIN_DOCS, TOP_TERMS, UNITS = 3, 200, 1_000_000_000
#: Distinct terms that a task counts, and pairs of counts that it tallies, before it ships them.
SHIP_TERMS, SHIP_CELLS = 400_000, 2_000_000
#: Group sizes of at most so many groups (about 10 MB) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

#: What each byte of UTF-8 is in a term: letters in lower case, all bytes beyond ASCII themselves, a blank else.
_FOLD = bytes(b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and characters beyond ASCII, A-Z as a-z."""
    return text.translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: added up over the task's documents, and for each group a row without a term."""
    names = ["lang", "source", "term", "n", "docs"]

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            told, size = list(docs), len(docs) + 1
            kinds = pa.array([None, *told], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size), pa.array([source] * size), kinds, pa.array([0, *map(n.__getitem__, told)], pa.int64()), pa.array([0, *map(docs.__getitem__, told)], pa.int64())], names=names
            )

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for b in batches:
        for text, lang, source in values(*b.columns):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(docs)
            found = terms(text)
            n.update(found)
            docs.update(set(found))
            size += len(docs)
            if size > SHIP_TERMS:
                yield from out(held)
                held, size = {}, 0
    yield from out(held)
    settle()


def _pairs(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the given lengths, end to end: the places of each two members of a list, the earlier one first."""
    size = np.repeat(counts, counts)
    start = np.repeat(np.cumsum(counts) - counts, counts)
    after = size - (np.arange(len(size)) - start) - 1  # members that follow in the list
    a = np.repeat(np.arange(len(size)), after)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, ca, cb, m: of each two sources, how many of the task's terms have these two counts (none zero); a < b."""
    names = ["lang", "a", "b", "ca", "cb", "m"]
    langs: dict[str, int] = {}
    sources: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def merged() -> tuple[np.ndarray, ...]:
        *key, m = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort(key[::-1])
        key = [k[order] for k in key]
        first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0)))[: len(m)])
        return *[k[first] for k in key], np.add.reduceat(m[order], first) if len(first) else m

    def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        lang, a, b, ca, cb, m = rows
        named = lambda table, at: pa.array(list(table), pa.string()).take(pa.array(at))
        return pa.RecordBatch.from_arrays([named(langs, lang), named(sources, a), named(sources, b), pa.array(ca), pa.array(cb), pa.array(m)], names=names)

    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            lang = np.array([langs.setdefault(x, len(langs)) for x in part.column(0).to_pylist()], np.int64)
            flat = part.column(1).flatten()
            source = np.array([sources.setdefault(x, len(sources)) for x in flat.field(0).to_pylist()], np.int64)
            count = flat.field(1).to_numpy()
            size = np.diff(part.column(1).offsets.to_numpy())
            i, j = _pairs(size)
            for cut in range(0, len(i), SHIP_CELLS):
                x, y = i[cut : cut + SHIP_CELLS], j[cut : cut + SHIP_CELLS]
                of = np.repeat(lang, size)[x]
                held.append((of, source[x], source[y], count[x], count[y], np.ones(len(x), np.int64)))
                waiting += len(x)
                if waiting > SHIP_CELLS:
                    held = [merged()]
                    waiting = len(held[0][0])
                    if waiting > SHIP_CELLS // 2:
                        yield out(held[0])
                        held, waiting = [], 0
    if held:
        yield out(merged())
    settle()


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNITS * (count + 1) / total), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + 1) * F.lit(UNITS).cast("decimal(10,0)"), wide(total)) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), exactly: a share is below 2 ** 31."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the other sources by divergence, and its own terms.

    A language keeps the terms that ``min_docs`` of its rows have.  Part ``pair`` has a row for each other source of the
    language, with ``excess`` of the two sources' shares added up over all kept terms (0 without any); part ``term``
    has the kept terms that the source has at a larger share than the language, ``top`` at most.  The larger values come
    first, of equals the lesser item in UTF-8.  Null text, lang and source are read as ''; a group without terms takes
    part; a language with one source has no pairs; very long texts are taken whole; rows that repeat a document count
    as documents; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text, lang, source = (F.coalesce(c, F.lit("")) for c in ("text", "lang", "source"))
    read = docs.select(text.cast("binary").alias("text"), lang.alias("lang"), source.alias("source"))
    seen = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = seen.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term's counts by source: as many as its language has sources, each pair of which is a row of the result
    kept = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = kept.where(F.col("term").isNull() | (F.col("docs") >= min_docs))  # most terms go
    kept = scratch.table(kept.select("lang", "term", F.array_sort("held").alias("held")))
    named = kept.where("term is not null")
    size = named.groupBy("lang").agg(F.count("*").alias("v"))
    counts = named.select("lang", "term", F.inline("held"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = kept.where("term is null").select("lang", F.explode("held.source").alias("source"))
    groups = groups.join(size, "lang", "left").join(total, ["lang", "source"], "left").select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))
    groups, found = scratch.counted(groups)
    small = F.broadcast if found["rows"] <= BROADCAST_GROUPS else lambda df: df
    result = _by_pair(named, counts, groups, scratch).unionByName(_by_term(named, groups, small, top))
    return result.select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def _by_pair(named: DataFrame, counts: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    one, two = groups.toDF("lang", "a", "v", "na"), groups.select("lang", F.col("source").alias("b"), F.col("n").alias("nb"))
    pairs = scratch.table(one.join(two, "lang").where("a < b"))  # half the rows of the result
    joint = scratch.table(named.select("lang", "held").mapInArrow(_tallied, "lang string, a string, b string, ca long, cb long, m long").groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")))
    own = scratch.table(counts.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m")))
    no = F.lit(0).cast("long")

    def cells(rows: DataFrame, *told: tuple[Column, Column, Column]) -> DataFrame:
        made = [F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m")) for ca, cb, m in told]
        return rows.select("lang", "a", "b", F.inline(F.array(*made)))

    m, ca, cb, c = (F.col(x) for x in ("m", "ca", "cb", "c"))
    all_cells = cells(joint, (ca, cb, m), (ca, no, -m), (no, cb, -m), (no, no, m))
    all_cells = all_cells.unionByName(cells(pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]), (c, no, m), (no, no, -m)))
    all_cells = all_cells.unionByName(cells(pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]), (no, c, m), (no, no, -m)))
    all_cells = all_cells.unionByName(cells(pairs, (no, no, F.col("v"))))
    all_cells = all_cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    p, q = share(ca, F.col("na") + F.col("v")), share(cb, F.col("nb") + F.col("v"))
    told = all_cells.join(pairs, ["lang", "a", "b"]).select("lang", "a", "b", "m", p.alias("p"), q.alias("q"))
    sums = told.groupBy("lang", "a", "b").agg(F.sum(excess(F.col("p"), F.col("q")) * m).alias("there"), F.sum(excess(F.col("q"), F.col("p")) * m).alias("back"))
    sums = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left")
    way = lambda x, y, value: F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(value).alias("value"))
    ways = F.array(way("a", "b", "there"), way("b", "a", "back"))
    rows = sums.select("lang", F.inline(ways)).withColumn("value", F.coalesce("value", no))
    return _ranked(rows).withColumn("part", F.lit("pair"))


def _by_term(named: DataFrame, groups: DataFrame, small, top: int) -> DataFrame:
    whole = F.aggregate("held", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    rows = named.select("lang", "term", whole.alias("all"), F.inline("held"))
    langs = groups.groupBy("lang").agg(F.first("v").alias("v"), F.sum("n").alias("of_lang"))
    about = groups.select("lang", "source", F.col("n").alias("of_source")).join(langs, "lang")
    p, q = share(F.col("n"), F.col("of_source") + F.col("v")), share(F.col("all"), F.col("of_lang") + F.col("v"))
    rows = rows.join(small(about), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).where(F.col("rank") <= top).withColumn("part", F.lit("term"))


def oracle_sql() -> str:
    """The same rows in DuckDB, with every term of every pair."""
    share_of = lambda c, n: f"(1 + ({UNITS}::HUGEINT * ({c} + 1)) // ({n} + v))"
    excess_of = "((p - q) * (p - q)) // q"
    return f"""
        WITH read AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), words AS (
            SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM read
        ), kept AS (
            SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT i) >= {MIN_DOCS}
        ), sizes AS (
            SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), groups AS (
            SELECT DISTINCT read.lang, source, coalesce(v, 0) AS v FROM read LEFT JOIN sizes USING (lang)
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
        ), full_counts AS (
            SELECT g.lang, g.source, v, k.term, coalesce(n, 0) AS n, coalesce(sum(n) OVER (PARTITION BY g.lang, g.source), 0) AS of_source,
                sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, k.term) AS n_lang, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang) AS of_lang
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), shares AS (
            SELECT *, {share_of("n", "of_source")} AS p, {share_of("n_lang", "of_lang")} AS p_lang FROM full_counts
        ), pair_values AS (
            SELECT a.lang, a.source, b.source AS item, sum({excess_of.replace("p", "a.p").replace("q", "b.p")}) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), told AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
            FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
            LEFT JOIN pair_values z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
            UNION ALL
            SELECT lang, source, 'term', term, {excess_of.replace("q", "p_lang")} FROM shares WHERE n > 0 AND p > p_lang
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
