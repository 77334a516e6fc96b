"""Benchmark decontamination by a positional inverted index of the training texts.

Each training text is cut into words, and of every word that a test text holds a posting (term, text, place) is
stored, sorted by term inside each part of the corpus; parts are those of the input, so a frequent term's postings
are spread over all of them and nothing is shuffled to store them.  A window of test words is met by the lists of
its two rarest terms, each taken back by the term's place in the test text: where both name the same start in the
same text the window may stand, and the lists of all its other terms are then intersected at that start.  Starts at
which consecutive words of a test text stand make up runs, so windows that overlap are told once.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restitch.llm.session import Scratch

#: Words of a window.
WINDOW = 10
#: Tables about the test texts of at most so many rows (under 64 MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

_UPPER, _FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The number of the term that stands for a text as a whole: one posting each, with its id and number of words.
_TEXT = 0


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and characters beyond ASCII, A-Z as a-z; none of a null text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # lower() is faster, and changes A-Z alone in ASCII
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _FOLDED)), F.lit(WORD), F.lit(0))


class Test:
    """The test texts, cut into words: ``terms`` (term, name) and ``places`` (item_id, item, n, place, term).

    ``item`` numbers the distinct texts under their ids; rows that repeat both are one.
    """

    def __init__(self, items: DataFrame, scratch: Scratch):
        cut = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).distinct().where("size(w) > 0")
        cut = scratch.table(cut.withColumn("item", F.monotonically_increasing_id()))
        flat = cut.select("item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("place", "name"))
        # numbers from 1, so that term 0 is free
        self.terms, seen = scratch.counted(flat.select("name").distinct().withColumn("term", F.monotonically_increasing_id() + 1))
        self.places, placed = scratch.counted(flat.join(self.terms, "name").drop("name"))
        self.small = max(seen["rows"], placed["rows"]) <= BROADCAST_ROWS

    def near(self, df: DataFrame) -> DataFrame:
        """A table of a row a term or place at most, as the side of a join that may be broadcast."""
        return F.broadcast(df) if self.small else df


def index(docs: DataFrame, test: Test, scratch: Scratch) -> DataFrame:
    """Postings: term, a, b, place (from 1), and for the posting of the text itself doc_id and n_words.

    ``a`` and ``b``, 128 bits of id and text, stand for a row; rows with the same id and text have the same and are told
    alike.
    """
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.xxhash64("doc_id", text).alias("a"), F.xxhash64(F.lit(1), text, F.lit(2), "doc_id").alias("b"), words(F.col("text")).alias("w"))
    flat = cut.select("doc_id", "a", "b", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("place", "name"))
    itself = docs.sparkSession.range(1).select(F.lit("").alias("name"), F.lit(_TEXT).cast("long").alias("term"))
    found = flat.join(test.near(test.terms.select("name", "term").union(itself)), "name")
    whole = lambda c: F.when(F.col("term") == _TEXT, F.col(c))
    postings = found.select("term", "a", "b", "place", whole("doc_id").alias("doc_id"), whole("n").cast("long").alias("n_words"))
    return scratch.table(postings.sortWithinPartitions("term"))


def _windows(test: Test, postings: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """item, n, first (place of its first word), length, and its rarest terms t1, t2 with their places p1, p2 (null, if it has one word).

    Windows with a term that no training text holds are left out: they stand nowhere.
    """
    often = postings.where(F.col("term") != _TEXT).groupBy("term").count()
    often = scratch.table(often)
    # a test text's places in order, each with those that follow it in its window
    w = Window.partitionBy("item").orderBy("place").rowsBetween(Window.currentRow, size - 1)
    told = test.places.join(test.near(often), "term", "left").withColumn("_w", F.collect_list(F.struct(F.col("count").alias("n"), "term", "place")).over(w))
    told = told.where((F.size("_w") == size) | ((F.col("n") < size) & (F.col("place") == 0)))
    told = told.where(F.forall("_w", lambda s: s["n"].isNotNull())).withColumn("_r", F.array_sort("_w"))
    rarest = [F.get("_r", F.lit(i))[k].alias(f"{k[0]}{i + 1}") for i in (0, 1) for k in ("term", "place")]
    return scratch.table(told.select("item", "n", F.col("place").alias("first"), F.size("_w").alias("length"), *rarest))


def _starts(test: Test, postings: DataFrame, windows: DataFrame, slop: int, scratch: Scratch) -> DataFrame:
    """a, b, item, t1, p1, p2, diag: where the lists of a window's two rarest terms meet.

    ``diag`` is where the test text's first word then stands; with ``slop`` the second term may stand as far from
    its place.  The lists of windows with the same two terms are intersected once.
    """
    pair = windows.select("item", "t1", "p1", "t2", "p2").distinct()
    rare = pair.select("item", F.col("t1").alias("term"), F.col("p1").alias("at"), "p1", "p2", F.lit(1).alias("role"))
    rare = scratch.table(rare.union(pair.where("t2 is not null").select("item", "t2", "p2", "p1", "p2", F.lit(2))))
    met = postings.select("term", "a", "b", "place").join(test.near(rare), "term")
    off = F.when(F.col("role") == 2, F.sequence(F.lit(-slop), F.lit(slop))).otherwise(F.array(F.lit(0)))
    met = met.select("a", "b", "item", "p1", "p2", "role", F.explode(F.transform(off, lambda o: F.col("place") - F.col("at") + o)).alias("diag"))
    both = met.groupBy("a", "b", "item", "p1", "p2", "diag").agg(F.bit_or(F.col("role")).alias("roles"))
    return scratch.table(both.where((F.col("roles") == 3) | (F.col("p2").isNull() & (F.col("roles") == 1))).drop("roles"))


def _of_texts(postings: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """The postings of texts in which a window may stand, if these are few enough to be broadcast; else all, which the next join sorts out."""
    texts, seen = scratch.counted(starts.select("a", "b").distinct())
    return postings.join(F.broadcast(texts), ["a", "b"], "left_semi") if seen["rows"] <= BROADCAST_ROWS else postings


def phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of words of a test text that stand in a training text: doc_id, a, b, item_id, doc_start (from 1), item_start (from 0), length.

    Each has ``window`` words or more, or the whole test text, if that has fewer.
    """
    scratch = Scratch(docs.sparkSession)
    test = Test(items, scratch)
    return _named(_phrases(test, index(docs, test, scratch), window, scratch), test)


def _named(found: DataFrame, test: Test) -> DataFrame:
    return found.join(test.near(test.places.where("place = 0").select("item", "item_id")), "item")


def _phrases(test: Test, postings: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    windows = _windows(test, postings, window, scratch)
    starts = _starts(test, postings, windows, 0, scratch)
    postings = _of_texts(postings, starts, scratch)
    # every place of the windows that may stand at a start, once
    same = windows.select("item", "p1", "p2", "n", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("place")).distinct()
    same = scratch.table(same.join(test.places.select("item", "place", "term"), ["item", "place"]))
    wanted = starts.alias("s").join(test.near(same).alias("w"), F.expr("s.item = w.item and s.p1 = w.p1 and s.p2 <=> w.p2"))
    wanted = wanted.select("a", "b", "s.item", "n", "diag", F.col("w.place").alias("at"), "term").distinct().withColumn("place", F.col("diag") + F.col("at"))
    stands = wanted.join(postings.select("a", "b", "term", "place"), ["a", "b", "term", "place"]).select("a", "b", "item", "n", "diag", "at").distinct()
    # consecutive places make runs
    w = Window.partitionBy("a", "b", "item", "diag").orderBy("at")
    runs = stands.withColumn("_run", F.col("at") - F.row_number().over(w)).groupBy("a", "b", "item", "n", "diag", "_run").agg(F.min("at").alias("item_start"), F.count("*").alias("length"))
    runs = runs.where(F.col("length") >= F.least(F.lit(window), F.col("n")))
    return runs.select("a", "b", "item", (F.col("diag") + F.col("item_start")).alias("doc_start"), "item_start", "length")


def proximity(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """Windows of test words that stand in a training text with each word within ``slop`` of its place: a, b, item_id, doc_start, item_start, length, exact.

    Places are counted from the window's rarest word; ``exact`` says that all words stand in theirs.
    """
    scratch = Scratch(docs.sparkSession)
    test = Test(items, scratch)
    postings = index(docs, test, scratch)
    windows = _windows(test, postings, window, scratch)
    starts = _starts(test, postings, windows, slop, scratch)
    postings = _of_texts(postings, starts, scratch)
    inside = windows.select("item", "first", "length", "p1", "p2", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("place"))
    inside = scratch.table(inside.join(test.places.select("item", "place", "term"), ["item", "place"]))
    wanted = starts.alias("s").join(test.near(inside).alias("w"), F.expr("s.item = w.item and s.p1 = w.p1 and s.p2 <=> w.p2"))
    wanted = wanted.select("a", "b", "s.item", "first", "length", "diag", F.col("w.place").alias("at"), "term")
    off = F.col("_place") - F.col("diag") - F.col("at")
    near = wanted.join(postings.select("a", "b", "term", F.col("place").alias("_place")), ["a", "b", "term"]).where(F.abs(off) <= slop)
    near = near.groupBy("a", "b", "item", "first", "length", "diag", "at").agg(F.min(F.abs(off)).alias("off"))
    near = near.groupBy("a", "b", "item", "first", "length", "diag").agg(F.count("*").alias("met"), F.max("off").alias("off")).where("met = length")
    told = near.select("a", "b", "item", (F.col("diag") + F.col("first")).alias("doc_start"), F.col("first").alias("item_start"), "length", (F.col("off") == 0).alias("exact"))
    return _named(told, test)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts the words inside any occurrence of a window of ``window`` consecutive words of a test text (all its
    words, if it has fewer); ``n_items`` the test ids with such windows, ``items_sha256`` is the digest of those, sorted as
    strings and joined by commas.  A null text has no words, and a null test id is told as ''.  Very long texts are
    taken whole; rows that repeat an id, a text or both are rows of their own; test rows that share an id are one item.
    An empty table of documents gives no rows, without test texts nothing is hit; other columns, whatever their names,
    are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    test = Test(items, scratch)
    postings = index(docs, test, scratch)
    found = scratch.table(_named(_phrases(test, postings, window, scratch), test))
    # words in overlapping occurrences count once
    spans = found.groupBy("a", "b", "doc_start").agg(F.max("length").alias("length"))
    w = Window.partitionBy("a", "b").orderBy("doc_start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("doc_start") + F.col("length")
    before = F.coalesce(F.max(end).over(w), F.lit(0))
    hits = spans.withColumn("_new", F.greatest(end - F.greatest(F.col("doc_start"), before), F.lit(0))).groupBy("a", "b").agg(F.sum("_new").alias("n_hit"))
    ids = found.groupBy("a", "b").agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("ids"))
    texts = postings.where(F.col("term") == _TEXT).select("a", "b", "doc_id", "n_words")
    scratch.drop_others(postings, found)
    out = texts.join(hits.join(ids, ["a", "b"]), ["a", "b"], "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    """The same rows in DuckDB: windows of all texts as strings."""
    cut = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_FOLDED}'), '{WORD}')"
    return f"""
        WITH d AS (
            SELECT row_number() OVER () AS i, doc_id, {cut("text")} AS w FROM documents
        ), t AS (
            SELECT item_id, {cut("text")} AS w, least(len(w), {window}) AS l FROM benchmark
        ), wanted AS (
            SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS g
            FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM t WHERE l > 0)
        ), grams AS (
            SELECT i, l, s, array_to_string(w[s:s + l - 1], ' ') AS g
            FROM (SELECT i, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM wanted) WHERE len(w) >= l)
        ), hits AS (
            SELECT i, s, l, item_id FROM grams JOIN wanted USING (l, g)
        ), covered AS (
            SELECT i, count(*) AS n_hit FROM (SELECT DISTINCT i, unnest(range(s, s + l)) AS at FROM hits) GROUP BY i
        ), ids AS (
            SELECT i, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT i, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY i
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (i) LEFT JOIN ids USING (i)"""
