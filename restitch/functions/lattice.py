"""Candidate lattices as Spark columns: an array of candidate lists, one for each place of a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least probability of a candidate, candidates kept of an ambiguous place, and readings of a line.
MIN_PROBABILITY, KEPT, MOST = 0.025, 3, 1 << 16


def softmax(scores: Column, scale: float = 1.0) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x.cast("double") * scale))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def scaled_pixels(pixels: Column) -> Column:
    """Pixels of 0 to 255 as 0 to 1."""
    return F.transform(pixels, lambda v: v.cast("float") / F.lit(255.0).cast("float"))


def ranked(probabilities: Column) -> Column:
    """(p, idx) structs, the most probable first; of equals the larger index first."""
    told = F.transform(probabilities, lambda p, i: F.struct(p.alias("p"), i.alias("idx")))
    return F.reverse(F.array_sort(told))


def char_of(idx: Column, codepoints: Column) -> Column:
    return F.chr(F.element_at(codepoints, idx + 1))


def candidates(probabilities: Column, codepoints: Column) -> Column:
    """Distinct lower-case characters of the classes above MIN_PROBABILITY, the most probable first."""
    likely = F.filter(ranked(probabilities), lambda s: s["p"] > MIN_PROBABILITY)
    return F.array_distinct(F.transform(likely, lambda s: F.lower(char_of(s["idx"], codepoints))))


def top_char(probabilities: Column, codepoints: Column) -> Column:
    """The most probable class's character, in its own case."""
    return char_of(F.element_at(ranked(probabilities), 1)["idx"], codepoints)


def spell(text: Column, confusions: dict[str, list[str]]) -> Column:
    """The lattice of a text whose characters may be misread as given; a character's own reading comes first where listed so."""
    table = F.create_map(*[x for c, others in confusions.items() for x in (F.lit(c), F.array(*map(F.lit, others)))])
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(table, c), F.array(c)))


def with_char(rows: DataFrame, idx: str, class_map: DataFrame, out: str) -> DataFrame:
    """``rows`` with the character of a class, by a table of classes (class_idx, codepoint); null for one that it lacks."""
    known = class_map.select(F.col("class_idx").alias("_class"), F.chr(F.col("codepoint")).alias(out))
    return rows.join(F.broadcast(known), F.col(idx) == F.col("_class"), "left").drop("_class")  # a row for each of the classifier's classes


def readings_of_text(text: Column, confusions: dict[str, list[str]]) -> tuple[Column, Column]:
    """(reading count capped at MOST, ambiguous places) of ``spell``'s lattice of a text, from its letters' counts."""
    many = {c: min(len(o), KEPT) for c, o in confusions.items() if len(o) > 1}
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    places = reduce(Column.__add__, [count(c) for c in many])
    product = reduce(Column.__mul__, [F.pow(F.lit(float(n)), count(c)) for c, n in many.items()])
    return F.least(product, F.lit(float(MOST))), places


def join_words(words: Column) -> Column:
    """The lattice of a line from those of its words, with a blank between words."""
    gap = F.array(F.array(F.lit(" ")))
    return F.flatten(F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.concat(w, gap)).otherwise(w)))


def choices(place: Column) -> Column:
    """How many readings of a place count."""
    return F.when(F.size(place) > 1, F.least(F.size(place), F.lit(KEPT))).otherwise(1)


def reading_count(lattice: Column) -> Column:
    """The product of the choices of all places, as a double."""
    return F.aggregate(lattice, F.lit(1.0), lambda a, c: a * choices(c))


def ambiguous_places(lattice: Column) -> Column:
    return F.size(F.filter(lattice, lambda c: F.size(c) > 1))


def capped(lattice: Column) -> Column:
    """The lattice with at most KEPT candidates a place; from the left, places keep one while more than MOST readings remain."""
    start = F.struct(reading_count(lattice).alias("left"), F.lit(0).alias("n"))
    step = lambda acc, c: F.struct((acc["left"] / choices(c)).alias("left"), (acc["n"] + (acc["left"] > MOST).cast("int")).alias("n"))
    # what remains only falls, so the places that keep one are the first
    first = F.when(reading_count(lattice) > MOST, F.aggregate(lattice, start, step)["n"]).otherwise(0)
    rest = F.slice(lattice, first + 1, F.greatest(F.size(lattice), F.lit(0)))
    return F.concat(F.transform(F.slice(lattice, F.lit(1), first), lambda c: F.slice(c, 1, 1)), F.transform(rest, lambda c: F.slice(c, 1, KEPT)))


def readings(lattice: Column) -> Column:
    """All readings of a capped lattice, by number: the first place turns fastest.  An empty lattice has one, the empty text.

    For short lattices, such as parts of a word; ``with_readings`` gives those of whole lines as rows.
    """
    return F.aggregate(lattice, F.array(F.lit("")), lambda told, c: F.flatten(F.transform(c, lambda x: F.transform(told, lambda t: F.concat(t, x)))))


#: Numbers that a row holds at once.
_STEP = 256


def with_readings(rows: DataFrame, cand: str, no: str, text: str) -> DataFrame:
    """A row for each reading of a lattice, once capped, with its number and text; the other columns are repeated.

    Rows come from numbers, in two steps, so that none holds more than a few hundred readings, whatever the cap is.  A null
    lattice, or one with an empty place, has no reading.
    """
    told = rows.withColumn("_c", capped(F.col(cand))).where(~F.exists("_c", lambda c: F.coalesce(F.size(c), F.lit(0)) < 1))
    start = F.struct(F.lit(1).cast("long").alias("n"), F.array().cast("array<bigint>").alias("r"))
    radix = F.aggregate("_c", start, lambda a, c: F.struct((a["n"] * F.size(c)).alias("n"), F.concat(a["r"], F.array(a["n"])).alias("r")))
    told = told.withColumn("_r", radix).withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_r.n") - 1) / _STEP))))
    told = told.withColumn(no, F.explode(F.sequence(F.col("_hi") * _STEP, F.least(F.col("_hi") * _STEP + _STEP - 1, F.col("_r.n") - 1))))
    char = lambda c, r: F.get(c, (F.floor(F.col(no) / r) % F.size(c)).cast("int"))
    return told.withColumn(text, F.array_join(F.zip_with("_c", "_r.r", char), "")).drop("_c", "_r", "_hi")
