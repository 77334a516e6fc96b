"""Line rules as Spark expressions: bit-parallel approximate automata over the places of a lattice.

A template is a row of states, one for each of its places; which of them are reached is a set of bits, kept for
every number of errors up to the largest budget.  A place of the lattice moves all states at once by masks of its
candidates, so readings are never enumerated and no row leaves the JVM.  Templates are packed side by side into
longs: one pass over a line tells the errors of all rules.  Of the rule chosen, a second pass from the line's end
picks at each ambiguous place the first candidate from which the rest can still be met at that number of errors,
which is the least reading.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.functions import lattice
from restitch.operators.rules import Rule, compiled, table

#: States of a long; its sign and one further bit stay free.
BITS = 62
#: Characters with masks of their own; what lies beyond matches only what any character does.
ASCII = 128


@dataclass
class Packed:
    """Templates side by side in one long: ``one`` and ``many`` are the states that read one character, or any number."""

    levels: int
    used: int = 0
    start: int = 0
    one: int = 0
    many: int = 0
    #: For each of the characters, and the last for all others: states that read it once, and again and again.
    chars: list[list[int]] = field(default_factory=lambda: [[0, 0] for _ in range(ASCII + 1)])
    #: (rule, bit of its end)
    ends: list[tuple[Rule, int]] = field(default_factory=list)

    def add(self, rule: Rule) -> None:
        self.start |= 1 << self.used
        for q, (kind, chars) in enumerate(rule.places, self.used):
            which = 0 if kind == "one" else 1
            if which:
                self.many |= 1 << q
            else:
                self.one |= 1 << q
            for c in range(ASCII + 1):
                if chars is None or (c < ASCII and chr(c) in chars):
                    self.chars[c][which] |= 1 << q
        self.used += len(rule.places) + 1
        self.ends.append((rule, self.used - 1))

    def table(self) -> dict[str, list[int]]:
        return {"one": [a for a, _ in self.chars], "many": [b for _, b in self.chars]}


def packed(own: tuple[Rule, ...]) -> list[Packed]:
    """Rules by rank, so those with like budgets share a long and its levels."""
    out: list[Packed] = []
    for rule in own:
        kinds = [kind for kind, _ in rule.places]
        if len(kinds) >= BITS or ("many", "many") in zip(kinds, kinds[1:], strict=False):
            raise ValueError(f"a template has at most {BITS - 1} places, and a character between two groups that read any number: {rule.template}")
        if any(c is not None and ord(max(c)) >= ASCII for _, c in rule.places):
            raise ValueError(f"fixed characters are those of ASCII: {rule.template}")
        if not out or out[-1].used + len(kinds) + 1 > BITS:
            out.append(Packed(rule.budget + 1))
        out[-1].add(rule)
    return out


def _or(*bits: Column) -> Column:
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is told once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass
class Masks:
    """The states of templates that read one character, and those that read any number; ``forward`` from a template's start, or back from its end.

    Sets are structs of a long for each number of errors: e0, e1, ...  A state that reads one character is left out at the
    price of an error, one that reads any number for nothing.
    """

    one: Column
    many: Column
    #: States that a step of two passes at the price of one error, as one of the two reads any number.
    two: Column
    forward: bool = True

    def _pass(self, x: Column, by: Column, places: int = 1) -> Column:
        """The states that are reached from x through those in ``by``."""
        return F.shiftleft(x.bitwiseAND(by), places) if self.forward else F.shiftright(x, places).bitwiseAND(by)

    def _closed(self, levels: int, met: Column) -> Column:
        """Sets with what is reached from ``met`` when nothing is read."""

        def level(e: int, told: list[Column]) -> Column:
            n = met[f"e{e}"]
            found = [n, self._pass(n, self.many)]
            if told:
                found += [self._pass(told[-1], self.one), self._pass(told[-1], self.two, 2)]
            if e == levels - 1:
                return F.struct(*[x.alias(f"e{k}") for k, x in enumerate([*told, _or(*found)])])
            return _let(_or(*found), lambda x: level(e + 1, [*told, x]))

        return level(0, [])

    def begin(self, levels: int, states: Column) -> Column:
        """The sets before anything is read."""
        return _let(F.struct(*[(states if e == 0 else F.lit(0).cast("long")).alias(f"e{e}") for e in range(levels)]), lambda met: self._closed(levels, met))

    def read(self, levels: int, sets: Column, char: Column) -> Column:
        """The sets after a place whose masks are ``char``; a character may be put in or changed at the price of an error."""

        def met(e: int) -> Column:
            same = sets[f"e{e}"]
            found = [self._pass(same, char["one"]), same.bitwiseAND(char["many"])]
            if e:
                found += [sets[f"e{e - 1}"], self._pass(sets[f"e{e - 1}"], self.one)]
            return _or(*found).alias(f"e{e}")

        return _let(F.struct(*[met(e) for e in range(levels)]), lambda m: self._closed(levels, m))


def _levels(sets: Column, levels: int) -> Column:
    return F.array(*[sets[f"e{e}"] for e in range(levels)])


def _constant(value: object, kind: str) -> Column:
    """A constant that Spark parses once, rather than an expression for each of its numbers."""
    return F.from_json(F.lit(json.dumps(value)), kind)


_TABLE = "struct<one:array<bigint>,many:array<bigint>>"


def _moves(candidates: Column, table: Column) -> Column:
    """The masks of a place: what any of its candidates reads, by a table of characters."""
    at = lambda c: F.least(F.ascii(c), F.lit(ASCII)) + 1
    any_of = lambda kind: F.aggregate(candidates, F.lit(0).cast("long"), lambda a, c: _or(a, F.element_at(table[kind], at(c))))
    return F.struct(any_of("one").alias("one"), any_of("many").alias("many"))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def moves(cand: Column, own: tuple[Rule, ...]) -> Column:
    """The masks of each place of a lattice for all rules: an array of w0, w1, ..."""
    tables = [_constant(p.table(), _TABLE) for p in packed(own)]
    return F.transform(cand, lambda c: F.struct(*[_moves(c, t).alias(f"w{k}") for k, t in enumerate(tables)]))


def best_rule(moved: Column, own: tuple[Rule, ...]) -> Column:
    """(at, errors) of the rule with the least (errors - budget, rank), null where none is within its budget; ``at`` is its rank.

    ``moved`` are the ``moves`` of a lattice.
    """
    words = packed(own)
    masks = [Masks(_long(p.one), _long(p.many), _long(p.one & (p.many >> 1))) for p in words]
    start = F.struct(*[m.begin(p.levels, _long(p.start)).alias(f"w{k}") for k, (p, m) in enumerate(zip(words, masks, strict=True))])
    step = lambda acc, c: F.struct(*[m.read(p.levels, acc[f"w{k}"], c[f"w{k}"]).alias(f"w{k}") for k, (p, m) in enumerate(zip(words, masks, strict=True))])
    ways = sorted((e - rule.budget, rule.rank, e, k, bit) for k, p in enumerate(words) for rule, bit in p.ends for e in range(rule.budget + 1))

    # in order, so the first that holds is the best
    told = _constant([{"at": rank, "errors": e, "word": k, "bit": 1 << bit} for _, rank, e, k, bit in ways], "array<struct<at:int,errors:int,word:int,bit:bigint>>")

    def first(done: Column) -> Column:
        sets = F.array(*[_levels(done[f"w{k}"], p.levels) for k, p in enumerate(words)])
        met = lambda x: F.element_at(F.get(sets, x["word"]), x["errors"] + 1).bitwiseAND(x["bit"]) != 0
        best = F.get(F.filter(told, met), F.lit(0))
        return F.when(best.isNotNull(), F.struct(best["at"].alias("at"), best["errors"].alias("errors")))

    return F.aggregate(moved, start, step, first)


def _single(own: tuple[Rule, ...]) -> Column:
    """A row a rule, by rank: its masks, by itself."""
    out = []
    for rule in own:
        p = Packed(rule.budget + 1)
        p.add(rule)
        out.append({"one": p.one, "many": p.many, "ahead": p.one & (p.many >> 1), "back": p.many & (p.one >> 1), "end": 1 << (p.used - 1), "chars": p.table()})
    return _constant(out, f"array<struct<one:bigint,many:bigint,ahead:bigint,back:bigint,end:bigint,chars:{_TABLE}>>")


def least_reading(cand: Column, rule: Column, errors: Column, levels: int) -> Column:
    """(number, changes) of the least reading that a rule matches with these errors.

    ``cand`` has for each place of a capped lattice its candidates, ``c``, the masks of each, ``own``, and of all, ``any``;
    ``rule`` is a row of ``_single``.  ``changes`` are the places, from 1, that aren't read as their first candidate, and
    their characters.
    """
    ahead, back = Masks(rule["one"], rule["many"], rule["ahead"]), Masks(rule["one"], rule["many"], rule["back"], forward=False)
    sets = "array<array<bigint>>"

    def forward(acc: Column, place: Column) -> Column:
        kept = F.when(F.size(place["c"]) > 1, F.concat(acc["kept"], F.array(_levels(acc["now"], levels)))).otherwise(acc["kept"])  # at most 16 places are ambiguous
        return F.struct(ahead.read(levels, acc["now"], place["any"]).alias("now"), kept.alias("kept"))

    start = F.struct(ahead.begin(levels, F.lit(1).cast("long")).alias("now"), F.array().cast(sets).alias("kept"))
    reached = F.aggregate(cand, start, forward)["kept"]
    meet = lambda a, b: F.exists(F.sequence(F.lit(0), errors), lambda e: F.element_at(a, e + 1).bitwiseAND(F.element_at(b, errors - e + 1)) != 0)

    def backward(acc: Column, place: Column) -> Column:
        c = place["c"]
        at = F.element_at(acc["reached"], -1)
        before = F.transform(place["own"], lambda m, d: F.struct(d.alias("d"), F.get(c, d).alias("x"), back.read(levels, acc["now"], m).alias("now")))
        choice = F.get(F.filter(before, lambda s: meet(at, _levels(s["now"], levels))), F.lit(0))
        many = lambda s: F.struct(
            s["now"].alias("now"),
            F.slice(acc["reached"], 1, F.size(acc["reached"]) - 1).alias("reached"),
            (acc["number"] * F.size(c) + s["d"]).alias("number"),
            F.when(s["d"] > 0, F.concat(acc["changes"], F.array(F.struct(place["at"].alias("at"), s["x"].alias("x"))))).otherwise(acc["changes"]).alias("changes"),
        )
        one = F.struct(back.read(levels, acc["now"], place["any"]).alias("now"), acc["reached"].alias("reached"), acc["number"].alias("number"), acc["changes"].alias("changes"))
        return F.when(F.size(c) > 1, _let(choice, many)).otherwise(one)

    end = F.struct(
        back.begin(levels, rule["end"]).alias("now"), reached.alias("reached"), F.lit(0).cast("long").alias("number"), F.array().cast("array<struct<at:int,x:string>>").alias("changes")
    )
    return F.aggregate(F.reverse(cand), end, backward, lambda acc: F.struct(acc["number"].alias("number"), acc["changes"].alias("changes")))


MATCH = "struct<rule:int,template:string,errors:int,reading:bigint,text:string>"


def classified(lines: DataFrame, language: str = "python3", level: str = "line", cand: str = "cand", out: str = "match") -> DataFrame:
    """``lines`` with ``match``: the number, template and errors of the best rule for a lattice, and the reading that it matches.

    Of rules within their budgets that with the least (errors - budget, rank) is the best, and of its readings the one
    with the least number.  Each different lattice is matched once.  A null lattice, one with an empty place and one that
    no rule fits have a null match; an empty lattice is an empty text.
    """
    own = compiled(table(language, level))
    levels = max(r.budget for r in own) + 1
    told = lines.select(F.col(cand).alias("_of")).where(F.col("_of").isNotNull() & ~F.exists("_of", lambda c: c.isNull() | (F.size(c) == 0))).distinct()
    # few rows of heavy work: dealt out to as many tasks as rows are shuffled to
    told = told.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_of")
    told = told.withColumn("_c", lattice.capped(F.col("_of")))
    told = told.withColumn("_best", best_rule(moves(F.col("_c"), own), own))
    told = told.withColumn("_rule", F.get(_single(own), F.col("_best.at")))
    chars = F.col("_rule.chars")
    place = lambda c, i: F.struct(c.alias("c"), (i + 1).alias("at"), F.transform(c, lambda x: _moves(F.array(x), chars)).alias("own"), _moves(c, chars).alias("any"))
    several = F.exists("_c", lambda c: F.size(c) > 1)
    plain = F.struct(F.lit(0).cast("long").alias("number"), F.array().cast("array<struct<at:int,x:string>>").alias("changes"))
    told = told.withColumn("_places", F.when(several, F.transform("_c", place)))
    told = told.withColumn("_read", F.when(F.col("_places").isNull(), plain).otherwise(least_reading(F.col("_places"), F.col("_rule"), F.col("_best.errors"), levels)))
    first = F.array_join(F.transform("_c", lambda c: c[0]), "")
    text = F.aggregate(F.col("_read.changes"), first, lambda t, s: F.overlay(t, s["x"], s["at"], F.lit(1)))
    name = F.get(_constant([{"rule": r.number, "template": r.template} for r in own], "array<struct<rule:int,template:string>>"), F.col("_best.at"))
    match = F.struct(name["rule"].alias("rule"), name["template"].alias("template"), F.col("_best.errors").alias("errors"), F.col("_read.number").alias("reading"), text.alias("text"))
    told = told.select("_of", F.when(F.col("_best").isNotNull(), match).alias(out))
    return lines.join(told, F.col(cand) == F.col("_of"), "left").drop("_of")
