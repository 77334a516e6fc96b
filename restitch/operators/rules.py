"""Fuzzy line rules: the catalogue, and the cheapest rule and reading of a lattice.

A rule's template is a sequence of literal characters and groups.  How well it fits a lattice is the least number
of insertions, deletions and substitutions over all readings, found by one pass over the lattice with the
template's positions as states; readings are never enumerated.  Of rules within their budgets the one with the
least (errors - budget, rank, reading number) is chosen, and only its reading is matched for the group spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import regex

#: Share of a template's fixed characters that may be wrong, and the macros of templates.
TOLERANCE = 0.25
MACROS = {"VARIABLE": "[a-z_]+", "FUNCTION": "[a-z_]+", "STATEMENT": ".+", "PARAMETERS": ".*", "ARGS": ".*?", "VAL": ".+"}
KEPT, MOST = 3, 1 << 16
_IDX = 17  # bits for the number of a reading

#: Fixed values: (template, number of fixed characters).  The third part is how the line is written again: {n} is
#: the text of a group, {n:kind} the group repaired as that kind.
PYTHON_LINES = [
    (r"import (.*)", 7, "import {1:module}"),
    (r"import (.*?) as (.*)", 11, "import {1:module} as {2}"),
    (r"from (.*?) import (.*)", 13, "from {1:module} import {2:names}"),
    (r"def (VARIABLE)\((PARAMETERS)\):", 7, "def {1}({2}):"),
    (r"class (VARIABLE):", 7, "class {1:class}:"),
    (r"if (STATEMENT):", 4, "if {1:expr}:"),
    (r"elif (STATEMENT):", 6, "elif {1:expr}:"),
    (r"return (STATEMENT)", 7, "return {1:expr}"),
    (r"while (STATEMENT):", 7, "while {1:expr}:"),
    (r"for (VARIABLE) in (STATEMENT):", 9, "for {1:expr} in {2:expr}:"),
    (r"for (VARIABLE) in range\((STATEMENT)\):", 16, "for {1:expr} in range({2:expr}):"),
    (r"(FUNCTION)\((PARAMETERS)\)", 2, "{1:function}({2:args})"),
    (r"(VARIABLE)\.(FUNCTION)\((PARAMETERS)\)", 3, "{1:owner}.{2:method}({3:args})"),
    (r"self\.(FUNCTION)\((PARAMETERS)\)", 7, "self.{1:own}({2:args})"),
    (r"(VARIABLE) = (STATEMENT)", 3, "{1} = {2:expr}"),
    (r"assert (STATEMENT)", 7, "assert {1:expr}"),
    (r"del (STATEMENT)", 4, "del {1:expr}"),
    (r"raise (STATEMENT)", 6, "raise {1}"),
    (r"global (VARIABLE)", 7, "global {1:variable}"),
    (r"pass", 4, "pass"),
    (r"else:", 5, "else:"),
    (r"break", 5, "break"),
    (r"continue", 8, "continue"),
    (r"(.*)", 0, "{1}"),
]
PYTHON_EXPRESSIONS = [
    (r"(FUNCTION)\((PARAMETERS)\)", 2, "{1:callable}({2:args})"),
    (r"lambda (PARAMETERS): (STATEMENT)", 9, "lambda {1}: {2:expr}"),
    (r"(VARIABLE)\.(FUNCTION)\((PARAMETERS)\)", 3, "{1:owner}.{2:method}({3:args})"),
    (r"(self)\.(FUNCTION)\((PARAMETERS)\)", 7, "self.{2:own}({3:args})"),
    (r"(STATEMENT) and (STATEMENT)", 5, "{1:expr} and {2:expr}"),
    (r"(STATEMENT) or (STATEMENT)", 4, "{1:expr} or {2:expr}"),
    (r"not (STATEMENT)", 4, "not {1:expr}"),
    (r"(STATEMENT) for (VARIABLE) in (STATEMENT)", 9, "{1:expr} for {2:expr} in {3:expr}"),
    (r"\[(STATEMENT) for (VARIABLE) in (STATEMENT)\]", 11, "[{1:expr} for {2:expr} in {3:expr}]"),
    (r"(STATEMENT) for (VARIABLE) in range\((STATEMENT)\)", 16, "{1:expr} for {2:expr} in range({3:expr})"),
    (r"\[(STATEMENT) for (VARIABLE) in range\((STATEMENT)\)\]", 18, "[{1:expr} for {2:expr} in range({3:expr})]"),
    (r"true", 4, "True"),
    (r"false", 5, "False"),
    (r"none", 4, "None"),
    (r"(VARIABLE)", 0, "{1:variable}"),
]
HASKELL_LINES = [
    (r"(VARIABLE) = (VAL)", 3, "{1} = {2}"),
    (r"let (VARIABLE) = (VAL)", 7, "let {1} = {2}"),
    (r"(FUNCTION) (ARGS) = (PARAMETERS)", 4, "{1} {2:words} = {3}"),
    (r"(FUNCTION) (ARGS)", 1, "{1} {2:words}"),
    (r"(.*)", 0, "{1}"),
]
HASKELL_EXPRESSIONS = [
    (r"(STATEMENT) && (STATEMENT)", 4, "{1} && {2}"),
    (r"(STATEMENT) \|\| (STATEMENT)", 4, "{1} || {2}"),
    (r"not (STATEMENT)", 4, "not {1}"),
    (r"true", 4, "True"),
    (r"false", 5, "False"),
]
CATALOGUE = {("python3", "line"): PYTHON_LINES, ("python3", "expr"): PYTHON_EXPRESSIONS, ("haskell", "line"): HASKELL_LINES, ("haskell", "expr"): HASKELL_EXPRESSIONS}

Lattice = list[list[str]]


@dataclass(frozen=True, eq=False)
class Rule:
    number: int
    rank: int
    template: str
    budget: int
    form: str
    #: ("one" | "many", characters or None for any): what the template consumes, place by place.
    places: tuple[tuple[str, str | None], ...] = field(repr=False)
    pattern: regex.Pattern = field(repr=False, compare=False)


_LETTERS = "abcdefghijklmnopqrstuvwxyz_"


def _places(template: str) -> tuple[tuple[str, str | None], ...]:
    out: list[tuple[str, str | None]] = []
    for m in regex.finditer(r"\((\w+|\.\*\??)\)|\\(.)|(.)", template):
        group, escaped, plain = m.groups()
        if group is None:
            out.append(("one", escaped or plain))
            continue
        body = MACROS.get(group, group)
        if body == "[a-z_]+":
            out += [("one", _LETTERS), ("many", _LETTERS)]
        elif body == ".+":
            out += [("one", None), ("many", None)]
        elif body in (".*", ".*?"):
            out.append(("many", None))
        else:
            out += [("one", c) for c in body]
    return tuple(out)


Table = tuple[tuple[str, int, str], ...]


def table(language: str, level: str = "line") -> Table:
    """The catalogue's rows of a language: what tasks are given, so that rules registered on the driver count there."""
    if (language, level) not in CATALOGUE:
        raise ValueError(f"no {level} rules for {language}")
    return tuple(CATALOGUE[language, level])


def register(language: str, level: str, template: str, weight: int, form: str) -> None:
    """Add a rule to a language, or the first one to a new language; of rules with equal budgets earlier ones are preferred."""
    if not _places(template):
        raise ValueError("a template needs something to match")
    CATALOGUE.setdefault((language, level), []).append((template, weight, form))
    CATALOGUE.setdefault((language, "expr" if level == "line" else "line"), [])


@lru_cache(maxsize=16)
def compiled(own: Table) -> tuple[Rule, ...]:
    """Rules by rank: those with the larger budget come first."""
    told = []
    for number, (template, weight, form) in enumerate(own):
        budget = math.ceil(weight * TOLERANCE)
        body = regex.sub(r"\(([A-Z]+)\)", lambda m: f"({MACROS[m[1]]})", template)
        told.append((number, template, budget, form, regex.compile(f"^(?e)((?:{body}){{e<={budget}}})$")))
    told.sort(key=lambda r: -r[2])
    return tuple(Rule(n, rank, t, b, f, _places(t), p) for rank, (n, t, b, f, p) in enumerate(told))


def rules(language: str, level: str = "line") -> tuple[Rule, ...]:
    return compiled(table(language, level))


def capped(lattice: Lattice) -> Lattice:
    """At most KEPT candidates a place; from the left, places keep one while more than MOST readings remain."""
    left, out = 1.0, []
    for c in lattice:
        left *= min(len(c), KEPT)
    for c in lattice:
        n = min(len(c), KEPT)
        out.append(c[:1] if left > MOST else c[:n])
        left /= n or 1
    return out


def reading(lattice: Lattice, number: int) -> str:
    """A reading of a capped lattice; the first place turns fastest."""
    out = []
    for c in lattice:
        number, d = divmod(number, len(c))
        out.append(c[d])
    return "".join(out)


def _radices(lattice: Lattice) -> list[int]:
    out, r = [], 1
    for c in lattice:
        out.append(r)
        r *= len(c)
    return out


def fit(rule: Rule, lattice: Lattice) -> tuple[int, int] | None:
    """(errors, reading number) of the best reading within the budget; ``lattice`` is capped."""
    places, one = rule.places, 1 << _IDX
    limit, end = (rule.budget + 1) << _IDX, len(rule.places)
    radices = _radices(lattice)

    def spread(live: dict[int, int]) -> dict[int, int]:
        """Template places that nothing is read for: a deletion, or a repetition that ends."""
        for q in range(min(live, default=end), end):
            if q in live:
                cost = live[q] + (one if places[q][0] == "one" else 0)
                if cost < limit and cost < live.get(q + 1, limit):
                    live[q + 1] = cost
        return live

    live = spread({0: 0})
    for c, radix in zip(lattice, radices, strict=True):
        after: dict[int, int] = {}
        for q, cost in live.items():
            if cost + one < limit and cost + one < after.get(q, limit):
                after[q] = cost + one  # an inserted character, read as the first candidate
            if q == end:
                continue
            kind, chars = places[q]
            to = q + 1 if kind == "one" else q
            best = cost + one
            for d, x in enumerate(c):
                if chars is None or x in chars:
                    best = min(best, cost + d * radix)
                    break
            if best < limit and best < after.get(to, limit):
                after[to] = best
        if not after:
            return None
        live = spread(after)
    got = live.get(end)
    return None if got is None else (got >> _IDX, got & (one - 1))


@dataclass(frozen=True)
class Match:
    rule: Rule
    errors: int
    number: int
    text: str
    spans: tuple[tuple[int, int], ...]

    def group(self, k: int) -> str:
        a, b = self.spans[k - 1]
        return self.text[a:b]


class States:
    """The places of some rules as bits of one number, so that a lattice is read for all of them at once: what is reached with no error, one, two and so on."""

    def __init__(self, own: tuple[Rule, ...]):
        self.places: list[tuple[int, str | None]] = []
        self.one = self.many = self.start = at = 0
        self.ends: list[tuple[Rule, int]] = []
        for rule in own:
            self.start |= 1 << at
            for kind, chars in rule.places:
                self.one |= (kind == "one") << at
                self.many |= (kind == "many") << at
                self.places.append((1 << at, chars))
                at += 1
            self.ends.append((rule, 1 << at))
            at += 1
        self.levels = max((r.budget for r in own), default=0) + 1
        self.read = lru_cache(maxsize=10_000)(self._read)

    def _read(self, candidate: str) -> int:
        return sum(bit for bit, chars in self.places if chars is None or candidate in chars)

    def spread(self, x: int) -> int:
        while (y := x | (x & self.many) << 1) != x:
            x = y
        return x

    def best(self, lattice: Lattice) -> Rule | None:
        """The rule with the least (errors - budget, rank)."""
        one, many, spread = self.one, self.many, self.spread
        now = [spread(self.start)]
        for _ in range(1, self.levels):
            now.append(spread((now[-1] & one) << 1))
        for c in lattice:
            fits = 0
            for x in c:
                fits |= self.read(x)
            after, before, less = [], 0, 0  # what is reached with an error less: before this place, and with it
            for x in now:
                less = spread((x & fits & one) << 1 | x & fits & many | before | ((before | less) & one) << 1)
                after.append(less)
                before = x
            now = after
        best, chosen = 1, None
        for rule, end in self.ends:
            if chosen is not None and -rule.budget > best:
                break  # no later rule can score less
            errors = next((e for e in range(rule.budget + 1) if now[e] & end), None)
            if errors is not None and errors - rule.budget < best:
                best, chosen = errors - rule.budget, rule
        return chosen


states = lru_cache(maxsize=16)(States)


def classify(lattice: Lattice, own: tuple[Rule, ...]) -> Match | None:
    """The best rule of a lattice, or None where none is within its budget."""
    if any(not c for c in lattice):
        raise ValueError("a place of the lattice has no candidate")
    lattice = capped(lattice)
    chosen = states(own).best(lattice)
    return None if chosen is None else read_as(chosen, *fit(chosen, lattice), lattice)


def read_as(rule: Rule, errors: int, number: int, lattice: Lattice) -> Match | None:
    """The match of a rule with a reading of a lattice, whose errors are known."""
    text = reading(capped(lattice), number)
    m = rule.pattern.match(text)
    return None if m is None else Match(rule, errors, number, text, tuple(m.span(k) for k in range(2, rule.pattern.groups + 1)))


def distance(lattice: Lattice, term: str, tolerance: float = TOLERANCE) -> tuple[int | None, int | None]:
    """(edits, reading number) of the reading nearest to a term, or nulls where none is within the tolerance."""
    lattice = capped(lattice)
    n, m, one = len(lattice), len(term), 1 << _IDX
    allowed = max(math.ceil(m * tolerance) - 1, 0)
    if abs(n - m) > allowed or any(not c for c in lattice):
        return None, None
    limit = (allowed + 1) << _IDX
    row = [j * one for j in range(m + 1)]
    for c, radix in zip(lattice, _radices(lattice), strict=True):
        up, row = row, [row[0] + one]
        for j in range(m):
            cost = min(up[j] + one, up[j + 1] + one, row[j] + one)
            for d, x in enumerate(c):
                if x == term[j]:
                    cost = min(cost, up[j] + d * radix)
                    break
            row.append(cost)
        if min(row) >= limit:
            return None, None
    return (row[m] >> _IDX, row[m] & (one - 1)) if row[m] < limit else (None, None)


def nearest(lattice: Lattice, terms: list[str], tolerance: float = TOLERANCE) -> tuple[str, float]:
    """The nearest term of any reading, and its ratio; of equals that of the lower reading, then the earlier term.

    Where no ratio is below the tolerance: the first reading, and the tolerance.
    """
    best: tuple[float, int, int] | None = None
    for k, term in enumerate(terms):
        if abs(len(lattice) - len(term)) <= max(math.ceil(len(term) * tolerance) - 1, 0):
            edits, number = distance(lattice, term, tolerance)
            if edits is not None and edits / (len(term) or 1) < tolerance and (best is None or (edits / (len(term) or 1), number, k) < best):
                best = (edits / (len(term) or 1), number, k)
    return (reading(capped(lattice), 0), tolerance) if best is None else (terms[best[2]], best[0])
