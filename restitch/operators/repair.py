"""Repair of code lines: rules choose how a line is read, dictionaries what its names are.

Lines are classified each by itself, where they lie.  Names that a document binds are gathered from its lines in
order, and every line is then written again with the names it can see.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.functions.text import indented, naive_fix
from restitch.operators.dictionary import matches
from restitch.operators.ordered import Scope, in_scopes, latest_before
from restitch.operators.rules import Lattice, Match, Rule, Table, classify, compiled, nearest, read_as, table
from restitch.streaming.cache import work_dir

#: The built-in functions that a call may mean.
BUILTINS = [
    "abs", "all", "any", "ascii", "bin", "bool", "bytearray", "bytes", "callable", "chr", "classmethod", "compile", "complex", "copyright", "credits", "delattr", "dict", "dir",
    "divmod", "enumerate", "eval", "exec", "exit", "filter", "float", "format", "frozenset", "getattr", "globals", "hasattr", "hash", "help", "hex", "id", "input", "int", "isinstance",
    "issubclass", "iter", "len", "license", "list", "locals", "map", "max", "memoryview", "min", "next", "object", "oct", "open", "ord", "pow", "print", "property", "quit", "range", "repr",
    "reversed", "round", "set", "setattr", "slice", "sorted", "staticmethod", "str", "sum", "super", "tuple", "type", "vars", "zip",
]
MODULES = sorted(sys.stdlib_module_names)


@dataclass
class Names:
    """What a line can refer to."""

    variables: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=lambda: BUILTINS)
    modules: list[str] = field(default_factory=lambda: MODULES)


def _slice(lattice: Lattice, text: str, span: tuple[int, int]) -> tuple[str, Lattice]:
    """A group's text and lattice without white space at its ends."""
    a, b = span
    raw = text[a:b]
    a, b = a + len(raw) - len(raw.lstrip()), b - (len(raw) - len(raw.rstrip()))
    return text[a:b], lattice[a:b] if b > a else []


def arguments(text: str) -> list[tuple[int, int]]:
    """Spans between top-level commas, where parentheses nest."""
    if not text.strip():
        return []
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append((start, i))
            start = i + 1
    return [*out, (start, len(text))]


class Writer:
    """Writes matched lines again with the names in sight."""

    def __init__(self, expressions: tuple[Rule, ...], names: Names):
        self.expressions, self.names = expressions, names

    def line(self, match: Match, lattice: Lattice) -> str:
        said: dict[str, str] = {}  # what an owner was taken for

        def put(m: re.Match) -> str:
            k, kind = int(m[1]), m[2]
            text, own = _slice(lattice, match.text, match.spans[k - 1])
            return match.group(k) if kind is None else self.part(kind, text, own, said)

        return re.sub(r"\{(\d)(?::(\w+))?\}", put, match.rule.form)

    def expression(self, text: str, lattice: Lattice) -> str:
        if not lattice:
            return text
        match = classify(lattice, self.expressions)
        return text if match is None else self.line(match, lattice)

    def part(self, kind: str, text: str, own: Lattice, said: dict[str, str]) -> str:
        names = self.names
        if kind == "expr":
            return self.expression(text, own)
        if kind == "args":
            return ", ".join(self.expression(*_slice(own, text, span)) for span in arguments(text))
        if kind == "names":
            return ", ".join(x.strip() for x in text.split(","))
        if kind == "words":
            return " ".join(text.split())
        if kind == "owner":
            variable, far = nearest(own, names.variables)
            module, farther = nearest(own, names.imports)
            said["of"] = "" if far <= farther else module
            return variable if far <= farther else module
        if kind == "method":
            return text if said.get("of") else nearest(own, names.methods)[0]  # a module's names are joined later
        terms = {
            "module": names.modules, "class": names.classes, "function": names.functions, "callable": [*names.functions, *names.classes],
            "variable": names.variables, "own": names.methods,
        }[kind]
        return nearest(own, terms)[0] if own else text


MATCH = T.StructType(
    [
        T.StructField("rule", T.IntegerType()), T.StructField("template", T.StringType()), T.StructField("errors", T.IntegerType()), T.StructField("reading", T.LongType()),
        T.StructField("text", T.StringType()), T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("module", T.StringType()),
        T.StructField("spans", T.ArrayType(T.IntegerType())),
    ]
)


_ARROW = {
    "rule": pa.int32(), "template": pa.string(), "errors": pa.int32(), "reading": pa.int64(), "text": pa.string(), "groups": pa.list_(pa.string()), "module": pa.string(),
    "spans": pa.list_(pa.int32()),
}


@lru_cache(maxsize=4)
def _matcher(told: Table, modules: tuple[str, ...]) -> Callable[[str], dict]:
    """The match of a lattice's JSON.  Short ones are kept, 100,000 at most, for later tasks of a worker too."""
    own = compiled(told)

    def match(text: str) -> dict:
        lattice = json.loads(text)
        m = classify(lattice, own) if all(lattice) else None
        if m is None:
            return dict.fromkeys(_ARROW)
        module = nearest(_slice(lattice, m.text, m.spans[0])[1], list(modules))[0] if "{1:module}" in m.rule.form else None
        groups = [m.group(k + 1) for k in range(len(m.spans))]
        return {"rule": m.rule.number, "template": m.rule.template, "errors": m.errors, "reading": m.number, "text": m.text, "groups": groups, "module": module, "spans": [x for span in m.spans for x in span]}

    kept = lru_cache(maxsize=100_000)(match)
    return lambda text: kept(text) if len(text) <= 1_000 else match(text)


def _match(cand: Column, language: str, modules: list[str], *fields: str) -> Column:
    """Some fields of the match of a lattice's JSON."""
    told, known, kind = table(language), tuple(modules), pa.struct([(f, _ARROW[f]) for f in fields])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = _matcher(told, known)
        for texts in batches:
            each = texts.dictionary_encode()
            yield pa.array([match(x) for x in each.dictionary.to_pylist()], kind).take(each.indices)

    return F.arrow_udf(run, T.StructType([MATCH[f] for f in fields]))(cand)


def classified(lines: DataFrame, language: str = "python3", modules: list[str] = MODULES) -> DataFrame:
    """``lines`` (with ``cand``, a lattice) with ``match``: rule, errors, reading and groups of the best rule.

    An empty place makes a line unreadable: its match has no rule.  Lines are matched where they lie: a worker keeps the
    matches that it found, so an equal lattice is matched once a worker while it is held, and however many lines have it, they don't
    meet in one task.
    """
    return lines.withColumn("match", _match(F.to_json("cand"), language, modules, *MATCH.names))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_document(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by document to as many tasks as Spark shuffles to: rows of programs are alike and shrink, so their size on disk tells little of what a task holds."""
    return rows.repartition(_tasks(rows), "doc_id")


def bound_names() -> Column:
    """What a matched line binds, as a (kind, terms, free) struct; null where it binds nothing.

    ``free`` is whether it counts only outside any open def or class.
    """
    m = F.col("match")
    at = lambda k: F.get(m["groups"], F.lit(k))
    told = lambda kind, terms, free=False: F.struct(F.lit(kind).alias("kind"), terms.alias("terms"), F.lit(free).alias("free"))
    form = m["template"]
    return (
        F.when(form.isin(r"for (VARIABLE) in (STATEMENT):", r"for (VARIABLE) in range\((STATEMENT)\):", r"(VARIABLE) = (STATEMENT)"), told("variable", F.array(at(0)), True))
        .when(form == r"class (VARIABLE):", told("class", F.array(at(0))))
        .when(form == r"import (.*)", told("import", F.array(m["module"])))
        .when(form == r"import (.*?) as (.*)", told("import", F.array(F.trim(at(1)))))
        .when(form == r"from (.*?) import (.*)", told("import", F.transform(F.split(at(1), ","), lambda n: F.trim(n))))
    )


def _opens(template: str) -> Column:
    return F.coalesce(F.col("match.template") == template, F.lit(False))


_DEF, _CLASS = r"def (VARIABLE)\((PARAMETERS)\):", r"class (VARIABLE):"


def _bound(lines: DataFrame, fields: tuple[str, ...], *more: Column) -> DataFrame:
    """doc_id, line_no, kind and terms (null where a Python line binds nothing) and further columns of a line's match; only these are sorted by document."""
    matched = lines.select("doc_id", "line_no", "indent", _match(F.to_json("cand"), "python3", MODULES, *fields).alias("match"))
    told = matched.select("doc_id", "line_no", "indent", _opens(_DEF).alias("_def"), _opens(_CLASS).alias("_class"), bound_names().alias("s"), *more)
    told = in_scopes(told, "doc_id", "line_no", "indent", {"in_def": "_def", "in_class": "_class"})
    counts = ~F.col("s.free") | (~F.col("in_def") & ~F.col("in_class"))
    told = told.withColumn("s", F.when(counts, F.col("s"))).drop("indent", "_def", "_class", "in_def", "in_class")
    return told.select("*", "s.kind", "s.terms").drop("s")


def symbols(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, term) for each name that a line of Python code binds."""
    return _bound(lines, ("template", "groups", "module")).select("doc_id", "line_no", "kind", F.explode("terms").alias("term"))


#: Lines that bind or open something: their names aren't uses.
_BINDS = ["import (.*)", "import (.*?) as (.*)", "from (.*?) import (.*)", r"def (VARIABLE)\((PARAMETERS)\):", "class (VARIABLE):", r"for (VARIABLE) in (STATEMENT):", r"for (VARIABLE) in range\((STATEMENT)\):", "(VARIABLE) = (STATEMENT)"]


def references(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, term, bound) for each name on a line that binds nothing: ``bound`` is the line_no and kind of the latest binding before it, or null.

    A name that is bound again, as another kind too, refers to its last binding; what is bound inside an open def isn't seen.
    """
    calls = F.col("match.rule").isNotNull() & ~F.col("match.template").isin(_BINDS)
    used = F.when(calls, F.array_distinct(F.regexp_extract_all("match.text", F.lit("[a-z_]+"), F.lit(0)))).alias("used")
    told = _bound(lines, ("rule", "template", "text", "groups", "module"), used)
    # both from one reading of the lines, so these are matched once
    named = lambda names, turn, kind: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(turn).alias("turn"), kind.cast("string").alias("kind")))
    rows = told.select("doc_id", "line_no", F.inline(F.concat(named(F.col("used"), 0, F.lit(None)), named(F.col("terms"), 1, F.col("kind")))))
    before = Window.partitionBy("doc_id", "term").orderBy("line_no", "turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.last(F.when(F.col("turn") == 1, F.struct("line_no", "kind")), True).over(before)
    return _by_document(rows).withColumn("bound", bound).where("turn = 0").select("doc_id", "line_no", "term", "bound")


#: A line in pieces: literals, names with what follows their dot, and single characters.
_PIECES = r"'[^']*'|\"[^\"]*\"|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|[^A-Za-z_]"
_OF = r"^([A-Za-z_]\w*)\.([A-Za-z_]\w*)$"


def with_exports(told: DataFrame, exports: DataFrame) -> DataFrame:
    """``told`` (doc_id, line_no, fixed) with the names after a module's dot replaced by the nearest ones that it exports.

    ``exports`` has module, term and ord.  A module is what the latest binding of the owner's name before the line imports;
    an owner that is bound otherwise by then is none.  Where no name is near, and within literals, nothing is changed.
    """
    line = F.coalesce("fixed", F.lit(""))
    bound = lambda term, module: F.struct(term.alias("owner"), module.alias("module"))
    group = lambda form, k: F.regexp_extract(line, form, k)
    plain, named, other = r"^import ([\w.]+)$", r"^import ([\w.]+) as (\w+)$", r"^(?:for )?(\w+) (?:=|in) "
    binds = (
        F.when(line.rlike(plain), bound(group(plain, 1), group(plain, 1)))
        .when(line.rlike(named), bound(group(named, 2), group(named, 1)))
        .when(line.rlike(other), bound(group(other, 1), F.lit(None).cast("string")))
    )
    bindings = told.select("doc_id", "line_no", binds.alias("b")).where("b is not null").select("doc_id", "line_no", "b.*")
    pieces = F.regexp_extract_all(line, F.lit(_PIECES), F.lit(0))
    uses = told.where(line.contains(".")).select("doc_id", "line_no", F.posexplode(pieces).alias("place", "piece")).where(F.col("piece").rlike(_OF))
    uses = uses.select("doc_id", "line_no", "place", F.regexp_extract("piece", _OF, 1).alias("owner"), F.regexp_extract("piece", _OF, 2).alias("token"))
    uses = latest_before(uses, bindings, ["doc_id"], ["line_no"], "owner").withColumn("module", F.col("bound.module")).where("module is not null")
    near = matches(uses, exports, by=["module"]).where("ratio > 0")
    written = uses.join(near, ["module", "token"]).groupBy("doc_id", "line_no")
    written = written.agg(F.map_from_entries(F.collect_list(F.struct("place", F.concat_ws(".", "owner", "term")))).alias("_written"))
    again = F.array_join(F.transform(pieces, lambda x, i: F.coalesce(F.element_at("_written", i), x)), "")
    return told.join(written, ["doc_id", "line_no"], "left").withColumn("fixed", F.when(F.col("_written").isNull(), F.col("fixed")).otherwise(again)).drop("_written")


@lru_cache(maxsize=4)
def _kept(told: Table, expressions: Table) -> tuple[dict[tuple, int], dict[tuple, str | None], dict[str | None, str]]:
    """What a worker keeps for its later tasks too: each different set of names by number, what was written of a set and a lattice, and first readings."""
    return {}, {}, {None: ""}


def repaired_lines(lines: DataFrame, language: str = "python3", exports: DataFrame | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, line_no, indent, raw and fixed of each line (doc_id, line_no, indent, cand), and the columns ``kept``.

    ``raw`` is the first reading.  A line that can't be read stays null in ``fixed``.  Lines are classified
    where they lie; a document's rows are then sorted once and read in order, first the names that its lines bind and the scopes
    that they open, then the lines, so that a task holds the names of one document and nothing is repeated for every line.  ``exports`` (module, term, ord) tells the names of
    modules, which are data and never found by importing them.
    """
    fields = ("rule", "errors", "reading", "template", "groups", "module")
    own = ["doc_id", "line_no", "indent", *kept]
    matched = lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.col("indent").cast("int").alias("indent"), *kept, F.to_json("cand").alias("cand"))
    matched = matched.withColumn("match", _match(F.col("cand"), language, MODULES, *fields))
    none = lambda kind: F.lit(None).cast(kind)
    line = F.struct(F.lit(1).alias("turn"), *[none(t).alias(n) for n, t in (("kind", "string"), ("terms", "array<string>"), ("opens", "string"))], "cand", "match.rule", "match.errors", "match.reading")
    opens = F.when(_opens(_DEF), "def").when(_opens(_CLASS), "class")
    name = F.struct(F.lit(0).alias("turn"), F.col("s.kind").alias("kind"), F.col("s.terms").alias("terms"), opens.alias("opens"), *[none(t).alias(n) for n, t in (("cand", "string"), ("rule", "int"), ("errors", "int"), ("reading", "bigint"))])
    turns = F.array(name, line) if language == "python3" else F.array(line)
    rows = matched.withColumn("s", bound_names()).select(*own, F.explode(turns).alias("_r"))
    rows = rows.select("doc_id", "line_no", "indent", *[F.when(F.col("_r.turn") == 1, F.col(c)).alias(c) for c in kept], "_r.*")
    rows = _by_document(rows).sortWithinPartitions("doc_id", "turn", "line_no")
    catalogue = table(language), table(language, "expr")
    schema = T.StructType([*rows.schema.fields[: len(own)], T.StructField("raw", T.StringType()), T.StructField("fixed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_number, expressions = {r.number: r for r in compiled(catalogue[0])}, compiled(catalogue[1])
        at, bound = object(), {}
        known, written, first = _kept(*catalogue)
        for b in batches:
            turns, raw, fixed = b.column(len(own)), [], []
            given = (b.column(i).to_pylist() for i in range(3))
            for doc, no, indent, turn, kind, terms, opens, cand, rule, errors, number_read in zip(*given, *(b.column(i).to_pylist() for i in range(len(own), b.num_columns)), strict=True):
                if doc != at:
                    at, names, imports, place, number = doc, Names(), [], 0, None
                    in_def, in_class = Scope(), Scope()
                    bound = {"variable": names.variables, "class": names.classes}
                if turn == 0:
                    inside = in_def.add(indent, opens == "def"), in_class.add(indent, opens == "class")
                    if kind == "import":
                        imports.append((no, terms))
                    elif kind == "class" or kind == "variable" and inside == (False, False):
                        bound[kind] += terms
                    continue
                while place < len(imports) and imports[place][0] < no:
                    names.imports += imports[place][1]
                    place, number = place + 1, None
                if cand not in first:
                    if len(first) > 200_000:
                        first.clear()
                        first[None] = ""
                    first[cand] = "".join(c[0] if c else "" for c in json.loads(cand))
                raw.append(first[cand])
                if rule is None:
                    fixed.append(None)
                    continue
                if number is None:
                    if len(known) > 50_000:
                        known.clear()
                        written.clear()
                    number = known.setdefault((tuple(names.variables), tuple(names.classes), tuple(names.imports)), len(known))
                key = (number, cand)
                if key not in written:
                    if len(written) > 200_000:
                        written.clear()
                    lattice = json.loads(cand)
                    written[key] = Writer(expressions, names).line(read_as(by_number[rule], errors, number_read, lattice), lattice)
                fixed.append(written[key])
            lines_only = b.filter(pc.equal(turns, 1))
            yield pa.RecordBatch.from_arrays([*lines_only.columns[: len(own)], pa.array(raw, pa.string()), pa.array(fixed, pa.string())], names=schema.names)

    out = rows.mapInArrow(run, schema)
    if language != "python3":
        return out
    out = out.withColumn("fixed", naive_fix(F.col("fixed")))
    if exports is None:
        return out
    path = f"{work_dir(lines.sparkSession)}/lines"
    out.write.parquet(path)  # read three times below; in the shared folder, so that the lines aren't repaired again
    return with_exports(lines.sparkSession.read.schema(out.schema).parquet(path), exports)


def repaired_code(lines: DataFrame, language: str = "python3", exports: DataFrame | None = None) -> DataFrame:
    """doc_id, code and fixed_code: the lines of each document in order, indented by two blanks a level."""
    told = _by_document(repaired_lines(lines, language, exports))
    told = told.withColumns({"raw": indented(F.col("raw"), F.col("indent")), "fixed": indented(F.coalesce("fixed", "raw"), F.col("indent"))})
    both = told.select("doc_id", "line_no", F.struct("raw", "fixed").alias("t"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "t")))
    return both.groupBy("doc_id").agg(rows.alias("r")).select(
        "doc_id", F.array_join(F.transform("r", lambda s: s["t"]["raw"]), "\n").alias("code"), F.array_join(F.transform("r", lambda s: s["t"]["fixed"]), "\n").alias("fixed_code")
    )
