"""The library's queries by name, and the SQL that tells the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restitch.functions import lattice, text
from restitch.operators import automaton, dictionary, evaluate, ordered, repair, rules, store
from restitch.operators.diagnostics import diagnostics
from restitch.plans import service
from restitch.sources import containers, files
from restitch.sources.files import predicted_scores
from restitch.streaming import cache

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: one file or a folder of them, whatever their names.  Only a pattern may stand for a single file there."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


# ---------------------------------------------------------------- dictionaries and accuracy

_NEAREST = """
    terms AS (SELECT DISTINCT p_name AS term FROM part),
    tokens AS (SELECT DISTINCT translate(p_name, 'lo', '10') AS token FROM part),
    near AS (
        SELECT token, term, levenshtein(token, term) / length(term) AS ratio,
               row_number() OVER (PARTITION BY token ORDER BY levenshtein(token, term) / length(term), term) AS k
        FROM tokens JOIN terms ON levenshtein(token, term) < 0.25 * length(term)),
    repaired AS (
        SELECT p_partkey, p_name AS expected, translate(p_name, 'lo', '10') AS noisy,
               coalesce(term, translate(p_name, 'lo', '10')) AS repaired, coalesce(ratio, 0.25) AS ratio
        FROM part LEFT JOIN near ON token = translate(p_name, 'lo', '10') AND k = 1),
    scored AS (
        SELECT *, CAST(round_even(100.0::DOUBLE - levenshtein(replace(noisy, ' ', ''), replace(expected, ' ', '')) * 100.0::DOUBLE / length(replace(expected, ' ', '')), 0) AS BIGINT) AS accuracy,
               CAST(round_even(100.0::DOUBLE - levenshtein(replace(repaired, ' ', ''), replace(expected, ' ', '')) * 100.0::DOUBLE / length(replace(expected, ' ', '')), 0) AS BIGINT) AS accuracy_fixed,
               length(replace(expected, ' ', '')) AS length
        FROM repaired)"""


def _repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("expected"), F.translate("p_name", "lo", "10").alias("noisy"))
    terms = part.select(F.col("expected").alias("term"), F.col("expected").alias("ord")).distinct()
    return dictionary.repair(part, "noisy", terms)


@query(f"WITH {_NEAREST} SELECT p_partkey, noisy, repaired, ratio, accuracy_fixed FROM scored")
def nearest_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate.score(_repaired_names(spark, sf_dir), "noisy", "repaired", "expected")
    return scored.select("p_partkey", "noisy", "repaired", "ratio", "accuracy_fixed")


@query(f"WITH {_NEAREST} SELECT p_partkey, accuracy, accuracy_fixed, accuracy_fixed - accuracy AS improvement, length FROM scored")
def accuracy_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate.score(_repaired_names(spark, sf_dir), "noisy", "repaired", "expected")
    return scored.select("p_partkey", "accuracy", "accuracy_fixed", "improvement", "length")


@query(f"""WITH {_NEAREST}, mean AS (
        SELECT round_even(sum(accuracy * length)::DOUBLE / sum(length), 2) AS accuracy, round_even(sum(accuracy_fixed * length)::DOUBLE / sum(length), 2) AS accuracy_fixed,
               sum(length)::BIGINT AS length FROM scored)
    SELECT accuracy, accuracy_fixed, length, round_even(accuracy_fixed - accuracy, 2) AS improvement FROM mean""")
def accuracy_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.weighted(evaluate.score(_repaired_names(spark, sf_dir), "noisy", "repaired", "expected"))


_WORD = "string_split(p_name, ' ')[1]"


@query(f"""
    WITH tokens AS (SELECT p_partkey, translate({_WORD}, 'aeo', '430') AS token FROM part),
    vars AS (SELECT DISTINCT {_WORD} AS term FROM part), imports AS (SELECT DISTINCT lower(p_type) AS term FROM part UNION SELECT lower(n_name) FROM nation),
    v AS (SELECT token, term, r FROM (SELECT token, term, levenshtein(token, term) / length(term) AS r, row_number() OVER (PARTITION BY token ORDER BY levenshtein(token, term) / length(term), term) AS k
          FROM (SELECT DISTINCT token FROM tokens) JOIN vars ON levenshtein(token, term) < 0.25 * length(term)) WHERE k = 1),
    i AS (SELECT token, term, r FROM (SELECT token, term, levenshtein(token, term) / length(term) AS r, row_number() OVER (PARTITION BY token ORDER BY levenshtein(token, term) / length(term), term) AS k
          FROM (SELECT DISTINCT token FROM tokens) JOIN imports ON levenshtein(token, term) < 0.25 * length(term)) WHERE k = 1)
    SELECT p_partkey, t.token, CASE WHEN coalesce(v.r, 0.25) <= coalesce(i.r, 0.25) THEN coalesce(v.term, t.token) ELSE i.term END AS repaired,
           CASE WHEN coalesce(v.r, 0.25) <= coalesce(i.r, 0.25) THEN 'variable' ELSE 'import' END AS kind, least(coalesce(v.r, 0.25), coalesce(i.r, 0.25)) AS ratio
    FROM tokens t LEFT JOIN v USING (token) LEFT JOIN i USING (token)""")
def nearest_dictionary_var_vs_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")[0]
    variables = part.select(word.alias("term")).distinct().withColumn("ord", F.col("term"))
    imports = part.select(F.lower("p_type").alias("term")).union(table(spark, sf_dir, "nation").select(F.lower("n_name"))).distinct().withColumn("ord", F.col("term"))
    tokens = part.select("p_partkey", F.translate(word, "aeo", "430").alias("token"))
    return dictionary.repair_as_variable_or_import(tokens, "token", variables, imports).select("p_partkey", "token", "repaired", "kind", "ratio")


@query("SELECT 'nation' AS scope, n_name AS term FROM nation UNION ALL SELECT 'region', r_name FROM region")
def distinct_concat_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.lit("nation").alias("scope"), F.col("n_name").alias("term"))
    return dictionary.concat_dictionaries(nation, table(spark, sf_dir, "region").select(F.lit("region").alias("scope"), F.col("r_name").alias("term")))


# ---------------------------------------------------------------- class scores and lattices



def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", lattice.softmax(F.col("embedding"), 10.0).alias("p"))


def _codepoints() -> Column:
    """Class i stands for the character with code point 48 + i."""
    return F.sequence(F.lit(48), F.lit(48 + 127))


@query("""
    WITH scored AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE * 10)) AS e FROM embeddings),
    places AS (SELECT vec_id, unnest(e) / list_sum(e) AS p, generate_subscripts(e, 1) - 1 AS i FROM scored),
    likely AS (SELECT vec_id, lower(chr((48 + i)::INTEGER)) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i DESC) AS k FROM places WHERE p > 0.025),
    firsts AS (SELECT vec_id, c, min(k) AS k FROM likely GROUP BY vec_id, c)
    SELECT e.vec_id, coalesce(string_agg(c, ' ' ORDER BY k), '') AS candidates, count(c) AS n_candidates
    FROM embeddings e LEFT JOIN firsts USING (vec_id) GROUP BY e.vec_id""")
def char_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _probabilities(spark, sf_dir).select("vec_id", lattice.candidates(F.col("p"), _codepoints()).alias("c"))
    return told.select("vec_id", F.array_join("c", " ").alias("candidates"), F.size("c").cast("long").alias("n_candidates"))


@query("""
    WITH places AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT vec_id, chr((48 + arg_max(i, (x, i)))::INTEGER) AS top FROM places GROUP BY vec_id""")
def top1_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "embeddings")
    return scores.select("vec_id", lattice.top_char(F.transform("embedding", lambda x: x.cast("double")), _codepoints()).alias("top"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) AS text, count(*) AS n_lines FROM conversations GROUP BY conv_id")
def ordered_concat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    joined = ordered.ordered_concat(rows, ["conv_id"], ["turn"], "line", "\n")
    return joined.join(rows.groupBy("conv_id").agg(F.count("line").alias("n_lines")), "conv_id")


#: Letters that are easily misread, with what they may be.
CONFUSIONS = {"l": ["l", "1", "i", "t"], "o": ["o", "0"], "e": ["e", "c", "6"]}


@query("""
    WITH words AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS w FROM documents),
    counted AS (SELECT doc_id, length(w) - length(translate(w, 'le', '')) AS three, length(w) - length(translate(w, 'o', '')) AS two FROM words),
    sized AS (SELECT doc_id, three + two AS places, CASE WHEN three * ln(3) + two * ln(2) > 11.1 THEN 65536 ELSE least(65536, round(pow(3, three) * pow(2, two))) END AS n FROM counted)
    SELECT d.doc_id, coalesce(sum(places), 0)::BIGINT AS ambiguous, coalesce(sum(n), 0)::BIGINT AS readings FROM documents d LEFT JOIN sized USING (doc_id) GROUP BY d.doc_id""")
def lattice_size_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    told = table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: F.struct(*[c.alias(k) for c, k in zip(lattice.readings_of_text(w, CONFUSIONS), ("n", "places"), strict=True)])).alias("words"))
    return told.select(
        "doc_id",
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w["places"]).alias("ambiguous"),
        F.aggregate("words", F.lit(0.0), lambda a, w: a + w["n"]).cast("long").alias("readings"),
    )


@query(f"""
    WITH RECURSIVE read AS (
        SELECT p_partkey, {_WORD} AS word, 0 AS place, '' AS reading, 0::BIGINT AS reading_no, 1::BIGINT AS radix FROM part
        UNION ALL
        SELECT p_partkey, word, place + 1, reading || c[d], reading_no + (d - 1) * radix, radix * len(c) FROM (
            SELECT *, unnest(range(1, len(c) + 1)) AS d FROM (
                SELECT *, CASE word[place + 1] WHEN 'l' THEN ['l', '1', 'i'] WHEN 'o' THEN ['o', '0'] WHEN 'e' THEN ['e', 'c', '6'] ELSE [word[place + 1]] END AS c FROM read WHERE place < length(word))))
    SELECT p_partkey, reading_no, reading FROM read WHERE place = length(word)""")
def permutations_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", lattice.spell(F.split("p_name", " ")[0], CONFUSIONS).alias("cand"))
    return lattice.with_readings(words, "cand", "reading_no", "reading").drop("cand")


# ---------------------------------------------------------------- rules

#: Rules without groups: template, budget, and how it is written, in the order of their ranks.
LITERALS = [("else:", 2, "else:"), ("break", 2, "break"), ("continue", 2, "continue"), ("false", 2, "False"), ("pass", 1, "pass"), ("true", 1, "True"), ("none", 1, "None")]


def _literal_sql() -> str:
    """One pass over distinct tokens: of each rule its score and rank as one number, told only for tokens of a like length."""
    told = []
    for rank, (word, budget, _) in enumerate(LITERALS):
        d = f"levenshtein(left(token, {len(word) + budget}), '{word}')"
        told.append(f"CASE WHEN length(token) BETWEEN {len(word) - budget} AND {len(word) + budget} THEN CASE WHEN {d} <= {budget} THEN ({d} - {budget} + 2) * 8 + {rank} ELSE 99 END ELSE 99 END")
    written = " ".join(f"WHEN {rank} THEN '{w}'" for rank, (_, _, w) in enumerate(LITERALS))
    return f"""
        WITH words AS (
            SELECT unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g'), '[^ \\t\\n\\v\\f\\r]+')) AS token FROM documents
        ), tokens AS (
            SELECT token FROM words GROUP BY token
        ), scored AS (
            SELECT token, least({", ".join(told)}) AS best FROM tokens
        )
        SELECT token, CASE WHEN best = 99 THEN token ELSE CASE best % 8 {written} END END AS written, CASE WHEN best < 99 THEN CAST(best // 8 - 2 AS BIGINT) END AS score FROM scored"""


@query(_literal_sql())
def literal_rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)))
    tokens = table(spark, sf_dir, "documents").select(words.alias("w")).select(F.regexp_replace("w", r"[^\x00-\x7F]", "?").alias("token")).distinct()
    each = []
    for rank, (word, budget, written) in enumerate(LITERALS):
        d = F.when(F.abs(F.length("token") - len(word)) <= budget, F.levenshtein(F.col("token"), F.lit(word), budget)).otherwise(-1)
        each.append(F.when(d >= 0, F.struct((d - budget).cast("long").alias("score"), F.lit(rank).alias("rank"), F.lit(written).alias("written"))))
    best = F.array_min(F.array(*each))
    return tokens.select("token", best.alias("b")).select("token", F.coalesce("b.written", "token").alias("written"), F.col("b.score").alias("score"))


#: Lines of a small program, with a part's words put in.
PROGRAM = ["import math", "{a} = {n}", "def {b}({a}):", "  return {a} + 1", "for {a} in range({n}):", "  print({a})", "if {a} == {n} and not {b}({a}):", "  {b}({a}, {n})", "math.sqrt({n})", "pass"]
#: Haskell lines, likewise.
HASKELL_PROGRAM = ["let {a} = {n}", "{b} x y = x + y", "{a} = {b} 1 2", "main {a}"]


#: Letters that are misread, and what as.
NOISE = {"l": ["1", "l"], "o": ["0", "o"], "m": ["n", "m"], "u": ["v"]}


def _programs(spark: SparkSession, sf_dir: str, lines: list[str], noise: dict[str, list[str]] = NOISE) -> DataFrame:
    """Lines of a program for each part, as lattices read from a text in which some letters are misread."""
    words = F.split("p_name", " ")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), words[0].alias("a"), F.element_at(words, -1).alias("b"), F.col("p_size").cast("string").alias("n"))
    # a small file makes many lines of heavy work: dealt out while the rows are small
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit((len(x) - len(x.lstrip())) // 2).alias("indent"), F.lit(x.strip()).alias("line")) for k, x in enumerate(lines)]))
    told = part.select("*", each.alias("l")).select("*", "l.*")
    line = F.col("line")
    for name in ("a", "b", "n"):
        line = F.replace(line, F.lit(f"{{{name}}}"), F.col(name))
    return told.select("doc_id", "line_no", "indent", line.alias("expected"), lattice.spell(line, noise or {" ": [" "]}).alias("cand"))


def _first(sql: str) -> str:
    """The first reading of a text: what the noise of ``_programs`` puts first."""
    return f"translate({sql}, 'lomu', '10nv')"


def _letters(sql: str) -> str:
    """The first reading of letters only: digits are passed over."""
    return f"translate({sql}, 'mu', 'nv')"


_PARTS = "parts AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b, p_size::VARCHAR AS n FROM part)"
#: Of each line of PROGRAM: its rule's number, errors, and the text that the rule reads, as SQL; "return" is one edit off, as its u is always misread.
_READ = [
    (0, 0, "'import nath'"), (14, 0, f"{_letters('a')} || ' = ' || n"), (3, 0, f"'def ' || {_letters('b')} || '(' || {_first('a')} || '):'"), (7, 1, f"'retvrn ' || {_first('a')} || ' + 1'"),
    (10, 0, f"'for ' || {_letters('a')} || ' in range(' || n || '):'"), (11, 0, f"'print(' || {_first('a')} || ')'"),
    (5, 0, "'if ' || " + _first("a || ' == ' || n || ' and not ' || b || '(' || a || ')'") + " || ':'"), (11, 0, f"{_letters('b')} || '(' || {_first('a')} || ', ' || n || ')'"), (12, 0, "'nath.sqrt(' || n || ')'"), (19, 0, "'pass'"),
]
#: A name that begins an expression; "hot" is an edit from "not".
_LEAD = f"CASE a WHEN 'hot' THEN 'not' ELSE {_first('a')} END"
#: And how each is written again: modules, variables and built-ins by the dictionary, other names as they are read.
_WRITTEN = [
    "'import math'", f"{_letters('a')} || ' = ' || n", f"'def ' || {_letters('b')} || '(' || {_first('a')} || '):'", f"'return ' || {_LEAD} || ' + 1'", f"'for ' || {_letters('a')} || ' in range(' || n || '):'",
    f"'print(' || {_letters('a')} || ')'", f"'if ' || {_LEAD} || ' == ' || n || ' and not ' || {_first('b')} || '(' || {_letters('a')} || '):'", f"{_first('b')} || '(' || {_letters('a')} || ', ' || n || ')'", "'math.sqrt(' || n || ')'", "'pass'",
]
_HASKELL_WRITTEN = [f"'let ' || {_letters('a')} || ' = ' || n", f"{_letters('b')} || ' x y = x + y'", f"{_letters('a')} || ' = ' || {_first('b')} || ' 1 2'", f"'nain ' || {_first('a')}"]


def _said(line: str) -> str:
    """A line of a program as SQL."""
    return "'" + line.replace("{a}", "' || a || '").replace("{b}", "' || b || '").replace("{n}", "' || n || '") + "'"


def _program_columns(lines: list[str], written: list[str]) -> str:
    pad = lambda x: "'" + " " * (len(x) - len(x.lstrip())) + "' || "
    joined = lambda parts: " || chr(10) || ".join(pad(x) + p for x, p in zip(lines, parts, strict=True))
    return f"doc_id, {joined([_first(_said(x.strip())) for x in lines])} AS code, {joined(written)} AS fixed_code"


def _program_sql(lines: list[str], written: list[str]) -> str:
    return f"WITH {_PARTS} SELECT {_program_columns(lines, written)} FROM parts"


#: Lines for the rules that PROGRAM has none of.
RULE_LINES = [
    *PROGRAM, "import {a} as np", "from {a} import sin", "class {a}:", "elif {a}:", "while {a}:", "for {a} in items:", "self.run({a})", "assert {a}", "del {a}", "raise {a}",
    "global {a}", "else:", "break", "continve", "? ? {n}",
]


def _classified_sql(lines: str, language: str = "python3") -> str:
    """For ``lines`` (doc_id, line_no, line: a text that ``_programs`` misreads) the best rule and reading, by all edit distances.

    Every rule meets every lattice but for those that lack more of its fixed characters than its budget.  Costs by place of
    the template are lists; ``u`` leaves out what it costs to pass over the places before, so that passing over is a minimum.
    """
    one = 1 << 17
    told = []
    for r in rules.rules(language):
        fixed = [c for kind, c in r.places if kind == "one" and c is not None and len(c) == 1]
        need = ", ".join(f"{{'c': {_quoted(c)}, 'n': {fixed.count(c)}}}" for c in sorted(set(fixed)))
        many = ", ".join("true" if kind == "many" else "false" for kind, _ in r.places)
        chars = ", ".join("NULL" if c is None else _quoted(c) for _, c in r.places)
        told.append(f"({r.number}, {r.rank}, {_quoted(r.template)}, {r.budget}, [{many}], [{chars}]::VARCHAR[], [{need}]::STRUCT(c VARCHAR, n INTEGER)[])")
    digit = f"CASE WHEN chars[{{p}}] IS NULL OR contains(chars[{{p}}], c[1]) THEN 0 WHEN len(c) > 1 AND contains(chars[{{p}}], c[2]) THEN radix ELSE {one} END"
    step = f"least(u[q] + {one}, CASE WHEN q > 1 AND NOT many[q - 1] THEN u[q - 1] - {one} + {digit.format(p='q - 1')} END, CASE WHEN q <= len(many) AND many[q] THEN u[q] + {digit.format(p='q')} END)"
    return f"""
        lines AS ({lines}),
        rules(rule, rank, template, budget, many, chars, need) AS (VALUES {", ".join(told)}),
        lattices AS (
            SELECT line, list_transform(string_split(line, ''), lambda x: CASE x WHEN 'l' THEN ['1', 'l'] WHEN 'o' THEN ['0', 'o'] WHEN 'm' THEN ['n', 'm'] WHEN 'u' THEN ['v'] ELSE [x] END) AS cand
            FROM (SELECT DISTINCT line FROM lines)
        ), seen AS (
            SELECT line, cand, array_to_string(flatten(cand), '') AS flat FROM lattices
        ), fits AS MATERIALIZED (
            SELECT line, cand, rule, budget, many, chars FROM seen, rules
            WHERE coalesce(list_sum(list_transform(need, lambda s: greatest(s.n - (length(flat) - length(replace(flat, s.c, ''))), 0))), 0) <= budget
        ), costs AS (
            SELECT line, cand, rule, many, chars, 0 AS place, 1::BIGINT AS radix, list_transform(range(len(many) + 1), lambda x: 0::BIGINT) AS u FROM fits
            UNION ALL
            SELECT line, cand, rule, many, chars, place + 1, radix * len(c), list_transform(range(1, len(v) + 1), lambda q: list_min(v[1:q])) FROM (
                SELECT *, list_transform(range(1, len(u) + 1), lambda q: {step}) AS v FROM (SELECT *, cand[place + 1] AS c FROM costs WHERE place < len(cand)))
        ), done AS (
            SELECT line, rule, cand, u[-1] + {one} * len(list_filter(many, lambda x: NOT x)) AS cost FROM costs WHERE place = len(cand)
        ), best AS (
            SELECT line, cand, rule, template, cost // {one} AS errors, cost % {one} AS number,
                row_number() OVER (PARTITION BY line ORDER BY cost // {one} - budget, rank) AS k
            FROM done JOIN rules USING (rule) WHERE cost // {one} <= budget
        ), radices AS (
            SELECT line, rule, template, errors, number, cand, list_transform(range(1, len(cand) + 1), lambda i: coalesce(list_product(list_transform(cand[1:i - 1], lambda c: len(c))), 1)) AS radix
            FROM best WHERE k = 1
        ), matched AS (
            SELECT line, rule, template, CAST(errors AS INTEGER) AS errors,
                array_to_string(list_transform(cand, lambda c, i: c[CAST(number // CAST(radix[i] AS BIGINT) % len(c) + 1 AS INTEGER)]), '') AS text FROM radices
        )"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"WITH RECURSIVE {_PARTS}, " + _classified_sql(" UNION ALL ".join(f"SELECT doc_id, {k} AS line_no, {_said(x.strip())} AS line FROM parts" for k, x in enumerate(RULE_LINES))) + """
    SELECT doc_id, line_no, rule, template, errors, text FROM lines JOIN matched USING (line)""")
def fuzzy_rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the catalogue is the best one of some line."""
    matched = automaton.classified(_programs(spark, sf_dir, RULE_LINES))
    return matched.select("doc_id", "line_no", "match.rule", "match.template", "match.errors", "match.text")


@query(f"WITH {_PARTS} SELECT doc_id, 0 AS line_no, 'import' AS kind, 'math' AS term FROM parts UNION ALL SELECT doc_id, 1, 'variable', {_letters('a')} FROM parts")
def bound_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop's variable is bound while the function is open, so it doesn't count."""
    return repair.symbols(_programs(spark, sf_dir, PROGRAM))


@query(_program_sql(PROGRAM, _WRITTEN))
def fix_python_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_code(_programs(spark, sf_dir, PROGRAM))


#: Calls of names that two modules export, with a letter too many or too few, and of a name that is a module no more.
CALLS = ["import math", "import random as r", "math.{a}q({n})", "r.{b}q(math.{b}q)", "math = {n}", "math.{a}q({n})"]
_EXPORTS = """
    exports AS (SELECT DISTINCT CASE WHEN word < 'm' THEN 'math' ELSE 'random' END AS module, word AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)),
    calls AS (SELECT DISTINCT module, term || 'q' AS token FROM (SELECT 'math' AS module, a AS term FROM parts UNION ALL SELECT 'math', b FROM parts UNION ALL SELECT 'random', b FROM parts)),
    near AS (
        SELECT module, token, term, row_number() OVER (PARTITION BY module, token ORDER BY levenshtein(token, term) / length(term), term) AS k
        FROM calls JOIN exports USING (module) WHERE levenshtein(token, term) < 0.25 * length(term)),
    written AS (SELECT c.module, c.token, coalesce(n.term, c.token) AS term FROM calls c LEFT JOIN near n ON n.module = c.module AND n.token = c.token AND n.k = 1)"""


@query(f"""WITH {_PARTS}, {_EXPORTS}
    SELECT doc_id, 'import math' || chr(10) || 'import random as r' || chr(10) || 'math.' || x.term || '(' || n || ')' || chr(10) || 'r.' || y.term || '(math.' || z.term || ')'
        || chr(10) || 'math = ' || n || chr(10) || 'math.' || a || 'q(' || n || ')' AS fixed_code
    FROM parts JOIN written x ON x.module = 'math' AND x.token = a || 'q' JOIN written y ON y.module = 'random' AND y.token = b || 'q' JOIN written z ON z.module = 'math' AND z.token = b || 'q'""")
def fix_module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after a module's dot by a table of exports: words of parts, of which each module has one half."""
    word = F.explode(F.split("p_name", " "))
    exports = table(spark, sf_dir, "part").select(word.alias("term")).distinct().select(F.when(F.col("term") < "m", "math").otherwise("random").alias("module"), "term", F.col("term").alias("ord"))
    return repair.repaired_code(_programs(spark, sf_dir, CALLS, {}), exports=exports).select("doc_id", "fixed_code")


@query(_program_sql(HASKELL_PROGRAM, _HASKELL_WRITTEN))
def fix_haskell_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_code(_programs(spark, sf_dir, HASKELL_PROGRAM), "haskell")


def _accuracy_sql(found: str) -> str:
    compact = lambda x: f"replace({x}, ' ', '')"
    return f"CAST(round_even(100.0::DOUBLE - levenshtein({compact(f'lower({found})')}, {compact('lower(expected)')}) * 100.0::DOUBLE / length({compact('expected')}), 0) AS BIGINT)"


@query(f"WITH {_PARTS}, lines AS (" + " UNION ALL ".join(f"SELECT {_said(x.strip())} AS expected, {_first(_said(x.strip()))} AS raw, {w} AS fixed FROM parts" for x, w in zip(PROGRAM, _WRITTEN, strict=True)) + f"""),
    scored AS (SELECT {_accuracy_sql("raw")} AS accuracy, {_accuracy_sql("fixed")} AS accuracy_fixed, length(replace(expected, ' ', '')) AS length FROM lines),
    mean AS (SELECT round_even(sum(accuracy * length)::DOUBLE / sum(length), 2) AS accuracy, round_even(sum(accuracy_fixed * length)::DOUBLE / sum(length), 2) AS accuracy_fixed, sum(length)::BIGINT AS length FROM scored)
    SELECT *, round_even(accuracy_fixed - accuracy, 2) AS improvement FROM mean""")
def repaired_code_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _programs(spark, sf_dir, PROGRAM)
    told = repair.repaired_lines(lines, kept=("expected",))
    return evaluate.weighted(evaluate.score(told.withColumn("fixed", F.coalesce("fixed", "raw")), "raw", "fixed", "expected"))


#: Digits that may be letters.
DIGITS = {"0": ["0", "o"], "1": ["1", "l", "i"], "4": ["4", "a"], "3": ["3", "e"]}


_NEAREST_LATTICE = """
    WITH RECURSIVE words AS (SELECT p_partkey, translate(string_split(p_name, ' ')[-1], 'loae', '1043') || CASE WHEN p_size % 4 = 0 THEN 'x' ELSE '' END AS noisy FROM part),
    read AS (
        SELECT noisy, 0 AS place, '' AS reading, 0::BIGINT AS no, 1::BIGINT AS radix FROM (SELECT DISTINCT noisy FROM words)
        UNION ALL
        SELECT noisy, place + 1, reading || c[d], no + (d - 1) * radix, radix * len(c) FROM (
            SELECT *, unnest(range(1, len(c) + 1)) AS d FROM (
                SELECT *, CASE noisy[place + 1] WHEN '0' THEN ['0', 'o'] WHEN '1' THEN ['1', 'l', 'i'] WHEN '4' THEN ['4', 'a'] WHEN '3' THEN ['3', 'e'] ELSE [noisy[place + 1]] END AS c FROM read WHERE place < length(noisy)))),
    terms AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS term FROM part),
    near AS (SELECT noisy, term, levenshtein(reading, term) / length(term) AS ratio, row_number() OVER (PARTITION BY noisy ORDER BY levenshtein(reading, term) / length(term), no, term) AS k
             FROM read JOIN terms ON levenshtein(reading, term) < 0.25 * length(term) WHERE place = length(noisy))
    SELECT p_partkey, w.noisy, coalesce(term, w.noisy) AS term, coalesce(ratio, 0.25) AS ratio FROM words w LEFT JOIN near ON near.noisy = w.noisy AND k = 1"""


@query(_NEAREST_LATTICE)
def nearest_lattice_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_lattice(spark, sf_dir, None)


@query(_NEAREST_LATTICE)
def nearest_lattice_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the join for large dictionaries."""
    return _nearest_lattice(spark, sf_dir, True)


def _nearest_lattice(spark: SparkSession, sf_dir: str, pieces: bool | None) -> DataFrame:
    part = table(spark, sf_dir, "part")
    word = F.element_at(F.split("p_name", " "), -1)
    noisy = F.concat(F.translate(word, "loae", "1043"), F.when(F.col("p_size") % 4 == 0, "x").otherwise(""))
    told = part.select("p_partkey", noisy.alias("noisy")).withColumn("cand", lattice.spell(F.col("noisy"), DIGITS))
    terms = part.select(word.alias("term")).distinct().withColumn("ord", F.col("term"))
    return dictionary.nearest_readings(told, "cand", terms, pieces).select("p_partkey", "noisy", "term", "ratio")


_ARGS = "replace(p_name, ' ', ', ') || '(a, (b, c)), ' || p_size || CASE WHEN p_size % 5 = 0 THEN ',' WHEN p_size % 5 = 1 THEN ' (x,' ELSE '' END"


@query(f"""
    WITH RECURSIVE said AS (SELECT p_partkey, {_ARGS} AS args FROM part),
    read AS (
        SELECT p_partkey, args, 0 AS place, 0 AS depth, [''] AS parts FROM said
        UNION ALL
        SELECT p_partkey, args, place + 1, depth + CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END,
               CASE WHEN c = ',' AND depth = 0 THEN list_append(parts, '') ELSE list_append(parts[:-2], parts[-1] || c) END
        FROM (SELECT *, args[place + 1] AS c FROM read WHERE place < length(args)))
    SELECT p_partkey, args, len(parts) AS n_args, array_to_string(list_transform(parts, lambda p: trim(p)), '|') AS parts FROM read WHERE place = length(args)""")
def split_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 5
    args = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")), F.lit("(a, (b, c)), "), F.col("p_size").cast("string"), F.when(size == 0, ",").when(size == 1, " (x,").otherwise(""))
    told = table(spark, sf_dir, "part").select("p_partkey", args.alias("args"), text.split_args(args).alias("parts"))
    return told.select("p_partkey", "args", F.size("parts").cast("long").alias("n_args"), F.array_join("parts", "|").alias("parts"))


@query("""
    WITH said AS (SELECT p_partkey, '  ' || replace(p_name, ' ', ' , ') || '   ' AS s FROM part)
    SELECT p_partkey, array_to_string(list_transform(string_split(s, ','), lambda x: trim(x)), '|') AS names, trim(s) AS inner_text, 10 + length(s) - length(ltrim(s)) AS start_at, 10 + length(rtrim(s)) AS end_at FROM said""")
def trimmed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ")), F.lit("   "))
    told = table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.comma_names(s), "|").alias("names"), text.trimmed(s, F.lit(10)).alias("t"))
    return told.select("p_partkey", "names", F.col("t.text").alias("inner_text"), F.col("t.start").cast("long").alias("start_at"), F.col("t.end").cast("long").alias("end_at"))


@query("""SELECT vec_id, chr((33 + i)::INTEGER) AS c FROM (SELECT vec_id, arg_max(i, (x, i)) AS i FROM (
    SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY vec_id)""")
def class_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform("embedding", lambda x: x.cast("double"))
    best = table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(lattice.ranked(scores), 1)["idx"].alias("class_idx"))
    classes = spark.range(94).select(F.col("id").cast("int").alias("class_idx"), (F.col("id") + 33).cast("int").alias("codepoint"))
    return lattice.with_char(best, "class_idx", classes, "c").select("vec_id", "c")


@query("SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE / 255.0::DOUBLE AS first_pixel, list_max(list_transform(embedding, lambda x: x::DOUBLE / 255.0::DOUBLE)) AS brightest FROM embeddings")
def scaled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "embeddings").select("vec_id", lattice.scaled_pixels(F.col("embedding")).alias("p"))
    return told.select("vec_id", F.size("p").cast("long").alias("n"), F.element_at("p", 1).cast("double").alias("first_pixel"), F.array_max("p").cast("double").alias("brightest"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: CASE c WHEN 'l' THEN 'l/1/i/t' WHEN 'o' THEN 'o/0' WHEN 'e' THEN 'e/c/6' ELSE c END), ',') AS cand, length(p_name) AS places FROM part""")
def joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.split("p_name", " "), lambda w: lattice.spell(w, CONFUSIONS))
    told = table(spark, sf_dir, "part").select("p_partkey", lattice.join_words(words).alias("c"))
    return told.select("p_partkey", F.array_join(F.transform("c", lambda x: F.array_join(x, "/")), ",").alias("cand"), F.size("c").cast("long").alias("places"))


#: What is wrong in a repaired program: a parameter that begins with a digit, a condition that begins with "not", a function
#: that is called as it was misread or, where it is found, with an argument too many.
_FAULTS = f"""{_PARTS}, read AS (SELECT *, {_first("a")} AS own, {_first("b")} AS called, {_letters("b")} AS bound FROM parts),
    judged AS (SELECT *, CASE WHEN own[1] BETWEEN '0' AND '9' THEN 'parameter' WHEN a = 'hot' THEN 'condition' WHEN called <> bound THEN 'name' ELSE 'call' END AS fault FROM read),
    faults AS (
        SELECT doc_id, 3 AS line, 6 + length(b) AS col, 'syntax-error' AS symbol, 'E0001' AS message_id,
               CASE own[1] WHEN '0' THEN 'leading zeros in decimal integer literals are not permitted; use an 0o prefix for octal integers' ELSE 'invalid decimal literal' END AS message
        FROM judged WHERE fault = 'parameter'
        UNION ALL SELECT doc_id, 7, 8, 'syntax-error', 'E0001', 'invalid syntax' FROM judged WHERE fault = 'condition'
        UNION ALL SELECT doc_id, 7, 16 + length(a) + length(n), 'undefined-variable', 'E0602', format('Undefined variable ''{{}}''', called) FROM judged WHERE fault = 'name'
        UNION ALL SELECT doc_id, 8, 2, 'undefined-variable', 'E0602', format('Undefined variable ''{{}}''', called) FROM judged WHERE fault = 'name'
        UNION ALL SELECT doc_id, 8, 2, 'too-many-function-args', 'E1121', 'Too many positional arguments for function call' FROM judged WHERE fault = 'call')"""


@query(f"""WITH {_FAULTS} SELECT doc_id, 'error' AS type, 'main' AS module, '' AS obj, line, col::INTEGER AS "column", 'main.py' AS path, symbol, message, message_id FROM faults""")
def code_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = repair.repaired_code(_programs(spark, sf_dir, PROGRAM)).select("doc_id", F.col("fixed_code").alias("code"))
    return diagnostics(code)


def _width(line: str) -> str:
    """The width of a line's box as SQL."""
    return f"10 * length({_said(line.strip())})"


def _pictures_sql() -> str:
    left = lambda x: 10 * (len(x) - len(x.lstrip()))
    size = f"greatest({', '.join(f'{left(x)} + {_width(x)}' for x in PROGRAM)})"
    boxes = " UNION ALL ".join(f"SELECT doc_id, {k + 1} AS line, {left(x)} AS x, {30 * k} AS y, {_width(x)} AS width FROM parts" for k, x in enumerate(PROGRAM))
    place = lambda x, width: f"""'{{"x":' || {x} || '.0,"y":' || y || '.0,"width":' || {width} || '.0,"height":25.0}}'"""
    char = f"""CASE WHEN col >= 1 AND 10 * col <= width THEN ',"character":' || {place("x + 10 * (col - 1)", "10")} ELSE '' END"""
    return f"""WITH {_FAULTS}, boxes AS ({boxes}), sized AS (SELECT doc_id, {size} AS size FROM parts), texts AS (SELECT {_program_columns(PROGRAM, _WRITTEN)} FROM parts),
        marked AS (
            SELECT doc_id, count(*) AS n, string_agg('{{"line":' || {place("x", "width")} || {char} || '}}', ',' ORDER BY line, col) AS places
            FROM faults JOIN boxes USING (doc_id, line) GROUP BY doc_id)
        SELECT doc_id, code AS unfixed, fixed_code AS fixed, n::INTEGER AS n_errors,
               '{{"dimensions":{{"width":' || size || '.0,"height":295.0}},"bbox":{{"min_x":0.0,"min_y":0.0,"max_x":' || size || '.0,"max_y":295.0}},"errors":[' || places || ']}}' AS overlay
        FROM texts JOIN sized USING (doc_id) JOIN marked USING (doc_id)"""


@query(_pictures_sql())
def submitted_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _programs(spark, sf_dir, PROGRAM)
    wide = F.size("cand") * 10.0
    box = [(F.col("indent") * 20.0).alias("x"), (F.col("line_no") * 30.0).alias("y"), wide.alias("width"), F.lit(25.0).alias("height")]
    boxes = lines.select("doc_id", "line_no", *box)
    chars = lines.select("doc_id", "line_no", *box, F.explode(F.sequence(F.lit(0), F.size("cand") - 1)).alias("char_no"))
    chars = chars.withColumns({"x": F.col("x") + 10.0 * F.col("char_no"), "width": F.lit(10.0)})
    return service.submit(lines, boxes, chars).select("doc_id", "unfixed", "fixed", F.size("errors").alias("n_errors"), "overlay")


@query("""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS n_errors, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'syntax-error' WHEN 2 THEN 'undefined-variable' ELSE 'function-redefined,no-value-for-parameter' END AS symbols,
           CASE WHEN p_partkey % 3 = 0 THEN 'picture ' || p_partkey WHEN p_partkey % 3 = 1 THEN 'stored ' || p_partkey END AS content, CASE p_partkey % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'blob' END AS found_in,
           CASE WHEN p_size % 4 = 0 AND p_size % 8 <> 0 THEN 'print(' || p_size || ')' || chr(10) || 'check()' END AS program
    FROM part""")
def resubmitted_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code submitted again: its errors, its picture from the cache or else the store, and the test program where tests are due."""
    part, kind, key = table(spark, sf_dir, "part"), F.col("p_size") % 4, F.col("p_partkey").cast("string")
    code = F.when(kind == 0, F.concat(F.lit("print("), F.col("p_size").cast("string"), F.lit(")"))).when(kind == 1, "print(").when(kind == 2, "x = y").otherwise("def f(a): return a\ndef f(a): return 1\nf()")
    rows = part.select("p_partkey", key.alias("key"), code.alias("code"), F.when(F.col("p_size") % 8 != 0, "{}\ncheck()").alias("template"))
    held = lambda k, name: part.where(F.col("p_partkey") % 3 == k).select(key.alias("key"), F.concat(F.lit(name), key).alias("content"))
    told = service.resubmit(rows, held(0, "picture "), held(1, "stored "))
    return told.select("p_partkey", F.size("errors").cast("long").alias("n_errors"), F.array_join(F.transform("errors", lambda e: e["symbol"]), ",").alias("symbols"), "content", "found_in", "program")


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR length(coalesce(text, '')) = 0 THEN 'Program did not generate any output!' ELSE text END AS output, turn % 2 = 0 AND role = 'user' AS due FROM conversations""")
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    silent, errors = F.when(F.col("turn") % 3 != 0, F.col("text")), F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("error")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.output_or_default(silent).alias("output"), service.tests_due(errors, F.when(F.col("role") == "user", F.lit("{}"))).alias("due"))


@query("""
    SELECT c_custkey, 'img_' || c_custkey AS stem, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) END AS expected FROM customer WHERE c_custkey % 7 <> 0""")
def image_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed pictures, without dotfiles, and the code that the annotation of the same stem expects."""
    customer, name = table(spark, sf_dir, "customer"), F.concat(F.lit("img_"), F.col("c_custkey").cast("string"))
    pictures = files.named_rows(customer.select("c_custkey", F.concat(F.lit("/data/images/"), F.when(F.col("c_custkey") % 7 == 0, ".").otherwise(""), name, F.lit(".v2.png")).alias("path")))
    told = customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("/data/annotations/"), name, F.lit(".txt")).alias("path"), F.lower("c_name").alias("expected"))
    return files.with_annotation(pictures, files.named_rows(told)).select("c_custkey", "stem", "expected")


@query("""
    WITH said AS (SELECT md5(p_name || p_partkey) AS key, unnest([(0, p_size::VARCHAR, p_name, ''), (1, '', '2', 'count')]) AS c FROM part)
    SELECT key, c[1] AS case_no, c[2] AS input, c[3] AS expected, c[4] AS hint FROM said""")
def template_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.concat(F.lit('[{"input": "'), F.col("p_size").cast("string"), F.lit('", "output": "'), "p_name", F.lit('"}, {"output": "2", "hint": "count", "input": null}]'))
    rows = table(spark, sf_dir, "part").select(store.content_key(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("key"), cases.alias("cases"))
    return files.template_cases(rows)


@query("SELECT 'nation' AS container, n_name AS key FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'region', r_name FROM region WHERE r_name IN (SELECT n_name FROM nation WHERE n_regionkey < 3)")
def container_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    held = lambda c, t, k: t.select(F.lit(c).alias("container"), F.col(k).alias("key"))
    stored = held("nation", nation, "n_name").union(held("region", table(spark, sf_dir, "region"), "r_name")).union(held("other", nation, "n_name"))
    return files.blobs_of(stored, ["nation", "region"], nation.where("n_regionkey < 3").select(F.col("n_name").alias("key")))


@query("SELECT DISTINCT 'images' AS container, md5(text) AS key FROM documents WHERE text IS NOT NULL")
def stored_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as a stream whose sink stores, batch by batch, the contents that aren't there yet."""
    folder = cache.work_dir(spark)
    docs = streamed(spark, sf_dir, "documents")
    uploads = docs.where("text is not null").select(F.col("text").cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    cache.save_stream(uploads, f"{folder}/blobs", f"{folder}/state").awaitTermination()
    return files.blobs(spark, f"{folder}/blobs").select("container", "key")


@query("""SELECT p_partkey, '{"id":"' || CASE WHEN p_size % 3 = 0 THEN '' ELSE md5(p_name) END || '","error":"' || CASE WHEN p_size % 3 = 0 THEN 'Files Missing' ELSE '' END || '","success":' || CASE WHEN p_size % 3 = 0 THEN 'false' ELSE 'true' END || '}' AS response FROM part""")
def template_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("template"), F.when(F.col("p_size") % 3 != 0, F.lit('[{"input": "1"}]')).alias("cases"))
    return service.store_template(rows).select("p_partkey", "response")


@query()
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a network with random weights: vectors of 64, repeated to the size of a picture, stand for pixels."""

    def model():
        from restitch.functions import convnet

        weights = convnet.random_weights()
        return lambda pixels: convnet.forward(weights, pixels)

    pixels = F.slice(F.flatten(F.array_repeat("embedding", 13)), 1, 784)
    tensors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(pixels, lambda v: v.cast("float")).alias("pixels"))
    scored = predicted_scores(tensors, model)
    codepoints = F.sequence(F.lit(33), F.lit(126))
    return scored.select("vec_id", lattice.top_char(F.col("scores"), codepoints).alias("top"), F.array_join(lattice.candidates(F.col("scores"), codepoints), "").alias("candidates"))


# ---------------------------------------------------------------- ordered state


@query("""
    WITH e AS (SELECT event_id, user_id, ts, floor(value)::BIGINT % 4 AS indent, event_type = 'signup' AS opens FROM events),
    runs AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
    SELECT event_id, indent, run > 0 AND min(indent) OVER w >= first_value(indent) OVER w AS in_def FROM runs
    WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def scope_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.floor("value") % 4).alias("indent"), "event_type")
    return ordered.in_scope(rows, ["user_id"], ["ts", "event_id"], "indent", F.col("event_type") == "signup", "in_def", most=ordered.MOST_ROWS).select("event_id", "indent", "in_def")


#: A program whose names are bound again, as another kind and inside a function.
BINDINGS = [
    "import math", "{a} = {n}", "print({a})", "import os as {a}", "{a}.sqrt({n})", "{a} = 2", "print({a}, math)", "def {b}({a}):", "  {a} = 3", "  print({a}, {b})", "from sys import {a}, {b}", "{b}({a}, {n})",
]


@query(f"""
    WITH {_PARTS},
    bound AS (
        SELECT doc_id, 0 AS line_no, 'math' AS term, 'import' AS kind FROM parts UNION ALL SELECT doc_id, 1, a, 'variable' FROM parts UNION ALL SELECT doc_id, 3, a, 'import' FROM parts
        UNION ALL SELECT doc_id, 5, a, 'variable' FROM parts UNION ALL SELECT doc_id, 10, a, 'import' FROM parts UNION ALL SELECT doc_id, 10, b, 'import' FROM parts),
    texts AS (SELECT doc_id, unnest([{{'n': 2, 't': 'print(' || a || ')'}}, {{'n': 4, 't': a || '.sqrt(' || n || ')'}}, {{'n': 6, 't': 'print(' || a || ', math)'}}, {{'n': 9, 't': 'print(' || a || ', ' || b || ')'}},
        {{'n': 11, 't': b || '(' || a || ', ' || n || ')'}}], recursive := true) FROM parts),
    used AS (SELECT DISTINCT doc_id, n AS line_no, unnest(regexp_extract_all(t, '[a-z_]+')) AS term FROM texts),
    seen AS (SELECT u.doc_id, u.line_no, u.term, max(b.line_no) AS bound_at FROM used u LEFT JOIN bound b ON b.doc_id = u.doc_id AND b.term = u.term AND b.line_no < u.line_no GROUP BY ALL)
    SELECT s.doc_id, s.line_no, s.term, bound_at, any_value(kind) AS kind FROM seen s LEFT JOIN bound b ON b.doc_id = s.doc_id AND b.term = s.term AND b.line_no = bound_at GROUP BY ALL""")
def bindings_in_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each name in a call, the line and kind of the binding that it refers to: the latest before it, if any."""
    lines = _programs(spark, sf_dir, BINDINGS, {})
    return repair.references(lines).select("doc_id", "line_no", "term", F.col("bound.line_no").alias("bound_at"), F.col("bound.kind").alias("kind"))


@query("""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1 AS is_first FROM events)
    SELECT event_id, coalesce(sum(is_first::INTEGER) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_visible, NOT is_first AS is_visible FROM f""")
def users_seen_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few types hold all events: each is read in parts."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id")
    return ordered.seen_before(rows, ["event_type"], ["ts", "event_id"], "user_id", most=1000).select("event_id", "n_visible", "is_visible")


@query("""
    WITH e AS (SELECT event_id, event_type, ts, floor(value)::BIGINT % 4 AS indent, user_id % 50 = 0 AS opens FROM events),
    runs AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM e)
    SELECT event_id, indent, run > 0 AND min(indent) OVER w >= first_value(indent) OVER w AS in_scope FROM runs
    WINDOW w AS (PARTITION BY event_type, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def scopes_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes that run on through many parts of a group."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.floor("value") % 4).alias("indent"), "user_id")
    return ordered.in_scope(rows, ["event_type"], ["ts", "event_id"], "indent", F.col("user_id") % 50 == 0, "in_scope", most=1000).select("event_id", "indent", "in_scope")


@query("""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS is_first FROM events)
    SELECT event_id, event_type, coalesce(sum(is_first::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_visible,
           NOT is_first AS is_visible FROM f""")
def running_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return ordered.seen_before(rows, ["user_id"], ["ts", "event_id"], "event_type", most=ordered.MOST_ROWS).select("event_id", "event_type", "n_visible", "is_visible")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (
        SELECT user_id, event_id, k, [x] AS sums, [1] AS sizes, 0 AS level FROM e WHERE k = 1
        UNION ALL
        SELECT user_id, event_id, k,
               CASE WHEN lv = len(sums) THEN list_append(sums, x) ELSE list_transform(sums, lambda v, i: CASE WHEN i - 1 = lv THEN v + x ELSE v END) END,
               CASE WHEN lv = len(sums) THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda v, i: CASE WHEN i - 1 = lv THEN v + 1 ELSE v END) END, lv
        FROM (SELECT *, CASE WHEN x < means[1] - 10 THEN 0 WHEN x > means[-1] + 10 THEN len(means)
                             ELSE list_position(list_transform(means, lambda m: abs(m - x)), list_min(list_transform(means, lambda m: abs(m - x)))) - 1 END::INTEGER AS lv
              FROM (SELECT e.user_id, e.event_id, e.k, e.x, s.sums, s.sizes, list_transform(range(1, len(s.sums) + 1), lambda i: s.sums[i] / s.sizes[i]) AS means
                    FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
    SELECT event_id, level AS indent FROM s""")
def indent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ordered.indent_levels(rows, ["user_id"], ["ts", "event_id"], "value", 10.0).select("event_id", "indent")


# ---------------------------------------------------------------- boxes, errors, diagnostics, tests


@query("""
    SELECT l_returnflag, min(l_extendedprice) AS min_x, min(l_quantity) AS min_y, max(l_extendedprice + l_discount) AS max_x, max(l_quantity + l_tax) AS max_y
    FROM lineitem GROUP BY l_returnflag""")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bounding_box(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))


@query("""
    SELECT l_orderkey, l_partkey AS line, l_linenumber AS "column", p.p_retailprice AS line_x, p.p_size AS line_y, c.p_retailprice AS char_x, c.p_size AS char_y
    FROM lineitem LEFT JOIN part p ON p.p_partkey = l_partkey LEFT JOIN part c ON c.p_partkey = l_partkey AND c.p_size + 1 = l_linenumber""")
def error_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("line"), F.col("l_linenumber").alias("column"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.col("p_size").alias("column"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))
    return evaluate.locate_errors(errors, part.drop("column"), part)


@query("""
    WITH told AS (SELECT l_orderkey, l_partkey, 'Main.hs:' || l_orderkey || ':' || l_linenumber || ': error:' || chr(10) || '    part ' || l_partkey || chr(13) || chr(10) ||
                         'Main.hs:' || l_suppkey || ':1: warning: unused' AS err FROM lineitem)
    SELECT l_orderkey, l_partkey, unnest(regexp_extract_all(err, 'hs:(\\d+):(\\d+): (\\w+):\\W+([^\\r\\n]+)', 1))::INTEGER AS line, unnest(regexp_extract_all(err, 'hs:(\\d+):(\\d+): (\\w+):\\W+([^\\r\\n]+)', 2))::INTEGER AS "column",
           unnest(regexp_extract_all(err, 'hs:(\\d+):(\\d+): (\\w+):\\W+([^\\r\\n]+)', 3)) AS type, unnest(regexp_extract_all(err, 'hs:(\\d+):(\\d+): (\\w+):\\W+([^\\r\\n]+)', 4)) AS message FROM told""")
def diagnostics_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    err = F.concat(F.lit("Main.hs:"), s("l_orderkey"), F.lit(":"), s("l_linenumber"), F.lit(": error:\n    part "), s("l_partkey"), F.lit("\r\nMain.hs:"), s("l_suppkey"), F.lit(":1: warning: unused"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.inline(text.haskell_reports(err)))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.hint'), '') AS hint FROM events")
def json_testcases(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.from_json("props", "struct<k:string,hint:string>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(told["k"], F.lit("")).alias("k"), F.coalesce(told["hint"], F.lit("")).alias("hint"))


_TURNS = """
    WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT conv_id, turn, coalesce(length(reply) >= length(text), false) AS passed FROM t WHERE role = 'user' AND next_role = 'assistant')"""


def _turn_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as cases: one passes where the reply's size is what a reply that is no shorter has."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("reply"))
    turns = turns.where("role = 'user' and next_role = 'assistant'")
    cases = turns.select("conv_id", "turn", F.greatest(F.length("text"), F.length("reply")).cast("string").alias("expected"))
    outputs = turns.select("conv_id", "turn", F.length("reply").cast("string").alias("output"))
    return evaluate.test_results(cases, outputs, ["conv_id", "turn"])


@query(_TURNS + " SELECT conv_id, turn, passed FROM r")
def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_results(spark, sf_dir).select("conv_id", "turn", "passed")


@query(_TURNS + " SELECT conv_id, count(*) AS n_cases, count_if(passed)::BIGINT AS n_passed, bool_and(passed) AS all_passed FROM r GROUP BY conv_id")
def tests_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_results(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("all_passed"))


# ---------------------------------------------------------------- text


@query("SELECT p_partkey, replace('{}' || chr(10) || 'print(add(1, {1}))', '{}', 'def add(x, y): return {x: ' || p_name || '}') AS code FROM part")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("def add(x, y): return {x: "), "p_name", F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", text.fill_template(F.lit("{}\nprint(add(1, {1}))"), code).alias("code"))


@query("""SELECT page_id, md5(replace(replace(replace(html || ' x = '''' ,, --', '--', '__'), '''''', '"'), ',,', '"')) AS fixed_md5, length(replace(replace(replace(html || ' x = '''' ,, --', '--', '__'), '''''', '"'), ',,', '"')) AS n_chars FROM pages""")
def naive_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = text.naive_fix(F.concat("html", F.lit(" x = '' ,, --")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(fixed.cast("binary")).alias("fixed_md5"), F.length(fixed).cast("long").alias("n_chars"))


@query("""SELECT doc_id, CASE lower(lang) WHEN 'en' THEN 'python3' WHEN 'de' THEN 'haskell' ELSE 'python3' END AS language,
    CASE WHEN contains(source, 'src1') THEN text ELSE lower(text) END = text AS unchanged FROM documents""")
def lang_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = evaluate.by_language(F.col("lang"), {"en": F.lit("python3"), "de": F.lit("haskell")}, F.lit("python3"))
    kept = F.when(F.contains("source", F.lit("src1")), F.col("text")).otherwise(F.lower("text")) == F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", language.alias("language"), kept.alias("unchanged"))




@query("""
    SELECT p_partkey, CASE WHEN levenshtein(t, 'true') <= 1 THEN 'True' WHEN levenshtein(t, 'false') <= 2 THEN 'False' WHEN levenshtein(t, 'none') <= 1 THEN 'None' ELSE t END AS token,
           repeat('  ', p_size) || p_name AS line
    FROM (SELECT p_partkey, p_size, p_name, CASE p_size % 5 WHEN 0 THEN 'tru' WHEN 1 THEN 'fa1se' WHEN 2 THEN 'nome' ELSE p_name END AS t FROM part)""")
def literals_and_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    token = F.when(k == 0, "tru").when(k == 1, "fa1se").when(k == 2, "nome").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.restore_literal(token).alias("token"), text.indented(F.col("p_name"), F.col("p_size")).alias("line"))


# ---------------------------------------------------------------- storage and cache


@query("""SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM benchmark WHERE text IS NOT NULL) GROUP BY md5(text)""")
def content_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select(store.content_key(F.col("text")).alias("key"), "doc_id")
    there = table(spark, sf_dir, "benchmark").where("text is not null").select(store.content_key(F.col("text")).alias("key"))
    return store.insert_if_absent(rows, there, "key", "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def fk_checked_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_parent(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without_parent(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
    WITH both AS (SELECT c_custkey AS k, 'customer' AS origin, c_acctbal AS balance, 0 AS version FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, 1 FROM supplier)
    SELECT k, arg_max(origin, version) AS origin, arg_max(balance, version) AS balance FROM both GROUP BY k""".replace("both", "merged"))
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("version"))
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("version"))
    return store.upsert(current, changes, "k", "version").select("k", "origin", "balance")


@query("""
    SELECT o_orderkey, coalesce(c.c_name, n.n_name) AS value, CASE WHEN c.c_name IS NOT NULL THEN 'cache' WHEN n.n_name IS NOT NULL THEN 'blob' END AS found_in
    FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey LEFT JOIN nation n ON n_nationkey = o_custkey""")
def cache_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    cached = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    blobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"))
    return store.read_through(requests, cached, blobs, "key", "value").drop("key")


_TTL = """
    SELECT event_id, user_id, CASE WHEN prev IS NULL THEN 'first' WHEN epoch_us(ts) - epoch_us(prev) <= 1800000000 THEN 'hit' ELSE 'expired' END AS status
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"""


@query(_TTL)
def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cache_status(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"]).select("event_id", "user_id", "status")


@query(_TTL)
def ttl_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streamed(spark, sf_dir, "events")
    told = cache.cache_status(events)
    return cache.replay(spark, told, told._jdf.schema().toDDL()).select("event_id", "user_id", "status")


@query("""
    SELECT event_id, user_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 'hit' ELSE 'miss' END AS status FROM events""")
def ttl_cache_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state with a time to live: keys that have expired leave none."""
    events = streamed(spark, sf_dir, "events")
    with cache.timers(spark):
        told = cache.expiring_status(events)
        return cache.replay(spark, told, told._jdf.schema().toDDL()).select("event_id", "user_id", "status")


@query("""
    SELECT o_custkey::VARCHAR AS key, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS code, max(o_orderdate) AS ts
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""")
def code_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of stored images, upserted in three batches, the second of them once more after the last."""
    path = f"{cache.work_dir(spark)}/store"
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    images = customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    containers.insert_absent(images, path, "images", 16)
    code = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").cast("binary").alias("content"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    for k in (0, 1, 2, 1):
        containers.save_code(code.where(F.col("o_orderkey") % 3 == k).drop("o_orderkey"), path, buckets=16)
    return containers.read(spark, path, ["code"]).select("key", F.col("content").cast("string").alias("code"), F.col("ts").cast("timestamp_ntz").alias("ts"))
