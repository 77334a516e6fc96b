"""Secret scans: fixed patterns, and assignment-aware lexing.

A text that holds both a sensitive stem and an assignment sign is lexed as source or configuration: names,
string literals, bare values and operators.  Assignments, keyword arguments, mapping entries, element pairs, setters,
options, macros and blocks give (name, value) pairs; ``a = b`` and ``"x" + "y"`` carry literals on, so a constant counts for every name
that it reaches.  A literal is a secret when the sensitivity of its name and its value's shape score high enough.
Values share their parts, so the work is in proportion to the text however often constants are joined.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.llm.textscan import values

#: Fixed by the contract of the scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}
_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    low = text.lower()
    out: list[Span] = []
    if any(s in low for s in _ASSIGN_STEMS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return _sorted(out)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1]))


# ---------------------------------------------------------------- lexing

_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer")
_TOKEN = re.compile(
    r"""
    (?P<word>(?:[A-Za-z]{2,}|I)'(?:s|t|d|m|ll|re|ve)\b(?!'))
  | (?P<block>(?<=:)[^\S\n]+[|>][+-]?\d?[^\S\n]*\n(?=[^\S\n]))
  | (?P<given>(?:(?<![\w-])--(?P<option>[A-Za-z][\w-]*)|\#[^\S\n]*define[^\S\n]+(?P<macro>[A-Za-z_]\w*))(?=[^\S\n]+[^\s(-]))
  | (?P<text>(?:[A-Za-z]{1,2}|[@$]{1,2})?(?:(?P<three>\"\"\"|\'\'\')(?s:.*?)(?P=three)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`))
  | (?P<tag><(?P<tagname>[A-Za-z_][\w.-]*)>(?P<tagtext>[^<>\n]+)</(?P=tagname)>)
  | (?P<compare>===?|!==?|<=|>=)
  | (?P<joint>::)
  | (?P<sign>:=|=>|->|\+=|=|:)
  | (?P<alt>\|\||\?\?|(?:or|else)\b)
  | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
  | (?P<plus>\+|\.\.)
  | (?P<open>[(\[{])
  | (?P<close>[)\]}])
  | (?P<comma>,)
  | (?P<stop>;)
  | (?P<line>\n)
  | (?P<blank>(?:[^\S\n]|\\\r?\n)+)
  | (?P<skip>\\.)
  | (?P<other>.)
    """,
    re.X | re.A,
)
_LINE = re.compile(r"(?P<indent>[^\S\n]*)(?P<said>(?:\S(?:[^\n]*\S)?)?)[^\S\n]*(?:\n|\Z)")
_BARE = re.compile(r"[^\s,;(){}\[\]<>\"'`]+")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Weights of the words of a name, of its last word, and of pairs of neighbouring words.
NAMES = {"password": 0.5, "passwd": 0.5, "pwd": 0.5, "passphrase": 0.5, "passcode": 0.5, "secret": 0.5, "secrets": 0.4, "token": 0.45, "apikey": 0.5, "credential": 0.45, "credentials": 0.4, "bearer": 0.45, "auth": 0.3}
LAST = {"pass": 0.45}
PAIRS = {("api", "key"): 0.5, ("access", "key"): 0.5, ("private", "key"): 0.5, ("secret", "key"): 0.55, ("signing", "key"): 0.5, ("encryption", "key"): 0.5, ("client", "secret"): 0.55, ("auth", "token"): 0.5, ("pass", "word"): 0.5, ("pass", "phrase"): 0.5}
#: Words written as one, such as pgpass; and what a plural weighs less.
_COMPOUND = re.compile(r"(?:db|pg|my|sql|mysql|user|root|admin|ftp|smtp|mail|ssh|ssl|http|proxy|redis|mongo|ldap|login|key|store|keystore|wifi|vpn)(?:pass|pwd|password|passwd|passphrase|secret|token)")
COMPOUND, PLURAL = 0.45, 0.1
#: A plural that is rarely of secrets: words and symbols of a text are called so.
NO_PLURAL = {"tokens", "auths"}
#: Calls that take a name and a value as neighbouring arguments, in lower case and without underscores; and calls that are named after what they set.
SETS_PAIR = {"define", "setdefault", "setenv", "putenv", "set", "put", "setproperty", "setitem", "setattr", "setparameter", "setconfig", "setheader", "addheader"}
_SETS_ONE = re.compile(r"(?:set|with|use)(?:_\w+|[A-Z]\w*)")
#: Entries of a mapping that tell about a secret and aren't its value.
DESCRIBES = {"type", "pattern", "regex", "format", "description", "title", "label", "name", "help", "placeholder", "id", "url", "uri", "href", "path", "file", "env", "ref", "$ref", "host", "user", "username", "email", "message", "error", "class"}
#: Words of a declaration that are types; the name before one is what is declared.
TYPES = {"string", "str", "text", "char", "varchar", "bytes", "byte"}
_HOLD_WORDS = ("changeme", "change_me", "example", "placeholder", "your_", "your-", "dummy", "redacted", "todo", "none", "null", "undefined", "true", "false")
_SEAM = max(map(len, _HOLD_WORDS)) - 1
#: An argument of a call that looks like this is the name of a setting.
_SETTING = re.compile(r"[A-Za-z]+(?:[_.\-/: ][A-Za-z]+)*")
THRESHOLD = 0.75


def _word_weight(word: str) -> float:
    if word in NAMES:
        return NAMES[word]
    one = word if word in NO_PLURAL else word.removesuffix("s")
    return COMPOUND if _COMPOUND.fullmatch(word) else max(NAMES.get(one, 0) - PLURAL, 0) if one != word else 0


def name_weight(name: str) -> float:
    words = [w.lower() for w in _HUMP.findall(name)]
    return max([0.0, *(_word_weight(w) for w in words), *(LAST.get(w, 0) for w in words[-1:]), *(PAIRS.get(p, 0) for p in zip(words, words[1:], strict=False))])


@dataclass(slots=True)
class Profile:
    """What the score of a text needs, so that the profile of two texts together follows from theirs."""

    n: int
    counts: Counter
    classes: int
    blank: bool
    held: bool  # a word of a placeholder is in it
    head: str
    tail: str

    @staticmethod
    def of(text: str) -> Profile:
        low = text.lower()
        classes = 0
        counts: Counter = Counter()
        for c, n in Counter(text).items():
            classes |= 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8
            counts[ord(c) & 127] += n  # characters beyond ASCII count by their last bits
        return Profile(len(text), counts, classes, any(map(str.isspace, text)), any(w in low for w in _HOLD_WORDS), low[:_SEAM], low[-_SEAM:])

    def __add__(self, more: Profile) -> Profile:
        seam = self.tail + more.head
        held = self.held or more.held or any(w in seam for w in _HOLD_WORDS)
        return Profile(
            self.n + more.n, self.counts + more.counts, self.classes | more.classes, self.blank or more.blank, held, (self.head + more.head)[:_SEAM], (self.tail + more.tail)[-_SEAM:]
        )

    def placeholder(self) -> bool:
        marks = (self.head[:1], self.tail[-1:])
        only = set(self.counts)
        return (
            self.held or only <= {ord("x"), ord("X")} or only == {ord("*")} or marks in (("<", ">"), ("%", "%")) or marks[0] == "$" or (self.head[:2], self.tail[-2:]) == ("{{", "}}")
        )

    def weight(self, quoted: bool) -> float:
        """-1 to 0.5 by length, classes of characters and entropy; a placeholder or prose is below zero."""
        if self.n < 6 or self.placeholder():
            return -1.0
        if self.blank:
            return -0.3
        classes = self.classes.bit_count()
        entropy = -sum(k / self.n * math.log2(k / self.n) for k in self.counts.values())
        return 0.1 * (self.n >= 8) + 0.1 * (classes >= 2) + 0.1 * (classes >= 3) + 0.1 * (entropy >= 2.5) + 0.1 * (entropy >= 3.3) - (0 if quoted else 0.15)


def literal_weight(value: str, quoted: bool) -> float:
    return Profile.of(value).weight(quoted)


class Value:
    """A literal (its span), or values joined.  Parts are shared, so a constant used again costs nothing."""

    __slots__ = ("parts", "profile", "quoted", "span")

    def __init__(self, span: tuple[int, int] | None, quoted: bool = True, parts: tuple[Value, ...] = ()):
        self.span, self.parts, self.profile = span, parts, None
        self.quoted = quoted and all(p.quoted for p in parts)

    @staticmethod
    def joined(parts: list[Value]) -> Value:
        return parts[0] if len(parts) == 1 else Value(None, True, tuple(parts))

    def profiled(self, text: str) -> Profile:
        stack = [self]
        while stack:
            v = stack[-1]
            if v.profile is None and v.span is not None:
                v.profile = Profile.of(text[slice(*v.span)])
            if v.profile is None and (missing := [p for p in v.parts if p.profile is None]):
                stack += missing
                continue
            if v.profile is None:
                v.profile = reduce(Profile.__add__, (p.profile for p in v.parts))
            stack.pop()
        return self.profile


class _Level:
    """The statement at hand inside a pair of brackets."""

    __slots__ = ("args", "at_arg", "callee", "inner", "kind", "left", "more", "names", "owners", "parts", "ready", "sign", "targets", "ternary", "use")

    def __init__(self, kind: str, use: str = "", callee: str = "", owners: tuple[str, ...] = ()):
        self.kind, self.use = kind, use  # use: of what is inside: "call", "list" (or a value in brackets), "set", "key" or nothing
        self.callee, self.owners = callee, owners  # the call that sets a value; who gets the mapping
        self.args: list[tuple[int, Value]] = []
        self.at_arg = 0
        self.inner: str | None = None  # the last literal, which may be a key
        self.left: list[str] = []
        self.fresh()

    def fresh(self) -> None:
        self.targets: list[str] = []  # who gets the value
        self.more: list[str] = []  # and who the values after commas, the last first
        self.sign, self.ternary = "", False
        self.empty()

    def empty(self) -> None:
        self.parts: list[Value] = []
        self.names: list[tuple[str, int, int]] = []  # names one after the other, not joined to parts yet
        self.ready = True  # an operand may follow

    def declared(self) -> str | None:
        """What a sign after the names or the literal at hand assigns to."""
        if self.names:
            last = self.names[-1][0]
            return self.names[-2][0] if len(self.names) > 1 and last.lower() in TYPES else last
        return self.inner


def pairs(text: str) -> list[tuple[str, Value]]:
    """(name, value) of each assignment: ``a = v``, ``a: type = v``, ``a = b = v``, ``a, b = v, w``, ``"k": v``, ``x["k"] = v``,
    ``a += v``, ``a = {"k": v}``, ``set_a(v)``, ``define("a", v)``, ``--a v``, ``#define a v``, and of each line of a block ``a: |``.

    One pass over the tokens with a stack of open brackets.  Values are literals and constants known by then, joined by
    plus signs or side by side; names that are not known are passed over.  Of a call's arguments those after the
    first are values (defaults), and a single one unless it looks like the name of a setting.
    """
    constants: dict[str, Value] = {}
    out: list[tuple[str, Value]] = []
    levels = [_Level("")]
    at, n = 0, len(text)

    def told(f: _Level, value: Value) -> None:
        for name in f.targets:
            constants[name] = value
            out.append((name, value))
            if name.lower() not in DESCRIBES:
                out.extend((owner, value) for owner in f.owners)
        if f.use in ("call", "list", "set"):
            f.args.append((f.at_arg, value))

    def fold(f: _Level) -> None:
        if len(f.names) == 1 and f.names[0][0] in constants:
            f.parts.append(constants[f.names[0][0]])
        f.names = []

    def value_of(f: _Level) -> Value | None:
        if f.names and not f.parts and f.targets and f.names[0][0] not in constants and (bare := _BARE.match(text, f.names[0][1])):
            return Value(bare.span(), False)  # a word without quotes; a key, as in x["k"], is none
        if f.names and not f.parts:
            f.names = f.names[:1]
        fold(f)
        return Value.joined(f.parts) if f.parts else None

    def finish(f: _Level) -> None:
        if (f.targets or f.use in ("call", "list", "set")) and (v := value_of(f)) is not None:
            told(f, v)
        f.empty()

    def has_set(f: _Level) -> None:
        if _SETS_ONE.fullmatch(f.callee.rsplit(".", 1)[-1]):
            out.extend((f.callee, v) for no, v in f.args if no == f.at_arg and not (v.span and _SETTING.fullmatch(text, *v.span)))
        for (no, key), (after, v) in zip(f.args, f.args[1:], strict=False):
            if key.span and after == no + 1:
                out.append((text[slice(*key.span)], v))

    while at < n:
        m = _TOKEN.match(text, at)
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind in ("tagname", "tagtext"):
            kind = "tag"
        f = levels[-1]
        if kind in ("blank", "joint") or (kind == "line" and f.kind in ("(", "[")):
            continue
        was, f.inner = f.inner, None
        if kind == "block":
            owners, at = f.targets, _block(text, at, found := [])
            out.extend((name, Value(span)) for name in owners for span in found)
            f.fresh()
        elif kind == "given":
            finish(f)
            f.fresh()
            f.targets, f.sign = [m["option"] or m["macro"]], "="
        elif kind in ("text", "three"):
            a, b = _inner(m)
            if f.names or not (f.ready or f.parts):
                f.empty()  # a word before a literal, as in return "x"
            if f.targets or f.use:
                f.parts.append(Value((a, b)))
            f.ready, f.inner = False, text[a:b]
        elif kind == "name":
            bare = None
            if f.targets and not f.parts and not f.names:
                bare = _BARE.match(text, start)
                after = text[bare.end() : bare.end() + 1]
                if bare.end() == at or after in tuple("\"'`([") and after or text[at] in ":=":
                    bare = None
            if bare is not None:
                f.parts.append(Value(bare.span(), False))
                f.ready, at = False, bare.end()
            else:
                if f.parts and not f.ready:
                    finish(f)
                    f.fresh()
                f.names.append((m["name"], start, at))
                f.ready = False
        elif kind == "sign":
            f.inner = was
            key, sign = f.declared(), m["sign"]
            f.inner = None
            if f.ternary and sign == ":":
                finish(f)
                continue
            plain = sign in ("=", ":=")
            if f.names and not f.parts and f.targets and plain and f.sign in (":", "=", ":="):
                if f.sign != ":" and key is not None:
                    f.targets.append(key)  # a = b = ...
                f.sign = sign  # or a: type = ...
                f.empty()
                continue
            if was is not None and f.parts and not f.names:
                f.parts.pop()  # the literal is a key
            names = f.names
            if f.parts:
                f.names = []
                finish(f)
            f.names = names
            keys = [key, *reversed(f.left)] if plain and f.kind in ("", "{") else [key]
            f.fresh()
            f.left = []
            if key is not None:
                f.targets, f.more, f.sign = [keys.pop()], keys, sign
            if sign == "+=" and key in constants:
                f.parts = [constants[key]]
        elif kind == "plus":
            if f.targets and not f.parts and not f.names and (bare := _BARE.match(text, start)) and bare.end() > at:
                f.parts.append(Value(bare.span(), False))
                f.ready, at = False, bare.end()
            else:
                fold(f)
                f.ready = True
        elif kind == "alt":
            finish(f)
        elif kind == "open":
            use = ""
            if m["open"] == "[" and (f.names or not f.targets):
                use = "key"
            elif m["open"] != "{" and (f.targets or f.use in ("call", "list", "set")) and not (f.parts and not f.ready):
                use = "call" if f.names else "list"
            callee = f.names[-1][0] if m["open"] == "(" and f.names and f.names[-1][2] == start else ""
            last = callee.rsplit(".", 1)[-1]
            if not (_SETS_ONE.fullmatch(last) or last.lower().replace("_", "") in SETS_PAIR):
                callee = ""
            whole = m["open"] == "{" and f.sign in ("=", ":", ":=") and not f.parts and not f.names
            levels.append(_Level(m["open"], use or "set" * bool(callee), callee, tuple(t.rsplit(".", 1)[-1] for t in f.targets) if whole else ()))
        elif kind == "close":
            if len(levels) == 1:
                finish(f)
                f.fresh()
                continue
            if f.use == "key":
                f.inner = was
            else:
                finish(f)
            if f.callee:
                has_set(f)
            levels.pop()
            up = levels[-1]
            if f.use == "key":
                if f.inner is not None:
                    up.names = [(f.inner, start, at)]
            elif f.use == "call":
                up.names = []
                many = f.at_arg > 0
                for no, v in f.args:
                    if no if many else not (v.span and _SETTING.fullmatch(text, *v.span)):
                        told(up, v)
                up.ready = False
            elif f.use == "list" and f.at_arg == 0 and len(f.args) == 1:
                up.parts.append(f.args[0][1])
                up.ready = False
            elif f.use == "list":
                for _, v in f.args:
                    told(up, v)
        elif kind == "comma":
            key = f.names[-1][0] if f.names and not f.targets else None
            finish(f)
            more = f.more
            f.fresh()
            f.at_arg += 1
            if more:
                f.targets, f.more = [more.pop()], more
            elif key is not None:
                f.left.append(key)
            else:
                f.left = []
        elif kind == "line":
            if not (f.ready and f.parts):
                finish(f)
                f.fresh()
                f.left = []
        elif kind == "tag":
            out.append((m["tagname"], Value(m.span("tagtext"))))
            f.fresh()
        elif kind == "other" and f.names and m["other"] in "?!" and text[at : at + 1] == ":":
            pass  # name?: type
        elif kind == "other" and f.targets and f.sign == ":" and not f.parts and m["other"] in "|&*?":
            pass  # a type
        elif kind == "other" and m["other"] == "?" and f.targets:
            f.ternary = True
            f.empty()
        elif kind == "other" and f.targets and not f.parts and not f.names and (bare := _BARE.match(text, start)):
            f.parts.append(Value(bare.span(), False))
            f.ready, at = False, bare.end()
        else:  # a comparison, the end of a statement, another operator, a word of prose
            if kind == "compare":
                f.empty()
            finish(f)
            f.fresh()
            f.left = []
    while levels:
        finish(levels.pop())
    return out


def _block(text: str, at: int, found: list[tuple[int, int]]) -> int:
    """Put the spans of the lines of the block at ``at`` into ``found``; where the first line is that isn't in it.

    The block's lines are indented like its first, or more, or blank.
    """
    deep = None
    while (m := _LINE.match(text, at)) is not None and m.end() > at:
        if m["said"]:
            deep = len(m["indent"]) if deep is None else deep
            if len(m["indent"]) < deep:
                break
            found.append(m.span("said"))
        at = m.end()
    return at


def _inner(m: re.Match) -> tuple[int, int]:
    """Where the characters of a literal are, without its prefix and quotes."""
    s = m["text"]
    a = next(i for i, c in enumerate(s) if c in "\"'`")
    q = 3 if m["three"] else 1
    return m.start("text") + a + q, m.end("text") - q


def lexed_spans(text: str, taken: list[Span], threshold: float = THRESHOLD) -> list[Span]:
    """Literals that reach sensitive names and don't lie within a span found before."""
    low = text.lower()
    if not any(s in text for s in (":", "=", "->", "</", "(", "--", "define")) or not any(s in low for s in _STEMS):
        return []
    stack = [v for name, v in pairs(text) if (w := name_weight(name)) and w + v.profiled(text).weight(v.quoted) >= threshold]
    found: set[tuple[int, int]] = set()
    seen: set[int] = set()
    while stack:
        v = stack.pop()
        if id(v) not in seen:
            seen.add(id(v))
            stack += v.parts
            if v.span is not None and v.span[1] > v.span[0]:
                found.add(v.span)
    starts = [x for x, _, _ in taken]
    ends = list(accumulate((y for _, y, _ in taken), max))  # how far the spans reach that start by then
    return [(a, b, "literal") for a, b in found if not ((k := bisect_right(starts, a)) and ends[k - 1] >= b)]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    more = lexed_spans(text, base)
    return base, _sorted(base + more) if more else base


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, text in values(*b.columns):
            base, spans = all_spans(text)
            n = Counter(k for *_, k in base)
            out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), len(spans)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, counts and digest of the fixed patterns, all spans, n_spans.

    Spans are kind:start:end in code points, by start and kind.  A null or empty text has none; a very long one is
    scanned whole, in time in proportion to it; repeated rows and ids are scanned alike; an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan, SCHEMA)


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    if not text:
        return text
    spans = all_spans(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(redact_text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark, and n_chars, where there is one, counted anew.

    Overlapping spans share a mark.  Texts without secrets, null texts among them, stay as they are, and so do all
    other columns, whatever their names.
    """
    text = _redact(F.col("text"))
    if "n_chars" not in docs.columns:
        return docs.withColumn("text", text)
    kind = docs.schema["n_chars"].dataType
    n_chars = F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text).cast(kind))
    return docs.withColumns({"text": text, "n_chars": n_chars})
