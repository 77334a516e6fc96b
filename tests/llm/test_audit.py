"""The source audit against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from restitch.llm import source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def brute(rows, top=200):
    langs: dict = {}
    for _, text, lang, source, _ in rows:
        langs.setdefault(lang or "", []).append((source or "", TERM.findall((text or "").translate(LOW))))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, ts in docs for t in set(ts))
        kept = [t for t, n in df.items() if n >= 3]
        by = {s: Counter() for s, _ in docs}
        for s, ts in docs:
            by[s].update(t for t in ts if df[t] >= 3)
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) * (p - q) // q
        whole = sum(by.values(), Counter())
        for s, c in by.items():
            pairs = [(o, sum(f(share(c, t), share(by[o], t)) for t in kept)) for o in by if o != s]
            own = [(t, f(share(c, t), share(whole, t))) for t in kept if c[t] > 0 and share(c, t) > share(whole, t)]
            for part, told, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                ranked = sorted(told, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def rows(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["hot"] * 4 + ["a", "b", "é", "", None])
        say = [rng.choice(["The", "of", f"w{'x' * rng.randrange(9)}", "été", "日本", f"rare{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randrange(30))]
        out.append((i, rng.choice([" ", "-", "1"]).join(say), rng.choice(["en", "fr", None, ""]), source, 1))
    return out


def got(df):
    return sorted(map(tuple, source_audit.audit(df).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_like_every_term_of_every_pair(spark, seed):
    data = rows(seed)
    assert got(spark.createDataFrame(data, SCHEMA).repartition(4)) == brute(data)


def test_odd_rows(spark):
    data = [(1, None, None, None, None), (2, "", "x", "only", 0), (3, "one two", "y", "s", 0), (3, "one two", "y", "s", 0), (3, "one two", "y", "t", 0), (None, "123 456", "y", "u", 0), (5, "lonely", "z", "p", 0), (6, "words", "z", "q", 0)]
    data += [(7, "long " * 60_000 + "tail", "w", "a", 0), (8, "long tail", "w", "b", 0), (9, "LONG Tail", "w", "c", 0)]
    assert got(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(rows(3, 40), SCHEMA)
    assert got(df.limit(0)) == []
    more = df.selectExpr("*", "1 as term", "2 as n", "3 as docs", "4 as held", "5 as `a.b`", "6 as value", "7 as item", "8 as rank")
    assert got(more) == got(df)


def test_in_small_pieces(spark, monkeypatch):
    """Tasks that ship often, and groups joined by a shuffle, give the same."""
    data = rows(4)
    for name, value in (("SHIP_TERMS", 5), ("SHIP_CELLS", 7), ("BROADCAST_GROUPS", 0)):
        monkeypatch.setattr(source_audit, name, value)
    assert got(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_top_terms_and_pairs(spark):
    data = [(i, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)), "en", "a" if i % 2 else "b", 0) for i in range(6)]
    data += [(10 + i, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(0, 400, 2)), "en", "c", 0) for i in range(3)]
    told = got(spark.createDataFrame(data, SCHEMA))
    assert told == brute(data) and max(r[-1] for r in told if r[2] == "term") == 200
    i, j = source_audit._pairs([3, 0, 1, 2])
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2), (4, 5)]


def test_shares_are_exact(spark):
    counts = [0, 1, 7, 10**10, 9 * 10**14]
    totals = [1, 3, 10**9 + 7, 10**10 + 1, 10**15 + 37]
    pairs = [(c, t) for c in counts for t in totals if t > c]
    df = spark.createDataFrame(pairs, "c long, t long")
    assert [tuple(r) for r in df.select("c", "t", source_audit.share(F.col("c"), F.col("t"))).collect()] == [(c, t, 1 + 1_000_000_000 * (c + 1) // t) for c, t in pairs]
