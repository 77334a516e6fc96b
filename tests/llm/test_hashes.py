"""Words, lines and sets that weak hashes take for one another."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from restitch.llm import jaccard, quality_rules
from restitch.llm.textscan import Scan

SWAP = str.maketrans("ab", "ba")


def thue_morse(n: int) -> str:
    """Equal to its complement for any sum over powers modulo 2 ** 64, from 1,024 characters on."""
    s = "a"
    while len(s) < n:
        s += s.translate(SWAP)
    return s


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 4096])
def test_words_and_lines(n):
    x = thue_morse(n)
    y = x.translate(SWAP)
    h = Scan([f"{x} {y} {x} {x[1:]} {x}a".encode()]).word_hash()
    assert h[0] == h[2] and len(set(h.tolist())) == 4
    stats = dict(zip(quality_rules.STATS, quality_rules.scan_stats([f"{x}\n{y}\nz\n{x} a b\n{y} a b".encode()])[0].tolist(), strict=True))
    assert stats["n_dup_lines"] == 0 and stats["n_repeat_words"] == 0
    assert quality_rules.scan_stats([f"{x}\n{y}\n{x}".encode()])[0][quality_rules.STATS.index("n_dup_lines")] == 1


def test_blocks_in_another_order():
    a, b = "abcdefgh", "ijklmnop"
    words = [a + b, b + a, a + a, b + b, a + b + a, a + a + b, "\0" * 8, "\0" * 9, "\0" * 16]
    h = Scan([" ".join(words).encode()]).word_hash()
    assert len(set(h.tolist())) == len(words)


@pytest.mark.parametrize("n", [1024, 4096])
def test_sets_of_such_words(spark, n):
    x = thue_morse(n)
    y = x.translate(SWAP)
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, x), (2, y), (3, x), (4, " ".join([x] * 5)), (5, " ".join([y] * 5)), (6, f"{same} {x}"), (7, f"{same} {y}")]
    rows += [(10 + i, " ".join(f"{t}{i}" for i in range(80))) for i, t in enumerate((x, y))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 10: 10, 11: 11}
    assert {r.doc_id for r in jaccard.drop_near(docs).collect()} == set(got.values())


def test_rows_with_the_same_number(spark, monkeypatch):
    """Texts are found again although all rows have one number."""
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*base[:49], f"x{i}"])) for i in range(6)] + [(10 + i, " ".join(f"y{i * 100 + k}" for k in range(20))) for i in range(5)] + [(20, "y0 y1"), (0, " ".join(base)), (30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.doc_id, r.n_shingles, r.component_id)
    want = sorted(map(key, jaccard.near_groups(docs).collect()))
    monkeypatch.setattr(jaccard, "_row_number", lambda: F.lit(7).cast("long"))
    assert sorted(map(key, jaccard.near_groups(docs).collect())) == want
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert sorted(map(key, jaccard.near_groups(docs, block_sets=3).collect())) == want
