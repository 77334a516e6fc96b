"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from restitch.llm import quality_rules, secrets
from tests.llm.test_core import LOW, brute_base, brute_components, brute_stats, check_pieces, family, frame


def expected_docs(spark, docs, sf_dir):
    """{doc_id: text} after quality rules, exact dedup, near dedup and redaction."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = []
    for i, t in rows:
        n, _, _, _, repeated = brute_stats(t)
        if n < 50 or 100 * repeated > 50 * n:
            continue
        stats = dict(zip(quality_rules.STATS, quality_rules.scan_stats([(t or "").encode()])[0].tolist(), strict=True))
        x = {k: [eval(e, {"greatest": max}, stats)] for k, e in quality_rules.FEATURES.items()}  # noqa: S307
        if not any(all(x[f][0] <= v if low else x[f][0] >= v for f, low, v in r.conditions) for r in rules):
            kept.append((i, t))
    last: dict = {}
    for i, t in kept:
        last[t.translate(LOW)] = max(i, last.get(t.translate(LOW), i))
    kept = [(i, t) for i, t in kept if last[t.translate(LOW)] == i]
    first = {i: c for i, _, c in brute_components(kept, 5, 80)}
    out = {}
    for i, t in kept:
        if first[i] == i:
            spans = secrets.all_spans(t)[1]
            assert [f"{k}:{a}:{b}" for a, b, k in spans if k != "literal"] == [s for *_, s in brute_base(t)]
            for a, b, _ in sorted(spans, reverse=True):
                t = t if any(x < b <= y and (x, y) != (a, b) and x <= a for x, y, _ in spans) else t[:a] + "[SECRET]" + t[b:]
            out[i] = t
    return out


def check(spark, docs, sf_dir):
    want = expected_docs(spark, docs, sf_dir)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns, name
    rows = at.collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows if "[SECRET]" in r.text)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    ids = {i: [*slow.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    check_pieces([tuple(r) for r in corpus_pipeline.pack(spark, at, sf_dir).collect()], ids)
    return ids


def test_run(spark, sf_dir):
    ids = check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    check_pieces([tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()], ids)


def test_copies_and_odd_rows(spark, sf_dir):
    texts = [None, "", "short text", *family(1, 80, 6), *family(2, 120, 6)]
    texts += [texts[4].upper(), texts[5], texts[10] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "# | $ " * 80, "same words here " * 60]
    check(spark, frame(spark, list(enumerate(texts, 10))), sf_dir)


def test_nothing(spark, sf_dir):
    at = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir)
    assert at.count() == 0
