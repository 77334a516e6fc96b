"""The URL filter against a plain Python version."""

from __future__ import annotations

import random
from itertools import combinations

from restitch.llm import url_filter

SCHEMA = "page_id long, url string, html string, verdict string"


def brute(urls):
    out = []
    for url in urls:
        host = path = ""
        query = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            rest = rest[cut:]
            end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
            path = rest[:end]
            if rest[end : end + 1] == "?":
                query = rest[end + 1 :].split("#")[0]
        best = max((r for r in url_filter.HOST_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        steps, digits = [], "0123456789"
        for step in path.split("/"):
            s = ""
            for c in step:
                s += "" if c in digits and s[-1:] == "#" else "#" if c in digits else c
            steps.append(s)
        tokens = {f"host:{x}" for x in host.split(".") if x} | {f"path:{x}" for x in steps if x} | {f"query:{x.split('=')[0]}" for x in query.split("&") if x.split("=")[0]}
        out.append((host, path, best and best[1] + best[2], best and best[0], tokens))
    labelled = [(t, v) for *_, v, t in out if v and t]
    least = -(-len(labelled) // 100)
    count: dict = {}
    for t, v in labelled:
        for k in (1, 2):
            for c in combinations(sorted(t), k):
                n = count.setdefault(c, {"allow": 0, "block": 0})
                n[v] += 1
    rules = {(c, v): (n[v] / sum(n.values()), n[v]) for c, n in count.items() for v in n if n[v] >= max(least, 1) and n[v] / sum(n.values()) >= url_filter.MIN_CONFIDENCE}
    kept = {(c, v): x for (c, v), x in rules.items() if len(c) == 1 or not any(((t,), v) in rules and rules[(t,), v][0] >= x[0] for t in c)}
    order = sorted(kept, key=lambda r: (-kept[r][0], -kept[r][1], len(r[0]), r[1] != "block", r[0]))
    return [(h, p, r, v or next((rv for c, rv in order if set(c) <= t), "allow")) for h, p, r, v, t in out]


def urls():
    out = [None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "http://example.com/en/x", "http://www.EXAMPLE.com/en/", "http://a.www.example.com/en", "http://badexample.com/en/", "x://a.net/es/1?q=1&q=2&=3&r#f", "http://net?/es/", "ftp://b.org/a://c/", "http://é.org/ü", "https://m.x.org/en/1"]
    for i in range(300):
        host = ["blog.a", "www.b", "m.c", "shop.d"][i % 4]
        out.append(f"http{'s' * (i % 2)}://{host}.example.{['com', 'net', 'org'][i % 3]}/{['en', 'fr', 'es', 'de'][i * 7 % 4]}/{i}{'?utm=1' * (i % 5 == 0)}")
    return out


def test_like_brute_force(spark):
    rows = urls() + urls()[5:9]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(rows)], SCHEMA)
    got = [(r.host, r.path, r.rule, r.verdict) for r in sorted(url_filter.judge(df).collect(), key=lambda r: r.page_id)]
    assert got == brute(rows)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "http://x.org/a", None, None), (1, None, None, None)], SCHEMA)
    assert {(r.verdict, r.by) for r in url_filter.judge(df).collect()} == {("allow", "default")}
    assert url_filter.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_finds_the_first_rule():
    rules = sorted([url_filter.TokenRule(("a",), "block", 0.9, 5), url_filter.TokenRule(("a", "b"), "allow", 0.95, 3), url_filter.TokenRule(("c",), "allow", 0.9, 9)], key=url_filter.TokenRule.order)
    index = url_filter.Index(rules)
    assert [index.verdict(t) for t in (["a"], ["b", "a"], ["a", "c"], ["b"], [])] == ["block", "allow", "allow", None, None]


def test_rules_of_more_than_two_tokens(spark):
    rows = [(list("abc"), "block")] * 10 + [([*pair, "z"], "allow") for pair in ("ab", "ac", "bc") for _ in range(5)]
    rows += [(list("defg"), "allow")] * 12 + [(list(c), "block") for c in combinations("defg", 3) for _ in range(4)]
    got, _ = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert {(r.tokens, r.verdict, r.confidence, r.support) for r in got if len(r.tokens) > 2} == {(("a", "b", "c"), "block", 1.0, 10), (("d", "e", "f", "g"), "allow", 1.0, 12)}
    # all rules of all lengths, none pruned, decide alike
    count: dict = {}
    for tokens, v in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                n = count.setdefault(c, {"allow": 0, "block": 0})
                n[v] += 1
    rules = [url_filter.TokenRule(c, v, n[v] / sum(n.values()), n[v]) for c, n in count.items() for v in n if n[v] and n[v] / sum(n.values()) >= url_filter.MIN_CONFIDENCE]
    every, index = url_filter.Index(sorted(rules, key=url_filter.TokenRule.order)), url_filter.Index(got)
    assert len(got) < len(rules)
    for k in range(6):
        for c in combinations("abcdefgz", k):
            assert index.verdict(list(c)) == every.verdict(list(c))


def test_url_that_only_three_tokens_decide(spark):
    # {example, com, en} goes with block in 20 of 22, each pair and each token of them in fewer than 80 %
    rules = [("block", "example.com", "/en/"), ("allow", "com", "/"), ("allow", "net", "/")]
    urls = ["http://example.com/en/"] * 20 + ["http://example.com/fr/"] * 10 + ["http://b.com/en/"] * 10
    urls += ["http://example.net/en/"] * 10 + ["http://example.org.com/en/"] * 2 + ["http://com.example/en/new"]
    pages = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(urls)], SCHEMA)
    got = {r.page_id: (r.verdict, r.by) for r in url_filter.judge(pages, rules).collect()}
    assert got[0] == ("block", "rule") and got[len(urls) - 1] == ("block", "mined")


def test_urls_that_share_many_tokens(spark):
    """Tokens of the same rows, of one verdict or of all rows are not combined: 2 ** 40 combinations are never made."""
    many = [f"k{i:02}" for i in range(40)]
    rows = [([*many, "all", "x"], "block")] * 30 + [([*many, "all", "y"], "allow")] * 4 + [(["all", "z", "y"], "allow")] * 30 + [(["all", *[f"p{i}" for i in range(40)]], "allow")] * 20
    rules, stands = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert stands["k39"] == "k00" and stands["p7"] == "p0" and len(rules) < 20
    index = url_filter.Index(rules, stands)
    assert [index.verdict(t) for t in (["k17", "all"], ["p33"], ["y"], ["k17", "x"])] == ["block", "allow", "allow", "block"]


def test_wide_rows_are_bounded(spark):
    """Rows with many tokens that nearly all share are combined by those that tell most."""
    tokens = [f"t{i:02}" for i in range(30)]
    rows = [([t for i, t in enumerate(tokens) if (k * 7 + i * 3) % 29], "block" if k % 3 else "allow") for k in range(120)]
    rules, _ = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert all(len(r.tokens) <= url_filter.MAX_WIDTH for r in rules)


def test_pairs_of_tokens_that_tell_little_in_wide_rows(spark):
    """{za, zb} goes with block always, each alone with either verdict, and 17 tokens of each row tell a little more."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        block = i % 2 == 0
        own = [f"m{k:02}" for k in range(17) if rng.random() < (0.75 if block else 0.55)]
        own += (["za", "zb"] if i % 4 == 0 else []) if block else (["za"] if i % 4 == 1 else ["zb"])
        rows.append((own, "block" if block else "allow"))
    rules, _ = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.05)
    found = {r.tokens: r for r in rules}
    assert (found["za", "zb"].verdict, found["za", "zb"].confidence, found["za", "zb"].support) == ("block", 1.0, 100)
    for r in rules:
        if len(r.tokens) == 2:  # counted over all rows
            n = [v for t, v in rows if set(r.tokens) <= set(t)]
            assert r.support == n.count(r.verdict) and r.confidence == r.support / len(n)


def test_combinations_beyond_the_width_of_rows(spark):
    """Whole rules: all of three and four tokens are found and counted over all rows, those with tokens that tell little in wide rows too."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        block = i % 2 == 0
        own = [f"m{k:02}" for k in range(17) if rng.random() < (0.8 if block else 0.5)]
        own += ["za", "zb", "zc"] if i % 4 == 0 else rng.sample(["za", "zb", "zc"], 2) if i % 8 in (1, 3, 5) else []
        rows.append((own, "block" if block else "allow"))
    assert max(len(t) for t, _ in rows) > url_filter.MAX_WIDTH
    table, support = spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.2
    told = lambda rules: {(r.tokens, r.verdict): (r.confidence, r.support) for r in rules if len(r.tokens) < 6}
    found, bounded = (told(url_filter.mine(table, support, whole=whole)[0]) for whole in (True, False))
    names, want = sorted({x for t, _ in rows for x in t}), {}
    for k in range(1, 6):
        for c in combinations(names, k):
            have = [v for t, v in rows if set(c) <= set(t)]
            for v in ("allow", "block"):
                n = have.count(v)
                if n >= 60 and n / len(have) >= url_filter.MIN_CONFIDENCE and not any(g[1] == v and set(g[0]) <= set(c) and x[0] >= n / len(have) for g, x in want.items()):
                    want[c, v] = n / len(have), n
    assert found == want and found[("za", "zb", "zc"), "block"] == (1.0, 75) and bounded != want


def test_long_urls_and_other_columns(spark):
    url = "http://a.example.com/" + "x/" * 50_000
    df = spark.createDataFrame([(1, url), (1, url), (None, "http://b.net/es/1")], "page_id long, url string")
    got = [tuple(r)[:5] for r in url_filter.judge(df.selectExpr("*", "'q' as host", "1 as rule", "2 as `a.b`", "'t' as tokens", "'v' as told")).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a.example.com", url[20:], "com/", "allow")] * 2 + [(None, "b.net", "/es/1", "net/es/", "block")], key=repr)
