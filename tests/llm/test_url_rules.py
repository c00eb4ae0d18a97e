import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spotloom.llm import url_rules as ur

RULES = [ur.ListedRule("allow", "org", "/"), ur.ListedRule("block", "example.org", "/es/"), ur.ListedRule("block", "example.org", "/en/1"), ur.ListedRule("allow", "com", "/fr/"), ur.ListedRule("block", "com", "/de/")]
URLS = [None, "", "no scheme/x", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "https://x.example.org/es/1?q=/z#/y", "https://example.org/en/1", "https://example.org/en/2", "https://myexample.org/es/1", "ftp://a.com/fr/x", "http://com/de/", "http://a.com/de", "http://a.com?x=/de/", "http://a.com#/fr/", "http://ÀB.com/fr/", "a://b://org/x", "http://a.comx/fr/", "http://a.com:80/fr/", "http://a.org/\nx/es/", "http://x.net/a/b.html?k=1&l=2"]


def brute_force(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        rest = rest[:cut]
        host, slash, tail = rest.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "x", 1), (None, URLS[7], "x", 1)], "page_id long, url string, host string, tokens int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = ur.judge(pages, labels, RULES, F.col("quality") == 0).collect()
    want = [(i, *brute_force(u)) for i, u in enumerate(URLS)] + [(3, *brute_force(URLS[3])), (None, *brute_force(URLS[7]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert ur.judge(pages.limit(0), labels, RULES, F.col("quality") == 0).collect() == []


def test_mined_rules_equal_counting_all_combinations(spark):
    rng = random.Random(1)
    baskets = []
    for _ in range(300):
        items = [t for t in "abcdef" if rng.random() < 0.4]
        bad = rng.random() < (0.95 if {"a", "b"} <= set(items) else 0.1)
        baskets.append(items + [ur.BLOCK_ITEM] * bad)
    got = {tuple(r.tokens): r.confidence for r in ur.mine_rules(spark.createDataFrame([(b,) for b in baskets], "items array<string>"), 0.01, 0.7).collect()}
    want = {}
    for k in range(1, 7):
        for combo in combinations("abcdef", k):
            held = [b for b in baskets if set(combo) <= set(b)]
            both = sum(ur.BLOCK_ITEM in b for b in held)
            if held and both >= 0.01 * len(baskets) and both / len(held) >= 0.7:
                want[combo] = both / len(held)
    assert got == pytest.approx(want)
    urls = [(f"u{i}", sorted(rng.sample("abcdefgh", rng.randrange(1, 7)))) for i in range(200)]
    rules = spark.createDataFrame([(i, list(t), c) for i, (t, c) in enumerate(want.items())], "rule_id long, tokens array<string>, confidence double")
    found = {r.url: r.confidence for r in ur.matches(spark.createDataFrame(urls, "url string, tokens array<string>"), rules).collect()}
    assert found == pytest.approx({u: max(c for t, c in want.items() if set(t) <= set(ts)) for u, ts in urls if any(set(t) <= set(ts) for t in want)})


def test_learned_combination_blocks(spark):
    rng = random.Random(2)
    make = lambda i: f"https://{rng.choice(['a', 'b'])}.site.net/{rng.choice(['news', 'shop'])}/{i}?{rng.choice(['ref', 'id'])}={i}"
    pages = [(i, make(i)) for i in range(600)]
    bad = lambda u: "/shop/" in u and "?ref=" in u
    labels = [(i, 0 if bad(u) else 1, 0) for i, u in pages if i % 2]
    got = ur.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES, F.col("quality") == 0)
    assert {r.page_id: r.verdict == "block" for r in got.collect()} == {i: bad(u) for i, u in pages}


def test_few_labels_make_no_rule(spark):
    pages = [(i, f"https://a.net/p{chr(97 + i)}/x") for i in range(8)] + [(8, "https://a.net/pa/" + "y/" * 5000), (9, None)]
    table = spark.createDataFrame([(*p, "block", "b.org") for p in pages], "page_id long, url string, verdict string, host string")
    labels = [(i, int(i not in (0, 1)), 0) for i in range(8)]
    bad = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = ur.judge(table, bad(labels), RULES, F.col("quality") == 0)
    assert {r.verdict for r in got.collect()} == {"allow"} and got.count() == 10
    assert {r.verdict for r in ur.judge(table, bad(labels[:1]), RULES, F.col("quality") == 0).collect()} == {"allow"}
    assert {r.page_id for r in ur.judge(table, bad(labels), RULES, F.col("quality") == 0, min_count=1).where("verdict = 'block'").collect()} == {0, 1, 8}


def test_reduced_items_decide_like_all_combinations(spark):
    """Items, pure rules and the lattice together give every URL the confidence of counting all token combinations."""
    rng = random.Random(4)
    baskets = []
    for i in range(120):
        held = {t for t in "abcde" if rng.random() < 0.4}
        held |= {t + t for t in held if t in "ab"}  # aa and bb come with a and b
        held |= {"z"} if i % 12 == 0 else set()  # only blocked URLs hold z
        bad = "z" in held or rng.random() < (0.9 if {"a", "b"} <= held else 0.2)
        if held:
            baskets.append((i, sorted(held), bad))
    table = spark.createDataFrame(baskets, "id long, tokens array<string>, bad boolean")
    groups, pure, left = ur.reduced(table, 0.02, 3)
    rules = [(set(r.tokens), r.confidence) for r in pure.unionByName(ur.mine_rules(left, 0.02, 0.7)).collect()]
    item = {r.token: r.item for r in groups.collect()}
    assert item["aa"] == item["a"] and item["bb"] == item["b"] and ({"z"}, 1.0) in rules
    everything, every = [], sorted({t for _, h, _ in baskets for t in h})
    for k in range(1, len(every) + 1):
        for combo in combinations(every, k):
            marks = [b for _, h, b in baskets if set(combo) <= set(h)]
            if sum(marks) >= max(3, 0.02 * len(baskets)) and sum(marks) / len(marks) >= 0.7:
                everything.append((set(combo), sum(marks) / len(marks)))
    for _ in range(300):
        url = set(rng.sample(every, rng.randrange(1, len(every))))
        items = {item[t] for t in url if t in item}
        got = max((c for r, c in rules if r <= items), default=None)
        assert got == pytest.approx(max((c for r, c in everything if r <= url), default=None))


def test_dozens_of_shared_tokens(spark):
    """Three labelled URLs share 40 path parts: no list of 2^40 combinations; every URL with such a part is blocked."""
    deep = "https://a.net/" + "/".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    pages = [(i, f"{deep}?k{chr(97 + i)}=1") for i in range(3)] + [(3, "https://a.net/pab"), (4, "https://a.net/other"), (5, "https://b.net/x"), (6, deep)]
    labels = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (4, 1, 0), (5, 1, 0)]
    got = ur.judge(spark.createDataFrame(pages + pages[:1], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES, F.col("quality") == 0)
    rows = got.collect()
    assert {r.page_id: r.verdict for r in rows} == {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"} and len(rows) == 8
    assert next(r for r in rows if r.page_id == 3).matched == ["p:pab"]
