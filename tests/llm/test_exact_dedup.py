import hashlib
import re
from collections import defaultdict

from spotloom.llm.exact_dedup import exact_dedup

ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "é x"), (8, "éx"), (8, "éx"), (None, "ab"), (9, "x" * 50_000), (10, "x " * 50_000), (11, "unique"), (12, "\x1ca\x85b")]


def brute_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha, first = hashlib.sha256(norm.encode()).hexdigest(), True
        for m in members:
            kept = m == best and first
            first = first and not kept
            out.append((m[0], best[0], len(members), kept, sha))
    return sorted(out, key=repr)


def test_edge_cases(spark, docs_of):
    docs = docs_of(ROWS).repartition(7)
    for name in ("digest", "run", "best", "check", "row_no"):
        docs = docs.withColumn(name, docs.lang)  # names the operator uses itself
    got = exact_dedup(docs, fan_in=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(ROWS)


def test_many_partitions_and_hot_text(spark, docs_of):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 200}") for i in range(900)]
    for parts, fan_in in ((1, 8), (40, 2), (40, 8)):
        got = exact_dedup(docs_of(rows).repartition(parts), fan_in=fan_in).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_empty_table(spark, docs_of):
    assert exact_dedup(docs_of([])).collect() == []
