"""The registered queries of the corpus operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import (
    bpe,
    chain_dedup,
    exact_dedup,
    language_model,
    merkle,
    mixing,
    piecewise_hash,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    spelling,
    suffix_dedup,
    url_rules,
)
from spotloom.sources.tables import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def _remainder(divisor: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % divisor


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    scored = docs.select("doc_id", (_remainder(3) == 1).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.outliers(table(spark, sf_dir, "documents"))


#: The listed rules.
LISTED = [
    url_rules.ListedRule("allow", "org", "/"),
    url_rules.ListedRule("block", "example.org", "/es/"),
    url_rules.ListedRule("block", "example.org", "/en/1"),
    url_rules.ListedRule("allow", "com", "/fr/"),
    url_rules.ListedRule("block", "com", "/de/"),
]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), LISTED, bad)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.train(docs))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def vocabulary() -> str:
    """Path of the byte-level vocabulary, the same on every machine that has the package of vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id", "component_size")


def op9_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.fuzzy_repeats(table(spark, sf_dir, "documents"))


#: Target weights of the mixing query: four domains from the source's number, languages, all sources alike.
MIX_PLAN = mixing.Plan(domain_weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, lang_weights={"en": 5, "de": 3, "fr": 2, "es": 2}, budget=(1, 2), max_epochs=2)


def source_domain() -> Column:
    """``d0`` to ``d3`` by the first number (ASCII digits, of any length) in the source's name; the empty name without one."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), "([0-9]+)", 1)
    rest = F.right(number, F.lit(2)).cast("int") % 4  # a number's last two digits decide, however long it is
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.lit("d"), rest.cast("string")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), source_domain(), MIX_PLAN)


def _deal_sql(name: str, nodes: str, parent: str, child: str) -> str:
    """Common table expressions that deal a parent's budget to its children."""
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM {nodes}),
{name}_b AS (SELECT *, cap * w_left <= w * (budget - cap_before) AS filled FROM {name}_a),
{name} AS (
  SELECT *, CASE WHEN filled THEN cap ELSE (w * (budget - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY {parent}), 0)))
                 // sum(w) FILTER (NOT filled) OVER (PARTITION BY {parent}) END AS alloc FROM {name}_b)"""


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)', 1) = '' THEN ''
              ELSE 'd' || (right(regexp_extract(source, '([0-9]+)', 1), 2)::INT % 4) END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 2 * sum(n_tokens)::HUGEINT AS cap FROM d GROUP BY ALL),
n1 AS (SELECT 0 AS root, domain, cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END::HUGEINT AS w,
              (SELECT sum(tokens) // 2 FROM leaf) AS budget FROM (SELECT domain, sum(cap) AS cap FROM leaf GROUP BY 1)),
{_deal_sql("l1", "n1", "root", "domain")},
n2 AS (SELECT t.domain, lang, t.cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END::HUGEINT AS w,
              alloc AS budget FROM (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY 1, 2) t JOIN l1 USING (domain)),
{_deal_sql("l2", "n2", "domain", "lang")},
n3 AS (SELECT leaf.domain, leaf.lang, source, tokens, leaf.cap, 1::HUGEINT AS w, alloc AS budget FROM leaf JOIN l2 USING (domain, lang)),
{_deal_sql("l3", "n3", "domain, lang", "source")},
b AS (SELECT domain, lang, source, tokens, alloc AS leaf_budget, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epochs FROM l3),
p AS (SELECT d.*, leaf_budget, epochs, leaf_budget - epochs * tokens AS rest,
             sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || (epochs + 1) || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens
                                 ROWS UNBOUNDED PRECEDING) AS until
      FROM d JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, leaf_budget::BIGINT AS leaf_budget,
       (epochs + CASE WHEN until <= rest AND epochs < 2 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(table(spark, sf_dir, "documents"))


#: The checksum table of CRC-32 by its rule, and the unsigned checksum of the text in the column ``s``.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))"
_CRC_BYTES = "list_transform(range(1, length(hex(encode(s))) // 2 + 1), lambda j: ('0x' || substr(hex(encode(s)), 2 * j - 1, 2))::BIGINT)"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {_CRC_BYTES}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql(depth: int = 12) -> str:
    """SQL of the manifest for up to 8 ** ``depth`` rows a language: each level of each tree is a table of runs."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(field, ["doc_id", "source", "lang", "n_chars"]))
    parts = [
        f"crc AS (SELECT {_CRC_TABLE} AS t)",
        f"ids AS (SELECT doc_id AS id, {_CRC} AS h FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL), crc)",
        f"d AS (SELECT doc_id, lang, sha256({head} || {field('text')}) AS leaf, CASE WHEN h % 3 = 0 THEN sha256({head} || {field(_LOWERED.format('text'))}) END AS present FROM documents LEFT JOIN ids ON doc_id = id)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS own FROM d)",
        "a0 AS (SELECT coalesce(lang, '') AS g, lang IS NULL AS no_lang, own AS idx, leaf AS digest FROM leaves)",
    ]

    def climb(name: str) -> None:
        for i in range(depth):
            parts.append(f"{name}s{i} AS (SELECT *, count(*) OVER (PARTITION BY g, no_lang) AS m FROM {name}{i})")
            parts.append(f"{name}f{i} AS MATERIALIZED (SELECT g, no_lang, idx // 8 AS idx, any_value(m) AS m, list(digest ORDER BY idx) AS kids FROM {name}s{i} GROUP BY g, no_lang, idx // 8)")
            parts.append(f"{name}{i + 1} AS (SELECT g, no_lang, idx, CASE WHEN m = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest FROM {name}f{i})")

    climb("a")
    parts.append(f"b0 AS MATERIALIZED (SELECT '' AS g, false AS no_lang, row_number() OVER (ORDER BY no_lang DESC, g) - 1 AS idx, digest, g AS lang, no_lang AS lang_null FROM a{depth})")
    climb("b")
    parts.append("p0 AS (SELECT leaves.*, b0.digest AS subroot, b0.idx AS top, '' AS proof, coalesce(present, leaf) AS folded FROM leaves JOIN b0 ON b0.lang = coalesce(leaves.lang, '') AND b0.lang_null = (leaves.lang IS NULL))")
    last = "p0"
    for name, at, on in (("a", "own", "f.g = coalesce(p.lang, '') AND f.no_lang = (p.lang IS NULL)"), ("b", "top", "true")):
        for i in range(depth):
            pos = f"((p.{at} // {8**i}) % 8)"
            left, right = f"array_to_string(kids[1:{pos}], '')", f"array_to_string(kids[{pos} + 2:], '')"
            parts.append(
                f"p{name}{i} AS (SELECT p.* EXCLUDE (proof, folded), CASE WHEN m = 1 THEN proof ELSE proof || {left} || {right} END AS proof, "
                f"CASE WHEN m = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded FROM {last} p JOIN {name}f{i} f ON {on} AND f.idx = p.{at} // {8 ** (i + 1)})"
            )
            last = f"p{name}{i}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}, (SELECT digest AS root FROM b{depth})"


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT doc_id, {_LOWERED.format("run")} AS run
         FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_CRC} AS h FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM counted), crc),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, pos, left(word, pos::INT) || substr(word, pos::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM w)),
near AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
         UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = cut.rest
         UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = cut.rest),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.form_n >= 10 * w.n THEN near END AS form,
             CASE WHEN best.form_n >= 10 * w.n THEN best.form_n END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, form AS root, 1 AS steps FROM f WHERE form IS NOT NULL
       UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, last(root ORDER BY steps) AS root FROM up GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
"""


def op13_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.likenesses(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_rules": op4_url_rules,
        "op5_language_model": op5_language_model,
        "op6_suffix_array": op6_suffix_array,
        "op7_bpe": op7_bpe,
        "op8_simhash": op8_simhash,
        "op9_chaining": op9_chaining,
        "op10_mixing": op10_mixing,
        "op11_merkle": op11_merkle,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_piecewise_hash": op13_piecewise_hash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op10_mixing": OP10_SQL, "op11_merkle": _merkle_sql(), "op12_spelling_variants": OP12_SQL}
