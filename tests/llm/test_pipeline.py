"""The pipeline's stages against brute force on a small corpus."""

import random
import re
from dataclasses import replace

import corpus_pipeline as cp
import pytest
from test_mixing import brute_force as mix_by_hand
from test_simhash_dedup import components, fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "st"]) for _ in range(rng.randrange(1, 5)))
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(20, 120))]
        rows.append([i, " ".join(w.upper() + "!!" for w in words) if i % 5 == 0 else " ".join(words), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src5", None])])
    rows += [[200 + i, rows[i + 1][1].replace(" ", "\n", 1), "en", "src0"] for i in range(0, 40, 2)]
    rows += [[300 + i, rows[i + 2][1] + " tail", "fr", "src2"] for i in range(0, 30, 3)]
    rows += [[1, *rows[1][1:]], [None, rows[3][1], "en", "src1"], [400, "", "en", "src3"], [401, None, None, None]]
    out = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = rows_of(docs)
    good = cp.quality(spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r[0] for r in rows_of(good)}
    assert len(kept & {i for i in range(150) if i % 5}) >= 117 and len(kept & {i for i in range(150) if i % 5 == 0}) <= 2

    got = rows_of(cp.exact(spark, docs, folder))
    groups = {}
    for r in every:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert got == sorted(want, key=repr)

    got = rows_of(cp.near(spark, docs, folder))
    fps = [fingerprint(r[1]) for r in every]
    best = {}
    for r, root in zip(every, components(fps)):
        if root not in best or (r[0] is None, r[0] or 0) < (best[root][0] is None, best[root][0] or 0):
            best[root] = r
    assert got == sorted(best.values(), key=repr)

    got = rows_of(cp.mixed(spark, docs.where("doc_id IS NULL OR doc_id <> 1"), folder))
    rows = [r for r in every if r[0] != 1]
    domain = lambda s: "" if not s else "d%d" % (int(s[3:]) % 4)
    plan = replace(cp.MIX_PLAN, budget=(3, 4), max_epochs=1)
    by_hand = mix_by_hand([r[:4] for r in rows], plan, domain)
    assert sorted(map(repr, (r[0] for r in got))) == sorted(repr(r[0]) for r in by_hand if r[-1])


def test_run_keeps_going_on_its_own_output(spark, folder):
    out = cp.run(spark, folder)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    rows = out.collect()
    assert 0 < len(rows) < 150 and len({r.doc_id for r in rows}) == len(rows)


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_batches_of_whole_texts_are_small(spark, folder):
    """Workers get at most a thousand rows at a time once a stage has been planned; a smaller setting of the session is kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda: [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(lambda it: (type(b).from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()]
    try:
        for stage in (cp.quality, cp.near, cp.encoded):
            spark.conf.unset(name)
            stage(spark, docs, folder)
            assert sizes() == [1000, 1000, 500]
        spark.conf.set(name, "700")
        cp.encoded(spark, docs, folder)
        assert max(sizes()) == 700
    finally:
        spark.conf.set(name, before)
