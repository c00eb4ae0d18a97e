from math import comb

import pytest

from spotloom.operators.enrich import hypergeometric_tail
from spotloom.sources import io


def test_sample_round_trip_reads_one_replicate(spark, tmp_path):
    a = spark.createDataFrame([("r0", 0, 1, 0.5)], "replicate string, level int, spot_id long, x double")
    b = spark.createDataFrame([("r1", 1, 2, "t")], "replicate string, level int, spot_id long, label string")
    io.write_sample({"spots": io.merge_samples([a, b])}, str(tmp_path))
    assert [tuple(r) for r in io.read_sample(spark, str(tmp_path), "spots", ["r1"]).select("spot_id", "x", "label").collect()] == [(2, None, "t")]
    plan = io.read_sample(spark, str(tmp_path), "spots", ["r1"], 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan
    assert io.read_sample(spark, str(tmp_path), "spots", level=0).count() == 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "counts.csv").write_text("GENE,c1,c2\nTYPE,a,b\ng1,0,2\ng2,3,0\n")
    rows = io.read_wide_counts(spark, str(tmp_path / "counts.csv"), "GENE", "r0", "TYPE").collect()
    assert sorted((r.spot, r.gene, r.value) for r in rows) == [("c1", "g2", 3.0), ("c2", "g1", 2.0)]
    (tmp_path / "meta.csv").write_text("NAME,kind\nTYPE,group\nc1,A\n")
    assert [tuple(r) for r in io.read_metadata(spark, str(tmp_path / "meta.csv"), "NAME", ["kind"], "TYPE").collect()] == [("c1", "A")]
    (tmp_path / "pairs.txt").write_text("0\t1\n1\t0\n2\t2\n1\t3\n")
    got = io.read_pairs(spark, str(tmp_path / "pairs.txt"), "r0").collect()
    assert sorted((r.src, r.dst) for r in got) == [(0, 1), (1, 0), (1, 3), (3, 1)]
    (tmp_path / "sets.csv").write_text("one,two\na,b\nc,\n")
    assert sorted(map(tuple, io.read_gene_sets(spark, str(tmp_path / "sets.csv")).collect())) == [("one", "a"), ("one", "c"), ("two", "b")]


def test_gene_modules(spark, tmp_path):
    path = tmp_path / "modules.csv"
    path.write_text("Title,,,,\nfirst,,,second,\nGene,Module,,Gene,Module\na,m1,,c,m1\nb,m2,, d ,m3\ne,,,,\na,m1,,,m3\n")
    got = sorted(map(tuple, io.read_gene_modules(spark, str(path), skip=1).collect()))
    assert got == [("first", "m1", "a"), ("first", "m2", "b"), ("second", "m1", "c"), ("second", "m3", "d")]
    with pytest.raises(ValueError, match="no block"):
        io.read_gene_modules(spark, str(path), skip=9)


def test_hypergeometric_tail():
    for shared, chosen, members, total in ((0, 5, 4, 20), (2, 5, 4, 20), (4, 5, 4, 20), (3, 10, 15, 18)):
        want = sum(comb(members, x) * comb(total - members, chosen - x) for x in range(shared, min(chosen, members) + 1)) / comb(total, chosen)
        assert hypergeometric_tail(shared, chosen, members, total) == pytest.approx(want)
