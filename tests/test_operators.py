"""Small hand-checked cases of operators that the registry's tables do not pin."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import strings as st
from tessera.operators import intervals as iv
from tessera.operators import matrix as mx
from tessera.operators import relational as rel
from tessera.operators import stats
from tessera.sources import scans, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_strings(spark):
    assert one(spark, st.reverse_complement(F.lit("ATCGn"))) == "nCGAT"
    assert one(spark, st.hamming(F.lit("ACGT"), F.lit("ACNT"))) == 1
    assert one(spark, st.hamming(F.lit(""), F.lit("A"))) == 0
    assert one(spark, st.n_count(F.lit("ANNA"))) == 2
    assert one(spark, st.chop(F.lit("a_b_c"), "_", (1, 3))) == "a_c"
    assert one(spark, st.between_affixes(F.lit("pre-x-suf"), "pre-", "-suf")) == "x"
    assert one(spark, st.between_affixes(F.lit("x"), "pre-", "-suf")) is None
    assert tuple(one(spark, st.cigar_spans(F.lit("5S10M2D3I4M")))) == (16, 17)
    assert [one(spark, st.genotype(F.lit(g))) for g in ("0|0", "1/1", "1|0", "./.")] == ["ref", "alt", "het", None]
    assert one(spark, st.cut_left(F.lit(1.0), (0, 1, 2), "ab")) == "b"
    assert one(spark, st.cut_right(F.lit(1.0), (0, 1, 2), "ab")) == "a"
    assert one(spark, st.cut_site(F.lit(10), F.lit(50), F.lit(True))) == 45


def test_intervals(spark):
    a = spark.createDataFrame([("c", 0, 5), ("c", 5, 8), ("c", 9, 12), ("c", 1, 2), ("d", 0, 1)], "k string, start long, end long")
    m = iv.merge(a, ["k"])
    assert sorted(tuple(r) for r in m.collect()) == [("c", 0, 8, 3), ("c", 9, 12, 1), ("d", 0, 1, 1)]
    assert iv.disjoint_violations(m, ["k"]).count() == 0
    b = spark.createDataFrame([("c", 8, 9), ("c", 100, 250)], "k string, b_start long, b_end long")
    assert sorted((r.start, r.b_start) for r in iv.overlap_join(m, b, ["k"], 3).collect()) == [(0, 8), (9, 8)]
    p = spark.createDataFrame([("c", 8), ("c", 9), ("c", 11)], "k string, pos long")
    assert sorted((r.pos, r.start) for r in iv.point_in_interval(p, m, ["k"], "pos", 4).collect()) == [(9, 9), (11, 9)]


def test_ranges_raise(spark):
    df = spark.createDataFrame([("B73", "A1-3,B2")], "sample string, spec string")
    assert [r.well for r in scans.expand_ranges(df, "spec").orderBy("well").collect()] == ["A1", "A2", "A3", "B2"]
    for bad in ("A3-1", "?"):
        with pytest.raises(PySparkException):
            scans.expand_ranges(spark.createDataFrame([("x", bad)], "sample string, spec string"), "spec").collect()


def test_stats(spark):
    p = spark.createDataFrame([(0.01,), (0.02,), (0.02,), (0.9,)], "p double")
    assert sorted(round(r.q, 6) for r in stats.bh_adjust(p, "p").collect()) == [0.026667, 0.026667, 0.026667, 0.9]
    x = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 2.0), (0, 2.0)], "y int, v double")
    assert stats.auc(x, "y", "v").first()["auc"] == 0.75


def test_relational(spark):
    c = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("b", "x", 1)], "k string, i string, n long")
    two = {r.k: (r.top1, r.n1, r.top2, r.n2) for r in rel.top_two(c, "k", "i", "n").collect()}
    assert two == {"a": ("x", 3, "y", 3), "b": ("x", 1, None, 0)}
    conf = spark.createDataFrame([("C0", 1, "x"), ("C1", 2, "x")], "method string, mapq int, topk string")
    assert [tuple(r) for r in rel.config_deviations(conf, "method", "C0", ["mapq", "topk"]).collect()] == [("C1", "mapq", "2", "1")]


def test_markov_conserves(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 1, 1.0), (2, 1, 2.0)], "src long, dst long, w double")
    v = spark.createDataFrame([(1, 4.0), (2, 8.0)], "node long, x double")
    assert {r.node: r.x for r in mx.markov_step(e, v).collect()} == {1: 6.0, 2: 4.0}


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("total\ttss\ncell1\t10\t3\ncell2\t20\t4\n")
    assert [tuple(r) for r in scans.row_named_tsv(spark, str(tmp_path / "m.tsv")).orderBy("total").collect()] == [("10", "3"), ("20", "4")]
    (tmp_path / "g.gff").write_text("##gff\nchr1\tx\tgene\t5\t9\t.\t-\t.\tID=gene:G1;n=2\nchr1\tx\texon\t5\t9\t.\t-\t.\tID=e\n")
    assert [tuple(r) for r in scans.gff_genes(spark, str(tmp_path / "g.gff")).collect()] == [("G1", "chr1", 5, 9, "-")]
    (tmp_path / "v.vcf").write_text("#h\nc\t1\t.\tA\tG,T\nc\t2\t.\tAT\tG\nc\t3\t.\tC\t*,TT\nc\t4\t.\tC\t*,T\n")
    assert [tuple(r) for r in scans.vcf_snvs(spark, str(tmp_path / "v.vcf")).orderBy("pos").collect()] == [("c", 1, "A", "G"), ("c", 4, "C", "T")]
    (tmp_path / "a.sam").write_text("@HD\nr1\t0\tc\t7\t60\t4M1D2M\t*\t0\t0\tACGTAC\t*\tNM:i:1\tCB:Z:AA\tXA:Z:c,1;d,2;\n")
    s = scans.sam(spark, str(tmp_path / "a.sam"))
    assert tuple(s.first()["spans"]) == (7, 6)
    assert tuple(scans.read_metrics(s).first()) == ("r1", "AA", 60, 0, 1, 2)
    (tmp_path / "f.fa").write_text(">s1 x\nACG\nT\n>s2\nGG\n")
    assert [(r.name, r.sequence) for r in scans.fasta(spark, str(tmp_path / "f.fa")).orderBy("name").collect()] == [("s1", "ACGT"), ("s2", "GG")]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    sinks.by_chunk(df, "k", 4, str(tmp_path / "chunks"))
    assert spark.read.option("header", True).csv(str(tmp_path / "chunks"), sep="\t").count() == 2


def test_streams(spark, tmp_path):
    from tessera.streaming import outcomes

    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 2.0D as value union all select timestamp'2024-01-01 00:50:00', 'a', 3.0D union all select timestamp'2024-01-01 01:10:00', 'b', 1.0D").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = outcomes.windowed_counts(source).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("counted").collect()) == [("a", 2, 5.0), ("b", 1, 1.0)]


def test_bh_adjust_query_takes_all_parts(spark, tmp_path):
    from tessera.plans import registry

    parts = [(f"b{k % 3}", k) for k in range(1900, 2150)]
    spark.createDataFrame(parts, "p_brand string, p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for brand in ("b0", "b1", "b2"):
        p = {k: (k * 7919 % 1000 + 1) / 1001 for b, k in parts if b == brand}
        raw = {k: x * len(p) / sum(y <= x for y in p.values()) for k, x in p.items()}
        want |= {k: min(1.0, min(raw[j] for j in p if p[j] >= x)) for k, x in p.items()}
    got = {r.p_partkey: r.q for r in registry.queries()["bh_adjust"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_coassignment_query_takes_all_suppliers(spark, tmp_path):
    from tessera.plans import registry

    keys = range(190, 230)
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    label = lambda k, seed: (k * 2654435761 + seed * 40503) % 4294967296 % 7
    same = {(i, j): sum(label(i, s) == label(j, s) for s in range(1, 6)) for i in keys for j in keys if i < j}
    got = {(r.i, r.j): r.f for r in registry.queries()["coassignment_f"](spark, str(tmp_path)).collect()}
    assert got == {k: n / 5 for k, n in same.items() if n}


def test_frozen_lists_and_overrides_stop_on_bad_input(spark):
    from tessera.operators import blocks, keyed

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert blocks.whitelisted(rows, spark.createDataFrame([(1,), (1,)], "k int"), "k").count() == 1
    with pytest.raises(Exception, match="listed key is missing"):
        blocks.whitelisted(rows, spark.createDataFrame([(1,), (9,)], "k int"), "k").count()
    base = spark.createDataFrame([(10, "wd")], "n int, mode string")
    over = spark.createDataFrame([("x", 20, None), ("y", None, "nd")], "name string, n int, mode string")
    assert sorted(map(tuple, keyed.overridden(base, over).collect())) == [("x", 20, "wd"), ("y", 10, "nd")]
    with pytest.raises(Exception, match="not one record"):
        keyed.overridden(base.union(base), over).collect()
