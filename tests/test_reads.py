"""Read-level sources on small files written here."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import reads, scans

SAM = """@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500
r1_AC_GT\t0\tchr1\t11\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tCB:Z:c1\tNM:i:1\tAS:i:9
r2_AC_GT\t16\tchr1\t11\t20\t8M2S\t*\t0\t0\tACGTACGTAC\t*\tCB:Z:c1\tNM:i:0\tXA:Z:chr2,+5,10M,1;chr2,-9,10M,2;
r3_AC_GT\t4\tchr1\t11\t0\t*\t*\t0\t0\tAC\t*\tCB:Z:c2
r4_AC_GT\t1024\tchr1\t11\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tCB:Z:c1
r5_AC_GT\t0\tchr1\t11\t30\t10M\t*\t0\t0\tACGTACGTAC\t*\tCB:Z:c1
r6_AC_GT\t0\tchr2\t7\t60\t5M\t*\t0\t0\tACGTA\t*
"""


@pytest.fixture(scope="module")
def sam(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("sam") / "a.sam"
    p.write_text(SAM)
    return scans.sam(spark, str(p)), str(p)


def test_alignments(spark, sam):
    df, path = sam
    names = lambda x: sorted(r.name.split("_")[0] for r in x.collect())
    assert names(reads.kept_alignments(df)) == ["r1", "r2", "r5", "r6"]
    assert names(reads.kept_alignments(df, 30, "CB")) == ["r1", "r5"] and names(reads.kept_alignments(df, 30, "CB", True)) == ["r1", "r4", "r5"]
    assert names(reads.multi_mapped(df)) == ["r2"]
    assert {r.name[:2]: (r.coverage, r.identity) for r in reads.identity(df.filter("flag in (0, 16)")).collect()} == {"r1": (1.0, 0.9), "r2": (0.8, 1.0), "r5": (1.0, 1.0), "r6": (1.0, 1.0)}
    assert [(r.name, r.tags["CB"]) for r in reads.barcode_from_name(df.filter("chrom = 'chr2'"), [1, 2]).collect()] == [("r6", "ACGT")]
    sites = sorted(tuple(r) for r in reads.cut_sites(reads.kept_alignments(df)).collect())
    assert sites == [("chr1", 13, 14, "c1", "-"), ("chr1", 14, 15, "c1", "+")]
    assert names(reads.deduplicated(reads.kept_alignments(df, 0, "CB"))) == ["r1", "r2"]
    assert sorted(tuple(r) for r in reads.contig_sizes(spark, path).collect()) == [("chr1", 1000), ("chr2", 500)]
    assert names(reads.without_reads(df, spark.createDataFrame([("r1_AC_GT",), ("zz",)], "name string"))) == ["r2", "r3", "r4", "r5", "r6"]


def test_fastq(spark, tmp_path):
    (tmp_path / "r1.fq").write_text("@a/1 x\nACGT\n+\n@III\n@b/1\nAC\n+\nII\n@c/1\nTT\n+\n@@\n")
    (tmp_path / "r2.fq").write_text("@a/2\nGG\n+\nII\n@c/2\nCC\n+\nI@\n")
    assert sorted(tuple(r) for r in reads.fastq(spark, str(tmp_path / "r1.fq")).collect()) == [("a/1", "ACGT", "@III"), ("b/1", "AC", "II"), ("c/1", "TT", "@@")]
    assert sorted(tuple(r) for r in reads.paired_fastq(spark, str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq")).collect()) == [("a", "ACGT", "@III", "GG", "II"), ("c", "TT", "@@", "CC", "I@")]


def test_assignment(spark):
    m = spark.createDataFrame([("r1", "x", "A", 9, 0, 60), ("r1", "x", "B", 9, 1, 60), ("r2", "x", "A", 5, 0, 30), ("r2", "x", "B", 5, 0, 30), ("r3", "y", "B", 1, 0, 0)], "Read string, BC string, Genome string, AS int, NM int, MAPQ int")
    got = {r.Read: (r.Genome, r.assigned_class) for r in reads.best_genome(m).collect()}
    assert got["r1"] == ("A", "winner") and got["r2"][1] == "ambiguous" and got["r3"] == ("B", "winner")
    a = spark.createDataFrame([("rescued",), ("winner",), (None,)], "assigned_class string")
    assert [r[0] for r in reads.friend_mode(a).collect()] == ["ambiguous", "winner", None]


def test_panels(spark, tmp_path):
    (tmp_path / "p.vcf").write_text("##x\nchr1\t5\t.\tA\tG\t.\t.\t.\tGT:DS\t0/0:0.1\t1|1:1.9\nchr1\t9\t.\tA\tG\t.\t.\t.\tGT\t0/1\t./.\nchr1\t12\t.\tA\tG\t.\t.\t.\tGP\t0.1,0.2,0.7\t1,0,0\n")
    path = str(tmp_path / "p.vcf")
    assert {(r.pos, r.founder, r.call) for r in reads.informative_panel(scans.vcf_genotypes(spark, path, ["f", "g"])).collect()} == {(5, "f", "ref"), (5, "g", "alt")}
    dose = reads.dose_matrix(spark, path, ["f", "g"])
    assert {(r.pos, r["sample"]): r.dose for r in dose.collect()} == {(5, "f"): 0.1, (5, "g"): 1.9, (9, "f"): 1.0, (9, "g"): None, (12, "f"): pytest.approx(1.6), (12, "g"): 0.0}
    assert sorted(r.pos for r in reads.common_variants(dose, least=0.45).collect()) == [5, 9]
    sites = spark.createDataFrame([("a", "f", "ref", 3, 1), ("a", "f", "alt", 0, 2), ("a", "g", "het", 5, 5), ("b", "f", None, 1, 1)], "grp string, founder string, call string, r int, a int")
    got = {(x.grp, x.founder): x.concordance for x in reads.founder_calls(sites, ["grp"], F.col("r"), F.col("a")).collect()}
    assert got == {("a", "f"): 5 / 6, ("a", "g"): None, ("b", "f"): None}


def test_bundles_and_runs(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n%\n2 2 3\n1 1 5\n2 1 1.5\n2 2 2\n")
    (tmp_path / "rows.txt").write_text("g1\ng2\n")
    (tmp_path / "cols.txt").write_text("c1\nc2\n")
    (tmp_path / "one.txt").write_text("c1\n")
    at = lambda n: str(tmp_path / n)
    assert sorted(tuple(r) for r in reads.matrix_market(spark, at("m.mtx"), at("rows.txt"), at("cols.txt")).collect()) == [("g1", "c1", 5.0), ("g2", "c1", 1.5), ("g2", "c2", 2.0)]
    with pytest.raises(Exception, match="no name"):
        reads.matrix_market(spark, at("m.mtx"), at("rows.txt"), at("one.txt")).collect()
    for track, data in (("t1", "d1"), ("t2", "d1")):
        (tmp_path / "runs" / track / data).mkdir(parents=True)
        (tmp_path / "runs" / track / data / "s7_maize.tsv").write_text("barcode\tn\nb1\t3\n")
    got = reads.runs(spark, at("runs") + "/*/*/*.tsv", ["track", "dataset"], "barcode string, n int")
    assert sorted(tuple(r) for r in got.collect()) == [("b1", 3, "t1", "d1"), ("b1", 3, "t2", "d1")]
    assert reads.runs(spark, at("nothing") + "/*/*.tsv", ["track", "dataset"], "barcode string, n int").columns == got.columns
    text = spark.read.text(at("runs") + "/*/*/*.tsv")
    assert {(r.sample, r.species) for r in reads.tagged_files(text, r"^(s\d+)_([a-z]+)\.tsv$", ["sample", "species"]).collect()} == {("s7", "maize")}
    assert reads.optional(spark, at("none.parquet"), got).count() == 2
    (tmp_path / "f.fa").write_text(">g1::chr1:1-5\nAC\nGT\n>g2 x\nTT\n")
    assert [r.sequence for r in reads.fasta_subset(scans.fasta(spark, at("f.fa")), spark.createDataFrame([("g1",)], "id string")).collect()] == ["ACGT"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b1", 1), ("b2", 2), ("b3", 3)], "bc string, n int")
    groups = spark.createDataFrame([("b1", "x"), ("b2", "y")], "bc string, grp string")
    counts = {r.grp: r.n for r in reads.split_with_counts(df, groups, "bc", "grp", str(tmp_path / "out")).collect()}
    assert counts == {"x": 1, "y": 1, None: 1} and spark.read.parquet(str(tmp_path / "out" / "all")).count() == 2
    assert [r.bc for r in reads.missing_outputs(df, groups, "bc").collect()] == ["b3"]
