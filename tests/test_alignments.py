"""Binary alignments: the same rows as the text form at every split size, exact bytes through the filter, damage and odd records."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import alignments as al
from tessera.sources import scans

REFS = [("chr1", 1 << 28), ("chr2", 5000), ("ctg", 900)]
KINDS = {"NM": "i", "AS": "i", "ZF": "f", "ZA": "A", "ZB": "B"}


def sam_lines(n, seed=3):
    r = random.Random(seed)
    for k in range(n):
        bases = r.choice([0, 1, 2, 35, 36, 151]) if k % 97 else 90_001  # some records are longer than a member
        seq = "".join(r.choices("ACGTN", k=bases)) or "*"
        qual = "*" if seq == "*" or k % 5 == 0 else "".join(chr(33 + r.randrange(41)) for _ in seq)
        chrom = r.choice(["chr1", "chr2", "ctg", "*"])
        pos, cigar = (0, "*") if chrom == "*" else (r.randrange(1, 4000), f"{bases}M" if bases < 3 else f"1S{bases - 2}M1S")
        tags = [f"CB:Z:c{r.randrange(9)}", f"NM:i:{r.randrange(-3, 70000)}", "ZF:f:0.25", "ZA:A:x", "ZB:B:s,-1,2,300"][: r.randrange(6)]
        yield "\t".join([f"read{k}", str(r.choice([0, 4, 16, 99, 256])), chrom, str(pos), str(r.randrange(61)), cigar if bases else "*", r.choice(["=", "*"]) if chrom != "*" else "*", str(r.randrange(50)), str(r.randrange(-9, 9)), seq, qual, *tags])


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("aln")
    (d / "a.sam").write_text("@HD\tVN:1.6\n" + "\n".join(sam_lines(1200)) + "\n")
    text = scans.sam(spark, f"file://{d}/a.sam")
    p = F.split("value", "\t")
    rest = spark.read.text(f"file://{d}/a.sam").filter("value not like '@%'").select(p[0].alias("name"), p[6].alias("next_chrom"), p[7].cast("long").alias("next_pos"), p[8].cast("int").alias("length"), p[10].alias("qual"))
    rows = al.encoded(text.drop("spans").join(rest, "name"), REFS, KINDS)
    al.write_bam(rows.coalesce(1), f"file://{d}/bam", REFS, "@HD\tVN:1.6\n" + "@CO\t" + "x" * 150_000 + "\n")
    return d, text, rest


def plain(df):
    return sorted(str({k: dict(sorted(v.items())) if isinstance(v, dict) else v for k, v in r.asDict(True).items()}) for r in df.collect())


@pytest.mark.parametrize("split", [1 << 26, 100_000, 20_011])
def test_scan_gives_the_text_rows_at_every_split(spark, made, split):
    d, text, _ = made
    got = al.bam(spark, f"file://{d}/bam", split_bytes=split)
    assert got.columns == text.columns
    assert split > 1 << 20 or got.rdd.getNumPartitions() > 5
    assert plain(got) == plain(text)


def test_columns_and_fixed_field_filters(spark, made):
    d, text, rest = made
    path = f"file://{d}/bam"
    cols = ("name", "next_chrom", "next_pos", "length", "qual")
    assert plain(al.bam(spark, path, cols, split_bytes=30_000)) == plain(rest.select(*cols))
    got = al.bam(spark, path, ("name", "chrom"), chroms=["chr2", "*"], min_mapq=20, off_flags=4 | 256, split_bytes=30_000)
    assert plain(got) == plain(text.filter("chrom in ('chr2', '*') and mapq >= 20 and (flag & 260) = 0").select("name", "chrom"))


def test_kept_tags_pass_as_they_were_and_in_order(spark, made):
    d, _, _ = made
    values = spark.createDataFrame([("c1",), ("c4",), ("c4",), ("none",), (None,)], "v string")
    al.keep_tagged(spark, f"file://{d}/bam", f"file://{d}/kept", values, "v", split_bytes=30_000)
    of = lambda p: {r.name: bytes(r.record) for r in al.bam(spark, f"file://{d}/{p}", ("name", "tags", "record")).filter("tags['CB'] in ('c1', 'c4')").collect()}
    assert of("kept") == of("bam") and len(of("kept")) == al.bam(spark, f"file://{d}/kept", ("name",)).count() > 100
    places = [(r.ref < 0, r.ref, r.pos) for r in al.bam(spark, f"file://{d}/kept", ("ref", "pos")).collect()]
    assert places == sorted(places)
    assert al.header(f"file://{d}/kept").references == REFS
    with pytest.raises(FileExistsError):
        al.keep_tagged(spark, f"file://{d}/bam", f"file://{d}/kept", values, "v")


def test_many_operations_stand_in_a_tag(spark, tmp_path):
    cigar = "1M1I" * 40_000
    rows = spark.createDataFrame([("long", 0, "chr1", 7, 9, cigar, "A" * 80_000, {"CB": "c"})], "name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, tags map<string,string>")
    al.write_bam(al.encoded(rows, REFS), f"file://{tmp_path}/x", REFS)
    got = al.bam(spark, f"file://{tmp_path}/x").collect()
    assert [(r.cigar, r.tags, len(r.seq)) for r in got] == [(cigar, {"CB": "c"}, 80_000)]


def test_empty_tables_damage_and_other_references(spark, made, tmp_path):
    d, text, _ = made
    al.write_bam(al.encoded(text.drop("spans").limit(0), REFS), f"file://{tmp_path}/none", REFS)
    part = next((d / "bam").glob("*.bam")).read_bytes()
    (tmp_path / "bad.bam").write_bytes(part[: len(part) // 2] + b"\0" * 50 + part[len(part) // 2 + 50 :])
    with pytest.raises(Exception, match="member"):
        al.bam(spark, f"file://{tmp_path}/bad.bam", split_bytes=50_000).count()
    assert al.bam(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="KeyError"):
        al.encoded(text.drop("spans"), REFS[:1]).count()


def test_spans_by_name_and_records_alone(spark, made):
    d, text, _ = made
    got = al.bam(spark, f"file://{d}/bam", ("name", "spans"), split_bytes=100_000)
    assert plain(got) == plain(text.select("name", "spans"))
    df = text.drop("spans")
    assert al.encoded(df, REFS, KINDS, alone=True).columns == ["record"]
    assert plain(al.encoded(df, REFS, KINDS, alone=True)) == plain(al.encoded(df, REFS, KINDS).select("record"))
