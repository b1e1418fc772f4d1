"""Alleles at sites against a walk of each read in Python; deletions, clips, insertions, skips, odd rows and empty tables."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.strings import cigar_spans
from tessera.operators import alleles as al

READS = "name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, tags map<string,string>"
SITES, GROUPS = "chrom string, pos long, ref string, alt string", "cell string, grp string"


def pairs(pos, cigar, seq):
    q, out = 0, {}
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            out |= {pos + i: seq[q + i].upper() for i in range(n)}
        pos += n if op in "M=XDN" else 0
        q += n if op in "M=XIS" else 0
    return out


def made(n, r):
    for k in range(n):
        ops = r.choice(["{}M", "3S{}M2I{}M", "{}M5D{}M4S", "2H{}=1X{}M", "{}M1500N{}M", "*"])
        cigar = ops.format(r.randrange(1, 30), r.randrange(1, 30))
        size = sum(int(a) for a, b in re.findall(r"(\d+)([MIS=X])", cigar))
        seq = "".join(r.choices("ACGTacgt", k=size)) if cigar != "*" else "ACGT"
        tags = r.choice([{"CB": f"c{r.randrange(6)}", "NM": str(r.randrange(5))}, {"CB": "c1"}, {"NM": "3"}])
        yield (f"r{k}", r.choice([0, 0, 0, 16, 4, 256, 1024, 2048]), r.choice(["x", "y"]), r.randrange(1000, 1100), r.randrange(60), cigar, seq if k % 31 else "*", tags)


def test_counts_and_bias_equal_a_walk(spark):
    r = random.Random(8)
    reads = list(made(900, r))
    sites = [(c, p, *r.sample("ACGT", 2)) for c in "xyz" for p in [*range(1000, 1140, 7), 1024, 2047, 2048, 2560, 2600]]
    groups = [("c0", "a"), ("c1", "a"), ("c2", "b"), ("c2", "c"), ("c2", "c"), (None, "a"), ("c3", None)]
    df = spark.createDataFrame(reads, READS).withColumn("spans", cigar_spans(F.col("cigar")))
    twice = spark.createDataFrame([*sites, ("x", 1007, "T", "T"), (None, 5, "A", "C"), ("x", None, "A", "C")], SITES)
    seen = al.observed(df.repartition(4), twice, spark.createDataFrame(groups, GROUPS))
    at = {(c, p): (a, b) for c, p, a, b in sites}
    at["x", 1007] = min(at["x", 1007], ("T", "T"))
    counts, bias = {}, {}
    for _, flag, c, pos, mapq, cigar, seq, tags in reads:
        if flag & (4 | 256 | 1024 | 2048) or mapq < 10 or "CB" not in tags or cigar == "*" or seq == "*":
            continue
        for g in sorted({g for cell, g in groups if cell == tags["CB"] and g}):
            for p, b in pairs(pos, cigar, seq).items():
                if (c, p) in at:
                    kind = (at[c, p] + (b,)).index(b) if b in at[c, p] else 2
                    counts.setdefault((g, c, p), [0, 0, 0])[kind] += 1
                    if kind < 2:
                        x = bias.setdefault((g, ("ref", "alt")[kind]), [0, 0, 0])
                        x[0], x[1], x[2] = x[0] + 1, x[1] + int(tags.get("NM", 0)), x[2] + mapq
    got = {(x.grp, x.chrom, x.pos): [x.n_ref, x.n_alt, x.n_other] for x in al.allele_counts(seen).collect()}
    assert got == counts and len(got) > 60 and any(p > 2000 for _, _, p in got)
    assert {(x.grp, x.allele): (x.n, round(x.mean_edits, 9), round(x.mean_mapq, 9)) for x in al.allele_bias(seen).collect()} == {k: (n, round(e / n, 9), round(m / n, 9)) for k, (n, e, m) in bias.items()}


def test_empty_tables(spark):
    df = spark.createDataFrame([], READS).withColumn("spans", cigar_spans(F.col("cigar")))
    seen = al.observed(df, spark.createDataFrame([], SITES), spark.createDataFrame([], GROUPS))
    assert al.allele_counts(seen).count() == 0 and al.allele_bias(seen).count() == 0


def test_sums_not_observations_leave_a_bin(spark):
    """3,000 reads over 40 sites: one row for each group, site and batch at most, not one for each read and site."""
    reads = [(f"r{k}", 0, "x", 5000, 30, "50M", "ACGTG" * 10, {"CB": f"c{k % 2}", "NM": "2"}) for k in range(3000)]
    sites = [("x", 5000 + k, "A", "C") for k in range(40)]
    df, at = spark.createDataFrame(reads, READS).repartition(4), spark.createDataFrame(sites, SITES)
    groups = spark.createDataFrame([("c0", "a"), ("c1", "b")], GROUPS)
    seen = al.observed(df.withColumn("spans", cigar_spans(F.col("cigar"))), at, groups)
    assert 80 <= seen.count() <= 4 * 80
    got = {(x.grp, x.pos): (x.n_ref, x.n_alt, x.n_other) for x in al.allele_counts(seen).collect()}
    kinds = [(1500, 0, 0), (0, 1500, 0), (0, 0, 1500), (0, 0, 1500), (0, 0, 1500)]
    assert got == {(g, 5000 + k): kinds[k % 5] for g in "ab" for k in range(40)}


def test_odd_alleles_borders_and_slices(spark, monkeypatch):
    """Null and long alleles are kept as they are, letters that are not ASCII take one place, skips reach far, batches are cut."""
    b = al.BIN
    reads = [("r0", 0, "x", b - 3, 30, f"4M{3 * b}N6M", "acgtACGTAC", {"CB": "c"}), ("r1", 0, "x", b - 3, 30, "10M", "A\u00e9GTAC", {"CB": "c", "NM": "1"}), ("r2", 0, "x", -2, 30, "9M", "ACGTACGTA", {"CB": "c"}), ("r3", 0, "x", b - 3, 30, None, "ACGT", {"CB": "c"}), ("r4", 0, None, b - 3, 30, "4M", "ACGT", {"CB": "c"})]
    sites = [("x", b - 3, "A", None), ("x", b - 2, "g", "c"), ("x", b - 1, None, "g"), ("x", b, "TA", "t"), ("x", b + 1, None, None), ("x", b + 3, "A", "C"), ("x", 4 * b + 1, "A", "C"), ("x", 4 * b + 6, "G", "C"), ("x", -1, "C", "T")]
    rows = {(b - 3, "A", None): (2, 0, 0), (b - 2, "G", "C"): (0, 1, 1), (b - 1, None, "G"): (0, 2, 0), (b, "TA", "T"): (0, 2, 0), (b + 1, None, None): (0, 0, 0), (4 * b + 1, "A", "C"): (1, 0, 0), (4 * b + 6, "G", "C"): (0, 1, 0), (-1, "C", "T"): (1, 0, 0)}
    df, at, groups = spark.createDataFrame(reads, READS).coalesce(1), spark.createDataFrame(sites, SITES), spark.createDataFrame([("c", "a")], GROUPS)
    seen = al.observed(df, at, groups)
    assert {(x.pos, x.ref, x.alt): (x.n_ref, x.n_alt, x.n_other) for x in al.allele_counts(seen).collect()} == rows
    for s in (seen, al.observed(df, at, groups, apart=False)):
        assert {x.allele: (x.n, x.mean_edits, x.mean_mapq) for x in al.allele_bias(s).collect()} == {"ref": (4, 0.25, 30.0), "alt": (6, 2 / 6, 30.0)}
    batch = df.select(F.lit("a").alias("grp"), "chrom", F.col("pos"), "cigar", "seq", F.lit(0).cast("long").alias("edits"), F.lit(0).cast("long").alias("mapq")).filter("cigar is not null").toArrow().combine_chunks().to_batches()[0]
    whole = [x for p in al._pieces([batch]) for x in p.to_pylist()]
    monkeypatch.setattr(al, "ROOM", 8)
    assert [x for p in al._pieces([batch]) for x in p.to_pylist()] == whole and len(whole) == 9


def test_long_cigars_are_not_kept_and_empty_batches_pass():
    pieces = lambda cigar, seq: [x for p in al._pieces([pa.RecordBatch.from_pylist([{"grp": "a", "chrom": "x", "pos": 10, "cigar": cigar, "seq": seq, "edits": 0, "mapq": 9}])]) for x in p.to_pylist()]
    size = al._kept_runs.cache_info().currsize
    [one] = pieces("1M1I" * 40, "AC" * 40)
    assert one["bases"] == b"A" * 40 and al._kept_runs.cache_info().currsize == size
    none = pa.RecordBatch.from_pylist([], pa.schema({"seq": pa.string(), "cigar": pa.string(), "pos": pa.int64(), "bases": pa.binary(), "refs": pa.binary(), "alts": pa.binary()}))
    assert not list(al._pieces([none])) and not list(al._tallies([none], True))
