"""Queries over binary alignment files that lines are written to first: return flag and line status are the chromosome, supplier the cell."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import alleles
from tessera.operators.rounds import scratch_folder
from tessera.plans.base import query
from tessera.sources import alignments as al
from tessera.sources import reads

REFERENCES = [(m, 1 << 28) for m in ("AF", "AO", "NF", "NO", "RF", "RO")]
ROWS_SQL = "select l_orderkey || '-' || l_linenumber as name, l_returnflag || l_linestatus as chrom, l_partkey as pos, cast(l_quantity as int) as mapq, (l_linenumber = 2)::int * 4 + (l_linenumber = 3)::int * 16 + (l_linenumber = 4)::int * 256 as flag, l_suppkey as cell, l_linenumber as edits, 20 + cast(l_quantity as int) as bases from lineitem"
SPLIT = 1 << 18
#: What a summary is made of; other columns are not decoded.
READ = ("name", "chrom", "pos", "spans", "tags")


def _written(t, name: str) -> str:
    line, n = t("lineitem"), F.col("l_quantity").cast("int")
    flag = F.when(F.col("l_linenumber") == 2, 4).when(F.col("l_linenumber") == 3, 16).when(F.col("l_linenumber") == 4, 256).otherwise(0)
    tags = F.create_map(F.lit("CB"), F.col("l_suppkey").cast("string"), F.lit("NM"), F.col("l_linenumber").cast("string"))
    rows = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), flag.alias("flag"), F.concat("l_returnflag", "l_linestatus").alias("chrom"), F.col("l_partkey").alias("pos"), n.alias("mapq"), F.concat((20 + n).cast("string"), F.lit("M")).alias("cigar"), F.rpad(F.lit("ACGT"), 20 + n, "ACGT").alias("seq"), tags.alias("tags")
    )
    path = f"{scratch_folder(line.sparkSession)}/{name}-{uuid.uuid4().hex}"
    al.write_bam(al.encoded(rows, REFERENCES, {"NM": "i"}, alone=True), path, REFERENCES)
    return path


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("chrom").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.sum("pos").alias("pos_sum"), F.sum(F.col("tags")["NM"].cast("int")).alias("edits"), F.count_distinct(F.col("tags")["CB"]).alias("cells"), F.sum("spans.ref_consumed").alias("aligned"))


SUMMARY_SQL = "select chrom, count(*) as n, count(distinct name) as names, sum(pos) as pos_sum, sum(edits) as edits, count(distinct cell) as cells, sum(bases) as aligned from r where {} group by 1"


@query(f"with r as ({ROWS_SQL}) " + SUMMARY_SQL.format("mapq >= 10 and flag & 260 = 0"))
def alignment_file_scan(t):
    """Filters on fixed fields before decoding, over splits smaller than the file."""
    path = _written(t, "scan")
    spark = t("lineitem").sparkSession
    return _summary(al.bam(spark, path, READ, min_mapq=10, off_flags=4 | 256, split_bytes=SPLIT))


@query(f"with r as ({ROWS_SQL} where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)) " + SUMMARY_SQL.format("true"))
def alignments_of_kept_cells(t):
    """A file of the alignments whose cell is in a list, read back."""
    spark, path = t("lineitem").sparkSession, _written(t, "cells")
    al.keep_tagged(spark, path, path + "-kept", t("supplier").filter("s_acctbal < 0"), "s_suppkey", split_bytes=SPLIT)
    return _summary(al.bam(spark, path + "-kept", READ, split_bytes=SPLIT))


@query(f"with r as ({ROWS_SQL}) select chrom, case when flag & 16 > 0 then pos - 1 + bases - 5 else pos - 1 + 4 end as start, cast(cell as varchar) as cell, case when flag & 16 > 0 then '-' else '+' end as strand from r where flag & 260 = 0 and mapq >= 30 group by all")
def cut_sites_of_alignment_file(t):
    """Distinct insertion sites of mapped primary alignments of a binary file."""
    path = _written(t, "cuts")
    rows = al.bam(t("lineitem").sparkSession, path, ("flag", "chrom", "pos", "mapq", "spans", "tags"), split_bytes=SPLIT)
    return reads.cut_sites(reads.kept_alignments(rows, 30, "CB")).select("chrom", "start", "cell", "strand")


SITES_SQL = "select case when p_size % 2 = 0 then 'RF' else 'NO' end as chrom, p_partkey as pos, 'ACGT'[p_size % 4 + 1] as ref, 'ACGT'[(p_size + 1) % 4 + 1] as alt from part"
SEEN_SQL = f"""with r as ({ROWS_SQL}), k as (select chrom, pos, mapq, edits, n_name as grp from r join supplier on s_suppkey = cell join nation on n_nationkey = s_nationkey where mapq >= 10 and flag & 260 = 0),
d as (select k.*, g.d from k join (select unnest(range(80)) as d) g on g.d < mapq + 22), b as (select chrom, pos + d as pos, grp, mapq, edits, 'ACGT'[(case when d < mapq then d + 3 else d + 1 end) % 4 + 1] as base from d where d < mapq or d >= mapq + 2),
s as ({SITES_SQL}), o as (select grp, b.chrom, b.pos, ref, alt, base, edits, mapq from b join s on s.chrom = b.chrom and s.pos = b.pos) """


def _seen(t, apart: bool) -> DataFrame:
    """Reads of 3 clipped bases, as many aligned as the quantity, 2 deleted and 20 aligned, at sites that are parts."""
    n = F.col("l_quantity").cast("int")
    flag = F.when(F.col("l_linenumber") == 2, 4).when(F.col("l_linenumber") == 3, 16).when(F.col("l_linenumber") == 4, 256).otherwise(0)
    tags = F.create_map(F.lit("CB"), F.col("l_suppkey").cast("string"), F.lit("NM"), F.col("l_linenumber").cast("string"))
    reads_ = t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("chrom"), F.col("l_partkey").alias("pos"), n.alias("mapq"), flag.alias("flag"), tags.alias("tags"), F.concat(F.lit("3S"), n.cast("string"), F.lit("M2D20M")).alias("cigar"), F.rpad(F.lit("ACGT"), 23 + n, "ACGT").alias("seq"))
    letter = lambda k: F.substring(F.lit("ACGT"), (F.col("p_size") + k).cast("int") % 4 + 1, F.lit(1))
    sites = t("part").select(F.when(F.col("p_size") % 2 == 0, "RF").otherwise("NO").alias("chrom"), F.col("p_partkey").alias("pos"), letter(0).alias("ref"), letter(1).alias("alt"))
    groups = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cell"), F.col("n_name").alias("grp"))
    return alleles.observed(reads_, sites, groups, apart=apart)


@query(SEEN_SQL + "select grp, chrom, pos, ref, alt, count(*) filter (where base = ref) as n_ref, count(*) filter (where base = alt) as n_alt, count(*) filter (where base not in (ref, alt)) as n_other from o group by all")
def allele_counts_at_sites(t):
    return alleles.allele_counts(_seen(t, True))


@query(SEEN_SQL + "select grp, case when base = ref then 'ref' else 'alt' end as allele, count(*) as n, round(avg(edits), 6) as mean_edits, round(avg(mapq), 6) as mean_mapq from o where base in (ref, alt) group by 1, 2")
def allele_mapping_bias(t):
    out = alleles.allele_bias(_seen(t, False))
    return out.select("grp", "allele", "n", F.round("mean_edits", 6).alias("mean_edits"), F.round("mean_mapq", 6).alias("mean_mapq"))
