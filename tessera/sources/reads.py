"""Read-level sources: paired reads, alignments with filters, panels, matrices, partitioned runs; and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.strings import cut_site, genotype

UNMAPPED, REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 4, 16, 256, 1024, 2048


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual): records are cut at the line that begins with @ four lines apart, file by file.

    A record is read as one element (a line separator of newline and @), so no line numbers are needed and files split;
    qualities that begin with @ are told by the missing + line and joined to the record before."""
    r = spark.read.option("lineSep", "\n@").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    r = r.withColumn("l", lines)
    # A piece of fewer than four lines lost its quality to a leading @, which the piece behind it holds.
    after = F.lead("value").over(Window.partitionBy("file").orderBy("at"))
    whole = r.withColumn("after", after).filter(F.size("l") >= 3)
    qual = F.when(F.size("l") >= 4, F.col("l")[3]).otherwise(F.concat(F.lit("@"), F.split("after", "\n")[0]))
    return whole.select(F.regexp_replace(F.split(F.col("l")[0], r"\s")[0], "^@", "").alias("name"), F.col("l")[1].alias("seq"), qual.alias("qual"))


def paired_fastq(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Both mates by the name before /1 and /2; a mate without its pair goes."""
    side = lambda p, s: fastq(spark, p).select(F.regexp_replace("name", "/[12]$", "").alias("name"), F.col("seq").alias(f"seq{s}"), F.col("qual").alias(f"qual{s}"))
    return side(first, 1).join(side(second, 2), "name")


def kept_alignments(alignments: DataFrame, min_mapq: int = 0, tag: str | None = None, duplicates: bool = False) -> DataFrame:
    """Mapped primary alignments of at least a mapping quality, with a tag where one is asked for; duplicates only if wanted."""
    off = UNMAPPED | SECONDARY | SUPPLEMENTARY | (0 if duplicates else DUPLICATE)
    out = alignments.filter((F.col("flag").bitwiseAND(off) == 0) & (F.col("mapq") >= min_mapq))
    return out.filter(F.try_element_at("tags", F.lit(tag)).isNotNull()) if tag else out


def multi_mapped(alignments: DataFrame, below: int = 30, edits: int = 3) -> DataFrame:
    """Alignments of low mapping quality with more than one alternative within so many edits of their own."""
    xa, nm = F.try_element_at("tags", F.lit("XA")), F.coalesce(F.try_element_at("tags", F.lit("NM")).cast("int"), F.lit(0))
    close = F.size(F.filter(F.filter(F.split(xa, ";"), lambda x: x != ""), lambda x: F.element_at(F.split(x, ","), -1).cast("int") - nm < edits))
    return alignments.filter(xa.isNotNull() & (F.col("mapq") < below) & (close > 1))


def identity(alignments: DataFrame) -> DataFrame:
    """Adds coverage (aligned bases over the read) and identity ((aligned - NM) / aligned)."""
    nm, aligned = F.coalesce(F.try_element_at("tags", F.lit("NM")).cast("int"), F.lit(0)), F.col("spans.query_aligned")
    return alignments.withColumns({"coverage": F.try_divide(aligned, F.length("seq")), "identity": F.try_divide(aligned - nm, aligned)})


def barcode_from_name(alignments: DataFrame, fields: Sequence[int], tag: str = "CB") -> DataFrame:
    """Moves the named fields (from 0) of an underscore-split read name into a tag; the name keeps its first field."""
    p = F.split("name", "_")
    code = F.array_join(F.array(*[F.get(p, F.lit(i)) for i in fields]), "")
    return alignments.withColumns({"tags": F.map_concat(F.map_filter("tags", lambda k, v: k != tag), F.create_map(F.lit(tag), code)), "name": p[0]})


def cut_sites(alignments: DataFrame, tag: str = "CB") -> DataFrame:
    """(chrom, start, end, cell, strand): distinct one-base insertion sites; the cell is part of what makes them distinct."""
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    at = cut_site(F.col("pos") - 1, F.col("pos") - 1 + F.col("spans.ref_consumed"), reverse)
    out = alignments.select("chrom", at.alias("start"), (at + 1).alias("end"), F.try_element_at("tags", F.lit(tag)).alias("cell"), F.when(reverse, "-").otherwise("+").alias("strand"))
    return out.filter("cell is not null").dropDuplicates(["chrom", "start", "cell", "strand"])


def deduplicated(alignments: DataFrame, tag: str = "CB") -> DataFrame:
    """One alignment per position, strand and cell: the one of best mapping quality, the smallest name on ties."""
    key = ["chrom", "pos", F.col("flag").bitwiseAND(REVERSE).alias("__rev"), F.try_element_at("tags", F.lit(tag)).alias("__cell")]
    best = F.min_by(F.struct(*alignments.columns), F.struct(-F.col("mapq"), F.col("name")))
    return alignments.groupBy(*key).agg(best.alias("r")).select("r.*")


def best_genome(metrics: DataFrame, read: str = "Read", genome: str = "Genome") -> DataFrame:
    """Each read's genome by alignment score, then fewest edits, then mapping quality; a full tie is ambiguous."""
    rank = F.struct(F.col("AS"), -F.col("NM"), F.col("MAPQ"))
    g = metrics.groupBy(read).agg(F.max_by(F.struct(genome, "BC"), F.struct(rank.alias("r"), F.col(genome))).alias("top"), F.max(rank).alias("best"), F.count("*").alias("n"))
    ties = metrics.join(g.select(read, "best"), read).filter(rank == F.col("best")).groupBy(read).agg(F.count("*").alias("ties"))
    call = F.when(F.col("ties") > 1, "ambiguous").otherwise("winner")
    return g.join(ties, read).select(read, F.col("top.BC").alias("BC"), F.col(f"top.{genome}").alias(genome), call.alias("assigned_class"))


def friend_mode(assigned: DataFrame) -> DataFrame:
    """Rescued reads count as ambiguous."""
    return assigned.withColumn("assigned_class", F.when(F.col("assigned_class") == "rescued", "ambiguous").otherwise(F.col("assigned_class")))


def without_reads(alignments: DataFrame, drop: DataFrame, read: str = "name") -> DataFrame:
    """Alignments whose read is not in the drop list; the list grows with the data and is never broadcast by hand."""
    return alignments.join(drop.select(read).distinct(), read, "left_anti")


def informative_panel(genotypes: DataFrame) -> DataFrame:
    """Long founder genotypes with calls, of the sites where one founder is ref and another alt."""
    called = genotypes.withColumn("call", genotype(F.col("gt")))
    site = called.groupBy("chrom", "pos", "ref", "alt").agg(F.count_if(F.col("call") == "ref").alias("r"), F.count_if(F.col("call") == "alt").alias("a")).filter("r > 0 and a > 0")
    return called.join(site.select("chrom", "pos", "ref", "alt"), ["chrom", "pos", "ref", "alt"], "left_semi")


def dose_matrix(spark: SparkSession, path: str, samples: Sequence[str]) -> DataFrame:
    """Long (chrom, pos, sample, dose): the DS field, else the alternative alleles of GT, else the expectation from GP."""
    p = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 9 + len(samples))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.split(F.col("p")[9 + i], ":").alias("v")) for i, s in enumerate(samples)]))
    long = p.select(F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("pos"), F.split(F.col("p")[8], ":").alias("f"), each.alias("s"))
    field = lambda n: F.get("s.v", F.array_position("f", F.lit(n)).cast("int") - 1)
    alleles = F.split(F.replace(field("GT"), F.lit("|"), F.lit("/")), "/")
    from_gt = F.when(F.size(F.filter(alleles, lambda x: x.rlike("^[01]$"))) == 2, F.aggregate(alleles, F.lit(0.0), lambda a, x: a + x.try_cast("double")))
    gp = F.split(field("GP"), ",")
    from_gp = F.get(gp, F.lit(1)).try_cast("double") + 2 * F.get(gp, F.lit(2)).try_cast("double")
    return long.select("chrom", "pos", F.col("s.sample").alias("sample"), F.coalesce(field("DS").try_cast("double"), from_gt, from_gp).alias("dose"))


def common_variants(genotypes: DataFrame, dose: str = "dose", least: float = 0.01) -> DataFrame:
    """Sites with one alternative whose minor allele frequency is at least so much."""
    g = genotypes.groupBy("chrom", "pos").agg((F.avg(dose) / 2).alias("af"))
    return g.filter(F.least("af", 1 - F.col("af")) >= least)


def contig_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) of an alignment header."""
    h = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    return h.select(F.regexp_extract("value", "SN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", "LN:([0-9]+)", 1).cast("long").alias("length"))


def fasta_subset(records: DataFrame, ids: DataFrame, name: str = "name", separator: str = "::") -> DataFrame:
    """Records whose name, up to a separator, is in a list of ids."""
    return records.join(ids.select(F.col(ids.columns[0]).alias("__id")).distinct(), F.substring_index(name, separator, 1) == F.col("__id"), "left_semi")


def matrix_market(spark: SparkSession, path: str, rows: str, columns: str) -> DataFrame:
    """(row, column, value) of a coordinate file with its name lists; fails where an index has no name."""
    named = lambda p, n: spark.read.text(p).select(F.col("value").alias(n), F.col("_metadata.file_name").alias("__f"), F.monotonically_increasing_id().alias("__m")).select(n, F.row_number().over(Window.orderBy("__f", "__m")).alias("__i"))
    t = spark.read.text(path).filter(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("m"))
    size = t.agg(F.min("m").alias("m"))
    t = t.join(F.broadcast(size.withColumnRenamed("m", "first"))).filter("m > first").select(F.col("p")[0].cast("int").alias("i"), F.col("p")[1].cast("int").alias("j"), F.col("p")[2].cast("double").alias("value"))
    out = t.join(named(rows, "row"), F.col("i") == F.col("__i"), "left").drop("__i").join(named(columns, "column"), F.col("j") == F.col("__i"), "left").drop("__i")
    check = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("an index has no name")))
    return out.select(check("row").alias("row"), check("column").alias("column"), "value")


def runs(spark: SparkSession, pattern: str, parts: Sequence[str], schema: str, sep: str = "\t") -> DataFrame:
    """All files of a pattern with the last folder names as columns; an empty table where no file matches."""
    empty = spark.createDataFrame([], ", ".join([schema, *(f"{p} string" for p in parts)]))
    try:
        df = spark.read.schema(schema).option("ignoreMissingFiles", True).csv(pattern, sep=sep, header=True, enforceSchema=False)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    at = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", *[F.element_at(at, -1 - len(parts) + i).alias(p) for i, p in enumerate(parts)])


def tagged_files(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Columns from the groups of a pattern over the file's name; files that do not match go."""
    name = F.col("_metadata.file_name")
    return df.select("*", *[F.regexp_extract(name, pattern, i + 1).alias(n) for i, n in enumerate(names)]).filter(name.rlike(pattern))


def optional(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """The Parquet table at a path, or the fallback where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fallback


def split_with_counts(df: DataFrame, groups: DataFrame, key: str, group: str, path: str) -> DataFrame:
    """Writes a folder per group and one of all rows that have a group; (group, n), with NULL for dropped rows.

    groups: (key, group)."""
    marked = df.join(groups.select(key, group), key, "left")
    marked.filter(F.col(group).isNotNull()).write.partitionBy(group).parquet(f"{path}/by_group")
    marked.filter(F.col(group).isNotNull()).drop(group).write.parquet(f"{path}/all")
    return marked.groupBy(group).agg(F.count("*").alias("n"))


def missing_outputs(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What an interrupted run has still to write."""
    return expected.join(present, key, "left_anti")


def founder_calls(sites: DataFrame, groups: Sequence[str], ref: Column, alt: Column) -> DataFrame:
    """Allele concordance of groups of reads with founders: share of observations that carry the founder's allele.

    sites: long (groups, founder, call) with counts of both alleles."""
    match = F.when(F.col("call") == "ref", ref).when(F.col("call") == "alt", alt)
    return sites.groupBy(*groups, "founder").agg(F.try_divide(F.sum(match), F.sum(F.when(F.col("call").isin("ref", "alt"), ref + alt))).alias("concordance"), F.count("*").alias("n_sites"))
