"""Scans of the text formats, as typed DataFrames. Sentinels become NULL; gz files are dealt out after reading, as one cannot be split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.strings import cigar_spans, clean_sentinel


def tsv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, sentinels: tuple[str, ...] = ("None", "none", "NA", "")) -> DataFrame:
    df = spark.read.schema(schema).csv(path, sep="\t", header=header, enforceSchema=False, nullValue="NA")
    return df.select(*[clean_sentinel(F.col(c), sentinels).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def row_named_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose header is one field short: rows begin with a name, which goes."""
    lines = spark.read.text(path)
    head = lines.first()
    names = head[0].split("\t") if head else []
    parts = lines.filter(F.col("value") != (head[0] if head else "")).select(F.split("value", "\t").alias("p"))
    shift = F.when(F.size("p") > len(names), 1).otherwise(0)
    return parts.select(*[F.try_element_at("p", F.lit(i + 1) + shift).alias(n) for i, n in enumerate(names)])


def bed(spark: SparkSession, path: str, extra: str = "cell string, strand string") -> DataFrame:
    return spark.read.schema("chrom string, start long, end long, " + extra).csv(path, sep="\t")


def narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, start long, end long, name string, score int, strand string, signal double, p double, q double, summit int").csv(path, sep="\t")


def gff_genes(spark: SparkSession, path: str, feature: str = "gene") -> DataFrame:
    """(geneID, chrom, start, end, strand); fields beyond the ninth belong to the attributes, shorter lines go."""
    p = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 9)
    a = p.select(*[F.col("p")[i].alias(n) for i, n in ((0, "chrom"), (2, "kind"), (3, "start"), (4, "end"), (6, "strand"))], F.array_join(F.slice("p", F.lit(9), F.size("p")), " ").alias("a")).filter(F.col("kind") == feature)
    return a.select(F.regexp_replace(F.regexp_extract("a", "ID=([^;]+)", 1), "^gene:", "").alias("geneID"), "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand")


def vcf_snvs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt): single-base references with the first single-base alternative."""
    p = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 5)
    alt = F.try_element_at(F.filter(F.split(F.col("p")[4], ","), lambda x: (F.length(x) == 1) & ~x.isin("*", ".")), F.lit(1))
    return p.select(F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("pos"), F.upper(F.col("p")[3]).alias("ref"), F.upper(alt).alias("alt")).filter((F.length("ref") == 1) & F.col("alt").isNotNull())


def vcf_genotypes(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """Long (chrom, pos, ref, alt, founder, gt) of the named sample columns."""
    p = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 9 + len(samples))
    calls = F.explode(F.array(*[F.struct(F.lit(s).alias("founder"), F.split(F.col("p")[9 + i], ":")[0].alias("gt")) for i, s in enumerate(samples)]))
    return p.select(F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("pos"), F.col("p")[3].alias("ref"), F.col("p")[4].alias("alt"), calls.alias("c")).select("chrom", "pos", "ref", "alt", "c.founder", "c.gt")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with their tags as a map and their CIGAR spans."""
    p = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 11)
    tags = F.map_from_entries(F.transform(F.slice("p", F.lit(12), F.size("p")), lambda t: F.struct(F.substring_index(t, ":", 1), F.regexp_replace(t, "^[^:]*:[^:]*:", ""))))
    cols = ((0, "name", "string"), (1, "flag", "int"), (2, "chrom", "string"), (3, "pos", "long"), (4, "mapq", "int"), (5, "cigar", "string"), (9, "seq", "string"))
    return p.select(*[F.col("p")[i].cast(t).alias(n) for i, n, t in cols], tags.alias("tags")).withColumn("spans", cigar_spans(F.col("cigar")))


def read_metrics(alignments: DataFrame, barcode_tag: str = "CB") -> DataFrame:
    """Read-level metrics of mapped primary first mates: (Read, BC, MAPQ, AS, NM, XAcount)."""
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    keep = alignments.filter("(flag & 4) = 0 and (flag & 256) = 0 and (flag & 2048) = 0 and (flag & 128) = 0")
    xa = F.coalesce(F.size(F.filter(F.split(tag("XA"), ";"), lambda x: x != "")), F.lit(0))
    return keep.select(F.col("name").alias("Read"), tag(barcode_tag).alias("BC"), F.col("mapq").alias("MAPQ"), F.coalesce(tag("AS").cast("int"), F.lit(0)).alias("AS"), F.coalesce(tag("NM").cast("int"), F.lit(0)).alias("NM"), F.greatest(xa, F.lit(0)).alias("XAcount"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence) per record."""
    r = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    return r.select(F.split(head, r"\s")[0].alias("name"), head.alias("description"), F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "").alias("sequence"))


def expand_ranges(df: DataFrame, spec: str, name: str = "well") -> DataFrame:
    """Well names of specifications such as 'A1-4,B2'; a bad or falling range raises."""
    part = df.withColumn("__part", F.explode(F.split(F.regexp_replace(spec, r"\s", ""), ",")))
    row = F.regexp_extract("__part", r"^([A-Z]+)(\d+)(?:-(\d+))?$", 1)
    lo, hi = (F.regexp_extract("__part", r"^([A-Z]+)(\d+)(?:-(\d+))?$", k) for k in (2, 3))
    lo = F.when(lo != "", lo.cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad range "), F.col("__part"))).cast("int"))
    hi = F.when(hi == "", lo).otherwise(F.expr(r"try_cast(regexp_extract(__part, '^([A-Z]+)(\\d+)(?:-(\\d+))?$', 3) as int)"))
    checked = F.when(hi >= lo, hi).otherwise(F.raise_error(F.concat(F.lit("falling range "), F.col("__part"))).cast("int"))
    return part.withColumn("__n", F.explode(F.sequence(lo, checked))).withColumn(name, F.concat(row, F.col("__n").cast("string"))).drop("__part", "__n")


def unpivot_layout(df: DataFrame, row: str = "row") -> DataFrame:
    """A plate layout, one row a plate row, as (well, barcode)."""
    cols = [c for c in df.columns if c != row]
    return df.unpivot([row], cols, "__col", "barcode").select(F.concat(F.col(row), F.regexp_replace("__col", r"\D", "")).alias("well"), "barcode")
