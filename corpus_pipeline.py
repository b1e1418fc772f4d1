"""The corpus pipeline: quality rules, line dedup, near copies, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next stage begins;
a stage deletes the scratch tables of the one before over the same sf_dir, which nothing reads any more by then. The last
stage's tables stay, as its result is read later.

Every stage: null and empty texts count as empty and are kept or dropped as the operator's docstring says (quality rules
drop them, the others keep them); very long texts are read whole; repeated rows are each judged, and near copies keep
one; an empty table gives an empty one; columns beyond those of documents are not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, ngram_join, packing, quality
from tessera.llm.common import Scratch, read
from tessera.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_open: dict[tuple[str, str], Scratch] = {}


def _scratch(spark: SparkSession, sf_dir: str) -> Scratch:
    """Of a stage but the last; that of the stage before goes."""
    _close(spark, sf_dir)
    return _open.setdefault((spark.sparkContext.applicationId, sf_dir), Scratch(spark))


def _close(spark: SparkSession, sf_dir: str) -> None:
    old = _open.pop((spark.sparkContext.applicationId, sf_dir), None)
    if old is not None:
        old.close()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_quality(docs.select(*COLUMNS), scratch=_scratch(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines are cut from the texts; n_chars follows."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), scratch=_scratch(spark, sf_dir))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.drop_near_copies(docs.select(*COLUMNS), scratch=_scratch(spark, sf_dir))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), scratch=_scratch(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    _close(spark, sf_dir)
    return packing.pack_documents(docs.select(*COLUMNS), tokenizer_path(), scratch=Scratch(spark))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_benchmark_leaks), ("best_fit_packing", pack)]

# Packing, perplexity and components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    between = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = between.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
