"""Sinks. Spark's commit protocol makes each write atomic; _SUCCESS marks a whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.strings import polynomial_hash


def tsv(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.csv(path, sep="\t", header=True, compression="gzip" if compress else "none")


def by_chunk(df: DataFrame, key: str, chunks: int, path: str) -> None:
    """One folder per chunk of the keys' polynomial hash."""
    df.withColumn("chunk", F.pmod(polynomial_hash(F.col(key)), F.lit(chunks))).repartition("chunk").write.partitionBy("chunk").csv(path, sep="\t", header=True, compression="gzip")


def by_group(df: DataFrame, group: str, path: str) -> None:
    df.write.partitionBy(group).parquet(path)


def sorted_parquet(df: DataFrame, key: str, path: str) -> None:
    """Range-partitioned and sorted by the key, so that row groups prune on it."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


def split_by_predicate(df: DataFrame, condition, path_true: str, path_false: str) -> None:
    """Two complementary outputs; rows where the condition is NULL go to the second."""
    df.filter(condition).write.parquet(path_true)
    df.filter(~F.coalesce(condition, F.lit(False))).write.parquet(path_false)


def fastq(df: DataFrame, path: str, name: str = "name", seq: str = "seq", qual: str = "qual") -> None:
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(name)), F.col(seq), F.lit("+"), F.col(qual))).write.text(path)
