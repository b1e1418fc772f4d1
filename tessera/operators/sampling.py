"""Random draws as orders by hash: repeatable, and the same on any number of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.strings import uniform_hash


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum without replacement; a smaller stratum is taken whole."""
    w = Window.partitionBy(stratum).orderBy(uniform_hash(F.col(key), seed), key)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def rarefy(df: DataFrame, cell: str, feature: str, count: str, target: int, seed: int = 0) -> DataFrame:
    """Draw `target` units of each cell's counts without replacement; cells with fewer go."""
    units = df.withColumn("__u", F.explode(F.sequence(F.lit(1), F.col(count).cast("int")))).filter(F.col(count) > 0)
    w = Window.partitionBy(cell)
    order = w.orderBy(F.xxhash64(cell, feature, "__u", F.lit(seed)), feature, "__u")
    drawn = units.withColumn("__n", F.count("*").over(w)).withColumn("__rn", F.row_number().over(order)).filter((F.col("__n") >= target) & (F.col("__rn") <= target))
    return drawn.groupBy(cell, feature).agg(F.count("*").alias(count))


def draws(df: DataFrame, key: str, n: int, repeats: int, seed: int = 0) -> DataFrame:
    """`repeats` independent draws of n rows each."""
    r = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    w = Window.partitionBy("draw").orderBy(F.xxhash64(key, "draw", F.lit(seed)), key)
    return r.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
