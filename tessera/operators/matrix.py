"""Sparse feature-by-cell matrices as triplets (feature, cell, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pseudobulk(df: DataFrame, feature: str, cluster: str, value: str, scale: float = 1e6) -> DataFrame:
    """Sums per feature and cluster, scaled to a common total of each cluster."""
    s = df.groupBy(feature, cluster).agg(F.sum(value).alias("total"))
    return s.withColumn("cpm", F.try_divide(F.col("total") * scale, F.sum("total").over(Window.partitionBy(cluster))))


def tfidf(df: DataFrame, feature: str, cell: str, value: str, scale: float = 1e4) -> DataFrame:
    """log(1 + tf * scale) * log(1 + cells / cells with the feature's sum); totals are aggregates joined back."""
    x = df.groupBy(feature, cell).agg(F.sum(value).alias("x"))
    per_cell = x.groupBy(cell).agg(F.sum("x").alias("in_cell"))
    per_feature = x.groupBy(feature).agg(F.sum("x").alias("in_feature"))
    n = per_cell.agg(F.count("*").alias("cells"))
    return x.join(per_cell, cell).join(per_feature, feature).crossJoin(F.broadcast(n)).withColumn("tfidf", F.log1p(F.col("x") / F.col("in_cell") * scale) * F.log(1 + F.col("cells") / F.col("in_feature"))).select(feature, cell, "tfidf")


def zscore(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """(x - mean) / sample sd within keys; NULL where the sd is 0 or undefined."""
    if not keys:
        # One row for the whole table.
        m = df.agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
        return df.crossJoin(F.broadcast(m)).withColumn(name, F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))


def reciprocal_z(df: DataFrame, value: str, row: str, col: str) -> DataFrame:
    """z across each row's columns and each column's rows, and their euclidean and geometric joint scores."""
    z = zscore(zscore(df, value, [row], "z_row"), value, [col], "z_col")
    a, b = (F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))) for c in ("z_row", "z_col"))
    return z.withColumns({"rz_euclid": F.sqrt(a * a + b * b), "rz_geom": F.sqrt(a * b)})


def variance_with_zeros(df: DataFrame, feature: str, value: str, n: int | Column) -> DataFrame:
    """Sample variance of a feature over n cells, absent ones 0."""
    n = F.lit(n) if isinstance(n, int) else n
    m = df.groupBy(feature).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    return m.select(feature, F.try_divide(F.col("s"), n).alias("mean"), F.try_divide(F.col("ss") - F.col("s") * F.col("s") / n, n - 1).alias("variance"))


def entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """Shannon entropy in bits of the positive values of a key."""
    p = df.withColumn("__v", F.greatest(F.col(value), F.lit(0.0))).withColumn("__p", F.try_divide(F.col("__v"), F.sum("__v").over(Window.partitionBy(key))))
    return p.filter("__p > 0").groupBy(key).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias("entropy"))


def annotate_top(df: DataFrame, key: str, label: str, value: str, ambiguous: float = 0.8) -> DataFrame:
    """Best and second label per key with margin and ratio; AMBIGUOUS where the second comes within the ratio."""
    # The rank limit drops rows before the exchange; no key is gathered whole.
    two = df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), label))).filter("__rn <= 2")
    at = lambda c, n: F.max(F.when(F.col("__rn") == n, F.col(c)))
    out = two.groupBy(key).agg(at(label, 1).alias("top"), at(value, 1).alias("best"), at(label, 2).alias("runner_up"), at(value, 2).alias("second"))
    ratio = F.try_divide(F.col("second"), F.col("best"))
    return out.withColumns({"margin": F.col("best") - F.col("second"), "call": F.when(ratio >= ambiguous, "AMBIGUOUS").otherwise(F.col("top").cast("string"))})


def markov_step(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One hop of row-normalised diffusion: edges (src, dst, w), values (node, x)."""
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    p = edges.join(total, "src").withColumn("p", F.col("w") / F.col("total"))
    return p.join(values, p.dst == values.node).groupBy(p.src.alias("node")).agg(F.sum(F.col("p") * F.col("x")).alias("x"))
