"""Tests, ranks, corrections, decompositions and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import least_from_here, prefix_sums


def average_rank(df: DataFrame, value: str, name: str = "avg_rank", keys: Sequence[str] = ()) -> DataFrame:
    """Ranks with ties averaged. Values are counted first, so the global order runs over distinct values, range by range."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    r = prefix_sums(n, value, ["__n"], keys).select(*keys, value, (F.col("before___n") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(r, [*keys, value])


def ks_distance(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D of groups a and b."""
    x = df.filter(F.col(group).isin(a, b)).groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    up = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.col(f"all_{c}")
    return prefix_sums(x, value, ["na", "nb"]).agg(F.max(F.abs(up("na") - up("nb"))).alias("ks_d"))


def auc(df: DataFrame, positive: str, value: str) -> DataFrame:
    """Area under the ROC curve from average ranks; NULL without both classes. positive: 0 or 1."""
    r = average_rank(df, value).agg(F.sum(F.when(F.col(positive) == 1, F.col("avg_rank"))).alias("r"), F.count_if(F.col(positive) == 1).alias("p"), F.count_if(F.col(positive) == 0).alias("n"))
    return r.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("n")).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(a, b), a, "__ra"), b, "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("rho"))


def bh_adjust(df: DataFrame, p: str, keys: Sequence[str] = (), name: str = "q") -> DataFrame:
    """Benjamini-Hochberg: least p * n / rank from here to the largest p, over distinct p; a null p has a null q and counts for nothing."""
    n = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("__n"))
    raw = prefix_sums(n, p, ["__n"], keys).withColumn("__q", F.col(p) * F.col("all___n") / (F.col("before___n") + F.col("__n")))
    q = least_from_here(raw, p, "__q", keys, "__least").select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], F.col(p).alias("__p"), F.least(F.lit(1.0), F.col("__least")).alias(name))
    on = F.col(p) == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return df.join(q, on, "left").drop("__p", *[f"__j{i}" for i in range(len(keys))])


def decomposition(df: DataFrame, group: str, half: str, x: str, n: str) -> DataFrame:
    """Change of a ratio of sums between halves 0 and 1: within groups, by weights, and in all. within + weight = delta exactly."""
    s = df.groupBy(group).agg(*[F.sum(F.when(F.col(half) == h, F.col(c))).alias(f"{c[0]}_{h}") for h in (0, 1) for c in (x, n)])
    a0, n0, a1, n1 = (F.coalesce(F.col(f"{c[0]}_{h}"), F.lit(0.0)) for h in (0, 1) for c in (x, n))
    all_ = Window.partitionBy()
    w0, w1 = n0 / F.sum(n0).over(all_), n1 / F.sum(n1).over(all_)
    r0, r1 = F.coalesce(F.try_divide(a0, n0), F.lit(0.0)), F.coalesce(F.try_divide(a1, n1), F.lit(0.0))
    t = s.select(((r1 - r0) * w0).alias("a"), (r1 * (w1 - w0)).alias("b"), (r1 * w1 - r0 * w0).alias("c"))
    return t.agg(F.sum("a").alias("within"), F.sum("b").alias("weight"), F.sum("c").alias("delta"))


def block_bootstrap(df: DataFrame, block: str, num: str, den: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of a ratio of sums under Poisson weights of whole blocks, drawn by hash: any partitioning gives the same."""
    b = df.groupBy(block).agg(F.sum(num).alias("a"), F.sum(den).alias("b")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(F.col(block), "draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    weight = F.lit(0)
    total, term = 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k
    w = b.withColumn("w", weight)
    r = w.groupBy("draw").agg(F.try_divide(F.sum(F.col("a") * F.col("w")), F.sum(F.col("b") * F.col("w"))).alias("r"))
    return r.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.5)).alias("mid"), F.percentile("r", F.lit(0.975)).alias("high"))


def signed_rank(df: DataFrame, difference: str) -> DataFrame:
    """Wilcoxon's paired test: pairs that differ, sum of the ranks of rising ones, and its z with ties and continuity corrected."""
    d = df.filter(F.col(difference) != 0).select(F.abs(F.col(difference)).alias("__a"), (F.col(difference) > 0).alias("__up"))
    t = d.groupBy("__a").agg(F.count("*").alias("m"), F.count_if("__up").alias("up"))
    s = prefix_sums(t, "__a", ["m"]).withColumn("r", F.col("before_m") + (F.col("m") + 1) / 2.0).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.sum(F.col("r") * F.col("up")).alias("w"), F.sum(F.col("m") * (F.col("m") * F.col("m") - 1) / 48.0).alias("ties"))
    off = F.col("w") - F.col("n") * (F.col("n") + 1) / 4.0
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("ties"))
    return s.select("n", "w", F.try_divide(off - F.signum(off) * 0.5, sd).alias("z"))


def ks_p(d, n, m):
    """Asymptotic two-sided p of a Kolmogorov-Smirnov distance of samples of n and m, by 100 terms of Kolmogorov's series."""
    root = F.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * d
    term = lambda s, i: s + F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * x * x)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def normal_p(z):
    """Two-sided p of a standard normal deviate."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")

    return p(z)
