"""Bootstraps with exact multinomial weights that all sides share.

A draw of n units is n picks by hash among their numbers, so the weights of a draw sum to n exactly, and two tables that
are weighted by unit get the same weights. Rows: draws times units, each joined once with the units' sums; quantiles are
over the draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.nulls import hash_below
from tessera.operators.ordered import numbered
from tessera.operators.rounds import settled

LEVELS = (0.025, 0.975)


def weights(units: DataFrame, unit: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, unit, mult) of the units that a draw picked; numbers of units follow their order."""
    order = settled(numbered(units.select(F.col(unit).alias("unit")).filter("unit is not null").distinct(), ["unit"], "place"))
    n = order.count()
    if not n:
        return order.select(F.lit(0).alias("draw"), "unit", F.lit(0).cast("long").alias("mult"))
    each = order.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = each.select("draw", hash_below(n, F.lit(seed), F.col("draw"), F.col("place")).alias("place"))
    return picks.groupBy("draw", "place").agg(F.count("*").alias("mult")).join(order, "place").select("draw", "unit", "mult")


def _interval(c: str, *names: str):
    return [F.percentile(c, F.lit(q)).alias(n) for q, n in zip(LEVELS, names, strict=True)]


def paired_ratios(raw: DataFrame, clean: DataFrame, block: str, group: str, part: str, whole: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Per group: ratio of sums part / whole in raw and in clean with percentile intervals, mean and interval of clean - raw, share of draws above 0.

    Blocks of either table are drawn, and weigh alike in both; a draw without a ratio on one side has no difference."""
    side = lambda df, s: df.groupBy(F.col(block).alias("unit"), F.col(group).alias("grp")).agg(F.sum(part).cast("double").alias(f"m_{s}"), F.sum(whole).cast("double").alias(f"t_{s}"))
    sums = settled(side(raw, "raw").join(side(clean, "clean"), ["unit", "grp"], "full").filter("unit is not null"))
    w = weights(sums, "unit", draws, seed)
    ratio = lambda s, f=lambda c: F.sum(c): F.try_divide(f(F.col(f"m_{s}")), f(F.col(f"t_{s}")))
    times = lambda c: F.sum(c * F.col("mult"))
    drawn = w.join(sums, "unit").groupBy("grp", "draw").agg(ratio("raw", times).alias("raw"), ratio("clean", times).alias("clean")).withColumn("delta", F.col("clean") - F.col("raw"))
    ci = drawn.groupBy("grp").agg(*_interval("raw", "raw_low", "raw_high"), *_interval("clean", "clean_low", "clean_high"), F.avg("delta").alias("delta"), *_interval("delta", "delta_low", "delta_high"), F.try_divide(F.count_if(F.col("delta") > 0), F.count("delta")).alias("above_0"))
    point = sums.groupBy("grp").agg(ratio("raw").alias("raw"), ratio("clean").alias("clean"))
    return point.join(ci, "grp").withColumnRenamed("grp", group)


def pair_means(pairs: DataFrame, run: str, other: str, value: str, keys: list[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """(keys, draw, mean): mean over pairs of different runs when runs are drawn; a run drawn twice pairs with others twice, never with itself.

    Every combination of keys draws its own runs, so that their differences are independent. keys: at most a few values."""
    p = settled(pairs.select(*keys, F.col(run).alias("unit"), F.col(other).alias("other"), F.col(value).cast("double").alias("v")).filter("unit <> other and v is not null"))
    out = None
    for k, at in enumerate(p.select(*keys).distinct().orderBy(*keys).collect()):
        mine = p
        for c in keys:
            mine = mine.filter(F.col(c).eqNullSafe(F.lit(at[c])))
        w = settled(weights(mine.select("unit").union(mine.select("other")), "unit", draws, seed + k))
        far = w.select("draw", F.col("unit").alias("other"), F.col("mult").alias("far"))
        both = mine.join(w, "unit").join(far, ["draw", "other"])
        got = both.groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("v") * F.col("mult") * F.col("far")), F.sum(F.col("mult") * F.col("far"))).alias("mean"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else p.select(*keys, F.lit(0).alias("draw"), F.col("v").alias("mean")).limit(0)


def pair_interval(pairs: DataFrame, run: str, other: str, value: str, keys: list[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """Per keys: the mean over pairs and its percentile interval over drawn runs."""
    drawn = pair_means(pairs, run, other, value, keys, draws, seed).groupBy(*keys).agg(*_interval("mean", "low", "high"))
    point = pairs.filter(F.col(run) != F.col(other)).groupBy(*keys).agg(F.avg(value).alias("mean"))
    return point.join(drawn, keys)
