"""Orders over a whole table without gathering it: ranges of values, sums per range, offsets joined back.

A range holds the rows between two percentiles. What stands before a row is the sum over the ranges before, a table of
at most as many rows as ranges (for each key), and the sum within its own range, a window over that range alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rounds import settled

MOST_RANGES = 1 << 12


def range_of(df: DataFrame, value: str, ranges: int | None = None) -> Column:
    """The number of a value's range, from approximate percentiles of the column; nulls come first. Equal values share a range."""
    n = min(MOST_RANGES, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [k / n for k in range(1, n)]
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(value).cast("double"), at, 10 * n)).first()[0] or [])) if at else []
    if not cuts:
        return F.when(F.col(value).isNull(), -1).otherwise(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    v, bounds = F.col(value).cast("double"), F.array(*[F.lit(float(c)) for c in cuts])
    # How many cuts lie below the value, by halving steps.
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.try_element_at(bounds, p + s) < v), p + s).otherwise(p))
    return F.when(v.isNull(), -1).otherwise(below)


def _with_range(df: DataFrame, value: str, keys: Sequence[str], aggregates: dict[str, Column], rows, ranges: int | None) -> DataFrame:
    """df with its range and, from the ranges beside it in `rows` (two bounds), columns over their aggregates."""
    dealt = df.withColumn("__range", range_of(df, value, ranges))
    totals = dealt.groupBy(*keys, "__range").agg(*[c.alias(name) for name, (c, _) in aggregates.items()])
    w = Window.partitionBy(*keys).orderBy("__range")
    beside = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), *[over(F.col(name)).over(w.rowsBetween(*rows)).alias(name) for name, (_, over) in aggregates.items()], *[F.sum(name).over(Window.partitionBy(*keys)).alias(f"{name}__all") for name in aggregates])
    on = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return dealt.join(beside, on).drop("__r", *[f"__k{i}" for i in range(len(keys))])


def prefix_sums(df: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds before_<c> and all_<c> for each column summed: over rows of smaller value, and over all, of the same keys.

    Rows are one for each value and keys: what ties is counted before."""
    out = _with_range(df, value, keys, {f"__{c}": (F.sum(c), F.sum) for c in sums}, (Window.unboundedPreceding, -1), ranges)
    w = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = {f"before_{c}": zero(F.col(f"__{c}")) + zero(F.sum(c).over(w)) for c in sums}
    return out.withColumns(own | {f"all_{c}": F.col(f"__{c}__all") for c in sums}).drop("__range", *[f"__{c}" for c in sums], *[f"__{c}__all" for c in sums])


def least_from_here(df: DataFrame, value: str, of: str, keys: Sequence[str] = (), name: str = "least", ranges: int | None = None) -> DataFrame:
    """Adds the least of a column over the rows of this value or a larger one, of the same keys."""
    out = _with_range(df, value, keys, {"__m": (F.min(of), F.min)}, (1, Window.unboundedFollowing), ranges)
    own = F.min(of).over(Window.partitionBy(*keys, "__range").orderBy(value).rangeBetween(0, Window.unboundedFollowing))
    return out.withColumn(name, F.least(own, F.col("__m"))).drop("__range", "__m", "__m__all")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 0) -> DataFrame:
    """Adds gapless numbers in an order of any columns; a part of the order is a partition, written once so that both uses see the same.

    Rows equal in all columns of the order are numbered in any order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, inside.cast("long") - 1 + first).join(before, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def medians(df: DataFrame, value: str, keys: Sequence[str], name: str = "median", ranges: int | None = None) -> DataFrame:
    """(keys, median) of the non-null values, the mean of the middle two for an even number; no group is gathered."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__m"))
    p = prefix_sums(c, "__v", ["__m"], keys, ranges)
    at = lambda i: F.max(F.when((F.col("before___m") <= i) & (F.col("before___m") + F.col("__m") > i), F.col("__v")))
    low, high = F.floor((F.col("all___m") - 1) / 2), F.floor(F.col("all___m") / 2)
    return p.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))
