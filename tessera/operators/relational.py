"""Keyed joins, fills, pivots, rankings and confusion summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered


def full_outer_fill(a: DataFrame, b: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Full outer join on keys; absent counts become 0."""
    return a.join(b, list(keys), "full").na.fill(0, list(fill))


def complete_grid(df: DataFrame, dims: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Every combination of the values of the dimensions, 0 where the table has none; dimensions are small by nature."""
    grid = reduce(lambda x, y: x.crossJoin(y), [df.select(d).distinct() for d in dims])
    return grid.join(df, list(dims), "left").na.fill(0, list(fill))


def top_n(df: DataFrame, by: Sequence[Column], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """First n rows by an order, of the table or of each key. A table's top n needs no shuffle of its rows."""
    if not keys:
        return df.orderBy(*by).limit(n)
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("__rn") <= n).drop("__rn")


def top_two(df: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """Best and second value per key with their items; 0 for an absent second. The rank limit drops rows before the exchange."""
    two = top_n(df.select(key, item, value), [F.desc(value), F.col(item)], 2, [key]).withColumn("__first", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), F.col(item))) == 1)
    at = lambda c, first: F.max(F.when(F.col("__first") == first, F.col(c)))
    return two.groupBy(key).agg(at(item, True).alias("top1"), at(value, True).alias("n1"), at(item, False).alias("top2"), F.coalesce(at(value, False), F.lit(0)).alias("n2"))


def share_of_total(df: DataFrame, value: str, keys: Sequence[str], name: str = "share") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))


def pivot_fill(df: DataFrame, key: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(key).pivot(column, list(values)).agg(F.sum(value)).na.fill(0)


def retained_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Set accounting of two id tables: shared, dropped, gained and the share kept."""
    flags = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    out = flags.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"), F.count_if(F.col("in_b").isNull()).alias("dropped"), F.count_if(F.col("in_a").isNull()).alias("gained"))
    return out.withColumn("kept_pct", F.try_divide(100.0 * F.col("shared"), F.col("shared") + F.col("dropped")))


def present_in_all(df: DataFrame, key: str, stage: str, n: int) -> DataFrame:
    """Keys seen in n different stages: an n-way intersection in one pass."""
    return df.groupBy(key).agg(F.count_distinct(stage).alias("stages")).filter(F.col("stages") == n).select(key)


def confusion_rates(df: DataFrame, truth: Column, called: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of a binary call; a rate with denominator 0 is NULL."""
    c = lambda x: F.count_if(x)
    out = df.groupBy(*keys).agg(c(truth & called).alias("tp"), c(~truth & called).alias("fp"), c(truth & ~called).alias("fn"), c(~truth & ~called).alias("tn"))
    sens, prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return out.withColumns({"sensitivity": sens, "precision": prec, "f1": F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def majority(df: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent label per key, the smaller label on ties, with its share."""
    n = df.groupBy(key, label).count()
    return n.groupBy(key).agg(F.min_by(label, F.struct(-F.col("count"), F.col(label))).alias("majority"), F.max("count").alias("n"), F.sum("count").alias("total")).withColumn("purity", F.col("n") / F.col("total"))


def union_fill(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def config_deviations(configs: DataFrame, name: str, baseline: str, columns: Sequence[str]) -> DataFrame:
    """(name, parameter, value, baseline) where a variant differs from the baseline row."""
    long = configs.select(name, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([name], list(columns), "parameter", "value")
    base = long.filter(F.col(name) == baseline).select("parameter", F.col("value").alias("baseline"))
    return long.join(F.broadcast(base), "parameter").filter(~F.col("value").eqNullSafe(F.col("baseline"))).select(name, "parameter", "value", "baseline")


def rank_depth_cut(df: DataFrame, depth: str, threshold: float, order: str) -> DataFrame:
    """Rows up to the last one, by falling depth, whose depth passes the threshold: those that pass it."""
    return numbered(df.filter(F.col(depth) >= threshold), [F.desc(depth), F.col(order)], "rank", 1)


def label_rules(df: DataFrame, label: str, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """First rule whose keyword the label contains, in lower case."""
    out = F.lit(otherwise)
    for word, value in reversed(list(rules)):
        out = F.when(F.contains(F.lower(df[label]), F.lit(word)), value).otherwise(out)
    return out


def run_lengths(df: DataFrame, key: str, label: str, order: Sequence[str]) -> DataFrame:
    """Per key the number of runs of equal neighbouring labels in an order, and the longest."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("__new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(w)).groupBy(key, "__run").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.count("*").alias("runs"), F.max("n").alias("longest"))
