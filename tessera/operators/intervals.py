"""Intervals: merging, overlap and containment joins over bins, cut sites and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of intervals per key, book-ended ones joined: a gap begins where a start passes every end before."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("__island")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, a_iv: tuple[str, str] = ("start", "end"), b_iv: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Pairs of closed intervals that touch. Both sides fall into bins of `width`; a pair is emitted in the bin where the later start lies, so none twice."""
    x = a.withColumn("__bin", _bins(F.col(a_iv[0]), F.col(a_iv[1]), width))
    y = b.withColumn("__bin", _bins(F.col(b_iv[0]), F.col(b_iv[1]), width))
    met = x.join(y, [*keys, "__bin"])
    touch = (F.col(a_iv[0]) <= F.col(b_iv[1])) & (F.col(b_iv[0]) <= F.col(a_iv[1]))
    return met.filter(touch & (F.floor(F.greatest(F.col(a_iv[0]), F.col(b_iv[0])) / width) == F.col("__bin"))).drop("__bin")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str, width: int, iv: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Points with each half-open interval [start, end) that holds them; a point meets one bin."""
    x = points.withColumn("__bin", F.floor(F.col(pos) / width))
    y = intervals.withColumn("__bin", _bins(F.col(iv[0]), F.col(iv[1]) - 1, width))
    return x.join(y, [*keys, "__bin"]).filter((F.col(pos) >= F.col(iv[0])) & (F.col(pos) < F.col(iv[1]))).drop("__bin")


def exists_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, a_iv: tuple[str, str] = ("start", "end"), b_iv: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Distinct rows of a that touch an interval of b."""
    return overlap_join(a, b, keys, width, a_iv, b_iv).select(*a.columns).distinct()


def disjoint_violations(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose follower begins before they end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("__next", F.lead(start).over(w)).filter(F.col("__next") < F.col(end)).drop("__next")


def extend(df: DataFrame, by: int, strand: str = "strand", start: str = "start", end: str = "end") -> DataFrame:
    """Widen upstream of the strand; starts stay at 1 or more."""
    return df.withColumns({start: F.greatest(F.lit(1), F.when(F.col(strand) == "-", F.col(start)).otherwise(F.col(start) - by)), end: F.when(F.col(strand) == "-", F.col(end) + by).otherwise(F.col(end))})


def insertion_sites(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A fragment's two cut sites with their strands."""
    ends = F.array(F.struct(F.col(start).alias("pos"), F.lit("+").alias("strand")), F.struct((F.col(end) - 1).alias("pos"), F.lit("-").alias("strand")))
    return df.withColumn("__site", F.explode(ends)).select(*[c for c in df.columns if c not in ("pos", "strand")], "__site.pos", "__site.strand")


def coverage(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Depth segments of half-open intervals, from running sums of their ends."""
    steps = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("s")).select(*keys, "s.pos", "s.d").groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("pos")
    return steps.withColumn("depth", F.sum("d").over(w)).withColumn("until", F.lead("pos").over(w)).filter("until is not null and depth > 0").select(*keys, F.col("pos").alias("start"), F.col("until").alias("end"), "depth")
