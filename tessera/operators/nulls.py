"""Set tests against a background matched on a covariate.

Background features stand in the order of their covariate. A bounded number of anchors lie evenly along that order, each
with a window of `width` background features around it; a feature belongs to the nearest anchor. A feature's value in a
cluster becomes its mid-rank among the window's values there. A set's statistic is the mean over its features; its null
replaces every feature by one drawn from that feature's own window, so that a set whose features share a window keeps
their common spread. Draws are by hash of set, feature and number: the same on any number of executors.

Rows: anchors times width (both parameters) for the windows, markers times draws for the nulls, times clusters where
values are taken; nothing is gathered but a window's `width` values of one cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered, prefix_sums
from tessera.operators.rounds import settled
from tessera.operators.stats import bh_adjust


def hash_below(n: Column | int, *parts: Column) -> Column:
    """A number from 0 below n for each combination of parts: 32 bits of an MD5, the same in any engine that has one."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long") % n


@dataclass
class Windows:
    """features: (feature, anchor, in_support); refs: (anchor, idx, ref), idx from 0 below width."""

    features: DataFrame
    refs: DataFrame
    width: int
    anchors: int


def windows(features: DataFrame, feature: str, x: str, background: str, width: int = 300, anchors: int = 200) -> Windows:
    """Windows of background features by the covariate x, ties by feature. background: a boolean column."""
    f = settled(features.select(F.col(feature).alias("feature"), F.col(x).cast("double").alias("x"), F.col(background).alias("bg")))
    order = settled(numbered(f.filter("bg").select("feature", "x"), ["x", "feature"], "at"))
    n, low, high = order.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        raise ValueError("no background features")
    half = min(width, n) // 2 or 1
    wide = min(2 * half, n)
    count = max(1, min(anchors, n - wide + 1))
    step = (n - wide) / (count - 1) if count > 1 else 0.0
    start = lambda a: F.floor(a * F.lit(step) + 0.5)
    places = f.groupBy("x").agg(F.count_if("bg").alias("n"))
    place = prefix_sums(places, "x", ["n"]).select(F.col("x").alias("__x"), (F.col("before_n") + F.col("n")).alias("rank"))
    near = F.least(F.lit(count - 1), F.greatest(F.lit(0), F.floor((F.col("rank") - half) / F.lit(step) + 0.5) if step else F.lit(0))).cast("int")
    own = f.join(place, F.col("x").eqNullSafe(F.col("__x"))).select("feature", near.alias("anchor"), F.coalesce(F.col("x").between(low, high), F.lit(False)).alias("in_support"))
    grid = f.sparkSession.range(count).select(F.col("id").cast("int").alias("anchor"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("idx"))
    refs = grid.withColumn("at", start(F.col("anchor")) + F.col("idx")).join(order, "at").select("anchor", "idx", F.col("feature").alias("ref"))
    return Windows(settled(own), settled(refs), wide, count)


def mid_ranks(w: Windows, values: DataFrame, feature: str, cluster: str, value: str) -> DataFrame:
    """(feature, cluster, u): the mid-rank of a feature's value among those of its window in the cluster, from 0 to 1."""
    v = values.select(F.col(feature).alias("feature"), F.col(cluster).alias("cluster"), F.col(value).cast("double").alias("v"))
    beside = w.refs.join(v.withColumnRenamed("feature", "ref"), "ref").groupBy("anchor", "cluster").agg(F.collect_list("v").alias("w"))
    count = lambda op: F.size(F.filter("w", lambda z: op(z)))
    u = (count(lambda z: z < F.col("v")) + count(lambda z: z <= F.col("v"))) / (2.0 * F.size("w"))
    return v.join(w.features, "feature").join(beside, ["anchor", "cluster"]).select("feature", "cluster", u.alias("u"))


def null_means(w: Windows, u: DataFrame, markers: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(type, cluster, draw, u): mean mid-rank of a set when each marker is replaced from its own window. markers: (feature, type)."""
    m = markers.select("feature", "type").distinct().join(w.features, "feature")
    picks = m.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("idx", hash_below(w.width, F.lit(seed), F.col("type"), F.col("feature"), F.col("draw")).cast("int"))
    ref_u = w.refs.join(u.withColumnRenamed("feature", "ref"), "ref").select("anchor", "idx", "cluster", "u")
    return picks.join(ref_u, ["anchor", "idx"]).groupBy("type", "cluster", "draw").agg(F.avg("u").alias("u"))


def set_test(w: Windows, u: DataFrame, markers: DataFrame, draws: int = 1000, seed: int = 0, min_support: float = 0.5, fdr: float = 0.05) -> DataFrame:
    """Per type and cluster: observed and null mean, sd and 95th percentile, effect_z, p = (1 + #{null >= observed}) / (1 + draws), q over all and per cluster, verdict.

    A set with less than `min_support` of its markers inside the background's range keeps its figures and is never significant."""
    m = markers.select("feature", "type").distinct().join(w.features, "feature")
    support = m.groupBy("type").agg(F.count("*").alias("n_markers"), F.avg(F.col("in_support").cast("double")).alias("frac_in_support"))
    seen = settled(m.join(u, "feature").groupBy("type", "cluster").agg(F.avg("u").alias("obs")))
    null = settled(null_means(w, u, markers, draws, seed))
    near = 1e-12  # sums of the same ranks in another order
    t = null.join(seen, ["type", "cluster"]).groupBy("type", "cluster").agg(F.first("obs").alias("obs"), F.avg("u").alias("null_mean"), F.stddev_samp("u").alias("null_sd"), F.percentile("u", F.lit(0.95)).alias("null_q95"), F.count_if(F.col("u") >= F.col("obs") - near).alias("above"))
    t = t.withColumns({"effect_z": (F.col("obs") - F.col("null_mean")) / F.greatest(F.col("null_sd"), F.lit(1e-9)), "p": (1 + F.col("above")) / (1.0 + draws)}).drop("above")
    t = settled(t.join(support, "type"))
    q = bh_adjust(bh_adjust(t, "p"), "p", ["cluster"], "q_cluster")
    ok = F.col("frac_in_support") >= min_support
    return q.withColumns({"testable": ok, "significant": ok & (F.col("q") < fdr), "significant_cluster": ok & (F.col("q_cluster") < fdr)})
