"""Prefix sums by ranges against sorting in memory; no plan gathers a table in one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, stats

SCHEMA = "k string, v double, n long"


def values(seed=1):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.choice([None, -0.0, 1e300, float(r.randrange(40)), r.gauss(0, 1)]), r.randrange(1, 5)) for _ in range(500)]


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_prefix_sums_and_least(spark, ranges, keys):
    df = spark.createDataFrame(values(), SCHEMA).groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    low = lambda v: float("-inf") if v is None else v
    rows = df.collect()
    group = lambda r: r["k"] if keys else 0
    for r in ordered.prefix_sums(df, "v", ["n"], keys, ranges).collect():
        mates = [x for x in rows if group(x) == group(r)]
        assert (r.before_n, r.all_n) == (sum(x.n for x in mates if low(x.v) < low(r.v)), sum(x.n for x in mates))
    for r in ordered.least_from_here(df.filter("v is not null"), "v", "n", keys, "m", ranges).collect():
        assert r.m == min(x.n for x in rows if group(x) == group(r) and x.v is not None and x.v >= r.v)


def test_numbers_have_no_gaps(spark):
    rows = values(4)
    df = spark.createDataFrame([(k, v, i) for i, (k, v, _) in enumerate(rows)], SCHEMA).repartition(7)
    got = ordered.numbered(df, [F.desc("v"), F.col("n")], "pos", 1).collect()
    want = sorted(((k, v, i) for i, (k, v, _) in enumerate(rows)), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
    assert [(r.n, r.pos) for r in sorted(got, key=lambda r: r.pos)] == [(x[2], p) for p, x in enumerate(want, 1)]


def test_global_orders_do_not_gather(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(2000).selectExpr("id % 7 as g", "cast(id % 333 as double) as v", "id % 2 as c")
        plans = [stats.average_rank(df, "v"), stats.ks_distance(df, "c", "v", "0", "1"), stats.bh_adjust(df, "v"), stats.signed_rank(df, "v"), stats.auc(df, "c", "v"), stats.spearman(df, "v", "g")]
        for p in plans:
            plan = p._jdf.queryExecution().executedPlan().toString()
            # What meets in one task are sums: of a range, or of the whole.
            for gathered in re.findall(r"Exchange SinglePartition[^\n]*\n[^\n]*", plan):
                assert "partial" in gathered or "Project" in gathered or "Aggregate" in gathered
            assert "rangepartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
