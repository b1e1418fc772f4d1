"""Results that must not hang on how rows are dealt or ordered."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.strings import uniform_hash
from tessera.operators import draws as d
from tessera.operators import keyed as k
from tessera.plans.base import QUERIES
from tessera.plans import readouts  # noqa: F401


def test_averages_are_summed_in_the_order_of_the_key(spark, tmp_path):
    """As doubles, 0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1."""
    rows = [(1, line, 7, flag, x) for flag, xs, base in (("A", (0.1, 0.2, 0.3), 0), ("N", (0.3, 0.2, 0.1), 10)) for line, x in enumerate(xs, base)]
    got = []
    for name, order in (("up", rows), ("down", rows[::-1]), ("mixed", rows[::2] + rows[1::2])):
        spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_discount double").coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        got.append(sorted(map(tuple, QUERIES["extrema_over_stages"](spark, str(tmp_path / name)).collect())))
    assert got == [[(7, "A", 1.0, False), (7, "N", 0.0, False)]] * 3


def test_nearest_anchor_looks_back_only_and_takes_the_least_name(spark):
    points = spark.createDataFrame([(1, "a", 5.0), (2, "a", 1.0), (3, "b", 2.0), (4, "c", 2.0), (5, "a", 9.0)], "id int, k string, at double")
    anchors = spark.createDataFrame([("a", 4.0, 9), ("a", 6.0, 1), ("a", 4.0, 3), ("a", 6.0, 2), ("b", 2.0, 8), ("b", 2.0, 7)], "k string, at double, name int")
    for dealt in (anchors, anchors.orderBy(F.desc("name"))):
        out = k.nearest_anchor(points, dealt, "k", "at", "name")
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert {r.id: (r.name, r.distance) for r in out.collect()} == {1: (3, 1.0), 2: (3, 3.0), 3: (7, 0.0), 4: (None, None), 5: (1, 3.0)}


def test_local_rank_among_background_rows_at_one_place(spark):
    rows = spark.createDataFrame([(1, "a", 2.0, 5.0)], "id int, k string, c double, v double")
    bg = [("a", 2.0, float(v)) for v in (9, 1, 8, 2, 7)]
    for dealt in (bg, bg[::-1]):
        got = k.local_rank(rows, spark.createDataFrame(dealt, "k string, c double, v double").coalesce(1), "k", "c", "v", 2).first()
        assert (got.local_rank, got.n_background) == (1.0, 2)


@pytest.mark.parametrize("size", [3, 40])
def test_repeated_draws_rank_few_rows(spark, size):
    df = spark.range(20000).select("id", F.when(F.col("id") < 19990, F.col("id") % 2).alias("g"))
    out = d.repeated_draws(df, ["g"], "id", size, 2)
    ids = [(i, None if i >= 19990 else i % 2) for i in range(20000)]
    hashes = {(r.id, r.draw): r.h for r in df.withColumn("draw", F.explode(F.array(F.lit(1), F.lit(2)))).select("id", "draw", uniform_hash(F.col("id") * 1009 + F.col("draw")).alias("h")).collect()}
    want = {(i, g, n) for n in (1, 2) for g in (0, 1, None) for _, i in sorted((hashes[i, n], i) for i, q in ids if q == g)[:size] for g in [g]}
    assert {(r.id, r.g, r.draw) for r in out.collect()} == want
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [d.FEW, 1])
def test_rows_of_repeated_draws_are_not_broadcast(spark, tmp_path, monkeypatch, few):
    """Their size is guessed without the draws, so the driver would take them all."""
    monkeypatch.setattr(d, "FEW", few)
    spark.range(5000).select("id", (F.col("id") % 3).alias("g")).write.parquet(str(tmp_path / "t"))
    out = d.repeated_draws(spark.read.parquet(str(tmp_path / "t")), ["g"], "id", 10, 12)
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            under = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))
            assert not any("Generate" in x for x in plan[i:under])
    assert out.groupBy("g", "draw").count().filter("count = 10").count() == 36
