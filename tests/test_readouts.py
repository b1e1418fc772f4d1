"""Operators that SQL does not cover: exact tests, agreement, checks that fail, guards."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyed, readouts


def test_fisher_sums_equal_or_less_likely_tables(spark):
    def brute(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        chance = lambda k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)
        return sum(p for p in map(chance, range(max(0, row + col - n), min(row, col) + 1)) if p <= chance(a) * (1 + 1e-7))

    tables = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (1, 0, 0, 1), (8, 2, 1, 5), (30, 12, 4, 60)]
    got = readouts.fisher_exact(spark.createDataFrame(tables, "a int, b int, c int, d int"), "a", "b", "c", "d").collect()
    for r in got:
        assert math.isclose(r.p, brute(r.a, r.b, r.c, r.d), rel_tol=1e-9)
        assert r.odds_ratio is None if r.b * r.c == 0 else math.isclose(r.odds_ratio, r.a * r.d / (r.b * r.c))


def test_expected_mutual_information_is_the_mean_over_all_labellings():
    a, b = [0, 0, 0, 1, 1], [0, 0, 1, 1, 2]

    def mi(x, y):
        n = len(x)
        return sum(k / n * math.log(k * n / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (k := sum(p == i and q == j for p, q in zip(x, y, strict=True))))

    every = [mi(a, list(p)) for p in itertools.permutations(b)]
    assert math.isclose(readouts.expected_mutual_information([3, 2], [2, 2, 1]), sum(every) / len(every), rel_tol=1e-12)


def test_adjusted_mutual_information(spark):
    rows = [(i % 3, (i % 3) * 10, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "p int, q int, r int")
    assert math.isclose(readouts.adjusted_mutual_information(df, "p", "q"), 1.0, abs_tol=1e-9)
    assert abs(readouts.adjusted_mutual_information(df, "p", "r")) < 0.05


def test_permutation_p(spark):
    seen = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 0.0)], "k string, v double")
    null = spark.createDataFrame([("a", float(x)) for x in range(9)] + [("b", 3.0)] * 4, "k string, v double")
    got = {r.k: r for r in readouts.permutation_p(seen, null, "k", "v").collect()}
    assert got["a"].p == 5 / 10 and got["b"].p == 1.0 and got["b"].z is None and got["c"].p == 1.0 and got["c"].q95 is None
    assert math.isclose(got["a"].q95, 7.6)


def test_checked_join_fails_on_a_repeated_key(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    good = keyed.checked_join(a, spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string"), ["k"])
    assert sorted((r.k, r.v) for r in good.collect() if r.v) == [(1, "x")] and good.count() == 3
    with pytest.raises(Exception, match="twice"):
        keyed.checked_join(a, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"]).collect()


def test_guards(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    assert sorted((r.k, r.v, r.scaled) for r in keyed.scaled(df, "v", ["k"]).filter("v is not null").collect()) == [("a", 1.0, 0.0), ("a", 1.0, 0.0), ("b", 2.0, 0.0), ("b", 4.0, 1.0)]
    assert [r.contrast for r in keyed.on_off_contrast(df, ["k"], F.col("k") == "a", "v").collect()] == [None, None]
    assert readouts.guarded_corr(df.withColumn("w", F.lit(1.0)), ["k"], "v", "w").select("r").distinct().collect() == [(None,)]
    anchors = spark.createDataFrame([("a", 0.0, 1), ("a", 10.0, 2)], "k string, at double, n int")
    points = spark.createDataFrame([("a", 5.0), ("a", -3.0), ("a", 10.0), ("z", 1.0)], "k string, at double")
    assert sorted((r.k, r.at, r.n, r.distance) for r in keyed.nearest_anchor(points, anchors, "k", "at", "n").collect() if r.n) == [("a", -3.0, 1, 3.0), ("a", 5.0, 1, 5.0), ("a", 10.0, 2, 0.0)]


def test_p_values(spark):
    from tessera.operators import stats

    z = spark.createDataFrame([(0.0,), (1.959964,), (-1.959964,), (None,)], "z double")
    got = [r.p for r in z.select(stats.normal_p(F.col("z")).alias("p")).collect()]
    assert got[0] == 1.0 and math.isclose(got[1], 0.05, abs_tol=1e-6) and got[1] == got[2] and got[3] is None
    one = spark.range(1).select(stats.ks_p(F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("a"), stats.ks_p(F.lit(1.0), F.lit(50.0), F.lit(50.0)).alias("b")).first()
    assert one.a == 1.0 and one.b < 1e-12


def test_guards_that_fail(spark):
    from tessera.operators import blocks

    df = spark.createDataFrame([("a", "x_B73"), ("b", "y_Mo17")], "k string, name string")
    listed = spark.createDataFrame([("a",), ("zz",)], "k string")
    assert [r.k for r in blocks.whitelisted(df, listed.filter("k = 'a'"), "k").collect()] == ["a"]
    with pytest.raises(Exception, match="missing"):
        blocks.whitelisted(df, listed, "k").collect()
    label = F.element_at(F.split("name", "_"), -1)
    assert [r.g for r in blocks.registered(df, {"B73": "1", "Mo17": "2"}, label, "g").collect()] == ["1", "2"]
    with pytest.raises(Exception, match="not registered: Mo17"):
        blocks.registered(df, {"B73": "1"}, label, "g").collect()
    stated = df.withColumn("plate", label)
    assert blocks.agreeing(stated, label, "plate", ["B73", "Mo17"]).count() == 2
    with pytest.raises(Exception, match="disagrees"):
        blocks.agreeing(stated, label, "plate", ["B73"]).collect()
