"""Bootstraps against the same weights applied in memory; exact totals, shared weights, coverage of a known ratio."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bootstrap as bs

SCHEMA = "block string, g string, m double, t double"


def rows(blocks, seed, p):
    r = random.Random(seed)
    return [(f"b{k}", g, float(sum(r.random() < p for _ in range(n))), float(n)) for k in range(blocks) for g in "xy" for n in [r.randint(1, 30)]]


def test_weights_are_whole_draws_in_any_partitioning(spark):
    units = spark.createDataFrame([(f"u{k}",) for k in range(37)] * 2 + [(None,)], "u string")
    a, b = (sorted(map(tuple, bs.weights(units.repartition(n), "u", 50, 4).collect())) for n in (1, 6))
    assert a == b
    totals = {}
    for d, _, n in a:
        totals[d] = totals.get(d, 0) + n
    assert totals == dict.fromkeys(range(50), 37)
    assert 0.2 < 1 - len(a) / (50 * 37) < 0.5


def test_paired_ratios_use_one_set_of_weights(spark):
    raw, clean = rows(25, 1, 0.3), rows(22, 2, 0.5) + [("only", "x", 3.0, 4.0), (None, "x", 1.0, 1.0)]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (raw, clean))
    got = {r.g: r for r in bs.paired_ratios(a, b, "block", "g", "m", "t", 200, 9).collect()}
    w = {}
    for d, u, n in bs.weights(a.select("block").union(b.select("block")), "block", 200, 9).collect():
        w.setdefault(d, {})[u] = n
    for g in "xy":
        ratio = lambda x, d: sum(m * w[d].get(k, 0) for k, h, m, _ in x if h == g) / sum(t * w[d].get(k, 0) for k, h, _, t in x if h == g)
        r, c = (np.array([ratio(x, d) for d in range(200)]) for x in (raw, clean))
        want = [np.quantile(r, 0.025), np.quantile(r, 0.975), np.quantile(c, 0.025), np.quantile(c, 0.975), (c - r).mean(), np.quantile(c - r, 0.025), np.quantile(c - r, 0.975), np.mean(c > r)]
        assert list(got[g])[3:] == pytest.approx(want)
        assert got[g].raw == pytest.approx(sum(x[2] for x in raw if x[1] == g) / sum(x[3] for x in raw if x[1] == g))
    same = bs.paired_ratios(a, a, "block", "g", "m", "t", 50).collect()
    assert all((r.delta, r.delta_low, r.delta_high) == (0, 0, 0) for r in same)


def test_intervals_cover_a_known_ratio(spark):
    hit = 0
    trials = spark.createDataFrame([(b, str(k), m, t) for k in range(40) for b, g, m, t in rows(30, 100 + k, 0.4) if g == "x"], SCHEMA)
    for r in bs.paired_ratios(trials, trials, "block", "g", "m", "t", 300).collect():
        hit += r.raw_low <= 0.4 <= r.raw_high
    assert hit >= 33


def test_pair_means_drop_a_run_with_itself(spark):
    r = random.Random(6)
    pairs = [(a, b, s, r.random() + (s == "late")) for s in ("early", "late") for a in range(12) for b in range(a + 1, 12)] + [(3, 3, "early", 50.0)]
    df = spark.createDataFrame(pairs, "a int, b int, stage string, v double")
    got = {(x.stage, x.draw): x["mean"] for x in bs.pair_means(df, "a", "b", "v", ["stage"], 60, 2).collect()}
    for k, s in enumerate(("early", "late")):
        for d in (0, 7, 59):
            w = {u: n for x, u, n in bs.weights(spark.range(12).select(F.col("id").cast("int").alias("u")), "u", 60, 2 + k).collect() if x == d}
            den = sum(w.get(a, 0) * w.get(b, 0) for a, b, g, _ in pairs if g == s and a != b)
            assert got[s, d] == pytest.approx(sum(v * w.get(a, 0) * w.get(b, 0) for a, b, g, v in pairs if g == s and a != b) / den)
    ci = {x.stage: x for x in bs.pair_interval(df, "a", "b", "v", ["stage"], 200, 2).collect()}
    assert ci["early"].low < ci["early"]["mean"] < ci["early"].high < ci["late"].low
