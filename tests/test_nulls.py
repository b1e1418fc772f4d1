"""The background set test: windows by hand, p against enumeration of a window, a planted set, a set out of support."""

import itertools
import random

import numpy as np
import pytest

from tessera.operators import nulls as nl


def table(spark, n=120, seed=3):
    r = random.Random(seed)
    f = [(i, float(i), i % 3 != 0) for i in range(n)] + [(n + k, 1e6 + k, False) for k in range(3)]
    # Values follow the covariate; a planted set stands above its neighbours in one cluster alone.
    v = [(i, c, x / 50 + r.gauss(0, 1) + (4 if c == "a" and i in (30, 33, 36, 39) else 0)) for (i, x, _), c in itertools.product(f, "ab")]
    return spark.createDataFrame(f, "g long, x double, bg boolean"), spark.createDataFrame(v, "g long, c string, v double"), f, {(i, c): x for i, c, x in v}


def test_windows_are_nearest_and_hold_their_width(spark):
    features, values, f, v = table(spark)
    w = nl.windows(features, "g", "x", "bg", 20, 9)
    back = [i for i, _, bg in f if bg]
    refs = {}
    for a, i, ref in w.refs.collect():
        refs.setdefault(a, {})[i] = ref
    assert len(refs) == 9 and all(sorted(x) == list(range(20)) for x in refs.values())
    starts = {a: back.index(x[0]) for a, x in refs.items()}
    assert all([x[i] for i in range(20)] == back[starts[a] : starts[a] + 20] for a, x in refs.items())
    for i, a, inside in w.features.collect():
        place = sum(b <= i for b in back)
        assert abs(place - starts[a] - 10) <= min(abs(place - s - 10) for s in starts.values()) + 1
        assert inside == (back[0] <= f[i][1] <= back[-1] if i < 120 else False)
    own = {r.feature: r.anchor for r in w.features.collect()}
    for i, c, u in nl.mid_ranks(w, values, "g", "c", "v").collect():
        mine = [v[x, c] for x in refs[own[i]].values()]
        assert u == pytest.approx((sum(x < v[i, c] for x in mine) + sum(x <= v[i, c] for x in mine)) / 40)


def test_nulls_against_enumeration_and_a_planted_set(spark):
    features, values, f, v = table(spark)
    w = nl.windows(features, "g", "x", "bg", 24, 8)
    u = nl.mid_ranks(w, values, "g", "c", "v").cache()
    sets = [(30, "planted"), (33, "planted"), (36, "planted"), (39, "planted"), (60, "one"), (60, "one"), (9, "two"), (90, "two"), (120, "far"), (121, "far")]
    markers = spark.createDataFrame(sets, "feature long, type string")
    got = {(r.type, r.cluster): r for r in nl.set_test(w, u, markers, 2000).collect()}
    at = {(r.feature, r.cluster): r.u for r in u.collect()}
    refs = {}
    for a, _, ref in w.refs.collect():
        refs.setdefault(a, []).append(ref)
    own = {r.feature: r.anchor for r in w.features.collect()}
    for kind, members in (("one", [60]), ("two", [9, 90])):
        for c in "ab":
            every = [np.mean([at[x, c] for x in pick]) for pick in itertools.product(*[refs[own[m]] for m in members])]
            obs, r = np.mean([at[m, c] for m in members]), got[kind, c]
            assert r.obs == pytest.approx(obs)
            assert r.null_mean == pytest.approx(np.mean(every), abs=0.02) and r.null_sd == pytest.approx(np.std(every), abs=0.02)
            assert r.p == pytest.approx(np.mean([x >= obs - 1e-12 for x in every]), abs=0.04)
    assert got["planted", "a"].significant and not got["planted", "b"].significant and got["planted", "a"].n_markers == 4
    assert not got["far", "a"].testable and not got["far", "a"].significant and got["far", "a"].frac_in_support == 0


def test_no_background_is_an_error(spark):
    features, *_ = table(spark)
    with pytest.raises(ValueError, match="background"):
        nl.windows(features.selectExpr("g", "x", "false as bg"), "g", "x", "bg")
