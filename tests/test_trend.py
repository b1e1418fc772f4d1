"""Local regression against direct weighted fits at every point."""

import numpy as np
import pytest

from tessera.operators import trend


def direct(x, y, span, degree):
    out = np.empty(len(x))
    q = max(degree + 1, int(np.floor(span * len(x) + 1e-5)))
    for i, at in enumerate(x):
        d = np.abs(x - at)
        h = np.sort(d)[min(q, len(x)) - 1] * (1 + 1e-9)
        w = np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
        root = np.sqrt(w)[:, None]
        out[i] = np.linalg.lstsq(np.vander(x - at, degree + 1, increasing=True) * root, y * root[:, 0], rcond=None)[0][0]
    return out


@pytest.mark.parametrize(("span", "degree"), [(0.75, 2), (0.3, 2), (0.5, 1)])
def test_within_a_thousandth_of_a_direct_fit(spark, span, degree):
    r = np.random.default_rng(7)
    x = r.exponential(2, 1000) + 3
    y = np.sin(x) + 0.3 * x + r.normal(0, 0.2, 1000)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(1000, None, 1.0), (1001, 2.0, None)], "i long, x double, y double").repartition(3)
    got = {v.i: v for v in trend.loess(df, "x", "y", span, degree).collect()}
    want = direct(x, y, span, degree)
    off = np.abs(np.array([got[i].fitted for i in range(1000)]) - want)
    dense = x < np.quantile(x, 0.99)
    assert off[dense].max() < 1e-3 * np.ptp(y) and off.max() < 1e-2 * np.ptp(y)
    assert got[3].residual == pytest.approx(y[3] - got[3].fitted)
    assert got[1000].fitted is None and got[1000].residual is None and got[1001].residual is None


def test_few_bins_and_flat_columns(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 1000 as double) / 100 as x", "pow(cast(id % 1000 as double) / 100, 2) as y", "1.5D as c")
    assert max(abs(r.residual) for r in trend.loess(df, "x", "y", 0.5, 2, bins=64).collect()) < 0.05
    assert {round(r.fitted, 6) for r in trend.loess(df, "c", "x").collect()} == {4.995}
    assert trend.loess(df.limit(0), "x", "y").collect() == []
