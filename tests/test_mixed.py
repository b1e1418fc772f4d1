"""Beta-binomial regression: special functions, derivatives, the integral against a dense sum, planted effects, odd tables."""

import math

import numpy as np
import pytest

from tessera.operators import mixed as mm

SCHEMA = "block string, k long, n long, dose double, extra string"


def drawn(blocks, each, seed, beta=(0.4, -0.9), precision=12.0, deviation=0.7):
    r, out = np.random.default_rng(seed), []
    for b in range(blocks):
        u = r.normal(0, deviation)
        for _ in range(each):
            x, n = float(r.integers(0, 2)), int(r.integers(1, 40))
            m = 1 / (1 + math.exp(-(beta[0] + beta[1] * x + u)))
            out.append((f"b{b}", int(r.binomial(n, r.beta(m * precision, (1 - m) * precision))), n, x, None))
    return out


def log_beta(a, b):
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def dense(rows, theta):
    """The log likelihood by a sum over 4001 places of u."""
    b0, b1, lp, ld = theta
    s, d = math.exp(lp), math.exp(ld)
    u = np.linspace(-9 * d, 9 * d, 4001)
    total, blocks = 0.0, {}
    for b, k, n, x, _ in rows:
        blocks.setdefault(b, []).append((k, n, x))
    for of in blocks.values():
        l = -0.5 * (u / d) ** 2 - ld - 0.5 * math.log(2 * math.pi)
        for k, n, x in of:
            m = 1 / (1 + np.exp(-(b0 + b1 * x + u)))
            l = l + np.array([log_beta(k + s * y, n - k + s * (1 - y)) - log_beta(s * y, s * (1 - y)) for y in m])
        total += l.max() + math.log(np.exp(l - l.max()).sum() * (u[1] - u[0]))
    return total


def test_log_gamma_and_derivatives():
    x = np.array([1e-3, 0.1, 0.5, 1, 2.5, 7.99, 8, 100, 1e6])
    v, d, dd = mm.log_gamma(x)
    assert np.allclose(v, [math.lgamma(y) for y in x], rtol=1e-11, atol=1e-11)
    assert d[3] == pytest.approx(-0.5772156649015329, abs=1e-11) and dd[3] == pytest.approx(math.pi**2 / 6, abs=1e-11)
    assert dd[2] == pytest.approx(math.pi**2 / 2, abs=1e-10)


def test_row_derivatives_are_those_of_differences():
    k, n = np.array([0.0, 3, 9, 5]), np.array([4.0, 3, 20, 11])
    eta, lp, h = np.array([-1.2, 0.3, 0.8, 2.0]), 1.3, 1e-5
    f = lambda e, r: mm.row_terms(k, n, eta + e, lp + r)
    _, e, r, ee, er, rr = f(0, 0)
    assert np.allclose(e, (f(h, 0)[0] - f(-h, 0)[0]) / (2 * h), atol=1e-6)
    assert np.allclose(r, (f(0, h)[0] - f(0, -h)[0]) / (2 * h), atol=1e-6)
    assert np.allclose(ee, (f(h, 0)[1] - f(-h, 0)[1]) / (2 * h), atol=1e-6)
    assert np.allclose(er, (f(0, h)[1] - f(0, -h)[1]) / (2 * h), atol=1e-6)
    assert np.allclose(rr, (f(0, h)[2] - f(0, -h)[2]) / (2 * h), atol=1e-6)


def test_fit_is_the_maximum_of_the_dense_likelihood(spark):
    rows = drawn(8, 12, 4)
    fit = mm.beta_binomial(spark.createDataFrame(rows, SCHEMA).repartition(5), "block", "k", "n", ["dose"])
    at = dense(rows, fit.estimate)
    assert fit.converged and fit.log_likelihood == pytest.approx(at, abs=2e-4)
    h, curve = 0.02, []
    for i in range(4):
        e = np.eye(4)[i] * h
        up, down = dense(rows, fit.estimate + e), dense(rows, fit.estimate - e)
        assert max(up, down) < at and abs(up - down) / (2 * h) < 0.02
        curve.append((up - 2 * at + down) / h**2)
    # The diagonal of the inverse covariance is the curvature.
    assert np.allclose(-np.diag(np.linalg.inv(fit.covariance)), curve, rtol=0.02)


def test_planted_effects_with_one_hot_block(spark):
    rows = drawn(60, 30, 5) + [("hot", *r[1:]) for r in drawn(1, 1500, 6)]
    fit = mm.beta_binomial(spark.createDataFrame(rows, SCHEMA).repartition(6), "block", "k", "n", ["dose"])
    want = np.array([0.4, -0.9, math.log(12), math.log(0.7)])
    se = np.sqrt(np.diag(fit.covariance))
    assert fit.converged and (np.abs(fit.estimate - want) < 3.5 * se).all() and (se < 0.3).all()
    got = {r.term: r for r in fit.table(spark).collect()}
    assert list(got) == ["(intercept)", "dose", "log_precision", "log_deviation"] and got["dose"].z < -5


def test_nulls_repeats_partitions_and_empty_tables(spark):
    rows = drawn(6, 10, 7)
    odd = [(None, 1, 2, 0.0, ""), ("b0", None, 2, 0.0, ""), ("b0", 0, 0, 0.0, ""), ("b1", 1, 3, None, "")]
    a = mm.beta_binomial(spark.createDataFrame(rows * 2, SCHEMA).repartition(1), "block", "k", "n", ["dose"])
    b = mm.beta_binomial(spark.createDataFrame(rows * 2 + odd, SCHEMA).repartition(7), "block", "k", "n", ["dose"])
    assert np.allclose(a.estimate, b.estimate, atol=1e-6)
    with pytest.raises(ValueError, match="no row"):
        mm.beta_binomial(spark.createDataFrame([], SCHEMA), "block", "k", "n", ["dose"])
