"""Beta-binomial regression with a random block: logit of the mean is x beta + u of the block, u normal.

The likelihood of a block is an integral over its u, taken by Gauss-Hermite quadrature around the block's own mode. Every
round is one pass over the rows: each batch sums its rows' log likelihoods and their first and second derivatives per
block and node in numpy, Spark adds these over batches (a block may be spread over all tasks), a second step turns a
block's sums into its likelihood, gradient and Hessian, and one row of their totals goes to the driver, which takes a
Newton step. Rows are aggregated over equal (x, k, n) within a block beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rounds import added, settled

NODES = 9
#: log precision and log deviation of u stay inside these; data without spread drive them outwards for ever.
LOG_PRECISION, LOG_DEVIATION = (-5.0, 12.0), (-6.0, 4.0)
#: Newton steps for the modes alone, before the first joint one.
FIRST_MODES = 4
# Coefficients of the Stirling series, fixed values.
SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log gamma of positive x with its first and second derivatives; arguments below 8 are raised by recurrence."""
    x = np.array(x, np.float64)
    value, first, second = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    while (low := x < 8).any():
        y = x[low]
        value[low] -= np.log(y)
        first[low] -= 1 / y
        second[low] += 1 / y**2
        x[low] = y + 1
    log = np.log(x)
    value += (x - 0.5) * log - x + 0.5 * np.log(2 * np.pi)
    first += log - 0.5 / x
    second += 1 / x + 0.5 / x**2
    for j, c in enumerate(SERIES):
        p = 2 * j + 1
        value += c / x**p
        first -= p * c / x ** (p + 1)
        second += p * (p + 1) * c / x ** (p + 2)
    return value, first, second


def row_terms(k: np.ndarray, n: np.ndarray, eta: np.ndarray, log_precision: float) -> tuple[np.ndarray, ...]:
    """Log likelihood (without the binomial coefficient) and its derivatives by eta and log precision: l, e, r, ee, er, rr."""
    s = np.exp(log_precision)
    m = np.clip(1 / (1 + np.exp(-eta)), 1e-9, 1 - 1e-9)
    a, b = m * s, (1 - m) * s
    (ka, ka1, ka2), (a0, a1, a2) = log_gamma(k + a), log_gamma(a)
    (kb, kb1, kb2), (b0, b1, b2) = log_gamma(n - k + b), log_gamma(b)
    (ns, ns1, ns2), (s0, s1, s2) = log_gamma(n + s), log_gamma(np.full_like(n, s))
    fa, fb, faa, fbb = ka1 - a1, kb1 - b1, ka2 - a2, kb2 - b2
    w = m * (1 - m)
    by_m, by_mm = s * (fa - fb), s * s * (faa + fbb)
    by_s = m * fa + (1 - m) * fb + s1 - ns1
    by_ss = m * m * faa + (1 - m) ** 2 * fbb + s2 - ns2
    by_ms = fa - fb + s * (m * faa - (1 - m) * fbb)
    return ka - a0 + kb - b0 + s0 - ns, by_m * w, by_s * s, by_mm * w * w + by_m * w * (1 - 2 * m), by_ms * w * s, by_ss * s * s + by_s * s


def dummies(df: DataFrame, factors: dict[str, list[str]], crossed: list[tuple[str, str]] = ()) -> tuple[DataFrame, list[str]]:
    """Adds 0/1 columns for every level of a factor but its first, and their products for crossed factors; with their names.

    factors: column to its levels in order; a value outside them is null, so that a fit leaves its row out."""
    own: dict[str, list[str]] = {}
    for f, levels in factors.items():
        own[f] = [f"{f}={v}" for v in levels[1:]]
        df = df.withColumns({n: F.when(F.col(f).isin(levels), (F.col(f) == v).cast("double")) for n, v in zip(own[f], levels[1:], strict=True)})
    names = [n for f in factors for n in own[f]]
    for a, b in crossed:
        both = {f"{x}*{y}": F.col(f"`{x}`") * F.col(f"`{y}`") for x in own[a] for y in own[b]}
        df, names = df.withColumns(both), [*names, *both]
    return df, names


@dataclass
class Fit:
    """Coefficients in the order of `terms`, then log precision and log deviation of the blocks; `covariance` of all of them."""

    terms: list[str]
    estimate: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    rounds: int
    converged: bool

    def table(self, spark) -> DataFrame:
        se = np.sqrt(np.clip(np.diag(self.covariance), 0, None))
        names = [*self.terms, "log_precision", "log_deviation"]
        z = [e / s if s > 0 else None for e, s in zip(self.estimate, se, strict=True)]
        return spark.createDataFrame([(n, float(e), float(s), None if v is None else float(v)) for n, e, s, v in zip(names, self.estimate, se, z, strict=True)], "term string, estimate double, std_error double, z double")


def _sums(rows: DataFrame, modes: DataFrame, p: int, theta: np.ndarray, nodes: int) -> DataFrame:
    """Per block: mode, scale and the rows' sums at each node: log likelihood, gradient by (beta, log precision), Hessian."""
    beta, log_precision = theta[:p].copy(), float(theta[p])
    z = np.polynomial.hermite.hermgauss(nodes)[0]
    q = p + 1
    up = np.triu_indices(q)
    width = 1 + q + len(up[0])

    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.to_pandas()
            block, at = np.unique(d["block"].to_numpy(), return_inverse=True)
            x = np.stack(d["x"].to_numpy())
            k, n, times = (d[c].to_numpy(np.float64) for c in ("k", "n", "times"))
            mode, scale = d["mode"].to_numpy(), d["scale"].to_numpy()
            out = np.zeros((len(block), nodes, width))
            for j in range(nodes):
                l, e, r, ee, er, rr = row_terms(k, n, x @ beta + mode + np.sqrt(2) * scale * z[j], log_precision)
                g = np.column_stack([x * e[:, None], r])
                h = np.empty((len(k), q, q))
                h[:, :p, :p] = x[:, :, None] * x[:, None, :] * ee[:, None, None]
                h[:, :p, p] = x * er[:, None]
                h[:, p, p] = rr
                part = np.column_stack([l, g, h[:, up[0], up[1]]]) * times[:, None]
                # Derivatives by u are those of the intercept, which is the first column of x.
                np.add.at(out[:, j], at, part)
            flat = out.reshape(len(block), -1)
            yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.string()), "sums": pa.array(list(flat), pa.list_(pa.float64()))})

    parts = rows.join(modes, "block").mapInArrow(add, "block string, sums array<double>")
    return added(parts, "block", "sums").join(modes, "block")


def _blocks(sums: DataFrame, p: int, theta: np.ndarray, nodes: int) -> DataFrame:
    """(block, its next mode and scale, likelihood, gradient and Hessian of theta as one array)."""
    z, weight = np.polynomial.hermite.hermgauss(nodes)
    q, log_deviation = p + 1, float(theta[p + 1])
    up = np.triu_indices(q)
    variance = np.exp(2 * log_deviation)

    def each(frames):
        for d in frames:
            if not len(d):
                continue
            s = np.stack(d["sums"].to_numpy()).reshape(len(d), nodes, -1)
            mode, scale = d["mode"].to_numpy(), d["scale"].to_numpy()
            u = mode[:, None] + np.sqrt(2) * scale[:, None] * z[None, :]
            joint = s[:, :, 0] - 0.5 * u * u / variance - log_deviation - 0.5 * np.log(2 * np.pi) + (np.log(weight) + z * z)[None, :] + np.log(np.sqrt(2) * scale)[:, None]
            top = joint.max(1, keepdims=True)
            share = np.exp(joint - top)
            whole = share.sum(1, keepdims=True)
            value, share = (top + np.log(whole))[:, 0], share / whole
            g = np.concatenate([s[:, :, 1 : 1 + q], (u * u / variance - 1)[:, :, None]], 2)
            h = np.zeros((len(d), nodes, q + 1, q + 1))
            h[:, :, up[0], up[1]] = s[:, :, 1 + q :]
            h[:, :, up[1], up[0]] = s[:, :, 1 + q :]
            h[:, :, q, q] = -2 * u * u / variance
            mean = np.einsum("bn,bni->bi", share, g)
            hessian = np.einsum("bn,bnij->bij", share, h) + np.einsum("bn,bni,bnj->bij", share, g, g) - mean[:, :, None] * mean[:, None, :]
            mid = nodes // 2
            slope, bend = s[:, mid, 1] - mode / variance, np.minimum(s[:, mid, 1 + q], 0.0) - 1 / variance
            step = np.clip(-slope / bend, -2, 2)
            total = np.column_stack([value, mean, hessian.reshape(len(d), -1)])
            yield pd.DataFrame({"block": d["block"], "mode": mode + step, "scale": 1 / np.sqrt(-bend), "total": list(total)})

    return sums.mapInPandas(each, "block string, mode double, scale double, total array<double>")


def _round(rows: DataFrame, modes: DataFrame, p: int, theta: np.ndarray, nodes: int) -> tuple[DataFrame, np.ndarray]:
    done = settled(_blocks(_sums(rows, modes, p, theta, nodes), p, theta, nodes))
    total = done.select(F.posexplode("total").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()
    return done.select("block", "mode", "scale"), np.array([r.v for r in total])


def beta_binomial(df: DataFrame, block: str, hits: str, trials: str, terms: list[str], nodes: int = NODES, most_rounds: int = 40, tolerance: float = 1e-6) -> Fit:
    """Maximum likelihood of hits out of trials by the numeric columns `terms` and an intercept.

    Rows without trials, or with a null, go; a null block is left out. `nodes` is odd, so that one is the mode. What is
    shuffled in a round: for each batch and block in it, nodes * (p + 2) * (p + 3) / 2 numbers, p the coefficients. With
    separated or constant data coefficients run off; the fit then ends unconverged at the bound of rounds."""
    if nodes % 2 == 0:
        raise ValueError("the number of nodes is odd")
    names = ["(intercept)", *terms]
    p = len(names)
    x = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in terms])
    rows = df.select(F.col(block).cast("string").alias("block"), x.alias("x"), F.col(hits).cast("double").alias("k"), F.col(trials).cast("double").alias("n"))
    rows = settled(rows.filter("block is not null and k is not null and n > 0 and not exists(x, v -> v is null)").groupBy("block", "x", "k", "n").agg(F.count("*").alias("times")))
    share = rows.agg(F.sum(F.col("k") * F.col("times")), F.sum(F.col("n") * F.col("times"))).first()
    if not share[1]:
        raise ValueError("no row has trials")
    rate = min(max(share[0] / share[1], 1e-4), 1 - 1e-4)
    theta = np.zeros(p + 2)
    theta[0], theta[p], theta[p + 1] = np.log(rate / (1 - rate)), 2.0, -1.0
    modes = settled(rows.select("block").distinct().withColumns({"mode": F.lit(0.0), "scale": F.lit(float(np.exp(theta[p + 1])))}))
    for _ in range(FIRST_MODES):
        modes, _ = _round(rows, modes, p, theta, 1)
    best, step, at, lambda_ = None, None, 0, 0.0
    for at in range(1, most_rounds + 1):
        new_modes, total = _round(rows, modes, p, theta, nodes)
        value, gradient, hessian = total[0], total[1 : p + 3], total[p + 3 :].reshape(p + 2, p + 2)
        if best is not None and value < best[0] - 1e-7 * (1 + abs(best[0])) and lambda_ < 20:
            # Too far: go half the way from the best place, with the modes found meanwhile.
            step, lambda_, modes = step / 2, lambda_ + 1, new_modes
            theta = _inside(best[1] + step, p)
            continue
        still = best is not None and np.abs(gradient_inside(gradient, theta, p)).max() < tolerance * (1 + abs(value))
        best, modes, lambda_ = (value, theta.copy(), hessian), new_modes, 0.0
        if still:
            return Fit(names, theta, _inverse(-hessian), float(value), at, True)
        step = np.clip(_inverse(-hessian) @ gradient, -2, 2)
        theta = _inside(theta + step, p)
    return Fit(names, best[1], _inverse(-best[2]), float(best[0]), at, False)


def _inside(theta: np.ndarray, p: int) -> np.ndarray:
    theta = theta.copy()
    theta[p], theta[p + 1] = np.clip(theta[p], *LOG_PRECISION), np.clip(theta[p + 1], *LOG_DEVIATION)
    return theta


def gradient_inside(gradient: np.ndarray, theta: np.ndarray, p: int) -> np.ndarray:
    """The gradient without what points out of the bounds that theta lies on."""
    g = gradient.copy()
    for i, (low, high) in ((p, LOG_PRECISION), (p + 1, LOG_DEVIATION)):
        if theta[i] <= low and g[i] < 0 or theta[i] >= high and g[i] > 0:
            g[i] = 0.0
    return g


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric matrix with its eigenvalues made positive, so that a Newton step always climbs."""
    value, vector = np.linalg.eigh((a + a.T) / 2)
    size = np.maximum(np.abs(value), 1e-10 * max(1.0, np.abs(value).max()))
    return vector / size @ vector.T
