"""Local regression of one column on another from binned moments.

The rows are summed into at most `bins` ranges of x (counts and moments up to the fourth order); weighted fits at a
bounded grid of places read those sums alone, and the curve between two places is the cubic through their values and
slopes. What reaches the driver and every worker is the table of bins and the grid, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import range_of


def _local(at: float, m: dict[str, np.ndarray], q: float, degree: int) -> tuple[float, float]:
    """Value and slope at one place: tricube weights within the distance of the q-th nearest row."""
    d = np.abs(m["x"] - at)
    order = np.argsort(d, kind="stable")
    reach = np.searchsorted(np.cumsum(m["n"][order]), q)
    h = d[order[min(reach, len(d) - 1)]]
    h = h * (q / m["n"].sum() if q > m["n"].sum() else 1) * (1 + 1e-9)
    if h <= 0:
        here = d <= 0
        return float(m["y0"][here].sum() / m["n"][here].sum()), 0.0
    w = np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
    # Moments about the place, from moments about 0.
    s = [m["n"], m["x1"], m["x2"], m["x3"], m["x4"]]
    choose = [[1], [1, 1], [1, 2, 1], [1, 3, 3, 1], [1, 4, 6, 4, 1]]
    about = lambda v, k: sum(c * (-at) ** (k - i) * v[i] for i, c in enumerate(choose[k]))
    p = degree + 1
    a = np.array([[(w * about(s, i + j)).sum() for j in range(p)] for i in range(p)])
    b = np.array([(w * about([m["y0"], m["y1"], m["y2"]], i)).sum() for i in range(p)])
    scale = h ** np.arange(p)
    fit = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-10)[0] / scale
    return float(fit[0]), float(fit[1]) if degree else 0.0


def curve(df: DataFrame, x: str, y: str, span: float = 0.75, degree: int = 2, bins: int = 2048, places: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and slopes of the local regression of y on x; rows with a null or NaN do not count."""
    good = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    mid, sd = good.agg(F.avg("x"), F.stddev_pop("x")).first()
    if mid is None:
        return np.empty(0), np.empty(0), np.empty(0)
    sd = sd or 1.0
    z = good.withColumn("z", (F.col("x") - mid) / sd).withColumn("bin", range_of(good, "x", bins))
    sums = {f"x{k}": F.sum(F.pow("z", F.lit(k))) for k in range(1, 5)} | {f"y{k}": F.sum(F.col("y") * F.pow("z", F.lit(k))) for k in range(3)}
    got = z.groupBy("bin").agg(F.count("*").cast("double").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), *[v.alias(k) for k, v in sums.items()]).toPandas().sort_values("low")
    m = {c: got[c].to_numpy(np.float64) for c in got.columns if c != "bin"}
    m["x"] = m["x1"] / m["n"]
    # Half of the places by rows, half by width: tails have few rows and steep curves.
    low, high = m["low"].min(), m["high"].max()
    at = np.unique(np.concatenate([m["x"][np.unique(np.linspace(0, len(got) - 1, places // 2).astype(int))], np.linspace(low, high, places // 2)]))
    fits = np.array([_local(p, m, max(degree + 1, np.floor(span * m["n"].sum() + 1e-5)), degree) for p in at])
    return at * sd + mid, fits[:, 0], fits[:, 1] / sd


def along(at: np.ndarray, value: np.ndarray, slope: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cubic pieces through values and slopes; straight on beyond both ends."""
    if len(at) < 2:
        return np.full(len(x), value[0] if len(at) else np.nan)
    k = np.clip(np.searchsorted(at, x, side="right") - 1, 0, len(at) - 2)
    h = at[k + 1] - at[k]
    t = np.clip((x - at[k]) / h, 0, 1)
    out = (1 + 2 * t) * (1 - t) ** 2 * value[k] + t * (1 - t) ** 2 * h * slope[k] + t * t * (3 - 2 * t) * value[k + 1] + t * t * (t - 1) * h * slope[k + 1]
    return out + np.where(x < at[0], (x - at[0]) * slope[0], 0) + np.where(x > at[-1], (x - at[-1]) * slope[-1], 0)


def loess(df: DataFrame, x: str, y: str, span: float = 0.75, degree: int = 2, bins: int = 2048, places: int = 200, name: str = "fitted", residual: str = "residual") -> DataFrame:
    """Adds the fitted value and what y is above it; null where x or y is."""
    held = curve(df, x, y, span, degree, bins, places)

    @F.pandas_udf("double")
    def fitted(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        known = v.notna().to_numpy()
        out[known] = along(*held, v.to_numpy(np.float64)[known])
        return pd.Series(out).where(known, None)

    return df.withColumn(name, fitted(F.col(x).cast("double"))).withColumn(residual, F.col(y) - F.col(name))


def variable_features(moments: DataFrame, mean: str = "mean", variance: str = "variance", span: float = 0.75) -> DataFrame:
    """The features whose variance lies above its trend over the means, with the residual."""
    return loess(moments, mean, variance, span).filter("residual > 0").drop("fitted")
