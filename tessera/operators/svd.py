"""Truncated singular value decomposition of a sparse matrix given as triplets, by a randomised range finder.

A thin block of l = rank + oversampling columns is a table (key, c0, ..., c{l-1}); products with the matrix and with its
transpose are a join with the triplets and one aggregation of l sums. Blocks are made orthonormal through their Gram
matrix, so the driver only sees matrices of l by l. The start is drawn by hash of the feature: the same on any
number of executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rounds import settled


def _cols(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def _normal(key: str, k: int, seed: int):
    """A standard normal number for each key, by hash."""
    u = lambda salt: (F.pmod(F.xxhash64(F.col(key), F.lit(k), F.lit(salt), F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))


def _times(triplets: DataFrame, block: DataFrame, over: str, to: str, l: int) -> DataFrame:
    """The matrix, or its transpose, times a block: rows of `to`, summed over `over`."""
    return triplets.join(block, over).groupBy(to).agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in _cols(l)])


def _gram(block: DataFrame, l: int) -> np.ndarray:
    """The l by l products of a block's columns: one small matrix a task, summed by cell."""

    def part(batches):
        total = np.zeros((l, l))
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(l)])
            total += x @ x.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(l * l)), pa.array(total.ravel())], ["cell", "g"])

    got = block.select(*_cols(l)).mapInArrow(part, "cell long, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(l * l)
    for cell, g in got:
        out[cell] = g
    return out.reshape(l, l)


def _turned(block: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """Each row of a block times a small matrix."""
    names = [key, *_cols(by.shape[1])]

    def turn(batches):
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)], 1) @ by
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(x.T))], names)

    kinds = [f"`{key}` {block.schema[key].dataType.simpleString()}", *[f"{c} double" for c in names[1:]]]
    return block.select(key, *_cols(by.shape[0])).mapInArrow(turn, ", ".join(kinds))


def _orthonormal(block: DataFrame, key: str, l: int, times: int = 1) -> tuple[DataFrame, int]:
    """A basis of the columns of a written block; columns beyond its rank go. A second time takes off what rounding left."""
    for _ in range(times):
        values, vectors = np.linalg.eigh(_gram(block, l))
        keep = values > max(values.max(), 0) * 1e-14
        block = _turned(block, key, vectors[:, keep] / np.sqrt(values[keep]))
        l = int(keep.sum())
    return block, l


@dataclass
class Svd:
    """values: descending; left: (row, c0, ...) and right: (feature, c0, ...) with orthonormal columns, signs fixed."""

    values: list[float]
    left: DataFrame
    right: DataFrame

    def scores(self) -> DataFrame:
        """Rows in the space of the components: left times values."""
        return _turned(self.left, "row", np.diag(self.values))


def truncated(matrix: DataFrame, row: str, feature: str, value: str, rank: int, oversample: int = 10, passes: int = 4, seed: int = 0) -> Svd:
    """Leading singular triples. `passes` rounds of power iteration sharpen the range; nulls count as 0, repeated cells add up.

    Signs: the entries of each right vector sum to no less than 0. A matrix of lower rank gives fewer triples."""
    t = settled(matrix.select(F.col(row).alias("row"), F.col(feature).alias("feature"), F.col(value).cast("double").alias("v")).groupBy("row", "feature").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")).filter("v <> 0"))
    l = rank + oversample
    y = t.groupBy("row").agg(*[F.sum(F.col("v") * _normal("feature", k, seed)).alias(f"c{k}") for k in range(l)])
    y = settled(y)
    if not y.limit(1).count():
        return Svd([], y.select("row"), t.select("feature"))
    q, l = _orthonormal(y, "row", l)
    for k in range(passes):
        z, l = _orthonormal(settled(_times(t, q, "row", "feature", l)), "feature", l)
        q, l = _orthonormal(settled(_times(t, z, "feature", "row", l)), "row", l, 2 if k == passes - 1 else 1)
    q = settled(q)
    b = settled(_times(t, q, "row", "feature", l))
    values, vectors = np.linalg.eigh(_gram(b, l))
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > max(values.max(), 0) * 1e-13]
    s, w = np.sqrt(values[order]), vectors[:, order]
    sums = b.agg(*[F.sum(c) for c in _cols(l)]).first()
    w = w * np.where(np.array(sums) @ w < 0, -1.0, 1.0)
    return Svd([float(x) for x in s], settled(_turned(q, "row", w)), settled(_turned(b, "feature", w / s)))


def scaled_rows(matrix: DataFrame, row: str, value: str) -> DataFrame:
    """Every row brought to euclidean length 1; rows of zeros stay."""
    norm = matrix.groupBy(F.col(row).alias("__row")).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("__norm"))
    return matrix.join(norm, F.col(row) == F.col("__row")).withColumn(value, F.when(F.col("__norm") > 0, F.col(value) / F.col("__norm")).otherwise(F.col(value).cast("double"))).drop("__row", "__norm")


def top_variance(matrix: DataFrame, row: str, feature: str, value: str, n: int) -> DataFrame:
    """The cells of the n features of highest variance over all rows, zeros included; ties by feature.

    The matrix is written once, as it is read for its rows, its features and its cells; so are the cells that stay."""
    matrix = settled(matrix)
    rows = matrix.select(row).distinct().count()
    s = matrix.groupBy(feature).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    best = s.orderBy(F.desc((F.col("ss") - F.col("s") * F.col("s") / rows) / max(rows - 1, 1)), feature).limit(n).select(feature)
    return settled(matrix.join(settled(best), feature, "left_semi"))


def drop_correlated(scores: DataFrame, covariate: DataFrame, key: str, name: str, cor_max: float) -> tuple[DataFrame, list[float]]:
    """Components whose correlation with a covariate (key, name) is at most cor_max in size, in their order, and all correlations."""
    cols = [c for c in scores.columns if c != "row"]
    if not cols:
        return scores, []
    got = scores.join(covariate, F.col("row") == F.col(key)).agg(*[F.corr(c, F.col(name).cast("double")).alias(c) for c in cols]).first()
    cor = [got[c] for c in cols]
    kept = [c for c, x in zip(cols, cor, strict=True) if x is None or math.isnan(x) or abs(x) <= cor_max]
    return scores.select("row", *kept), cor
