"""Truncated SVD against numpy's of the dense matrix; orthonormality, low rank, dropped components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import svd


def table(spark, x):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "cell long, site long, n double").repartition(3)


def dense(df, key, n):
    out = np.zeros((n, len(df.columns) - 1))
    for r in df.collect():
        out[r[key]] = r[1:]
    return out


def test_values_and_vectors_equal_a_dense_decomposition(spark):
    r = np.random.default_rng(4)
    part = lambda *n: r.random(n) * (r.random(n) < 0.4)
    x = part(70, 6) @ np.diag([9, 7, 5, 4, 3, 2]) @ part(6, 45) + r.normal(0, 0.01, (70, 45)) * (r.random((70, 45)) < 0.1)
    got = svd.truncated(table(spark, x), "cell", "site", "n", 5, passes=3)
    u, s, vt = np.linalg.svd(x)
    assert got.values == pytest.approx(s[:5], rel=1e-6)
    left, right = dense(got.left, "row", 70), dense(got.right, "feature", 45)
    assert left.T @ left == pytest.approx(np.eye(5), abs=1e-9) and right.T @ right == pytest.approx(np.eye(5), abs=1e-9)
    sign = np.where(vt[:5].sum(1) < 0, -1, 1)
    assert right == pytest.approx(vt[:5].T * sign, abs=1e-5)
    assert dense(got.scores(), "row", 70) == pytest.approx(u[:, :5] * s[:5] * sign, abs=1e-4)


def test_low_rank_and_nothing(spark):
    x = np.outer(np.arange(1, 9), [1, 0, 2, 5])
    got = svd.truncated(table(spark, x), "cell", "site", "n", 3)
    assert got.values == pytest.approx([np.linalg.norm(x)], rel=1e-9)
    none = spark.createDataFrame([], "cell long, site long, n double")
    assert svd.truncated(none, "cell", "site", "n", 3).values == []


def test_rows_sites_and_components_are_chosen(spark):
    r = random.Random(3)
    cells = [(i, j, float(r.randrange(1, 5) * (j == i % 7) + 1)) for i in range(40) for j in range(7) if r.random() < 0.8]
    df = spark.createDataFrame(cells, "cell long, site long, n double")
    unit = svd.scaled_rows(df, "cell", "n").groupBy("cell").agg(F.sum(F.col("n") ** 2).alias("s")).collect()
    assert all(x.s == pytest.approx(1) for x in unit)
    x = np.zeros((40, 7))
    for i, j, v in cells:
        x[i, j] = v
    best = sorted(range(7), key=lambda j: (-x[:, j].var(ddof=1), j))[:3]
    assert {v.site for v in svd.top_variance(df, "cell", "site", "n", 3).collect()} == set(best)
    got = svd.truncated(df, "cell", "site", "n", 3)
    depth = df.groupBy(F.col("cell").alias("k")).agg(F.sum("n").alias("depth"))
    kept, cor = svd.drop_correlated(got.scores(), depth, "k", "depth", 0.6)
    sc = dense(got.scores(), "row", 40)
    want = [np.corrcoef(sc[:, k], x.sum(1))[0, 1] for k in range(3)]
    assert cor == pytest.approx(want)
    assert kept.columns == ["row"] + [f"c{k}" for k in range(3) if abs(want[k]) <= 0.6] and len(kept.columns) < 4
