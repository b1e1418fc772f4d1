"""Queries over low-dimensional embeddings of suppliers by the parts they ship."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import matrix as mx
from tessera.operators import svd
from tessera.plans.base import query

SITES, RANK, COR_MAX = 500, 8, 0.6


def _decomposed(t):
    li = t("lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    x = mx.tfidf(li, "l_partkey", "l_suppkey", "l_quantity")
    x = svd.scaled_rows(svd.top_variance(x, "l_suppkey", "l_partkey", "tfidf", SITES), "l_suppkey", "tfidf")
    depth = li.groupBy(F.col("l_suppkey").alias("cell")).agg(F.log10(F.count("*")).alias("depth"))
    return svd.truncated(x, "l_suppkey", "l_partkey", "tfidf", RANK), depth


@query()
def svd_components(t):
    """Per component its singular value and its correlation with depth, and whether it stays."""
    got, depth = _decomposed(t)
    _, cor = svd.drop_correlated(got.scores(), depth, "cell", "depth", COR_MAX)
    rows = [(k, s, c, c is None or abs(c) <= COR_MAX) for k, (s, c) in enumerate(zip(got.values, cor, strict=True))]
    return depth.sparkSession.createDataFrame(rows, "component int, value double, depth_cor double, kept boolean")


@query()
def svd_scores(t):
    """Suppliers in the components that stay."""
    got, depth = _decomposed(t)
    kept, _ = svd.drop_correlated(got.scores(), depth, "cell", "depth", COR_MAX)
    return kept.select("row", F.array(*[F.col(c) for c in kept.columns if c != "row"]).alias("scores"))


@query("""with x as (select l_suppkey as c, l_partkey as f, sum(l_quantity) as x from lineitem group by 1, 2), n as (select count(distinct c) as n from x), s as (select f, sum(x) as s, sum(x * x) as ss from x group by 1),
b as (select f from s, n order by (ss - s * s / n) / (n - 1) desc, f limit 50), y as (select c, f, x from x where f in (from b)), m as (select c, sqrt(sum(x * x)) as m from y group by 1) select c, f, round(x / m, 6) as unit from y join m using (c)""")
def top_variance_unit_rows(t):
    x = t("lineitem").groupBy(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("f")).agg(F.sum("l_quantity").alias("x"))
    return svd.scaled_rows(svd.top_variance(x, "c", "f", "x", 50), "c", "x").select("c", "f", F.round("x", 6).alias("unit"))
