"""Queries of the background set test: parts are features, return flags clusters, brands sets; large parts are the background."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import matrix as mx
from tessera.operators import nulls as nl
from tessera.operators import trend
from tessera.operators.rounds import settled
from tessera.plans.base import query, r6

#: 31 and 7 in the denominators keep ranks and means off the halves that rounding could tip either way.
WIDTH, ANCHORS, DRAWS = 62, 40, 49

TEST_SQL = f"""with flag as (select distinct l_returnflag as cluster from lineitem), v0 as (select l_partkey as feature, l_returnflag as cluster, sum(l_quantity) as v from lineitem group by 1, 2),
v as (select p_partkey as feature, flag.cluster, coalesce(v, 0) as v from part cross join flag left join v0 on v0.feature = p_partkey and v0.cluster = flag.cluster),
f as (select p_partkey as feature, coalesce(sum(l_quantity), 0) as x, p_size >= 25 as bg from part left join lineitem on l_partkey = p_partkey group by p_partkey, p_size),
o as (select feature, x, row_number() over (order by x, feature) - 1 as spot from f where bg), k as (select count(*) as n, min(x) as low, max(x) as high, least({WIDTH}, count(*)) // 2 as half from o),
w as (select *, least(2 * half, n) as wide, greatest(1, least({ANCHORS}, n - least(2 * half, n) + 1)) as cnt from k), s as (select *, case when cnt > 1 then (n - wide) * 1.0 / (cnt - 1) else 0.0 end as step from w),
below as (select feature, x, sum(bg::int) over (order by x range between unbounded preceding and current row) as rank from f),
own as (select feature, cast(least(cnt - 1, greatest(0, floor((rank - half) / step + 0.5))) as bigint) as anchor, x between low and high as in_support from below, s),
grid as (select a.anchor, i.idx, cast(floor(a.anchor * step + 0.5) as bigint) + i.idx as spot from s, (select unnest(generate_series(0, {ANCHORS - 1})) as anchor) a, (select unnest(generate_series(0, {WIDTH - 1})) as idx) i where a.anchor < cnt and i.idx < wide),
refs as (select anchor, idx, feature as ref from grid join o using (spot)), beside as (select anchor, cluster, v.v from refs join v on v.feature = ref),
u as (select v.feature, v.cluster, (sum((b.v < v.v)::int) + sum((b.v <= v.v)::int)) / (2.0 * count(*)) as u from v join own using (feature) join beside b on b.anchor = own.anchor and b.cluster = v.cluster group by v.feature, v.cluster),
m as (select p_partkey as feature, p_brand as type, anchor, in_support from part join own on feature = p_partkey where p_size < 25)"""

NULL_SQL = f""", d as (select m.*, draw, ('0x' || md5('0:' || type || ':' || m.feature || ':' || draw)[1:8])::ubigint % wide as idx from m, s, (select unnest(generate_series(0, {DRAWS - 1})) as draw)),
z as (select d.type, u.cluster, draw, avg(u.u) as u from d join refs r on r.anchor = d.anchor and r.idx = d.idx join u on u.feature = r.ref group by 1, 2, 3), sup as (select type, count(*) as n_markers, avg(in_support::int) as frac_in_support from m group by 1),
ob as (select type, cluster, avg(u) as obs from m join u using (feature) group by 1, 2),
t as (select type, cluster, any_value(obs) as obs, avg(u) as null_mean, stddev_samp(u) as null_sd, quantile_cont(u, 0.95) as null_q95, (1 + count(*) filter (where u >= obs - 1e-12)) / (1.0 + {DRAWS}) as p from z join ob using (type, cluster) group by 1, 2),
r as (select *, count(*) over () as n, count(*) over (order by p range between unbounded preceding and current row) as k, count(*) over (partition by cluster) as nc, count(*) over (partition by cluster order by p range between unbounded preceding and current row) as kc from t),
q as (select *, least(1.0, min(p * n / k) over (order by p range between current row and unbounded following)) as q, least(1.0, min(p * nc / kc) over (partition by cluster order by p range between current row and unbounded following)) as q_cluster from r)
select type, cluster, n_markers, round(frac_in_support, 6) as frac_in_support, round(obs, 6) as obs, round(null_mean, 6) as null_mean, round(null_sd, 6) as null_sd, round(null_q95, 6) as null_q95, round((obs - null_mean) / greatest(null_sd, 1e-9), 4) as effect_z, round(p, 8) as p, round(q, 8) as q, round(q_cluster, 8) as q_cluster, frac_in_support >= 0.5 as testable, frac_in_support >= 0.5 and q < 0.05 as significant from q join sup using (type)"""


def _windows(t):
    total = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("x"))
    features = t("part").join(total, "p_partkey", "left").select(F.col("p_partkey").alias("feature"), F.coalesce("x", F.lit(0)).alias("x"), (F.col("p_size") >= 25).alias("bg"))
    flags = t("lineitem").select(F.col("l_returnflag").alias("cluster")).distinct()
    v = t("lineitem").groupBy(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("cluster")).agg(F.sum("l_quantity").alias("v"))
    # A few flags by all parts: a grid with zeros for what is missing.
    grid = t("part").select(F.col("p_partkey").alias("feature")).join(F.broadcast(flags)).join(v, ["feature", "cluster"], "left").select("feature", "cluster", F.coalesce("v", F.lit(0)).alias("v"))
    w = nl.windows(features, "feature", "x", "bg", WIDTH, ANCHORS)
    return w, settled(nl.mid_ranks(w, grid, "feature", "cluster", "v"))


@query(TEST_SQL + " select feature, cluster, round(u, 8) as u from u")
def background_mid_ranks(t):
    return _windows(t)[1].select("feature", "cluster", F.round("u", 8).alias("u"))


@query(TEST_SQL + NULL_SQL)
def background_set_test(t):
    w, u = _windows(t)
    markers = t("part").filter("p_size < 25").select(F.col("p_partkey").alias("feature"), F.col("p_brand").alias("type"))
    out = nl.set_test(w, u, markers, DRAWS)
    return out.select("type", "cluster", "n_markers", *[r6(c).alias(c) for c in ("frac_in_support", "obs", "null_mean", "null_sd", "null_q95")], F.round("effect_z", 4).alias("effect_z"), *[F.round(c, 8).alias(c) for c in ("p", "q", "q_cluster")], "testable", "significant")


@query()
def variable_parts(t):
    """Parts whose variance over suppliers lies above its trend over the means."""
    x = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("x"))
    n = t("supplier").count()
    moments = settled(mx.variance_with_zeros(x, "l_partkey", "x", n))
    return trend.variable_features(moments).select("l_partkey", r6("residual").alias("residual"))
