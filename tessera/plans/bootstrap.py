"""Queries of bootstraps: suppliers are blocks, line status a group, lines of up to 25 units the clean table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bootstrap as bs
from tessera.operators import linkage as lk
from tessera.operators.rounds import settled
from tessera.plans.base import query, r6
from tessera.plans.consensus import _runs

DRAWS = 50
WEIGHTS_SQL = """with o as (select unit, row_number() over (order by unit) - 1 as place, count(*) over () as n from (select distinct l_suppkey as unit from lineitem)),
k as (select draw, ('0x' || md5({seed} || ':' || draw || ':' || place)[1:8])::ubigint % n as place from o, (select unnest(generate_series(0, {draws} - 1)) as draw)), w as (select draw, unit, count(*) as mult from k join o using (place) group by 1, 2)"""


@query(WEIGHTS_SQL.format(seed=5, draws=DRAWS) + " select draw, unit, mult from w")
def bootstrap_weights(t):
    return bs.weights(t("lineitem").select("l_suppkey"), "l_suppkey", DRAWS, 5).select("draw", "unit", "mult")


@query(f"""{WEIGHTS_SQL.format(seed=0, draws=DRAWS)}, l as (select l_suppkey as unit, l_linestatus as g, (l_returnflag = 'R')::int as m, l_quantity <= 25 as c from lineitem),
s as (select unit, g, sum(m) as mr, count(*) as tr, sum(m) filter (where c) as mc, count(*) filter (where c) as tc from l group by 1, 2),
d as (select g, draw, sum(mr * mult) / sum(tr * mult) as raw, sum(mc * mult) / nullif(sum(tc * mult), 0) as clean from w join s using (unit) group by 1, 2), p as (select g, sum(mr) / sum(tr) as raw, sum(mc) / nullif(sum(tc), 0) as clean from s group by 1)
select g as l_linestatus, round(any_value(p.raw), 6) as raw, round(any_value(p.clean), 6) as clean, round(quantile_cont(d.raw, 0.025), 6) as raw_low, round(quantile_cont(d.raw, 0.975), 6) as raw_high, round(quantile_cont(d.clean, 0.025), 6) as clean_low, round(quantile_cont(d.clean, 0.975), 6) as clean_high,
round(avg(d.clean - d.raw), 6) as delta, round(quantile_cont(d.clean - d.raw, 0.025), 6) as delta_low, round(quantile_cont(d.clean - d.raw, 0.975), 6) as delta_high, round(count(*) filter (where d.clean > d.raw) * 1.0 / count(d.clean - d.raw), 6) as above_0 from d join p using (g) group by g""")
def paired_block_bootstrap(t):
    x = t("lineitem").select("l_suppkey", "l_linestatus", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("m"), F.lit(1).alias("one"))
    out = bs.paired_ratios(x, x.filter("l_quantity <= 25"), "l_suppkey", "l_linestatus", "m", "one", DRAWS)
    return out.select("l_linestatus", *[r6(c).alias(c) for c in out.columns if c != "l_linestatus"])


@query()
def run_pair_bootstrap(t):
    """Agreement of runs within each half of the nations, with its interval over drawn runs."""
    half = t("customer").select(F.col("c_custkey").alias("item"), (F.col("c_nationkey") % 2).alias("stage"))
    runs = settled(_runs(t, 15).join(half, "item"))
    pairs = None
    for stage in (0, 1):
        got = lk.rand_of_pairs(runs.filter(F.col("stage") == stage), "run", "item", "label").withColumn("stage", F.lit(stage))
        pairs = got if pairs is None else pairs.unionByName(got)
    return bs.pair_interval(settled(pairs), "run", "other", "ari", ["stage"], 200).select("stage", *[r6(c).alias(c) for c in ("mean", "low", "high")])
