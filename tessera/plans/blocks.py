"""Queries over co-assignment blocks, diffusion, guards, registries and run grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import blocks as b
from tessera.plans.base import query, r6


@query("""select o_orderkey, round(least(o_totalprice, 150000.0) - 1000 * (o_custkey % 7), 6) as d_empty, round(abs(o_totalprice - 150000.0), 6) as d_sd from orders""")
def pair_deltas(t):
    top, other = F.col("o_totalprice"), F.lit(150000.0)
    return t("orders").select("o_orderkey", r6(F.least(top, other) - 1000 * (F.col("o_custkey") % 7)).alias("d_empty"), r6(F.abs(top - other)).alias("d_sd"))


@query("""with x as (select l_suppkey as c, l_partkey as f, sum(case when l_returnflag = 'R' and l_quantity > 45 then 1 else 0 end) as v from lineitem group by 1, 2), r as (select f from x group by 1 having sum(v) > 0), k as (select c from x group by 1 having sum(v) > 0)
select c, count(*) as features, cast(sum(v) as bigint) as total from x where f in (from r) and c in (from k) group by 1""")
def zero_row_guard(t):
    x = t("lineitem").groupBy(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("f")).agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("v"))
    return b.nonempty(x, "f", "c", "v").groupBy("c").agg(F.count("*").alias("features"), F.sum("v").alias("total"))


@query("select l_partkey, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size < 10) and l_partkey in (select l_partkey from lineitem) group by 1")
def frozen_whitelist(t):
    listed = t("part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return b.whitelisted(t("lineitem"), listed, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("""with v as (select l_suppkey as c, l_partkey as p, sum(l_quantity) as v from lineitem group by 1, 2) select c, p_brand as type, round(avg(v / (p_size * 100 / 1000.0)), 6) as score, count(*) as n_support from v join part on p_partkey = p group by 1, 2""")
def marker_group_means(t):
    v = t("lineitem").groupBy(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("p")).agg(F.sum("l_quantity").alias("v"))
    part = t("part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("type"), (F.col("p_size") * 100).alias("width"))
    kb = b.per_length(v, part, "p", "v", "width")
    return kb.join(part.drop("width"), "p").groupBy("c", "type").agg(r6(F.avg("v")).alias("score"), F.count("*").alias("n_support"))


@query("""with e as (select c_nationkey as src, s_nationkey as dst, count(*) * 1.0 as w from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey group by 1, 2),
u as (select src, dst, sum(w) as w from (select * from e union all select dst, src, w from e) group by 1, 2), p as (select src, dst, w / sum(w) over (partition by src) as p from u), x0 as (select n_nationkey as node, n_nationkey * 1.0 as x from nation),
x1 as (select src as node, sum(p * x) as x from p join x0 on dst = node group by 1), x2 as (select src as node, sum(p * x) as x from p join x1 on dst = node group by 1) select node, round(x, 6) as x from x2""")
def two_hop_diffusion(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    li = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst"))
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    start = t("nation").select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("x"))
    return b.diffused(e, start, 2).select("node", r6("x").alias("x"))


SEEDS = "select s_suppkey as item, seed, (s_suppkey * 2654435761 + seed * 40503) % 4294967296 % 7 as label from supplier, (select unnest(generate_series(1, 5)) as seed)"
PAIRS = f"with s as ({SEEDS}), f as (select a.item as i, b.item as j, count(*) / 5.0 as f from s a join s b on a.seed = b.seed and a.label = b.label and a.item < b.item group by 1, 2), bl as (select s_suppkey as item, s_nationkey as block from supplier)"


def _seeds(t):
    s = t("supplier").select(F.col("s_suppkey").alias("item"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    s = s.withColumn("label", F.expr("(item * 2654435761L + seed * 40503) % 4294967296L % 7"))
    return s, "seed", "item", "label", t("supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("block"))


@query(f"""{PAIRS}, z as (select least(x.block, y.block) as bi, greatest(x.block, y.block) as bj, sum(coalesce(f, 0)) as s, count(*) as n from bl x join bl y on x.item < y.item left join f on f.i = x.item and f.j = y.item group by 1, 2),
blk as (select distinct block from bl), gr as (select p.block as bi, q.block as bj from blk p join blk q on p.block <= q.block) select gr.bi, gr.bj, round(s / n, 6) as mean, coalesce(n, 0) as n from gr left join z on z.bi = gr.bi and z.bj = gr.bj""")
def block_pair_means(t):
    return b.block_means_of_runs(*_seeds(t)).withColumn("mean", r6("mean"))


@query(f"""{PAIRS}, z as (select x.block, avg(coalesce(f, 0)) as m, avg(coalesce(f, 0) * coalesce(f, 0)) as q, avg(case when f >= 0.9 then 1.0 else 0 end) as h from bl x join bl y on x.item < y.item and x.block = y.block left join f on f.i = x.item and f.j = y.item group by 1), n as (select block, count(*) as m from bl group by 1)
select n.block, n.m, round(z.m, 6) as conf, round((q - z.m * z.m) / nullif(z.m * (1 - z.m), 0), 6) as stab, round(h, 6) as frac_high from n left join z using (block)""")
def block_confidence(t):
    return b.block_confidence_of_runs(*_seeds(t)).select("block", "m", *[r6(c).alias(c) for c in ("conf", "stab", "frac_high")])


@query("select r_name, case r_name when 'ASIA' then 'a' when 'AFRICA' then 'b' when 'AMERICA' then 'b' when 'EUROPE' then 'c' else 'd' end as genome, count(*) as nations from nation join region on r_regionkey = n_regionkey group by 1, 2")
def registry_lookup(t):
    n = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    names = {"ASIA": "a", "AFRICA": "b", "AMERICA": "b", "EUROPE": "c", "MIDDLE EAST": "d"}
    return b.registered(n, names, F.col("r_name"), "genome").groupBy("r_name", "genome").agg(F.count("*").alias("nations"))


@query("""with g as (select c_mktsegment as sample, c, c * 15 as first, least(100, (c + 1) * 15) as last from (select distinct c_mktsegment from customer), (select unnest(generate_series(0, 6)) as c)), done as (select distinct c_mktsegment as sample, c_nationkey % 7 as c from customer where c_custkey % 97 = 0)
select g.sample, g.c as chunk, first, last from g left join done using (sample, c) where done.c is null""")
def missing_chunks(t):
    done = t("customer").filter("c_custkey % 97 = 0").select(F.col("c_mktsegment").alias("sample"), (F.col("c_nationkey") % 7).alias("chunk")).distinct()
    return b.missing_chunks(t("customer").select(F.col("c_mktsegment").alias("sample")), "sample", 7, 100, done)


@query("""with m as (select p_size as k, count(*) as n from part group by 1), w as (select min(n) as k_max from m) select k, n, n <= k_max as smallest, k in (5, 10, 20, 40) and k <= k_max as in_window from m, w""")
def peak_grid_window(t):
    m = t("part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n"))
    k_max = F.col("k_max")
    return m.join(F.broadcast(m.agg(F.min("n").alias("k_max")))).select("k", "n", (F.col("n") <= k_max).alias("smallest"), (F.col("k").isin(5, 10, 20, 40) & (F.col("k") <= k_max)).alias("in_window"))
