"""Queries over repeatable draws, fuzzy and range joins, profiles, evidence and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import draws as d
from tessera.operators import keyed as k
from tessera.operators import readouts as ro
from tessera.plans.base import query, r6

HASH = "(({0}) * 2654435761) % 4294967296"


@query(f"select c_custkey, row_number() over (partition by c_nationkey order by {HASH.format('c_custkey + 3')}, c_custkey) as place from customer")
def group_shuffle(t):
    return d.shuffled(t("customer"), ["c_nationkey"], "c_custkey", 3).select("c_custkey", "place")


@query(f"select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by {HASH.format('o_orderkey')}, o_orderkey) as p from orders) where p <= 300")
def capped_groups(t):
    return d.capped(t("orders"), ["o_orderstatus"], "o_orderkey", 300).select("o_orderkey", "o_orderstatus")


@query(f"""with m as (select p_brand, p_partkey, p_retailprice, draw from part, (select unnest(generate_series(1, 12)) as draw)), r as (select *, row_number() over (partition by p_brand, draw order by {HASH.format('p_partkey * 1009 + draw')}, p_partkey) as p from m)
select p_brand, round(avg(s), 6) as mean_of_draws from (select p_brand, draw, sum(p_retailprice) as s from r where p <= 10 group by 1, 2) group by 1""")
def repeated_draws(t):
    drawn = d.repeated_draws(t("part"), ["p_brand"], "p_partkey", 10, 12)
    return drawn.groupBy("p_brand", "draw").agg(F.sum("p_retailprice").alias("s")).groupBy("p_brand").agg(r6(F.avg("s")).alias("mean_of_draws"))


@query(f"""with h as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by {HASH.format('c_custkey')}, c_custkey) as p from customer), v as (select c_mktsegment, c_nationkey, row_number() over (partition by c_nationkey order by {HASH.format('c_custkey + 1')}, c_custkey) as p from customer)
select c_custkey, c_mktsegment from h join v using (c_nationkey, p)""")
def permuted_segments(t):
    return d.permuted_column(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment")


@query(f"select l_returnflag, count(*) as n, count(*) filter (where {HASH.format('l_orderkey * 10 + l_linenumber')} < cast(0.02 * 4294967296 as bigint)) as injected from lineitem group by 1")
def injected_sites(t):
    li = t("lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return d.injected(li, "id", 0.02).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("injected").alias("injected"))


@query(f"""with w as (select s_nationkey as g, s_suppkey as tpl, sum(3) over (partition by s_nationkey order by s_suppkey) as b from supplier), h as (select c_nationkey as g, c_custkey as item, row_number() over (partition by c_nationkey order by {HASH.format('c_custkey')}, c_custkey) - 1 as nth from customer)
select w.g, tpl, item from h join w on h.g = w.g and nth >= b - 3 and nth < b""")
def consumed_slices(t):
    templates = t("supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("tpl"), F.lit(3).alias("n"))
    return d.consumed_slices(templates, t("customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("item")), "g", "tpl", "n", "item")


@query("""with q as (select distinct lpad(cast(l_partkey * 7 % 100000 as varchar), 6, '0') as code from lineitem), w as (select distinct lpad(cast(s_suppkey * 1013 % 100000 as varchar), 6, '0') as white from supplier), p as (select code, white, hamming(code, white) as dist from q, w)
select code, arg_min(white, (dist, white)) as white, min(dist) as distance from p where dist <= 2 group by 1""")
def fuzzy_codes(t):
    code = lambda c, m: F.lpad((F.col(c) * m % 100000).cast("string"), 6, "0")
    q = t("lineitem").select(code("l_partkey", 7).alias("code"))
    return d.near_strings(q, t("supplier").select(code("s_suppkey", 1013).alias("white")), "code", "white", 2, 6).withColumn("distance", F.col("distance").cast("long"))


@query("""with r as (select p_partkey, p_size * 100 as a, p_size * 100 + 150 as b from part), p as (select l_orderkey, cast(floor(l_extendedprice / 10) as bigint) as pos from lineitem)
select p_partkey, count(*) as n from r join p on pos >= a and pos < b group by 1""")
def overlapping_windows(t):
    # Windows of one size are one range: they meet the points once and are handed to their parts afterwards.
    r = t("part").select("p_partkey", (F.col("p_size") * 100).cast("long").alias("a"))
    ranges = r.select("a", (F.col("a") + 150).alias("b"), F.lit(1).alias("k")).distinct()
    points = t("lineitem").select(F.lit(1).alias("k"), F.floor(F.col("l_extendedprice") / 10).alias("pos")).groupBy("k", "pos").agg(F.count("*").alias("m"))
    hit = d.points_in_ranges(points, ranges, ["k"], "pos", "a", "b", 100).groupBy("a").agg(F.sum("m").alias("n"))
    return r.join(hit, "a").select("p_partkey", "n")


@query("""with x as (select l_suppkey as c, l_partkey as f, sum(l_quantity) as v from lineitem group by 1, 2), p as (select c % 3 = 0 as g, f, sum(v) as m from x group by 1, 2), n as (select g, sqrt(sum(m * m)) as pn from p group by 1), o as (select c, sqrt(sum(v * v)) as n from x group by 1),
e as (select x.c, p.g, sum(x.v * p.m) as dot from x join p using (f) group by 1, 2), cs as (select e.c, e.g, dot / (o.n * pn) as cosine from e join n on n.g = e.g join o on o.c = e.c)
select c, round(coalesce(max(cosine) filter (where g), 0), 6) as good, round(coalesce(max(cosine) filter (where not g), 0), 6) as bad, round(coalesce(max(cosine) filter (where g), 0) - coalesce(max(cosine) filter (where not g), 0), 6) as dif from cs group by 1""")
def reference_profiles(t):
    x = t("lineitem").groupBy(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("f")).agg(F.sum("l_quantity").alias("v"))
    return d.profile_difference(x, "c", "f", "v", F.col("c") % 3 == 0).select("c", *[r6(n).alias(n) for n in ("good", "bad", "dif")])


@query(f"""with o as (select l_suppkey as s, count(*) filter (where l_returnflag = 'R') as v from lineitem group by 1), n as (select s, cast({HASH.format('s * 1009 + draw')} % 400 as double) as v from o, (select unnest(generate_series(1, 99)) as draw))
select o.s, round((1.0 + count(*) filter (where n.v >= o.v)) / (1 + count(n.v)), 6) as p, round(case when stddev_samp(n.v) > 0 then (o.v - avg(n.v)) / stddev_samp(n.v) end, 6) as z, round(quantile_cont(n.v, 0.95), 6) as q95 from o left join n using (s) group by o.s, o.v""")
def permutation_p(t):
    from tessera.functions.strings import uniform_hash

    o = t("lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("v"))
    null = o.select("s", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("draw")).select("s", (uniform_hash(F.col("s") * 1009 + F.col("draw")) % 400).cast("double").alias("v"))
    return ro.permutation_p(o, null, "s", "v").select("s", r6("p").alias("p"), r6("z").alias("z"), r6("q95").alias("q95"))


@query("""with m as (select p_partkey as g, p_brand as type, p_size as stage, p_retailprice as v from part), s as (select type, stage, (v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0) as x, v from m window w as (partition by stage)), a as (select type, stage, avg(coalesce(x, 0)) as scaled, avg(v) as raw, count(*) as genes from s group by 1, 2)
select type, stage, round(scaled, 6) as scaled, round(raw, 6) as raw, genes, round(case when max(scaled) over v <= min(scaled) over v then 0 else (scaled - min(scaled) over v) / (max(scaled) over v - min(scaled) over v) end, 6) as rescaled from a window v as (partition by type)""")
def type_evidence(t):
    m = t("part").select(F.col("p_brand").alias("type"), F.col("p_size").alias("stage"), F.col("p_retailprice").alias("v"))
    a = k.scaled(m, "v", ["stage"], "x").groupBy("type", "stage").agg(F.avg("x").alias("scaled"), F.avg("v").alias("raw"), F.count("*").alias("genes"))
    out = k.scaled(a, "scaled", ["type"], "rescaled")
    return out.select("type", "stage", r6("scaled").alias("scaled"), r6("raw").alias("raw"), "genes", r6("rescaled").alias("rescaled"))


@query("""with u as (select user_id as mc, event_type as type, value as v from events), m as (select mc, arg_max(type, (n, type)) as modal from (select mc, type, count(*) as n from u group by 1, 2) group by 1)
select type, count(*) as n, count(distinct u.mc) as metacells, round(median(v), 6) as med, round(max(v), 6) as top, round(avg(case when modal = type then 1.0 else 0 end), 6) as agree, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from u join m using (mc) group by 1""")
def stage_report(t):
    u = t("events").select(F.col("user_id").alias("mc"), F.col("event_type").alias("type"), F.col("value").alias("v"))
    modal = u.groupBy("mc", "type").agg(F.count("*").alias("n")).groupBy("mc").agg(F.max_by("type", F.struct("n", "type")).alias("modal"))
    a = u.join(modal, "mc").groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("mc").alias("metacells"), r6(F.median("v")).alias("med"), r6(F.max("v")).alias("top"), r6(F.avg((F.col("modal") == F.col("type")).cast("double"))).alias("agree"))
    return a.join(F.broadcast(a.agg(F.sum("n").alias("t")))).withColumn("pct", r6(100.0 * F.col("n") / F.col("t"))).drop("t")


@query("""with f as (select l_suppkey as cell, l_returnflag as genome, sum(l_quantity) as v from lineitem group by 1, 2), own as (select s_suppkey as cell, case s_nationkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as own from supplier)
select own, count(*) as cells, round(sum(v), 2) as kept, round(sum(total - v), 2) as removed, count(*) filter (where v >= 5000) as embeddable from (select cell, own, coalesce(sum(v) filter (where genome = own), 0) as v, sum(v) as total from f join own using (cell) group by 1, 2) group by 1""")
def feature_ablation(t):
    own = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("s_nationkey") % 3 + 1)
    f = t("lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("genome")).agg(F.sum("l_quantity").alias("v"))
    cells = f.join(t("supplier").select(F.col("s_suppkey").alias("cell"), own.alias("own")), "cell").groupBy("cell", "own").agg(F.sum(F.when(F.col("genome") == F.col("own"), F.col("v")).otherwise(0.0)).alias("kept"), F.sum("v").alias("total"))
    return cells.groupBy("own").agg(F.count("*").alias("cells"), F.round(F.sum("kept"), 2).alias("kept"), F.round(F.sum(F.col("total") - F.col("kept")), 2).alias("removed"), F.count_if(F.col("kept") >= 5000).alias("embeddable"))


@query("""with c as (select l_returnflag as grp, l_linestatus as allele, cast(sum(l_linenumber) as bigint) as nm, count(*) as n from lineitem group by 1, 2) select grp, allele, round(nm / greatest(n, 1), 6) as mean_edits, n from c""")
def reference_bias(t):
    c = t("lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("allele")).agg(F.sum("l_linenumber").alias("nm"), F.count("*").alias("n"))
    return c.select("grp", "allele", r6(F.col("nm") / F.greatest("n", F.lit(1))).alias("mean_edits"), "n")


@query("""with base as (select max(p_size) as k, round(avg(p_retailprice), 2) as alpha, min(p_type) as mode from part), o as (select p_brand as name, case when min(p_size) > 1 then min(p_size) end as k, case when count(*) % 2 = 0 then round(avg(p_retailprice), 2) end as alpha, case when max(p_type) like 'S%' then max(p_type) end as mode from part group by 1)
select name, coalesce(o.k, base.k) as k, coalesce(o.alpha, base.alpha) as alpha, coalesce(o.mode, base.mode) as mode from o, base""")
def config_overrides(t):
    price = F.round(F.avg("p_retailprice"), 2)
    base = t("part").agg(F.max("p_size").alias("k"), price.alias("alpha"), F.min("p_type").alias("mode"))
    over = t("part").groupBy(F.col("p_brand").alias("name")).agg(F.when(F.min("p_size") > 1, F.min("p_size")).alias("k"), F.when(F.count("*") % 2 == 0, price).alias("alpha"), F.when(F.max("p_type").like("S%"), F.max("p_type")).alias("mode"))
    return k.overridden(base, over)


@query("""with e as (select user_id, event_type as l, row_number() over (partition by user_id order by ts, event_id) as rn from events), p as (select a.l as l, b.l as nb from e a join e b on a.user_id = b.user_id and b.rn = a.rn + 1), s as (select l, count(*) * 1.0 / (select count(*) from p) as p from p group by 1)
select round(avg(case when l <> nb then 1.0 else 0 end), 6) as mixing, round((select 1 - sum(p * p) from s), 6) as expected, round(avg(case when l <> nb then 1.0 else 0 end) / (select 1 - sum(p * p) from s), 6) as obs_exp from p""")
def neighbour_mixing_ratio(t):
    nb = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    c = t("events").select(F.col("event_type").alias("l"), nb.alias("nb")).filter("nb is not null").groupBy("l").agg(F.count("*").alias("n"), F.count_if(F.col("l") != F.col("nb")).alias("other"))
    a = c.agg(F.sum("n").alias("n"), F.sum("other").alias("other"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    mixing, expected = F.col("other") / F.col("n"), 1 - F.col("sq") / (F.col("n") * F.col("n"))
    return a.select(r6(mixing).alias("mixing"), r6(expected).alias("expected"), r6(F.try_divide(mixing, expected)).alias("obs_exp"))


@query("""with e as (select value as v, count(*) filter (where event_type = 'click') as a, count(*) filter (where event_type = 'purchase') as b from events where event_type in ('click', 'purchase') group by 1), n as (select sum(a) as n, sum(b) as m from e),
c as (select abs(sum(a) over (order by v) / n - sum(b) over (order by v) / m) as d, n, m from e, n), k as (select max(d) as d, any_value(n) as n, any_value(m) as m from c), x as (select d, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d as x from k)
select round(d, 6) as d, round(case when x < 0.2 then 1 else greatest(0, least(1, (select sum((case when i % 2 = 1 then 2.0 else -2.0 end) * exp(-2.0 * i * i * x.x * x.x)) from (select unnest(generate_series(1, 100)) as i)))) end, 6) as p from x""")
def ks_p_value(t):
    from tessera.operators import stats

    e = t("events").filter(F.col("event_type").isin("click", "purchase"))
    n = e.agg(F.count_if(F.col("event_type") == "click").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("m"))
    d = stats.ks_distance(e, "event_type", "value", "click", "purchase").join(F.broadcast(n))
    return d.select(r6("ks_d").alias("d"), r6(stats.ks_p(F.col("ks_d"), F.col("n").cast("double"), F.col("m").cast("double"))).alias("p"))
