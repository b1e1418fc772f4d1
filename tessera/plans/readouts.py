"""Queries over text fields, cascades, readouts of groups, agreement, and run plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import keyed as k
from tessera.operators import readouts as ro
from tessera.plans.base import query, r6


@query("select p_partkey, row_number() over (order by p_brand, p_partkey) as place from (select * from part order by p_retailprice desc, p_partkey limit 200)")
def top_then_position(t):
    top = t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(200)
    # 200 rows at most: one task for the numbers is the right size.
    return top.select("p_partkey", F.row_number().over(Window.orderBy("p_brand", "p_partkey")).alias("place"))


@query("""select c_mktsegment, c_custkey, nth from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by case when c_nationkey = 7 then 0 when c_nationkey < 5 then 1 else 2 end, c_acctbal desc, c_custkey) as nth from customer) where nth <= 10""")
def priority_rank_capped(t):
    first = F.when(F.col("c_nationkey") == 7, 0).when(F.col("c_nationkey") < 5, 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(first, F.desc("c_acctbal"), "c_custkey"))
    return t("customer").withColumn("nth", nth).filter("nth <= 10").select("c_mktsegment", "c_custkey", "nth")


@query("""with l as (select distinct case when c_nationkey % 3 = 0 then 'n' || c_nationkey else cast(c_nationkey as varchar) end as label from customer) select label, row_number() over (order by try_cast(label as int) nulls last, label) as ord from l""")
def numeric_label_order(t):
    label = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("n"), F.col("c_nationkey"))).otherwise(F.col("c_nationkey").cast("string"))
    return ro.label_order(t("customer").select(label.alias("label")).distinct(), "label")


@query("""with s as (select p_size, avg(p_retailprice) as score, count(*) as n from part group by 1), b as (select max(score) as best from s) select p_size, round(score, 6) as score from s, b where score >= best - 20 order by n desc, p_size limit 1""")
def near_best_fewest(t):
    s = t("part").groupBy("p_size").agg(F.avg("p_retailprice").alias("score"), F.count("*").alias("n"))
    best = s.agg(F.max("score").alias("best"))
    return s.join(F.broadcast(best)).filter(F.col("score") >= F.col("best") - 20).orderBy(F.desc("n"), "p_size").limit(1).select("p_size", r6("score").alias("score"))


@query("with m as (select p_brand, median(p_retailprice) as m from part group by 1) select p_brand, row_number() over (order by m desc, p_brand) as ord from m")
def factor_order(t):
    m = t("part").groupBy("p_brand").agg(F.median("p_retailprice").alias("m"))
    return m.select("p_brand", F.row_number().over(Window.orderBy(F.desc("m"), "p_brand")).alias("ord"))


@query("""with c as (select l_returnflag as f, l_linestatus as s, count(*) as n from lineitem group by 1, 2) select series, f, cast(sum(n) as bigint) as n from
(select s as series, f, n from c where f <> 'A' union all select unnest(['O', 'F']), f, n from c where f = 'A') group by 1, 2""")
def replicated_baseline(t):
    c = t("lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.count("*").alias("n"))
    base = c.filter("f = 'A'").select(F.explode(F.array(F.lit("O"), F.lit("F"))).alias("series"), "f", "n")
    return c.filter("f <> 'A'").select(F.col("s").alias("series"), "f", "n").unionByName(base).groupBy("series", "f").agg(F.sum("n").alias("n"))


@query("""select feature, cell, cast(sum(v) as bigint) as v from (select 'o_' || o_orderpriority as feature, o_custkey as cell, 1 as v from orders union all select 'e_' || event_type, user_id, 1 from events) group by 1, 2""")
def block_diagonal_union(t):
    o = t("orders").select(F.concat(F.lit("o_"), "o_orderpriority").alias("feature"), F.col("o_custkey").alias("cell"))
    e = t("events").select(F.concat(F.lit("e_"), "event_type").alias("feature"), F.col("user_id").alias("cell"))
    return o.unionByName(e).groupBy("feature", "cell").agg(F.count("*").alias("v"))


@query("""select p_partkey, metric, round(value, 6) as value from (select p_partkey, cast(p_size as double) as p_size, p_retailprice from part) unpivot (value for metric in (p_size, p_retailprice))""")
def melted_parts(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot(["p_partkey"], ["p_size", "p_retailprice"], "metric", "value").withColumn("value", r6("value"))


@query("""select o_orderpriority as key, o_orderstatus as st, (select count(distinct o_orderpriority) * count(distinct o_orderstatus) from orders) = (select count(*) from (select distinct o_orderpriority, o_orderstatus from orders)) as complete, count(*) as n from orders group by 1, 2""")
def grid_completeness(t):
    return ro.grid_complete(t("orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("st")), "key", "st")


@query("""select c_custkey, length(c_name) - length(replace(c_name, '0', '')) as zeros, length(c_name) - length(replace(c_name, '0', '')) <= 6 as kept, regexp_replace(c_name, '0', 'N') as renamed from customer""")
def count_gate_and_rewrite(t):
    zeros = ro.letter_count("c_name", "0")
    return t("customer").select("c_custkey", zeros.alias("zeros"), (zeros <= 6).alias("kept"), ro.replace_first("c_name", "0", "N").alias("renamed"))


@query("""with s as (select p_partkey, string_split(p_type || '_' || p_brand || '_x', '_') as a from (select p_partkey, replace(p_type, ' ', '_') as p_type, p_brand from part)) select p_partkey, case when len(a) >= 4 then a[-3] end as well from s""")
def field_from_end(t):
    text = F.concat_ws("_", F.regexp_replace("p_type", " ", "_"), "p_brand", F.lit("x"))
    return t("part").select("p_partkey", ro.field_from_end(text, "_", 3, 4).alias("well"))


@query("""with u as (select user_id, avg(value) as m, stddev_samp(value) as s, count(*) as n from events group by 1), tau as (select median(s) as t from u)
select user_id, case when n < 40 then 'few' when s is null then 'unknown' when s > t * 1.1 then 'noisy' when m > t then 'high' else 'quiet' end as regime from u, tau""")
def noise_regimes(t):
    u = t("events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("n"))
    tau = F.broadcast(u.agg(F.median("s").alias("t")))
    regime = F.when(F.col("n") < 40, "few").when(F.col("s").isNull(), "unknown").when(F.col("s") > F.col("t") * 1.1, "noisy").when(F.col("m") > F.col("t"), "high").otherwise("quiet")
    return u.join(tau).select("user_id", regime.alias("regime"))


RECODE = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow", "5-LOW": "slow"}


@query("""select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'fast' else 'slow' end as lane, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') group by 1""")
def recode_with_drop(t):
    return ro.recode(t("orders"), "o_orderpriority", RECODE, "lane").groupBy("lane").agg(F.count("*").alias("n"))


@query("""with m as (select l_partkey, min(l_suppkey) as to_id from lineitem where l_quantity >= 49 group by 1 having count(distinct l_suppkey) = 1) select p_partkey, to_id from part join m on l_partkey = p_partkey""")
def one_to_one_lift(t):
    m = t("lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("to_id"))
    return t("part").select("p_partkey").join(ro.single_targets(m, "p_partkey", "to_id"), "p_partkey")


@query("""select l_orderkey, l_linenumber, least(l_quantity * (1 - l_discount), l_quantity * (1 - l_tax)) as power from lineitem where least(l_quantity * (1 - l_discount), l_quantity * (1 - l_tax)) >= 45""")
def discriminative_power(t):
    power = F.least(F.col("l_quantity") * (1 - F.col("l_discount")), F.col("l_quantity") * (1 - F.col("l_tax")))
    return t("lineitem").select("l_orderkey", "l_linenumber", power.alias("power")).filter("power >= 45")


@query("""with n as (select l_suppkey, count(*) as n from lineitem group by 1), a as (select unnest([0.05, 0.1, 0.25, 0.5]) as alpha) select l_suppkey, alpha, cast(round_even(n * alpha / (1 - alpha), 0) as bigint) as mix from n, a""")
def mixing_counts(t):
    n = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return ro.mixing_counts(n, "n", [0.05, 0.1, 0.25, 0.5]).select("l_suppkey", "alpha", "mix")


@query("""select p_partkey, format('{:,}', cast(p_partkey * 1000 as bigint)) as comma, printf('%.1f%%', p_size * 1.3) as pct, case when p_size > 25 then '+' else '' end || printf('%d', p_size - 25) as signed from part""")
def number_labels(t):
    signed = F.concat(F.when(F.col("p_size") > 25, "+").otherwise(""), (F.col("p_size") - 25).cast("string"))
    return t("part").select("p_partkey", F.format_number(F.col("p_partkey") * 1000, 0).alias("comma"), F.format_string("%.1f%%", F.col("p_size") * 1.3).alias("pct"), signed.alias("signed"))


@query("select date_trunc('month', o_orderdate) as month, o_orderstatus, count(*) as n, strftime(max(o_orderdate), '%Y%m%d') as last_tag from orders group by 1, 2")
def monthly_tags(t):
    o = t("orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), "o_orderstatus")
    return o.agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("last_tag"))


@query("""select event_type, cast(json_extract_string(props, '$.k') as int) as k, json_extract_string(props, '$.absent') as absent, count(*) as n from events group by all""")
def json_fields(t):
    field = F.from_json("props", "k int, absent string")
    return t("events").select("event_type", field.alias("j")).groupBy("event_type", F.col("j.k").alias("k"), F.col("j.absent").alias("absent")).agg(F.count("*").alias("n"))


@query("""with p as (select l_suppkey as mc, l_partkey as g, sum(l_quantity) as v from lineitem group by 1, 2), tot as (select mc, sum(v) as total from p group by 1), m as (select avg(total) as mean from tot)
select mc, g, round(v / total * mean, 6) as scaled from p join tot using (mc), m""")
def pooled_rescale(t):
    p = t("lineitem").groupBy(F.col("l_suppkey").alias("mc"), F.col("l_partkey").alias("g")).agg(F.sum("l_quantity").alias("v"))
    tot = p.groupBy("mc").agg(F.sum("v").alias("total"))
    return p.join(tot, "mc").join(F.broadcast(tot.agg(F.avg("total").alias("mean")))).select("mc", "g", r6(F.col("v") / F.col("total") * F.col("mean")).alias("scaled"))


@query("select user_id, count(*) as n from events group by 1 having count(*) >= 50")
def frequent_keys(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 50")


@query("select l_suppkey, count(*) filter (where l_returnflag = 'N') as nuclear, count(*) filter (where l_returnflag = 'A') as pt, count(*) filter (where l_returnflag = 'R') as mt from lineitem group by 1")
def class_counts_by_key(t):
    n = lambda x: F.count_if(F.col("l_returnflag") == x)
    return t("lineitem").groupBy("l_suppkey").agg(n("N").alias("nuclear"), n("A").alias("pt"), n("R").alias("mt"))


@query("""select l_partkey, l_suppkey as best from (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn = 1""")
def best_keep_first(t):
    best = F.min_by("l_suppkey", F.struct(-F.col("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return t("lineitem").groupBy("l_partkey").agg(best.alias("best"))


@query("""with s as (select l_partkey, l_returnflag as stage, avg(l_discount) as v from lineitem group by 1, 2), e as (select l_partkey, min(v) as lo, max(v) as hi, count(*) as n from s group by 1)
select s.l_partkey, stage, round(case when hi <= lo then 0 else (v - lo) / (hi - lo) end, 6) as scaled, hi <= lo as flat from s join e using (l_partkey)""")
def extrema_over_stages(t):
    # Averages may be equal but for rounding, so they are summed in one order, that of the table's key, however the rows are dealt.
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.coalesce("l_discount", F.lit(0.0)).alias("x"))))
    mean = F.try_divide(F.aggregate(rows, F.lit(0.0), lambda total, r: total + r["x"]), F.count("l_discount"))
    s = t("lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("stage")).agg(mean.alias("v"))
    w = Window.partitionBy("l_partkey")
    return k.scaled(s, "v", ["l_partkey"]).select("l_partkey", "stage", r6("scaled").alias("scaled"), (F.max("v").over(w) <= F.min("v").over(w)).alias("flat"))


@query("""with c as (select user_id as mc, event_type as label, count(*) as n from events group by 1, 2), r as (select mc, arg_max(label, (n, label)) as modal, max(n) as top, sum(n) as total, sum(n) filter (where label = 'click') as own from c group by 1)
select mc, modal, round(top / total, 6) as modal_share, round(coalesce(own, 0) / total, 6) as support from r""")
def seed_support(t):
    return ro.label_support(t("events").select(F.col("user_id").alias("mc"), F.col("event_type").alias("label")), "mc", "label", F.lit("click")).select("mc", "modal", r6("modal_share").alias("modal_share"), r6("support").alias("support"))


@query("""with c as (select o_orderstatus as type, l_orderkey, count(*) as depth from lineitem join orders on o_orderkey = l_orderkey group by 1, 2) select type, count(*) as n, min(depth) as lo, max(depth) as hi, cast(sum(depth) as bigint) as reads from c group by 1""")
def depth_tallies(t):
    c = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("depth")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return c.groupBy(F.col("o_orderstatus").alias("type")).agg(F.count("*").alias("n"), F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.sum("depth").alias("reads"))


@query("""with b as (select sum(case when l_returnflag = 'R' then 1 else 0 end) * 1.0 / count(*) as base, sum(case when l_returnflag = 'R' then 1 else 0 end) as all_r from lineitem), c as (select l_suppkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as r from lineitem group by 1)
select l_suppkey, round(r / n, 6) as frac, round(r / n / base, 6) as enrichment, round(r * 1.0 / all_r, 6) as captured, case when r / n >= 0.35 then round(r * 1.0 / all_r, 6) end as captured_above from c, b""")
def contamination_profile(t):
    c = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    b = F.broadcast(c.agg((F.sum("r") / F.sum("n")).alias("base"), F.sum("r").alias("all_r")))
    frac, captured = F.col("r") / F.col("n"), F.try_divide(F.col("r"), F.col("all_r"))
    return c.join(b).select("l_suppkey", r6(frac).alias("frac"), r6(F.try_divide(frac, F.col("base"))).alias("enrichment"), r6(captured).alias("captured"), F.when(frac >= 0.35, r6(captured)).alias("captured_above"))


@query("""with a as (select user_id as id, arg_max(event_type, (ts, event_id)) as l from events group by 1), b as (select user_id as id, arg_min(event_type, (ts, event_id)) as l from events where user_id % 5 <> 0 group by 1)
select coalesce(a.l, '(new)') as from_label, coalesce(b.l, '(dropped)') as to_label, count(*) as n, count(*) filter (where a.l <> b.l) as movers from a full join b on a.id = b.id group by 1, 2""")
def label_flow(t):
    at = F.struct("ts", "event_id")
    a = t("events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", at).alias("l"))
    b = t("events").filter("user_id % 5 <> 0").groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", at).alias("l"))
    return ro.label_flow(a, b, "id", "l")


@query("""with x as (select l_partkey as p, avg(l_discount) as x, avg(l_tax) as y, l_returnflag as g from lineitem group by 1, 4) select g, count(*) as n, round(case when stddev_samp(x) > 0 and stddev_samp(y) > 0 then corr(x, y) end, 6) as r from x group by 1""")
def guarded_pearson(t):
    x = t("lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("g")).agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    return ro.guarded_corr(x, ["g"], "x", "y").select("g", "n", r6("r").alias("r"))


@query("""with a as (select l_suppkey as grp, l_returnflag as founder, count(*) filter (where l_linestatus = 'O') as same, count(*) as n from lineitem group by 1, 2), c as (select grp, founder, same / n as conc from a),
r as (select *, row_number() over (partition by grp order by conc desc, founder) as rn from c)
select grp, max(founder) filter (where rn = 1) as best, round(max(conc) filter (where rn = 1) - max(conc) filter (where rn = 2), 6) as margin, round(max(conc) filter (where founder = 'N'), 6) as self, max(founder) filter (where rn = 1) = 'N' as correct from r group by 1""")
def concordance_best(t):
    a = t("lineitem").groupBy(F.col("l_suppkey").alias("grp"), F.col("l_returnflag").alias("founder")).agg((F.count_if(F.col("l_linestatus") == "O") / F.count("*")).alias("conc"))
    return ro.best_and_margin(a, "grp", "founder", "conc", F.lit("N")).select("grp", "best", r6("margin").alias("margin"), r6("self").alias("self"), "correct")


@query("""with a as (select l_suppkey as g, arg_max(l_returnflag, (q, l_returnflag)) as top from (select l_suppkey, l_returnflag, sum(l_quantity) as q from lineitem group by 1, 2) group by 1),
b as (select l_suppkey as g, arg_max(l_returnflag, (q, l_returnflag)) as top from (select l_suppkey, l_returnflag, count(*) as q from lineitem group by 1, 2) group by 1)
select count(*) as n, count(*) filter (where a.top = b.top) as agree, round(count(*) filter (where a.top = b.top) / count(*), 6) as share from a join b using (g)""")
def argmax_agreement(t):
    top = lambda v: t("lineitem").groupBy(F.col("l_suppkey").alias("g"), "l_returnflag").agg(v.alias("q")).groupBy("g").agg(F.max_by("l_returnflag", F.struct("q", "l_returnflag")).alias("top"))
    same = F.count_if(F.col("a") == F.col("b"))
    both = top(F.sum("l_quantity")).withColumnRenamed("top", "a").join(top(F.count("*")).withColumnRenamed("top", "b"), "g")
    return both.agg(F.count("*").alias("n"), same.alias("agree"), r6(same / F.count("*")).alias("share"))


@query("""with d as (select case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end as bin, l_returnflag as st, l_orderkey from lineitem), a as (select bin, st, l_orderkey from d union all select 'all', st, l_orderkey from d)
select bin, st, count(*) as n, count(distinct l_orderkey) as orders from a group by 1, 2""")
def depth_bin_stages(t):
    d = t("lineitem").select(F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 30, "mid").otherwise("high").alias("bin"), F.col("l_returnflag").alias("st"), "l_orderkey")
    # Each row once for its bin and once for the subtotal, in one pass.
    both = d.withColumn("bin", F.explode(F.array("bin", F.lit("all"))))
    return both.groupBy("bin", "st").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("""with g as (select row_number() over (order by r_regionkey) - 1 as i, r_name from region), n as (select count(*) as n from region) select s_suppkey, s_suppkey // n as panel, r_name from supplier, n, g where g.i = s_suppkey % n""")
def factorial_tasks(t):
    names = t("region").select(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("g"))
    return ro.decoded_tasks(t("supplier").select("s_suppkey", F.col("s_suppkey").alias("task")), names, "task").select("s_suppkey", "panel", F.col("item.r_name").alias("r_name"))


@query("""with c as (select count(*) as n from customer), r as (select unnest(generate_series(0, 6)) as task) select task, task * ((n + 6) // 7) as first, least(n, (task + 1) * ((n + 6) // 7)) as last from r, c""")
def range_split(t):
    return ro.range_split(t("customer"), 7)


@query("""select event_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from events group by 1""")
def class_tally(t):
    return ro.tally(t("events"), "event_type").withColumn("pct", r6("pct"))


@query("""with l as (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select user_id, count(*) as records, count(*) filter (where p is distinct from event_type) as runs, count(distinct event_type) as kinds from l group by 1""")
def collapse_signature(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    l = t("events").withColumn("p", F.lag("event_type").over(w))  # noqa: E741
    return l.groupBy("user_id").agg(F.count("*").alias("records"), F.count_if(~F.col("p").eqNullSafe(F.col("event_type"))).alias("runs"), F.count_distinct("event_type").alias("kinds"))


@query("""select l_partkey, min(l_orderkey) as lo, max(l_orderkey) as hi, count(distinct l_suppkey) as members, arg_min(l_returnflag, (l_orderkey, l_linenumber)) as first_flag from lineitem group by 1""")
def interval_hull(t):
    li = t("lineitem")
    return li.groupBy("l_partkey").agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.count_distinct("l_suppkey").alias("members"), F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber")).alias("first_flag"))


@query("select label, axis, round(median(v), 5) as centre from (select label, unnest(generate_series(0, 3)) as axis, unnest(embedding[1:4]) as v from embeddings) group by 1, 2")
def centroid_medians(t):
    e = t("embeddings").select("label", F.posexplode(F.slice("embedding", 1, 4)).alias("axis", "v"))
    return e.groupBy("label", F.col("axis").cast("long").alias("axis")).agg(F.round(F.median(F.col("v").cast("double")), 5).alias("centre"))


@query("""with q as (select l_suppkey, l_partkey, sum(l_quantity) as v from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by v desc, l_partkey) as rn from q)
select l_suppkey, round(avg(v) filter (where rn <= 5), 6) as score from r group by 1 having count(*) >= 5""")
def top_types_by_best(t):
    q = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
    enough = q.groupBy("l_suppkey").count().filter("count >= 5").select("l_suppkey")
    return k.mean_of_top(q, ["l_suppkey"], "v", 5).join(enough, "l_suppkey").select("l_suppkey", r6("mean_top").alias("score"))


@query("""with c as (select o_custkey, count(*) as n, sum(o_totalprice) as s from orders group by 1), r as (select c_custkey, c_nationkey from customer) select c_nationkey, count(*) as customers, count(n) as with_orders, cast(coalesce(sum(n), 0) as bigint) as orders, count(*) filter (where n is null) as missing from r left join c on o_custkey = c_custkey group by 1""")
def reconciled_counts(t):
    c = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    j = t("customer").join(c, "c_custkey", "left")
    return j.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count("n").alias("with_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.count_if(F.col("n").isNull()).alias("missing"))


@query("""with r as (select user_id, min(value) as lo, max(value) as hi from events group by 1), s as (select user_id, min(value) as lo, max(value) as hi from events where event_type <> 'error' group by 1)
select count(*) as n, count(*) filter (where abs(r.lo - s.lo) <= 1e-9 and abs(r.hi - s.hi) <= 1e-9) as same from r left join s using (user_id)""")
def stored_range_check(t):
    rng = lambda df, x: df.groupBy("user_id").agg(F.min("value").alias(f"lo_{x}"), F.max("value").alias(f"hi_{x}"))
    j = rng(t("events"), "r").join(rng(t("events").filter("event_type <> 'error'"), "s"), "user_id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if((F.abs(F.col("lo_r") - F.col("lo_s")) <= 1e-9) & (F.abs(F.col("hi_r") - F.col("hi_s")) <= 1e-9)).alias("same"))


@query("""with g as (select p_partkey, p_size * 10 as a, p_size * 10 + cast(floor(p_retailprice) as int) as b from part) select p_partkey, greatest(0, a - 50) as first, b + 50 as last, greatest(300, least(2000, (b + 50 - greatest(0, a - 50)) // 3)) as bins from g""")
def padded_regions(t):
    g = t("part").select("p_partkey", (F.col("p_size") * 10).alias("a"), (F.col("p_size") * 10 + F.floor("p_retailprice").cast("int")).alias("b"))
    return ro.padded(g, "a", "b", 50, 3).select("p_partkey", "first", "last", "bins")


@query("""with c as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2), x as (select sum(n) as t from c), r as (select l_suppkey, sum(n) as rn from c group by 1), k as (select l_returnflag, sum(n) as kn from c group by 1)
select round(sum(n / t * ln(n * t / (rn * kn))), 6) as mi from c join r using (l_suppkey) join k using (l_returnflag), x""")
def mutual_information(t):
    c = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return ro.mutual_information(c, "l_suppkey", "l_returnflag", "n").select(r6("mi").alias("mi"))
