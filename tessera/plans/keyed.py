"""Queries over shims, gates, joins, summaries and orders by keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import keyed as k
from tessera.operators.ordered import numbered
from tessera.plans.base import query, r6


@query("select o_orderkey as key, o_orderstatus as call, o_totalprice as total, o_totalprice * 0.1 as margin, case when o_orderstatus = 'F' then 1 else 0 end as done from orders")
def schema_shim(t):
    df = k.rename_present(t("orders"), {"o_orderkey": "key", "orderkey": "key", "o_orderstatus": "call", "o_totalprice": "total"})
    df = k.derive_missing(df, margin=F.col("total") * 0.1, total=F.lit(0.0), done=(F.col("call") == "F").cast("int"))
    return df.select("key", "call", "total", "margin", "done")


@query("""select p_partkey, metric, round(case metric when 'p_size' then log10(p_size + 1) when 'p_retailprice' then p_retailprice else p_partkey * 100.0 end, 6) as value
from part cross join (values ('p_size'), ('p_retailprice'), ('code')) m(metric)""")
def spec_transform(t):
    df = t("part").select("p_partkey", "p_size", "p_retailprice", F.col("p_partkey").alias("code"))
    return k.transform_by_spec(df, ["p_partkey"], {"p_size": "log10p1", "p_retailprice": "identity", "code": "percent"}).withColumn("value", r6("value"))


@query("select o_orderstatus || '_' || cast(o_custkey // 100 as varchar) as block, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def block_rollup(t):
    block = F.concat_ws("_", "o_orderstatus", F.floor(F.col("o_custkey") / 100))
    return t("orders").groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select source, count(*) as n, count(amount) as n_amount, round(sum(amount), 2) as amount from
(select 'orders' as source, o_custkey as id, o_totalprice as amount from orders union all select 'customer', c_custkey, c_acctbal from customer union all select 'events', user_id, null from events) group by 1""")
def tagged_sources(t):
    frames = {
        "orders": t("orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount")),
        "customer": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")),
        "events": t("events").select(F.col("user_id").alias("id")),
    }
    return k.tagged_union(frames, "source").groupBy("source").agg(F.count("*").alias("n"), F.count("amount").alias("n_amount"), F.round(F.sum("amount"), 2).alias("amount"))


@query("""with b as (select p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g') as bare from part)
select p_partkey, case when count(*) over (partition by bare) > 1 then bare || '_' || row_number() over (partition by bare order by p_partkey) else bare end as safe from b""")
def safe_part_names(t):
    return k.safe_names(t("part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "safe")


@query("""select p_partkey, round(case when max(p_retailprice) over w <= min(p_retailprice) over w then 0 else (p_retailprice - min(p_retailprice) over w) / (max(p_retailprice) over w - min(p_retailprice) over w) end, 6) as scaled
from part window w as (partition by p_brand, p_size)""")
def scaled_prices(t):
    return k.scaled(t("part"), "p_retailprice", ["p_brand", "p_size"]).select("p_partkey", r6("scaled").alias("scaled"))


@query("""with c as (select l_orderkey, count(*) as n from lineitem group by 1) select o_orderstatus, count(*) as orders, cast(sum(n) as bigint) as reads from orders join c on o_orderkey = l_orderkey
where o_orderstatus = 'P' or n >= 4 group by 1""")
def floor_by_class(t):
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    kept = t("orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).filter((F.col("o_orderstatus") == "P") | (F.col("n") >= 4))
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("n").alias("reads"))


@query("select user_id, count(*) as n, round(avg(value), 6) as mean from events where user_id in (select user_id from events group by 1 having count(*) >= 60) group by 1")
def large_user_groups(t):
    return k.large_groups(t("events"), ["user_id"], 60).groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("""select s_suppkey, s_name, cast(regexp_extract(s_name, '([0-9]+)', 1) as int) as num from supplier where regexp_matches(s_name, '^Supplier') and cast(regexp_extract(s_name, '([0-9]+)', 1) as int) between 1 and 500 and length(s_name) > 5""")
def regex_range_filter(t):
    num = F.regexp_extract("s_name", "([0-9]+)", 1).try_cast("int")
    return t("supplier").filter(F.col("s_name").rlike("^Supplier") & num.between(1, 500) & (F.length("s_name") > 5)).select("s_suppkey", "s_name", num.alias("num"))


@query("""with n as (select l_partkey, count(distinct l_suppkey) as cells from lineitem group by 1), m as (select count(distinct l_suppkey) as c from lineitem), th as (select unnest([0.0, 0.05, 0.1, 0.2, 0.3]) as frac)
select frac, count(*) filter (where cells >= greatest(5, frac * c)) as kept, count(*) as features from n cross join m cross join th group by 1""")
def detection_sweep(t):
    li = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    n = li.groupBy("l_partkey").agg(F.count("*").alias("cells"))
    cells = li.agg(F.count_distinct("l_suppkey").alias("c"))
    per = n.groupBy("cells").agg(F.count("*").alias("features")).join(F.broadcast(cells)).withColumn("frac", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.05, 0.1, 0.2, 0.3)])))
    kept = F.sum(F.when(F.col("cells") >= F.greatest(F.lit(5.0), F.col("frac") * F.col("c")), F.col("features")).otherwise(0))
    return per.groupBy("frac").agg(kept.alias("kept"), F.sum("features").alias("features"))


@query("""select p_brand, count(*) as n, round(max(p_retailprice), 2) as top from part where not regexp_matches(p_type, '(?i)brass') and p_brand in (select p_brand from part where not regexp_matches(p_type, '(?i)brass') group by 1 having count(*) >= 20) group by 1""")
def eligible_types(t):
    p = t("part").filter(~F.col("p_type").rlike("(?i)brass"))
    return k.large_groups(p, ["p_brand"], 20).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.max("p_retailprice"), 2).alias("top"))


@query("""with q as (select p_brand, quantile_cont(p_retailprice, 0.75) as cut from part group by 1) select p_partkey, p.p_brand, round(cut, 6) as cut from part p join q on p.p_brand = q.p_brand
where p_size > 10 and p_retailprice <= cut and p_type like '%E%'""")
def compound_gate(t):
    cut = t("part").groupBy("p_brand").agg(F.percentile("p_retailprice", F.lit(0.75)).alias("cut"))
    return t("part").join(cut, "p_brand").filter((F.col("p_size") > 10) & (F.col("p_retailprice") <= F.col("cut")) & F.col("p_type").like("%E%")).select("p_partkey", "p_brand", r6("cut").alias("cut"))


@query("select c_custkey, o_orderkey, o_totalprice from (select distinct c_custkey from customer) left join orders on o_custkey = c_custkey")
def lookup_keeps_absent(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return k.lookup_all(t("customer").select("c_custkey").distinct(), o, "c_custkey")


@query("""with e as (select event_type, count(*) as n from events group by 1) select lower(e.event_type) as key, n, count(o_orderkey) as orders from e left join
(select o_orderkey, regexp_replace(case when o_orderpriority like '1%' then 'click-x' when o_orderpriority like '2%' then 'view-y-z' else 'other' end, '-.*$', '') as p from orders) on p = lower(e.event_type) group by all""")
def normalised_key_join(t):
    word = F.when(F.col("o_orderpriority").startswith("1"), "click-x").when(F.col("o_orderpriority").startswith("2"), "view-y-z").otherwise("other")
    o = t("orders").select("o_orderkey", F.regexp_replace(word, "-.*$", "").alias("key"))
    e = t("events").groupBy(F.lower("event_type").alias("key")).agg(F.count("*").alias("n"))
    # Orders are counted before they meet the few types.
    return e.join(o.groupBy("key").agg(F.count("*").alias("orders")), "key", "left").select("key", "n", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("select o_orderkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def checked_lookup(t):
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return k.checked_join(t("orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).drop("o_custkey")


@query("""with a as (select user_id as k, count(*) as na from events group by 1), u as (select o_custkey as k, max(o_totalprice) as top, count(*) as c from orders where o_orderstatus = 'P' and o_orderpriority like '1%' group by 1 having count(*) = 1)
select u.k, na, round(top, 2) as top from u join a on a.k = u.k""")
def unique_keys_inner(t):
    a = t("events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("na"))
    b = t("orders").filter("o_orderstatus = 'P' and o_orderpriority like '1%'").select(F.col("o_custkey").alias("k"), F.round("o_totalprice", 2).alias("top"))
    return k.unique_inner([a, b], "k")


@query("""with s as (select distinct user_id as k from events intersect select distinct o_custkey from orders intersect select c_custkey from customer where c_acctbal > 0)
select 'events' as source, count(*) as n from events where user_id in (from s) union all select 'orders', count(*) from orders where o_custkey in (from s) union all select 'customer', count(*) from customer where c_acctbal > 0 and c_custkey in (from s)""")
def aligned_tables(t):
    frames = {"events": t("events").select(F.col("user_id").alias("k")), "orders": t("orders").select(F.col("o_custkey").alias("k")), "customer": t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))}
    return k.tagged_union(dict(zip(frames, k.aligned(list(frames.values()), "k"), strict=True)), "source").groupBy("source").agg(F.count("*").alias("n"))


@query("""with b as (select o_custkey, round(max(o_totalprice), 2) as top from orders group by 1) select c_custkey, case when o_custkey is not null then top else c_acctbal end as amount, o_custkey is not null as from_b from customer left join b on o_custkey = c_custkey""")
def grafted_amounts(t):
    b = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("amount"))
    return k.graft(t("customer").select("c_custkey", F.col("c_acctbal").alias("amount")), b, "c_custkey", ["amount"])


@query("""with a as (select l_suppkey, count(*) as n, round(avg(l_discount), 6) as d from lineitem where l_linestatus = 'O' group by 1), b as (select l_suppkey, count(*) as n, round(avg(l_discount), 6) as d from lineitem where l_linestatus <> 'O' group by 1)
select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, a.n as n_pre, a.d as d_pre, b.n as n_post, b.d as d_post from a full join b on a.l_suppkey = b.l_suppkey""")
def suffix_merged(t):
    one = t("lineitem").withColumn("open", F.col("l_linestatus") == "O").groupBy("l_suppkey", "open").agg(F.count("*").alias("n"), r6(F.avg("l_discount")).alias("d"))
    return k.suffix_merge(one.filter("open"), one.filter("not open"), "l_suppkey", ["n", "d"])


@query("""with a as (select s_nationkey as k, s_acctbal as pos, s_suppkey as anchor from supplier) select c_custkey, (select anchor from a where a.k = c_nationkey order by abs(pos - c_acctbal), pos limit 1) as anchor,
(select min(round(abs(pos - c_acctbal), 6)) from a where a.k = c_nationkey) as distance from customer""")
def nearest_supplier(t):
    a = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("at"), F.col("s_suppkey").alias("anchor"))
    p = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("at"))
    return k.nearest_anchor(p, a, "k", "at", "anchor").select("c_custkey", "anchor", r6("distance").alias("distance"))


@query("""select s_suppkey, r_name, row_number() over (order by s_suppkey, r_name) - 1 as task from supplier cross join region""")
def run_plan(t):
    # Wells by genomes: the second side is a fixed short list of regions; wells are numbered range by range.
    names = t("region").select(F.array_sort(F.collect_list("r_name")).alias("names"))
    wells = numbered(t("supplier").select("s_suppkey"), ["s_suppkey"], "well")
    rank = wells.join(F.broadcast(names)).select("s_suppkey", "well", F.size("names").alias("g"), F.posexplode("names").alias("pos", "r_name"))
    return rank.select("s_suppkey", "r_name", (F.col("well") * F.col("g") + F.col("pos")).alias("task"))


@query("""with c as (select c_mktsegment as seg, o_orderstatus as st, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2) select seg, st, n, round(n / (select sum(n) from c c2 where c2.seg = c.seg and st = 'O'), 6) as share from c""")
def share_of_open(t):
    c = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_orderstatus").alias("st")).agg(F.count("*").alias("n"))
    return k.share_of_reference(c, ["seg"], "st", "O", "n").withColumn("share", r6("share"))


@query("""with c as (select c_mktsegment as seg, c_nationkey as nation, count(*) as n from customer group by 1, 2) select seg, nation, cast(sum(n) over w - n as bigint) as band_from, cast(sum(n) over w as bigint) as band_to from c window w as (partition by seg order by nation)""")
def flow_bands(t):
    c = t("customer").groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return k.bands(c, ["seg"], [F.col("nation")], "n").select("seg", "nation", "band_from", "band_to")


@query("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as duplicated from events")
def first_occurrence(t):
    return k.first_flags(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "duplicated")


@query("""with bg as (select s_nationkey as k, s_acctbal as c, s_suppkey as v from supplier), p as (select c_custkey, c_nationkey as k, c_acctbal as c, c_custkey % 100 as v from customer),
near as (select c_custkey, p.v as pv, bg.v as bv, row_number() over (partition by c_custkey order by bg.c desc) as rn from p join bg on bg.k = p.k and bg.c <= p.c)
select p.c_custkey, round((count(*) filter (where bv < pv and rn <= 3) + count(*) filter (where bv <= pv and rn <= 3)) / nullif(2.0 * count(*) filter (where rn <= 3), 0), 6) as local_rank, count(*) filter (where rn <= 3) as n_background from p left join near on near.c_custkey = p.c_custkey group by 1""")
def local_rank_window(t):
    bg = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("c"), F.col("s_suppkey").alias("v"))
    p = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("c"), (F.col("c_custkey") % 100).alias("v"))
    return k.local_rank(p, bg, "k", "c", "v", 3).select("c_custkey", r6("local_rank").alias("local_rank"), F.col("n_background").cast("long").alias("n_background"))


METRICS_SQL = """round(ok_strict / nullif(n_truth, 0), 6) as sens_strict, round(ok_strict / nullif(n_strict, 0), 6) as prec_strict, round(2.0 * ok_strict / nullif(n_truth + n_strict, 0), 6) as f1_strict,
round(ok_relaxed / nullif(n_truth, 0), 6) as sens_relaxed, round(ok_relaxed / nullif(n_relaxed, 0), 6) as prec_relaxed, round(2.0 * ok_relaxed / nullif(n_truth + n_relaxed, 0), 6) as f1_relaxed"""
CALLS_SQL = """select o_orderstatus as st, o_orderpriority as pr, o_totalprice > 100000 as truth, l_returnflag = 'A' as strict, l_returnflag in ('A', 'R') as relaxed, l_linenumber <= 3 as correct from lineitem join orders on o_orderkey = l_orderkey"""
COUNTS_SQL = "count(*) filter (where truth) as n_truth, count(*) filter (where strict) as n_strict, count(*) filter (where relaxed) as n_relaxed, count(*) filter (where truth and strict and correct) as ok_strict, count(*) filter (where truth and relaxed and correct) as ok_relaxed"


def _calls(t):
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), (F.col("o_totalprice") > 100000).alias("truth"), (F.col("l_returnflag") == "A").alias("strict"), F.col("l_returnflag").isin("A", "R").alias("relaxed"), (F.col("l_linenumber") <= 3).alias("correct"))


RATES = ["sens_strict", "prec_strict", "f1_strict", "sens_relaxed", "prec_relaxed", "f1_relaxed"]


@query(f"with c as ({CALLS_SQL}), s as (select st, {COUNTS_SQL} from c group by 1) select st, n_truth, {METRICS_SQL} from s")
def factorial_metrics(t):
    c = [F.col(x) for x in ("truth", "strict", "relaxed", "correct")]
    return k.call_metrics(_calls(t), ["st"], *c).select("st", "n_truth", *[r6(x).alias(x) for x in RATES])


@query(f"with c as ({CALLS_SQL}), s as (select st, pr, {COUNTS_SQL} from c group by 1, 2) select st, pr, n_truth, {METRICS_SQL} from s")
def factorial_metrics_by_bin(t):
    c = [F.col(x) for x in ("truth", "strict", "relaxed", "correct")]
    return k.call_metrics(_calls(t), ["st", "pr"], *c).select("st", "pr", "n_truth", *[r6(x).alias(x) for x in RATES])


@query("""with a as (select l_returnflag as m, l_linestatus as tr, count(*) filter (where l_discount < 0.05) as ok, count(*) as n from lineitem group by 1, 2) select m, round(sum(ok) / sum(n), 6) as pooled, round(avg(ok / n), 6) as mean_of_tracks from a group by 1""")
def repooled_rates(t):
    a = t("lineitem").groupBy(F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("tr")).agg(F.count_if(F.col("l_discount") < 0.05).alias("ok"), F.count("*").alias("n"))
    return a.groupBy("m").agg(r6(F.sum("ok") / F.sum("n")).alias("pooled"), r6(F.avg(F.col("ok") / F.col("n"))).alias("mean_of_tracks"))


@query("""with c as (select c_mktsegment as truth, o_orderstatus as call, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2), g as (select * from (select distinct truth from c) cross join (select distinct call from c))
select g.truth, g.call, coalesce(n, 0) as n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by g.truth), 6) as row_pct, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by g.call), 6) as col_pct from g left join c on c.truth = g.truth and c.call = g.call""")
def confusion_matrix_shares(t):
    from pyspark.sql import Window

    from tessera.operators import relational as rel

    c = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("truth"), F.col("o_orderstatus").alias("call")).agg(F.count("*").alias("n"))
    g = rel.complete_grid(c, ["truth", "call"], ["n"])
    pct = lambda key: r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return g.select("truth", "call", "n", pct("truth").alias("row_pct"), pct("call").alias("col_pct"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by 1, 2), s as (select user_id, arg_max(event_type, (n, event_type)) as top, max(n) as best, sum(n) as n from c group by 1)
select user_id, case when 2 * best > n then top else 'mixed' end as call, round(best / n, 6) as share from s""")
def majority_or_mixed(t):
    return k.majority_or(t("events"), "user_id", "event_type").withColumn("share", r6("share"))


@query("""with n as (select s_nationkey as g, count(distinct s_suppkey) as n from supplier group by 1) select g, l_returnflag as feature, round(sum(l_quantity) / any_value(n.n), 6) as mean, round(count(*) filter (where v > 10) / any_value(n.n), 6) as fraction from
(select l_suppkey, l_returnflag, sum(l_quantity) as l_quantity, sum(l_quantity) - 10 + 10 as v from lineitem group by 1, 2) join supplier on s_suppkey = l_suppkey join n on n.g = s_nationkey group by 1, 2""")
def mean_with_zeros(t):
    per = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    cells = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("g"))
    df = per.join(cells, "l_suppkey").withColumn("above", F.when(F.col("q") > 10, F.col("q")).otherwise(0.0))
    out = k.mean_over_all(df, cells, "g", "l_suppkey", "l_returnflag", "q").drop("fraction")
    return out.join(k.mean_over_all(df, cells, "g", "l_suppkey", "l_returnflag", "above").drop("mean"), ["g", "l_returnflag"]).select("g", F.col("l_returnflag").alias("feature"), r6("mean").alias("mean"), r6("fraction").alias("fraction"))


@query("""select user_id, round(avg(value) filter (where event_type = 'purchase') - avg(value) filter (where event_type <> 'purchase'), 6) as contrast from events group by 1""")
def on_off_contrast(t):
    return k.on_off_contrast(t("events"), ["user_id"], F.col("event_type") == "purchase", "value").withColumn("contrast", r6("contrast"))


@query("""with d as (select distinct c_nationkey as k, c_custkey as n from customer), g as (select k, n, n - row_number() over (partition by k order by n) as g from d), r as (select k, min(n) as a, max(n) as b from g group by k, g.g)
select k, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ',' order by a) as ranges from r group by 1""")
def folded_ranges(t):
    return k.folded_ranges(t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("n")), ["k"], "n")


@query("select p_brand, round(avg(p_retailprice), 6) as mean_top from (select p_brand, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc) as rn from part) where rn <= 5 group by 1")
def mean_of_top5(t):
    return k.mean_of_top(t("part"), ["p_brand"], "p_retailprice", 5).withColumn("mean_top", r6("mean_top"))


@query("select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over w as nth, greatest(0, floor((count(*) over (partition by p_brand) - 3) / 2)) as f from part window w as (partition by p_brand order by p_size, p_partkey)) where nth > f and nth <= f + 3")
def middle_blocks(t):
    return k.middle_blocks(t("part"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")], 3).select("p_brand", "p_partkey")


@query("""with a as (select distinct user_id as k from events), b as (select c_custkey as k from customer), f as (select a.k as a, b.k as b from a full join b on a.k = b.k), c as (select count(*) filter (where a is not null and b is not null) as both, count(*) filter (where b is null) as only_a, count(*) filter (where a is null) as only_b from f)
select "both", only_a, only_b, only_a = 0 and only_b = 0 as equal, only_a = 0 as a_in_b, only_b = 0 as b_in_a, "both" = 0 as disjoint from c""".replace("as both", 'as "both"'))
def set_relations(t):
    return k.set_relations(t("events").select(F.col("user_id").alias("k")), t("customer").select(F.col("c_custkey").alias("k")), "k")


@query("select event_type, round(min(value), 6) as lo, round(case when quantile_cont(value, 0.99) <= min(value) then min(value) + 1 else quantile_cont(value, 0.99) end, 6) as hi from events group by 1")
def clip_ranges(t):
    return k.clip_ranges(t("events"), ["event_type"], "value").select("event_type", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("select c_nationkey, round(case when quantile_cont(c_acctbal, 0.95) > 0 then quantile_cont(c_acctbal, 0.95) when max(c_acctbal) > 0 then max(c_acctbal) else 1 end, 6) as scale from customer group by 1")
def display_scale(t):
    return k.display_scale(t("customer"), ["c_nationkey"], "c_acctbal").withColumn("scale", r6("scale"))


@query("""select p_brand, count(*) as n, count(*) filter (where p_size > 10) as sized, count(*) filter (where p_size > 10 and p_retailprice > 1000) as priced, count(*) filter (where p_size > 10 and p_retailprice > 1000 and p_type like '%E%') as named from part group by 1""")
def eligibility_ladder(t):
    return k.ladder(t("part"), ["p_brand"], {"sized": F.col("p_size") > 10, "priced": F.col("p_retailprice") > 1000, "named": F.col("p_type").like("%E%")})


@query("""with q as (select c_nationkey, quantile_cont(c_acctbal, 0.9) as thr from customer group by 1) select c_custkey, round(thr, 6) as thr, c_acctbal >= thr as above from customer join q using (c_nationkey)""")
def group_quantile_flags(t):
    q = t("customer").groupBy("c_nationkey").agg(F.percentile("c_acctbal", F.lit(0.9)).alias("thr"))
    return t("customer").join(q, "c_nationkey").select("c_custkey", r6("thr").alias("thr"), (F.col("c_acctbal") >= F.col("thr")).alias("above"))
