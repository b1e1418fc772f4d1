"""All registered queries of the library, by name, with their SQL.

Domain columns map to those of the driver's tables: barcode to order, customer or user, genome to return flag or event
type, read counts to quantities, positions to seconds of `ts`, cells to documents or nations, features to parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import strings as st
from tessera.operators import communities as cm
from tessera.operators import graph as g
from tessera.operators import intervals as iv
from tessera.operators import matrix as mx
from tessera.operators import relational as rel
from tessera.operators import sampling as smp
from tessera.operators import stats
from tessera.plans import alignments, blocks, bootstrap, cleaning, consensus, draws, embedding, keyed, models, nulls, readouts  # noqa: F401  they register their queries
from tessera.plans.base import QUERIES as _Q
from tessera.plans.base import SQL as _SQL
from tessera.plans.base import query as _query
from tessera.plans.base import r6
from tessera.sources import scans

PRE_POST = "(select l_orderkey as k, count(*) as pre, sum(case when l_returnflag = 'N' then 1 else 0 end) as post from lineitem group by 1)"


def _pre_post(t) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("pre"), F.count_if(F.col("l_returnflag") == "N").alias("post"))


OUTCOME = "case when removed > 0 and post_frac >= 0.5 then 'rescued' when post_frac < 0.5 and pre > 0 then 'contaminated' when removed = 0 then 'clean' else 'mixed' end"


@_query(f"""with o as (select o_orderkey as k from orders), j as (select o.k, coalesce(pre, 0) as pre, coalesce(post, 0) as post from o left join {PRE_POST} c on o.k = c.k),
f as (select *, greatest(0, pre - post) as removed, case when pre > 0 then cast(post as double) / pre else 0 end as post_frac from j),
c as (select *, {OUTCOME} as outcome from f) select outcome, count(*) as n, cast(sum(removed) as bigint) as removed from c group by 1""")
def outcome_cascade(t):
    j = t("orders").select(F.col("o_orderkey").alias("k")).join(_pre_post(t), "k", "left").na.fill(0)
    f = j.withColumns({"removed": F.greatest(F.lit(0), F.col("pre") - F.col("post")), "post_frac": F.when(F.col("pre") > 0, F.col("post") / F.col("pre")).otherwise(0.0)})
    rules = [((F.col("removed") > 0) & (F.col("post_frac") >= 0.5), "rescued"), ((F.col("post_frac") < 0.5) & (F.col("pre") > 0), "contaminated"), (F.col("removed") == 0, "clean")]
    return f.withColumn("outcome", st.first_match(rules, "mixed")).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("removed").alias("removed"))


@_query("""with c as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_returnflag) as rn from c)
select l_suppkey, max(case when rn = 1 then l_returnflag end) as top1, max(case when rn = 1 then n end) as n1, max(case when rn = 2 then l_returnflag end) as top2, coalesce(max(case when rn = 2 then n end), 0) as n2,
round((max(case when rn = 1 then n end) + 1.0) / (coalesce(max(case when rn = 2 then n end), 0) + 1.0), 6) as ratio_pc from r group by 1""")
def top2_ratio_pc(t):
    c = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return rel.top_two(c, "l_suppkey", "l_returnflag", "n").withColumn("ratio_pc", r6((F.col("n1") + 1.0) / (F.col("n2") + 1.0)))


@_query("select l_returnflag, round(sum(l_quantity), 2) as total from lineitem group by 1 order by 2 desc, 1 limit 2")
def top2_groups_global(t):
    return rel.top_n(t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("total")), [F.desc("total"), F.asc("l_returnflag")], 2)


TYPES = ["click", "view", "purchase"]


@_query("""select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'purchase') as purchase,
round(log10(count(*) filter (where event_type = 'click') + 1), 6) as log_click from events group by 1 having click + view + purchase > 0""")
def barnyard_pivot(t):
    c = t("events").filter(F.col("event_type").isin(*TYPES)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rel.pivot_fill(c, "user_id", "event_type", "n", TYPES).withColumn("log_click", r6(F.log10(F.col("click") + 1)))


@_query("""with u as (select user_id, count(*) filter (where value < 20) * 1.0 / count(*) as r from events group by 1),
b as (select case when r >= 0 and r < 0.1 then '0-10' when r >= 0.1 and r < 0.3 then '10-30' when r >= 0.3 and r < 0.6 then '30-60' when r >= 0.6 and r < 1.01 then '60+' end as bin, count(*) as n from u group by 1)
select bin, n, cast(sum(n) over (order by bin) as bigint) as running, round(sum(n) over (order by bin) * 1.0 / sum(n) over (), 6) as share from b""")
def contam_profile_cum(t):
    from pyspark.sql import Window

    u = t("events").groupBy("user_id").agg((F.count_if(F.col("value") < 20) / F.count("*")).alias("r"))
    b = u.withColumn("bin", st.cut_left(F.col("r"), (0, 0.1, 0.3, 0.6, 1.01), ("0-10", "10-30", "30-60", "60+"))).groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")
    return b.select("bin", "n", F.sum("n").over(w).alias("running"), r6(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("share"))


@_query("""with c as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2) select *, round(n * 1.0 / sum(n) over (partition by o_orderpriority), 6) as share from c""")
def group_share_window(t):
    return rel.share_of_total(t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")), "n", ["o_orderpriority"]).withColumn("share", r6("share"))


@_query("""with a as (select o_custkey as k, count(*) as pre from orders where o_orderstatus <> 'F' group by 1), b as (select o_custkey as k, count(*) as post from orders where o_orderstatus = 'F' group by 1)
select k, coalesce(pre, 0) as pre, coalesce(post, 0) as post, greatest(0, coalesce(pre, 0) - coalesce(post, 0)) as removed from a full join b using (k)""")
def full_outer_removed(t):
    o = t("orders").withColumnRenamed("o_custkey", "k")
    a = o.filter("o_orderstatus <> 'F'").groupBy("k").agg(F.count("*").alias("pre"))
    b = o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("post"))
    return rel.full_outer_fill(a, b, ["k"], ["pre", "post"]).withColumn("removed", F.greatest(F.lit(0), F.col("pre") - F.col("post")))


@_query("""with o as (select o_orderstatus, o_orderpriority, count(*) as n from orders where o_totalprice > 250000 group by 1, 2)
select s.o_orderstatus, p.o_orderpriority, coalesce(n, 0) as n from (select distinct o_orderstatus from o) s cross join (select distinct o_orderpriority from o) p left join o using (o_orderstatus, o_orderpriority)""")
def grid_complete(t):
    c = t("orders").filter("o_totalprice > 250000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return rel.complete_grid(c, ["o_orderstatus", "o_orderpriority"], ["n"])


@_query("""select case when o_totalprice < 50000 then 'low_reads' when o_orderstatus = 'F' then 'single' when o_orderstatus = 'P' then 'doublet' else 'other' end as call_group, count(*) as n from orders group by 1""")
def call_group_cascade(t):
    rules = [(F.col("o_totalprice") < 50000, "low_reads"), (F.col("o_orderstatus") == "F", "single"), (F.col("o_orderstatus") == "P", "doublet")]
    return t("orders").groupBy(st.first_match(rules, "other").alias("call_group")).agg(F.count("*").alias("n"))


@_query("""with x as (select d.lang, l.quality = 1 as truth, d.n_chars >= 1000 as called from labels l join documents d using (doc_id)),
c as (select lang, count(*) filter (where truth and called) as tp, count(*) filter (where not truth and called) as fp, count(*) filter (where truth and not called) as fn, count(*) filter (where not truth and not called) as tn from x group by 1)
select *, case when tp + fn > 0 then tp * 1.0 / (tp + fn) end as sensitivity, case when tp + fp > 0 then tp * 1.0 / (tp + fp) end as precision, case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) end as f1 from c""")
def confusion_rates(t):
    x = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rel.confusion_rates(x, F.col("quality") == 1, F.col("n_chars") >= 1000, ["lang"])


BIN_SQL = "case when o_totalprice >= 0 and o_totalprice < 50000 then 'a' when o_totalprice >= 50000 and o_totalprice < 150000 then 'b' when o_totalprice >= 150000 and o_totalprice < 1e12 then 'c' end"


@_query(f"select o_orderstatus, coalesce(bin, 'All') as bin, count(*) as n from (select o_orderstatus, {BIN_SQL} as bin from orders) group by grouping sets ((o_orderstatus, bin), (o_orderstatus))")
def depth_tally_rollup(t):
    b = t("orders").select("o_orderstatus", st.cut_left(F.col("o_totalprice"), (0, 50000, 150000, 1e12), "abc").alias("bin"))
    tally = b.rollup("o_orderstatus", "bin").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").alias("gs"))
    return tally.filter("gs = 0").select("o_orderstatus", F.coalesce("bin", F.lit("All")).alias("bin"), "n")


@_query("""with a as (select distinct o_custkey as k from orders where year(o_orderdate) = 1995), b as (select distinct o_custkey as k from orders where year(o_orderdate) = 1996),
f as (select a.k as ka, b.k as kb from a full join b on a.k = b.k), c as (select count(*) filter (where ka is not null and kb is not null) as shared, count(*) filter (where kb is null) as dropped, count(*) filter (where ka is null) as gained from f)
select *, case when shared + dropped > 0 then 100.0 * shared / (shared + dropped) end as kept_pct from c""")
def retention_sets(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    return rel.retained_sets(o.filter("y = 1995"), o.filter("y = 1996"), "k")


@_query("select user_id from events where event_type in ('click', 'view', 'purchase') group by 1 having count(distinct event_type) = 3")
def nway_intersect(t):
    return rel.present_in_all(t("events").filter(F.col("event_type").isin(*TYPES)), "user_id", "event_type", 3)


@_query("select stages, count(*) as n from (select user_id, count(distinct event_type) as stages from events group by 1) group by 1")
def cell_presence_count(t):
    return t("events").groupBy("user_id").agg(F.count_distinct("event_type").alias("stages")).groupBy("stages").agg(F.count("*").alias("n"))


@_query("""select k, amount, null as kind from (select o_custkey as k, o_totalprice as amount from orders) union all select user_id, value, event_type from events""")
def multiset_union_fill(t):
    a = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("amount"))
    return rel.union_fill([a, t("events").select(F.col("user_id").alias("k"), F.col("value").alias("amount"), F.col("event_type").alias("kind"))])


@_query("""select l_suppkey, count(*) as t_all, count(*) filter (where l_returnflag = 'R') as m, round(count(*) filter (where l_returnflag = 'R') * 1.0 / count(*), 6) as purity,
round(sum(case when l_returnflag = 'R' then l_quantity end) / nullif(sum(case when l_returnflag = 'A' then l_quantity end), 0), 6) as ratio, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) as mean_of from lineitem group by 1""")
def purity_rollup(t):
    q = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    m = F.count_if(F.col("l_returnflag") == "R")
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("t_all"), m.alias("m"), r6(F.try_divide(m, F.count("*"))).alias("purity"), r6(F.try_divide(q("R"), q("A"))).alias("ratio"), r6(F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("mean_of"))


@_query("""select o_custkey, round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end), 2) as raw, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as clean,
round(round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) - round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end), 2), 2) as delta from orders where o_orderstatus in ('O', 'F') group by 1""")
def raw_clean_pivot_delta(t):
    p = rel.pivot_fill(t("orders").filter("o_orderstatus in ('O', 'F')"), "o_custkey", "o_orderstatus", "o_totalprice", ["O", "F"])
    return p.select("o_custkey", F.round("O", 2).alias("raw"), F.round("F", 2).alias("clean"), F.round(F.round("F", 2) - F.round("O", 2), 2).alias("delta"))


@_query("""with x as (select l_returnflag as g, case when l_shipdate < timestamp '1995-06-17' then 0 else 1 end as h, l_extendedprice * l_discount as x, l_extendedprice as n from lineitem),
s as (select g, coalesce(sum(x) filter (where h = 0), 0) as a0, coalesce(sum(n) filter (where h = 0), 0) as n0, coalesce(sum(x) filter (where h = 1), 0) as a1, coalesce(sum(n) filter (where h = 1), 0) as n1 from x group by 1),
r as (select *, n0 / sum(n0) over () as w0, n1 / sum(n1) over () as w1, coalesce(a0 / nullif(n0, 0), 0) as r0, coalesce(a1 / nullif(n1, 0), 0) as r1 from s)
select round(sum((r1 - r0) * w0), 8) as within, round(sum(r1 * (w1 - w0)), 8) as weight, round(sum(r1 * w1 - r0 * w0), 8) as delta from r""")
def decomposition_identity(t):
    x = t("lineitem").select(F.col("l_returnflag").alias("grp"), F.when(F.col("l_shipdate") < "1995-06-17", 0).otherwise(1).alias("half"), (F.col("l_extendedprice") * F.col("l_discount")).alias("x"), F.col("l_extendedprice").alias("n"))
    return stats.decomposition(x, "grp", "half", "x", "n").select(*[F.round(c, 8).alias(c) for c in ("within", "weight", "delta")])


@_query("""with m as (select user_id, count(*) as total, avg(value) as mean from events group by 1), z as (select *, (total - avg(total) over ()) / stddev_samp(total) over () as z from m),
f as (select greatest(50, coalesce(max(case when z < -0.5 then total end), 0)) as floor_ from z)
select case when total < 50 then 0 when total < floor_ then 1 when mean < 45 then 2 when mean > 55 then 3 else 4 end as qc_level, count(*) as n from z cross join f group by 1""")
def meta_qc_cascade(t):
    m = mx.zscore(t("events").groupBy("user_id").agg(F.count("*").alias("total"), F.avg("value").alias("mean")), "total", [], "z")
    f = m.agg(F.greatest(F.lit(50), F.coalesce(F.max(F.when(F.col("z") < -0.5, F.col("total"))), F.lit(0))).alias("floor_"))
    level = st.first_match([(F.col("total") < 50, 0), (F.col("total") < F.col("floor_"), 1), (F.col("mean") < 45, 2), (F.col("mean") > 55, 3)], 4)
    return m.crossJoin(F.broadcast(f)).groupBy(level.alias("qc_level")).agg(F.count("*").alias("n"))


@_query("""with s as (select quantile_cont(value, 0.9) as cut from events where event_id % 2 = 0) select event_type, count(*) filter (where value > cut) as above, count(*) as n from events cross join s where event_id % 2 = 1 group by 1""")
def frozen_threshold_compare(t):
    cut = t("events").filter("event_id % 2 = 0").agg(F.percentile("value", F.lit(0.9)).alias("cut"))
    return t("events").filter("event_id % 2 = 1").crossJoin(F.broadcast(cut)).groupBy("event_type").agg(F.count_if(F.col("value") > F.col("cut")).alias("above"), F.count("*").alias("n"))


SECONDS = "cast(floor(epoch(ts)) as bigint)"
WINDOWS = f"(select user_id as k, {SECONDS} as s, {SECONDS} + 3600 as e from events)"
MERGED = f"""(select k, min(s) as s, max(e) as e, count(*) as n_merged from (select *, sum(new) over (partition by k order by s, e rows unbounded preceding) as island from
(select *, case when s > coalesce(max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as new from {WINDOWS})) group by k, island)"""


def _windows(t) -> DataFrame:
    s = F.unix_timestamp("ts")
    return t("events").select(F.col("user_id").alias("k"), s.alias("s"), (s + 3600).alias("e"))


@_query(f"select * from {MERGED}")
def interval_merge(t):
    return iv.merge(_windows(t), ["k"], "s", "e")


@_query(f"""with a as (select event_id, user_id as k, {SECONDS} as s, {SECONDS} + 60 as e from events) select distinct a.event_id, m.s as ms, m.e as me from a join {MERGED} m on a.k = m.k and a.s <= m.e and m.s <= a.e""")
def overlap_join_distinct(t):
    s = F.unix_timestamp("ts")
    a = t("events").select("event_id", F.col("user_id").alias("k"), s.alias("start"), (s + 60).alias("end"))
    m = iv.merge(_windows(t), ["k"], "s", "e").select("k", F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    return iv.overlap_join(a, m, ["k"], 86_400).select("event_id", F.col("b_start").alias("ms"), F.col("b_end").alias("me")).distinct()


@_query(f"select k, s, count(*) as n_points from (select m.k, m.s from {MERGED} m join events v on v.user_id = m.k and cast(floor(epoch(v.ts)) as bigint) >= m.s and cast(floor(epoch(v.ts)) as bigint) < m.e) group by 1, 2")
def point_in_interval(t):
    p = t("events").select(F.col("user_id").alias("k"), F.unix_timestamp("ts").alias("pos"))
    return iv.point_in_interval(p, iv.merge(_windows(t), ["k"], "s", "e"), ["k"], "pos", 86_400, ("s", "e")).groupBy("k", "s").agg(F.count("*").alias("n_points"))


@_query(f"""with a as (select distinct user_id as k, {SECONDS} as s, {SECONDS} + 600 as e from events where event_type = 'click'), b as (select user_id as k, {SECONDS} as s, {SECONDS} + 600 as e from events where event_type = 'purchase')
select k, s, e from a where exists (select 1 from b where b.k = a.k and b.s <= a.e and a.s <= b.e)""")
def exists_overlap(t):
    s = F.unix_timestamp("ts")
    v = t("events").select("event_type", F.col("user_id").alias("k"), s.alias("s"), (s + 600).alias("e"))
    b = v.filter("event_type = 'purchase'").select("k", F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    return iv.exists_overlap(v.filter("event_type = 'click'").select("k", "s", "e").distinct(), b, ["k"], 86_400, ("s", "e"))


@_query(f"select count(*) as n from (select lead(s) over (partition by k order by s, e) as nx, e from {MERGED}) where nx < e")
def disjoint_check(t):
    return iv.disjoint_violations(iv.merge(_windows(t), ["k"], "s", "e"), ["k"], "s", "e").agg(F.count("*").alias("n"))


@_query(f"""with d as (select k, pos, sum(d) as d from (select k, s as pos, 1 as d from {WINDOWS} union all select k, e, -1 from {WINDOWS}) group by 1, 2),
c as (select k, pos, cast(sum(d) over (partition by k order by pos) as bigint) as depth, lead(pos) over (partition by k order by pos) as until from d)
select k, max(depth) as peak, cast(sum(depth * (until - pos)) as bigint) as area from c where until is not null and depth > 0 group by 1""")
def coverage_depth(t):
    return iv.coverage(_windows(t), ["k"], "s", "e").groupBy("k").agg(F.max("depth").alias("peak"), F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("area"))


@_query("""with n as (select upper(substr(replace(p_name, ' ', ''), 1, 5)) as code, count(*) as n from part group by 1), c as (select code from n), w as (select code as white from n where n >= (select avg(n) from n))
select code, min(hamming(code, white)) as best from c cross join w where length(code) = 5 and length(white) = 5 and position('N' in code) = 0 and position('N' in white) = 0 group by 1""")
def whitelist_hamming(t):
    # The whitelist holds the codes of at least mean frequency.
    n = t("part").groupBy(F.upper(F.substring(F.replace("p_name", F.lit(" "), F.lit("")), 1, 5)).alias("code")).agg(F.count("*").alias("n"))
    c = n.select("code")
    w = n.join(F.broadcast(n.agg(F.avg("n").alias("mean")))).filter("n >= mean").select(F.col("code").alias("white"))
    ok = lambda x: (F.length(x) == 5) & (F.instr(x, "N") == 0)
    return c.filter(ok(F.col("code"))).crossJoin(F.broadcast(w.filter(ok(F.col("white"))))).groupBy("code").agg(F.min(st.hamming(F.col("code"), F.col("white"))).cast("long").alias("best"))


@_query("select p_partkey, reverse(translate(p_name, 'ATCGatcg', 'TAGCtagc')) as rc, length(p_name) - length(replace(p_name, 'n', '')) as n_n, substr(p_name, 3, 5) as mid from part")
def revcomp_substr(t):
    return t("part").select("p_partkey", st.reverse_complement(F.col("p_name")).alias("rc"), (F.length("p_name") - F.length(F.replace("p_name", F.lit("n"), F.lit("")))).cast("long").alias("n_n"), F.substring("p_name", 3, 5).alias("mid"))


@_query("""with s as (select s_name as sample, chr(cast(65 + s_nationkey % 8 as int)) as r, s_suppkey % 9 + 1 as a, s_suppkey % 4 as w from supplier) select sample, r || unnest(generate_series(a, a + w)) as well from s
union all select sample, 'H' || a as well from s where r <> 'H'""")
def range_spec_expand(t):
    n = F.col("s_suppkey") % 9 + 1
    row = F.char((65 + F.col("s_nationkey") % 8).cast("int"))
    spec = F.concat(row, n.cast("string"), F.lit("-"), (n + F.col("s_suppkey") % 4).cast("string"), F.when(row != "H", F.concat(F.lit(", H"), n.cast("string"))).otherwise(F.lit("")))
    return scans.expand_ranges(t("supplier").select(F.col("s_name").alias("sample"), spec.alias("spec")), "spec").select("sample", "well")


@_query("""select case when lower(p_type) like '%brass%' then 'metal_b' when lower(p_type) like '%steel%' then 'metal_s' when lower(p_type) like '%small%' then 'small' else 'other' end as label, count(*) as n from part group by 1""")
def label_rules(t):
    p = t("part")
    return p.groupBy(rel.label_rules(p, "p_type", (("brass", "metal_b"), ("steel", "metal_s"), ("small", "small")), "other").alias("label")).agg(F.count("*").alias("n"))


@_query("select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part) where rn <= 10")
def panel_topn_cap(t):
    return rel.top_n(t("part").select("p_brand", "p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 10, ["p_brand"])


CPM = "(select p_type, s_nationkey, sum(l_quantity) as total from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2)"


def _cpm(t) -> DataFrame:
    x = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return mx.pseudobulk(x, "p_type", "s_nationkey", "l_quantity")


@_query(f"""with c as (select *, total * 1e6 / sum(total) over (partition by s_nationkey) as cpm from {CPM}) select p_type, s_nationkey, round(cpm, 4) as cpm, round((cpm - avg(cpm) over w) / nullif(stddev_samp(cpm) over w, 0), 4) as z from c window w as (partition by p_type)""")
def pseudobulk_cpm_z(t):
    return mx.zscore(_cpm(t), "cpm", ["p_type"], "z").select("p_type", "s_nationkey", F.round("cpm", 4).alias("cpm"), F.round("z", 4).alias("z"))


@_query(f"""with c as (select *, total * 1e6 / sum(total) over (partition by s_nationkey) as cpm from {CPM}), z as (select p_type, s_nationkey, greatest(0, coalesce((cpm - avg(cpm) over (partition by p_type)) / nullif(stddev_samp(cpm) over (partition by p_type), 0), 0)) as a,
greatest(0, coalesce((cpm - avg(cpm) over (partition by s_nationkey)) / nullif(stddev_samp(cpm) over (partition by s_nationkey), 0), 0)) as b from c) select p_type, s_nationkey, round(sqrt(a * a + b * b), 4) as euclid, round(sqrt(a * b), 4) as geom from z""")
def reciprocal_z(t):
    return mx.reciprocal_z(_cpm(t), "cpm", "p_type", "s_nationkey").select("p_type", "s_nationkey", F.round("rz_euclid", 4).alias("euclid"), F.round("rz_geom", 4).alias("geom"))


@_query("""with x as (select p_brand as f, l_suppkey as c, sum(l_quantity) as x from lineitem join part on l_partkey = p_partkey group by 1, 2), n as (select count(distinct c) as cells from x)
select f, c, round(ln(1 + x / sum(x) over (partition by c) * 1e4) * ln(1 + cells / sum(x) over (partition by f)), 6) as tfidf from x cross join n""")
def tfidf_triplets(t):
    x = t("lineitem").select("l_partkey", F.col("l_suppkey").alias("c"), "l_quantity").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("f")), "l_partkey")
    return mx.tfidf(x, "f", "c", "l_quantity").select("f", "c", r6("tfidf").alias("tfidf"))


@_query("""with s as (select p_brand, s_nationkey, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2), r as (select *, row_number() over (partition by p_brand order by v desc, s_nationkey) as rn from s),
t as (select p_brand, max(case when rn = 1 then s_nationkey end) as top, max(case when rn = 1 then v end) as best, max(case when rn = 2 then s_nationkey end) as runner_up, max(case when rn = 2 then v end) as second from r group by 1)
select p_brand, top, best, runner_up, second, best - second as margin, case when second / best >= 0.8 then 'AMBIGUOUS' else cast(top as varchar) end as call from t""")
def marker_top_annotation(t):
    x = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_brand", "s_nationkey").agg(F.sum("l_quantity").alias("v"))
    return mx.annotate_top(x, "p_brand", "s_nationkey", "v")


@_query("""with p as (select p_brand, p_type, count(*) * 1.0 / sum(count(*)) over (partition by p_brand) as p from part group by 1, 2) select p_brand as k, round(-sum(p * log2(p)), 6) as entropy from p group by 1""")
def label_entropy(t):
    c = t("part").groupBy(F.col("p_brand").alias("k"), "p_type").agg(F.count("*").cast("double").alias("v"))
    return mx.entropy(c, "k", "v").withColumn("entropy", r6("entropy"))


@_query("""with n as (select count(distinct l_suppkey) as n from lineitem), c as (select l_partkey, l_suppkey, sum(l_quantity) as v from lineitem group by 1, 2), m as (select l_partkey, sum(v) as s, sum(v * v) as ss from c group by 1)
select l_partkey, round(s / n, 6) as mean, round((ss - s * s / n) / (n - 1), 6) as variance from m cross join n""")
def sparse_variance(t):
    x = t("lineitem")
    n = x.agg(F.count_distinct("l_suppkey").alias("n_cells"))
    c = x.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    m = c.groupBy("l_partkey").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss")).crossJoin(F.broadcast(n))
    return m.select("l_partkey", r6(F.col("s") / F.col("n_cells")).alias("mean"), r6((F.col("ss") - F.col("s") * F.col("s") / F.col("n_cells")) / (F.col("n_cells") - 1)).alias("variance"))


DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double))))"


def _knn_sql(a: str, b: str) -> str:
    return f"(select node, neighbour from (select x.vec_id as node, y.vec_id as neighbour, row_number() over (partition by x.vec_id order by {DIST.format(a=a, b=b)}, y.vec_id) as rn from embeddings x join embeddings y on x.vec_id <> y.vec_id) where rn <= 10)"


FULL, HALF = _knn_sql("x.embedding", "y.embedding"), _knn_sql("x.embedding[1:32]", "y.embedding[1:32]")


@_query(f"""with m as (select a.label, avg(case when a.label <> b.label then 1.0 else 0.0 end) as mixing from {FULL} k join embeddings a on a.vec_id = k.node join embeddings b on b.vec_id = k.neighbour group by 1),
s as (select label, count(*) * 1.0 / sum(count(*)) over () as p from embeddings group by 1) select label, round(mixing, 6) as mixing, round(1 - p, 6) as expected, round(mixing - (1 - p), 6) as centred from m join s using (label)""")
def knn_mixing(t):
    e = t("embeddings")
    return g.mixing(g.knn(e, "vec_id", "embedding", 10), e.select(F.col("vec_id").alias("node"), "label")).select("label", *[r6(c).alias(c) for c in ("mixing", "expected", "centred")])


@_query(f"with a as (select * from {FULL}), b as (select * from {HALF}) select round((select count(*) from a join b using (node, neighbour)) * 1.0 / (select count(*) from a), 6) as preservation")
def knn_preservation(t):
    e = t("embeddings")
    return g.preservation(g.knn(e, "vec_id", "embedding", 10), g.knn(e, "vec_id", "embedding", 10, 32), 10).select(r6("preservation").alias("preservation"))


@_query(f"""select label, count(*) as n, round(avg(same), 6) as purity from (select k.node, a.label, avg((a.label = b.label)::int) as same from {FULL} k join embeddings a on a.vec_id = k.node join embeddings b on b.vec_id = k.neighbour group by 1, 2) group by 1""")
def knn_purity(t):
    e = t("embeddings")
    return cm.purity(g.knn(e, "vec_id", "embedding", 10), e.select(F.col("vec_id").alias("node"), "label")).select("label", "n", r6("purity").alias("purity"))


@_query(f"""with k as (select * from {FULL}), e as (select node as a, neighbour as b from k union all select neighbour, node from k), l as (select a, x.label as la, y.label as lb from e join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b),
c as (select la, count(*) as tot, sum((la = lb)::int) as inside from l group by 1) select round(sum(inside) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 6) as modularity from c""")
def knn_label_modularity(t):
    e = t("embeddings")
    q = cm.modularity(cm.symmetric(g.knn(e, "vec_id", "embedding", 10), "node", "neighbour"), e.select(F.col("vec_id").alias("node"), F.col("label").alias("community")))
    return e.sparkSession.range(1).select(F.lit(round(q, 6)).alias("modularity"))


@_query()
def neighbour_communities(t):
    return cm.communities(cm.symmetric(g.knn(t("embeddings"), "vec_id", "embedding", 10), "node", "neighbour"))


@_query("""with c as (select c_mktsegment as a, c_nationkey % 5 as b, count(*) as n from customer group by 1, 2), s as (select sum(n * (n - 1) / 2.0) as ij, sum(n) as n from c),
i as (select sum(m * (m - 1) / 2.0) as i from (select sum(n) as m from c group by a)), j as (select sum(m * (m - 1) / 2.0) as j from (select sum(n) as m from c group by b))
select round((ij - i * j / (n * (n - 1) / 2.0)) / ((i + j) / 2.0 - i * j / (n * (n - 1) / 2.0)), 8) as ari from s cross join i cross join j""")
def adjusted_rand(t):
    return g.adjusted_rand(t("customer").select("c_mktsegment", (F.col("c_nationkey") % 5).alias("bucket")), "c_mktsegment", "bucket").select(F.round("ari", 8).alias("ari"))


@_query("""with m as (select s_suppkey as item, seed, (s_suppkey * 2654435761 + seed * 40503) % 4294967296 % 7 as label from supplier cross join (values (1), (2), (3), (4), (5)) v(seed))
select a.item as i, b.item as j, count(*) / 5.0 as f from m a join m b on a.seed = b.seed and a.label = b.label and a.item < b.item group by 1, 2""")
def coassignment_f(t):
    s = t("supplier").select(F.col("s_suppkey").alias("item"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    return g.coassignment(s.withColumn("label", F.expr("(item * 2654435761L + seed * 40503) % 4294967296L % 7")), "seed", "item", "label")


@_query("""with x as (select value, count(*) filter (where event_type = 'click') as a, count(*) filter (where event_type = 'view') as b from events where event_type in ('click', 'view') group by 1)
select round(max(d), 8) as ks_d from (select abs(sum(a) over (order by value) * 1.0 / sum(a) over () - sum(b) over (order by value) * 1.0 / sum(b) over ()) as d from x)""")
def ks_two_sample(t):
    return stats.ks_distance(t("events"), "event_type", "value", "click", "view").select(F.round("ks_d", 8).alias("ks_d"))


@_query("""with a as (select o_custkey as k, avg(o_totalprice) as x from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as k, avg(o_totalprice) as y from orders where o_orderkey % 2 = 1 group by 1)
select count(*) as n, round(median(y - x), 4) as median_delta, round(100.0 * count(*) filter (where x = y) / count(*), 6) as pct_identical from a join b using (k)""")
def paired_delta(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_totalprice", "o_orderkey")
    a = o.filter("o_orderkey % 2 = 0").groupBy("k").agg(F.avg("o_totalprice").alias("x"))
    b = o.filter("o_orderkey % 2 = 1").groupBy("k").agg(F.avg("o_totalprice").alias("y"))
    return a.join(b, "k").agg(F.count("*").alias("n"), F.round(F.median(F.col("y") - F.col("x")), 4).alias("median_delta"), r6(100.0 * F.count_if(F.col("x") == F.col("y")) / F.count("*")).alias("pct_identical"))


@_query("""with x as (select quality, n_chars from labels join documents using (doc_id)), r as (select quality, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as r from x)
select round((sum(r) filter (where quality = 1) - count(*) filter (where quality = 1) * (count(*) filter (where quality = 1) + 1) / 2.0) / (count(*) filter (where quality = 1) * count(*) filter (where quality = 0)), 8) as auc from r""")
def auc_rank(t):
    return stats.auc(t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id"), "quality", "n_chars").select(F.round("auc", 8).alias("auc"))


@_query("""with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select round(corr(a, b), 8) as rho from r""")
def spearman(t):
    return stats.spearman(t("part"), "p_size", "p_retailprice").select(F.round("rho", 8).alias("rho"))


@_query("""with p as (select p_brand, p_partkey, (p_partkey * 7919 % 1000 + 1) / 1001.0 as p from part), r as (select *, rank() over (partition by p_brand order by p) + count(*) over (partition by p_brand, p) - 1 as r, count(*) over (partition by p_brand) as n from p),
q as (select *, p * n / r as q0 from r) select p_brand, p_partkey, round(least(1.0, min(q0) over (partition by p_brand order by p desc range between unbounded preceding and current row)), 8) as q from q""")
def bh_adjust(t):
    p = t("part").select("p_brand", "p_partkey", F.expr("(p_partkey * 7919 % 1000 + 1) / 1001.0D").alias("p"))
    return stats.bh_adjust(p, "p", ["p_brand"]).select("p_brand", "p_partkey", F.round("q", 8).alias("q"))


@_query("select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by (c_custkey * 2654435761) % 4294967296, c_custkey) as rn from customer) where rn <= 25")
def hash_stratified_sample(t):
    return smp.stratified(t("customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 25)


@_query()
def rarefy_rows(t):
    x = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return smp.rarefy(x, "l_suppkey", "l_returnflag", "n", 100)


@_query()
def block_bootstrap_ci(t):
    x = t("lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("double").alias("m"), F.lit(1.0).alias("one"))
    return stats.block_bootstrap(x, "l_suppkey", "m", "one")


@_query("""with b as (select avg(p_retailprice) as mu, stddev_samp(p_retailprice) as sd from part), x as (select p_brand, avg(p_retailprice) as m, count(*) as n from part group by 1)
select p_brand, round((m - mu) / (sd / sqrt(n)), 6) as z, case when (m - mu) / (sd / sqrt(n)) >= 2 and m / mu >= 1.01 then 'enriched' else 'background' end as call from x cross join b""")
def enrichment_call(t):
    b = t("part").agg(F.avg("p_retailprice").alias("mu"), F.stddev_samp("p_retailprice").alias("sd"))
    z = (F.col("m") - F.col("mu")) / (F.col("sd") / F.sqrt("n"))
    x = t("part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.count("*").alias("n")).crossJoin(F.broadcast(b))
    return x.select("p_brand", r6(z).alias("z"), F.when((z >= 2) & (F.col("m") / F.col("mu") >= 1.01), "enriched").otherwise("background").alias("call"))


@_query("select c_custkey, list_reduce(list_prepend(cast(0 as bigint), list_transform(list_filter(string_split(c_name, ''), lambda c: c <> ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (h * 131 + c) % 1000003) % 16 as chunk from customer")
def polynomial_hash_partition(t):
    return t("customer").select("c_custkey", F.pmod(st.polynomial_hash(F.col("c_name")), F.lit(16)).cast("long").alias("chunk"))


@_query("""with x as (select l_suppkey as k, l_shipdate < timestamp '1995-06-17' as pre, l_returnflag = 'R' as hit from lineitem), c as (select k, count(*) filter (where pre and hit) as a, count(*) filter (where pre and not hit) as b, count(*) filter (where not pre and hit) as c, count(*) filter (where not pre and not hit) as d from x group by 1)
select round((sum(a) - sum(c)) * 1.0 / nullif(sum(a), 0), 8) as removal_rate, round((sum(b) - sum(d)) * 1.0 / nullif(sum(b), 0), 8) as on_target_rate from c""")
def selectivity_rates(t):
    pre, hit = F.col("l_shipdate") < "1995-06-17", F.col("l_returnflag") == "R"
    c = t("lineitem").groupBy("l_suppkey").agg(F.count_if(pre & hit).alias("a"), F.count_if(pre & ~hit).alias("b"), F.count_if(~pre & hit).alias("c"), F.count_if(~pre & ~hit).alias("d"))
    rate = lambda x, y: F.round(F.try_divide(F.sum(x) - F.sum(y), F.sum(x)), 8)
    return c.agg(rate("a", "c").alias("removal_rate"), rate("b", "d").alias("on_target_rate"))


@_query(f"""with o as (select o_orderstatus, o_orderpriority = '1-URGENT' as wrong, o_totalprice, {BIN_SQL} as bin from orders) select o_orderstatus, bin, count(*) as n, count(*) filter (where wrong) as n_wrong, count(*) filter (where wrong and o_totalprice >= 200000) as n_pure from o group by 1, 2""")
def hop_table(t):
    o = t("orders").select("o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").alias("wrong"), "o_totalprice", st.cut_left(F.col("o_totalprice"), (0, 50000, 150000, 1e12), "abc").alias("bin"))
    return o.groupBy("o_orderstatus", "bin").agg(F.count("*").alias("n"), F.count_if("wrong").alias("n_wrong"), F.count_if(F.col("wrong") & (F.col("o_totalprice") >= 200000)).alias("n_pure"))


@_query("""with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2), r as (select *, row_number() over (partition by c_nationkey order by n desc, c_mktsegment) as rn, sum(n) over (partition by c_nationkey) as total from c)
select c_nationkey, c_mktsegment as majority, n, cast(total as bigint) as total, round(n * 1.0 / total, 6) as purity from r where rn = 1""")
def majority_label(t):
    return rel.majority(t("customer"), "c_nationkey", "c_mktsegment").withColumn("purity", r6("purity"))


@_query("select user_id, total, rank from (select user_id, count(*) as total, row_number() over (order by count(*) desc, user_id) as rank from events group by 1) where total >= 70")
def rank_depth_curve(t):
    return rel.rank_depth_cut(t("events").groupBy("user_id").agg(F.count("*").alias("total")), "total", 70, "user_id").withColumn("rank", F.col("rank").cast("long"))


@_query("""with e as (select vec_id, label, cast(embedding[1] as double) as x from embeddings) select label, round(quantile_cont(x, 0.25), 6) as q1, round(quantile_cont(x, 0.5), 6) as q2, round(quantile_cont(x, 0.75), 6) as q3 from e group by 1""")
def group_quantiles(t):
    q = lambda p: r6(F.percentile("x", F.lit(p)))
    return t("embeddings").select("label", F.col("embedding")[0].cast("double").alias("x")).groupBy("label").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))


@_query("select l_orderkey as id, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') and l_orderkey not in (select o_orderkey from orders where o_orderpriority = '5-LOW') group by 1")
def semi_anti_filter(t):
    o = t("orders")
    keep, drop = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), o.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").select("l_orderkey").join(keep, "l_orderkey", "left_semi").join(drop, "l_orderkey", "left_anti").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))


@_query("""with q as (select quantile_cont(o_totalprice, 0.01) as lo, quantile_cont(o_totalprice, 0.99) as hi from orders) select o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) as v from orders cross join q""")
def winsorise(t):
    q = t("orders").agg(F.percentile("o_totalprice", F.lit(0.01)).alias("lo"), F.percentile("o_totalprice", F.lit(0.99)).alias("hi"))
    return t("orders").crossJoin(F.broadcast(q)).select("o_orderkey", F.round(F.least(F.greatest("o_totalprice", "lo"), "hi"), 4).alias("v"))


@_query("select cast(floor(l_extendedprice / 5000) as bigint) as bin, count(*) as n from lineitem group by 1")
def histogram(t):
    return t("lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).alias("bin")).agg(F.count("*").alias("n"))


@_query("""with a as (select o_custkey as k, avg(o_totalprice) as x from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as k, avg(o_totalprice) as y from orders where o_orderkey % 2 = 1 group by 1),
d as (select round(y - x, 4) as d from a join b using (k)), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from d where d <> 0),
t as (select sum((m * m * m - m) / 48.0) as ties from (select count(*) as m from d where d <> 0 group by abs(d))), s as (select count(*) as n, sum(case when d > 0 then r else 0 end) as w from r),
o as (select n, w, w - n * (n + 1) / 4.0 as off, sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties) as sd from s cross join t) select n, round(w, 1) as w, round((off - sign(off) * 0.5) / sd, 6) as z from o""")
def signed_rank(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_totalprice", "o_orderkey")
    a = o.filter("o_orderkey % 2 = 0").groupBy("k").agg(F.avg("o_totalprice").alias("x"))
    b = o.filter("o_orderkey % 2 = 1").groupBy("k").agg(F.avg("o_totalprice").alias("y"))
    return stats.signed_rank(a.join(b, "k").select(F.round(F.col("y") - F.col("x"), 4).alias("d")), "d").select("n", F.round("w", 1).alias("w"), r6("z").alias("z"))


@_query("""with m as (select o_custkey, o_orderstatus, o_orderdate, o_orderkey, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders),
r as (select o_custkey, sum(case when p = o_orderstatus then 0 else 1 end) over (partition by o_custkey order by o_orderdate, o_orderkey) as run from m), c as (select o_custkey, run, count(*) as n from r group by 1, 2)
select o_custkey, count(*) as runs, max(n) as longest from c group by 1""")
def label_runs(t):
    return rel.run_lengths(t("orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Q["outcome_cascade"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
