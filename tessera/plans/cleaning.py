"""Queries of the cleaning chain: suppliers are barcodes, lines reads, return flags genomes; the design follows the nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cleaning as cl
from tessera.plans.base import query, r6
from tessera.sources import reads as rd

WITH = cl.Policy(ambiguous="design_rescue")
WITHOUT = cl.Policy()

BASE_SQL = """with reads as (select l_orderkey * 10 + l_linenumber as read, s_name as barcode, l_returnflag as genome, case when l_linenumber = 1 then 'ambiguous' else 'winner' end as assigned_class, cast(l_quantity as int) % 9 as delta from lineitem join supplier on s_suppkey = l_suppkey),
n as (select barcode, genome, count(*) as n, row_number() over (partition by barcode order by count(*) desc, genome) as rn from reads group by 1, 2),
calls as (select barcode, max(genome) filter (where rn = 1) as genome1, max(genome) filter (where rn = 2) as genome2, case when max(n) filter (where rn = 1) * 2 >= sum(n) then 'single' when min(n) * 100 >= 26 * max(n) and barcode like '%3' then 'doublet' when barcode like '%7' then 'indistinguishable' else 'ambiguous' end as call from n group by 1),
design as (select right(s_name, 10) as position, case s_nationkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as genome from supplier where s_nationkey < 20)"""
ALLOWED_SQL = BASE_SQL + """, a0 as (select c.*, d.genome as expected from calls c {join}),
a1 as (select *, case when call = 'ambiguous' then {rescue} else genome1 end as keep from a0), a2 as (select *, case when expected is not null and call <> 'ambiguous' then keep = expected end as matches from a1),
a as (select barcode, call, expected, matches, case when matches is false then null else keep end as allowed from a2),
j as (select r.*, a.call, a.allowed, case when a.call is null then 'no call' when a.matches is false then 'design mismatch' when a.allowed is null then 'nothing allowed' when not (genome = a.allowed or assigned_class = 'ambiguous' or delta <= 3) then 'other genome' end as reason from reads r left join a using (barcode))"""
WITH_SQL = ALLOWED_SQL.format(join="left join design d on d.position = right(barcode, 10)", rescue="expected")
WITHOUT_SQL = ALLOWED_SQL.format(join="left join (select null::varchar as genome) d on true", rescue="genome1")
COMPOSITION_SQL = """ select a.barcode, a.call, a.expected, a.matches, coalesce(a.allowed, '') as allowed, count(*) as pre, count(*) filter (where reason is null) as post, round(count(*) filter (where reason is null and genome = a.allowed) * 1.0 / nullif(count(*) filter (where reason is null), 0), 6) as own_share,
count(*) filter (where reason is null) >= 100 and coalesce(count(*) filter (where reason is null and genome = a.allowed) * 1.0 / nullif(count(*) filter (where reason is null), 0), 0) >= 0.9 as passes from a join j using (barcode) group by 1, 2, 3, 4, 5"""


def _reads(t):
    li = t("lineitem").join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    cls = F.when(F.col("l_linenumber") == 1, "ambiguous").otherwise("winner")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read"), F.col("s_name").alias("barcode"), F.col("l_returnflag").alias("genome"), cls.alias("assigned_class"), (F.col("l_quantity").cast("int") % 9).alias("delta"))


def _calls(t):
    n = _reads(t).groupBy("barcode", "genome").agg(F.count("*").alias("n"))
    g = n.groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "genome"))).alias("g"), F.sum("n").alias("total"))  # three genomes a barcode
    top, low = -F.col("g")[0]["n"], -F.element_at("g", -1)["n"]
    call = F.when(top * 2 >= F.col("total"), cl.SINGLE).when((low * 100 >= 26 * top) & F.col("barcode").endswith("3"), cl.DOUBLET).when(F.col("barcode").endswith("7"), cl.INDISTINGUISHABLE).otherwise(cl.AMBIGUOUS)
    return g.select("barcode", call.alias("call"), F.col("g")[0]["genome"].alias("genome1"), F.try_element_at("g", F.lit(2))["genome"].alias("genome2"))


def _design(t):
    genome = F.when(F.col("s_nationkey") % 3 == 0, "A").when(F.col("s_nationkey") % 3 == 1, "N").otherwise("R")
    return t("supplier").filter("s_nationkey < 20").select(F.right(F.col("s_name"), F.lit(10)).alias("position"), genome.alias("genome"))


def _judged(t, policy, design):
    barcodes = cl.allowed(_calls(t), policy, design)
    return barcodes, cl.judged(_reads(t), barcodes, policy)


@query(WITH_SQL + COMPOSITION_SQL)
def cleaned_with_design(t):
    barcodes, j = _judged(t, WITH, _design(t))
    return cl.composition(j, barcodes, WITH).withColumn("own_share", r6("own_share"))


@query(WITHOUT_SQL + COMPOSITION_SQL)
def cleaned_without_design(t):
    barcodes, j = _judged(t, WITHOUT, None)
    return cl.composition(j, barcodes, WITHOUT).withColumn("own_share", r6("own_share"))


@query(WITH_SQL + " select read, barcode, reason from j where reason is not null")
def reads_to_drop(t):
    return cl.drop_list(_judged(t, WITH, _design(t))[1])


@query(WITH_SQL + " select genome, count(*) as n from reads where read not in (select read from j where reason is not null) group by 1")
def reads_left(t):
    drop = cl.drop_list(_judged(t, WITH, _design(t))[1])
    return rd.without_reads(_reads(t), drop, "read").groupBy("genome").agg(F.count("*").alias("n"))


@query("""with m as (select l_orderkey as read, l_returnflag as genome, max(l_linestatus) as bc, max(cast(l_quantity as int) // 10) as a, min(l_linenumber) // 3 as nm, 0 as q from lineitem group by 1, 2),
r as (select *, rank() over (partition by read order by a desc, nm, q desc) as k from m), t as (select read, max(genome) as genome, max_by(bc, genome) as bc, case when count(*) > 1 then 'ambiguous' else 'winner' end as assigned_class from r where k = 1 group by 1) select read as "Read", bc as "BC", genome as "Genome", assigned_class from t""")
def best_genome_of_reads(t):
    m = t("lineitem").groupBy(F.col("l_orderkey").alias("Read"), F.col("l_returnflag").alias("Genome")).agg(F.max("l_linestatus").alias("BC"), F.max(F.floor(F.col("l_quantity").cast("int") / 10)).alias("AS"), F.floor(F.min("l_linenumber") / 3).alias("NM"), F.lit(0).alias("MAPQ"))
    return rd.friend_mode(rd.best_genome(m))
