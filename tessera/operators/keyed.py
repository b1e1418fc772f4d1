"""Schema shims, guarded filters, checked joins, summaries by keys and orders, all by column name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old names become new ones where the old is there and the new is not."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def derive_missing(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds only the columns that the table lacks."""
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def transform_by_spec(df: DataFrame, keys: Sequence[str], spec: dict[str, str]) -> DataFrame:
    """(keys, metric, value): long form with the transform that the spec names for each metric: identity, log10p1 or percent."""
    long = df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in spec], "metric", "raw")
    kind = F.coalesce(*[F.when(F.col("metric") == m, F.lit(k)) for m, k in spec.items()])
    value = F.when(kind == "log10p1", F.log10(F.col("raw") + 1)).when(kind == "percent", F.col("raw") * 100).otherwise(F.col("raw"))
    return long.select(*keys, "metric", value.alias("value"))


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def safe_names(df: DataFrame, name: str, order: str, out: str = "safe") -> DataFrame:
    """Names of [A-Za-z0-9_] only; names that fall together get their number in an order."""
    bare = F.regexp_replace(name, "[^A-Za-z0-9]+", "_")
    same = Window.partitionBy("__bare")
    nth = F.row_number().over(same.orderBy(order))
    return df.withColumn("__bare", bare).withColumn(out, F.when(F.count("*").over(same) > 1, F.concat_ws("_", "__bare", nth)).otherwise(F.col("__bare"))).drop("__bare")


def scaled(df: DataFrame, value: str, keys: Sequence[str], out: str = "scaled") -> DataFrame:
    """(x - lo) / (hi - lo) per key; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi <= lo, 0.0).otherwise(F.try_divide(F.col(value) - lo, hi - lo)))


def large_groups(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of the keys with that many rows or more: counts meet the table again by a join, no window over rows."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).drop("__n"), list(keys), "left_semi")


def lookup_all(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every id in its place; columns NULL where the table has none."""
    return ids.select(key).join(table, key, "left")


def checked_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails, when it runs, where b has a key twice: rows of a are never multiplied."""
    rest = [c for c in b.columns if c not in keys]
    one = b.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__b"))
    one = one.withColumn("__b", F.when(F.col("__n") == 1, F.col("__b")).otherwise(F.raise_error(F.lit("key occurs twice on the right side"))))
    return a.join(one.select(*keys, "__b"), list(keys), "left").select(*a.columns, *[F.col("__b")[c].alias(c) for c in rest])


def unique_inner(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Inner join over all frames of the keys that no frame has twice."""
    def single(df):
        return df.join(df.groupBy(key).count().filter("count = 1").select(key), key, "left_semi")

    return reduce(lambda a, b: a.join(b, key), map(single, frames))


def aligned(frames: Sequence[DataFrame], key: str) -> list[DataFrame]:
    """Each frame cut to the keys that all have."""
    shared = reduce(lambda a, b: a.join(b, key, "left_semi"), [f.select(key).distinct() for f in frames])
    return [f.join(shared, key, "left_semi") for f in frames]


def graft(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a with columns from b where b has the key; from_b tells which."""
    other = b.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__in"))
    out = a.join(other, key, "left")
    return out.select(*[F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in a.columns], F.coalesce("__in", F.lit(False)).alias("from_b"))


def suffix_merge(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], how: str = "full") -> DataFrame:
    """Both sides' columns as <name>_pre and <name>_post."""
    side = lambda df, s: df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return side(a, "pre").join(side(b, "post"), key, how)


def nearest_anchor(points: DataFrame, anchors: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """points with the anchor nearest to `at` within the key; the lower one on ties, then the least name, NULL without any.

    Points and anchors are sorted together, up and down: either way the anchor passed last is at hand. Looking ahead in one
    order instead would read the rest of the key again for every row."""
    anchors = anchors.filter(F.col(at).isNotNull()).groupBy(key, at).agg(F.min(name).alias(name))
    both = points.withColumns({"__a": F.lit(None).cast(anchors.schema[at].dataType), "__n": F.lit(None).cast(anchors.schema[name].dataType)}).unionByName(
        anchors.select(key, at, F.col(at).alias("__a"), F.col(name).alias("__n")), allowMissingColumns=True
    )
    both = both.withColumn("__s", F.when(F.col("__a").isNotNull(), F.struct(F.col("__a").alias("a"), F.col("__n").alias("n"))))
    passed = lambda *order: F.last("__s", True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    low, high = passed(at, F.col("__a").isNull()), passed(F.desc(at), F.col("__a").isNull())
    out = both.withColumns({"__low": low, "__high": high}).filter("__a is null")
    near = F.when(F.col("__high").isNull() | (F.col(at) - F.col("__low.a") <= F.col("__high.a") - F.col(at)), F.col("__low")).otherwise(F.col("__high"))
    return out.withColumn("__near", near).select(*points.columns, F.col("__near.n").alias(name), F.abs(F.col(at) - F.col("__near.a")).alias("distance"))


def share_of_reference(df: DataFrame, keys: Sequence[str], stage: str, reference: str, value: str, out: str = "share") -> DataFrame:
    """value over the value of the reference stage of the same keys."""
    base = F.max(F.when(F.col(stage) == reference, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.col(value), base))


def bands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: str) -> DataFrame:
    """Where each row's band begins and ends when rows are stacked in an order."""
    end = F.sum(n).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"band_from": end - F.col(n), "band_to": end})


def first_flags(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "duplicated") -> DataFrame:
    """False for the first row of a key in an order, True for later ones."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def local_rank(rows: DataFrame, background: DataFrame, key: str, covariate: str, value: str, width: int) -> DataFrame:
    """Mid-rank of a row's value among the `width` background rows at and before its place in covariate order, within the key."""
    both = rows.withColumn("__v", F.lit(None).cast("double")).unionByName(background.select(key, covariate, F.col(value).cast("double").alias("__v")), allowMissingColumns=True)
    # Of background rows at one place those of least value are nearest, so that the result does not hang on their order.
    w = Window.partitionBy(key).orderBy(covariate, F.col("__v").isNull(), F.desc("__v"))
    # Counted over background rows only: its running number is the place of a row.
    placed = both.withColumn("__at", F.count("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.collect_list("__v").over(Window.partitionBy(key).orderBy("__at").rangeBetween(-(width - 1), 0))
    out = placed.withColumn("__near", near).filter("__v is null")
    below, upto = F.size(F.filter("__near", lambda x: x < F.col(value))), F.size(F.filter("__near", lambda x: x <= F.col(value)))
    return out.select(*rows.columns, F.try_divide((below + upto).cast("double"), 2 * F.size("__near")).alias("local_rank"), F.size("__near").alias("n_background"))


def call_metrics(df: DataFrame, keys: Sequence[str], truth: Column, strict: Column, relaxed: Column, correct: Column) -> DataFrame:
    """Sensitivity, precision and F1 of strict and relaxed calls by any keys; NULL where the denominator is 0."""
    out = df.groupBy(*keys).agg(
        F.count_if(truth).alias("n_truth"), F.count_if(strict).alias("n_strict"), F.count_if(relaxed).alias("n_relaxed"),
        F.count_if(truth & strict & correct).alias("ok_strict"), F.count_if(truth & relaxed & correct).alias("ok_relaxed"), F.count("*").alias("n"),
    )
    for k in ("strict", "relaxed"):
        ok = F.col(f"ok_{k}")
        out = out.withColumns({f"sens_{k}": F.try_divide(ok, F.col("n_truth")), f"prec_{k}": F.try_divide(ok, F.col(f"n_{k}")), f"f1_{k}": F.try_divide(2.0 * ok, F.col("n_truth") + F.col(f"n_{k}"))})
    return out


def majority_or(df: DataFrame, key: str, label: str, otherwise: str = "mixed") -> DataFrame:
    """(key, call, share): the label of more than half the rows, else a fixed word."""
    n = df.groupBy(key, label).count()
    best = n.groupBy(key).agg(F.max_by(label, F.struct("count", label)).alias("top"), F.max("count").alias("best"), F.sum("count").alias("n"))
    return best.select(key, F.when(2 * F.col("best") > F.col("n"), F.col("top")).otherwise(otherwise).alias("call"), (F.col("best") / F.col("n")).alias("share"))


def mean_over_all(df: DataFrame, items: DataFrame, group: str, item: str, feature: str, value: str) -> DataFrame:
    """Mean value and share above 0 per (group, feature) over all items of the group: absent ones are zeros."""
    n = items.groupBy(group).agg(F.count_distinct(item).alias("n_items"))
    sums = df.groupBy(group, feature).agg(F.sum(value).alias("total"), F.count_if(F.col(value) > 0).alias("above"))
    return sums.join(n, group).select(group, feature, (F.col("total") / F.col("n_items")).alias("mean"), (F.col("above") / F.col("n_items")).alias("fraction"))


def on_off_contrast(df: DataFrame, keys: Sequence[str], on: Column, value: str) -> DataFrame:
    """Mean where on minus mean elsewhere; NULL where either side is empty."""
    return df.groupBy(*keys).agg((F.avg(F.when(on, F.col(value))) - F.avg(F.when(~on, F.col(value)))).alias("contrast"))


def folded_ranges(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Sets of whole numbers as text: '1-4,7,9-10'."""
    w = Window.partitionBy(*keys).orderBy(number)
    runs = df.select(*keys, number).distinct().withColumn("__g", F.col(number) - F.row_number().over(w)).groupBy(*keys, "__g").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r"))
    return listed.select(*keys, F.array_join("r.t", ",").alias("ranges"))


def mean_of_top(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Mean of the k largest values per key; the rank limit drops rows before the exchange."""
    top = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value)))).filter(F.col("__rn") <= k)
    return top.groupBy(*keys).agg(F.avg(value).alias("mean_top"))


def middle_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """k neighbouring rows around the middle of each key's order."""
    w = Window.partitionBy(*keys)
    at, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    begin = F.greatest(F.lit(0), F.floor((n - k) / 2))
    return df.withColumns({"__at": at, "__from": begin}).filter((F.col("__at") > F.col("__from")) & (F.col("__at") <= F.col("__from") + k)).drop("__at", "__from")


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether the key sets are equal, nested either way, or disjoint."""
    flags = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    both, only_a, only_b = (F.count_if(x) for x in (F.expr("a is not null and b is not null"), F.expr("b is null"), F.expr("a is null")))
    return flags.agg(both.alias("both"), only_a.alias("only_a"), only_b.alias("only_b")).selectExpr("both", "only_a", "only_b", "only_a = 0 and only_b = 0 as equal", "only_a = 0 as a_in_b", "only_b = 0 as b_in_a", "both = 0 as disjoint")


def clip_ranges(df: DataFrame, keys: Sequence[str], value: str, top: float = 0.99) -> DataFrame:
    """Lowest value and an upper quantile per key, widened by 1 where both are equal."""
    out = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.percentile(value, F.lit(top)).alias("hi"))
    return out.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))


def display_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The 95 % quantile, the largest value where that is not above 0, 1 where neither is."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.95)).alias("q"), F.max(value).alias("m"))
    return q.select(*keys, F.when(F.col("q") > 0, F.col("q")).when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("scale"))


def ladder(df: DataFrame, keys: Sequence[str], steps: dict[str, Column]) -> DataFrame:
    """Rows that pass the first k conditions, for every k: (keys, n, one column a step)."""
    passed, out = F.lit(True), [F.count("*").alias("n")]
    for name, c in steps.items():
        passed = passed & F.coalesce(c, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.groupBy(*keys).agg(*out)


def overridden(base: DataFrame, over: DataFrame) -> DataFrame:
    """Named sparse records on one default record: a null takes the default. base has one row, else this fails when it runs."""
    one = base.agg(F.count("*").alias("__rows"), *[F.first(c).alias(f"__{c}") for c in base.columns])
    one = one.withColumn("__rows", F.when(F.col("__rows") == 1, F.col("__rows")).otherwise(F.raise_error(F.lit("the default is not one record"))))
    both = over.crossJoin(F.broadcast(one)).filter("__rows = 1")
    return both.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in base.columns else F.col(c) for c in over.columns])
