"""Text fields, recodings, readouts of labelled groups, run plans and exact tests, by column name."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_order(labels: DataFrame, label: str) -> DataFrame:
    """(label, ord): labels that are numbers first, by value, then the others; a dimension table, small by what it is."""
    return labels.select(label, F.row_number().over(Window.orderBy(F.col(label).try_cast("int").asc_nulls_last(), label)).alias("ord"))


def grid_complete(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, complete, n): counts, and whether every pair of values of a and b occurs."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    whole = n.agg((F.count_distinct(a) * F.count_distinct(b) == F.count("*")).alias("complete"))
    return n.join(F.broadcast(whole)).select(a, b, "complete", "n")


def letter_count(text: str, letter: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))).cast("long")


def replace_first(text: str, old: str, new: str) -> Column:
    """The first occurrence alone."""
    at = F.instr(text, old)
    return F.when(at == 0, F.col(text)).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.expr(f"substring({text}, instr({text}, '{old}') + {len(old)})")))


def field_from_end(text: Column, separator: str, nth: int, least: int) -> Column:
    """The nth field from the end where there are at least so many; else NULL."""
    parts = F.split(text, separator)
    return F.when(F.size(parts) >= least, F.element_at(parts, -nth))


def recode(df: DataFrame, column: str, names: dict[str, str], out: str) -> DataFrame:
    """Rows whose value the dictionary lacks go."""
    value = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)]
    return df.filter(F.col(column).isin(list(names))).withColumn(out, value)


def single_targets(links: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target) of the keys with one target; others are dropped."""
    return links.groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("__max")).filter(F.col(target) == F.col("__max")).drop("__max")


def mixing_counts(df: DataFrame, n: str, shares: Sequence[float]) -> DataFrame:
    """How many reads to add so that they make up each share; halves go to the even neighbour."""
    out = df.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in shares])))
    return out.withColumn("mix", F.bround(F.col(n) * F.col("alpha") / (1 - F.col("alpha")), 0).cast("long"))


def label_support(df: DataFrame, key: str, label: str, own: Column) -> DataFrame:
    """Per key: the most frequent label, its share, and the share of a given label."""
    c = df.groupBy(key, label).agg(F.count("*").alias("n"))
    out = c.groupBy(key).agg(F.max_by(label, F.struct("n", label)).alias("modal"), F.max("n").alias("top"), F.sum("n").alias("total"), F.sum(F.when(F.col(label) == own, F.col("n")).otherwise(0)).alias("own"))
    return out.select(key, "modal", (F.col("top") / F.col("total")).alias("modal_share"), (F.col("own") / F.col("total")).alias("support"))


def label_flow(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Counts of moves between two labellings; keys of one side only are (new) or (dropped)."""
    j = a.select(key, F.col(label).alias("__a")).join(b.select(key, F.col(label).alias("__b")), key, "full")
    g = j.groupBy(F.coalesce("__a", F.lit("(new)")).alias("from_label"), F.coalesce("__b", F.lit("(dropped)")).alias("to_label"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("__a") != F.col("__b")).alias("movers"))


def guarded_corr(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson's r per key, NULL where either side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    of = lambda c: F.when(both, F.col(c))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop(of(x)).alias("__x"), F.stddev_pop(of(y)).alias("__y"), F.covar_pop(of(x), of(y)).alias("__c"))
    return out.select(*keys, "n", F.try_divide(F.col("__c"), F.col("__x") * F.col("__y")).alias("r"))


def best_and_margin(df: DataFrame, key: str, item: str, score: str, own: Column) -> DataFrame:
    """Best item, its lead over the second, the score of the key's own item, and whether that one is best.

    The rank limit is pushed below the exchange, so that no key is gathered whole."""
    two = df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item))).filter("__rn <= 2")
    at = lambda c, n: F.max(F.when(F.col("__rn") == n, F.col(c)))
    best = two.groupBy(key).agg(at(item, 1).alias("best"), (at(score, 1) - at(score, 2)).alias("margin"))
    mine = df.filter(F.col(item) == own).groupBy(key).agg(F.max(score).alias("self"))
    return best.join(mine, key, "left").withColumn("correct", F.col("best") == own)


def decoded_tasks(tasks: DataFrame, items: DataFrame, task: str) -> DataFrame:
    """task number to (panel, item): quotient and remainder by the number of items, one row with the array `g`."""
    n = F.size("g")
    return tasks.join(F.broadcast(items)).withColumns({"panel": F.expr(f"{task} div size(g)"), "item": F.get("g", (F.col(task) % n).cast("int"))}).drop("g")


def range_split(df: DataFrame, tasks: int) -> DataFrame:
    """(task, first, last): half-open ranges of row numbers, each of ceil(n / tasks) rows at most."""
    n = df.agg(F.count("*").alias("n")).withColumn("each", F.expr(f"(n + {tasks - 1}) div {tasks}"))
    return n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task"), "n", "each").select("task", (F.col("task") * F.col("each")).alias("first"), F.least("n", (F.col("task") + 1) * F.col("each")).alias("last"))


def tally(df: DataFrame, key: str) -> DataFrame:
    """Counts of a class column with their percentages."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("__t")))).select(key, "n", (100.0 * F.col("n") / F.col("__t")).alias("pct"))


def padded(df: DataFrame, start: str, end: str, pad: int, width: int, least: int = 300, most: int = 2000) -> DataFrame:
    """first, last and the number of bins of a region with a margin; bins of `width`, within bounds."""
    out = df.withColumns({"first": F.greatest(F.lit(0), F.col(start) - pad), "last": F.col(end) + pad})
    return out.withColumn("bins", F.greatest(F.lit(least).cast("long"), F.least(F.lit(most).cast("long"), F.expr(f"(last - first) div {width}"))))


def mutual_information(counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """Of two labellings, in nats, from their contingency counts; one row."""
    rows, cols = counts.groupBy(a).agg(F.sum(n).alias("__r")), counts.groupBy(b).agg(F.sum(n).alias("__c"))
    j = counts.join(rows, a).join(cols, b).join(F.broadcast(counts.agg(F.sum(n).alias("__t"))))
    return j.agg(F.sum(F.col(n) / F.col("__t") * F.log(F.col(n) * F.col("__t") / (F.col("__r") * F.col("__c")))).alias("mi"))


def expected_mutual_information(a: Sequence[int], b: Sequence[int]) -> float:
    """Expectation over all labellings with these group sizes (hypergeometric model), in nats."""
    n = sum(a)
    fact = [0.0, 0.0]
    for i in range(2, n + 1):
        fact.append(fact[-1] + math.log(i))
    total = 0.0
    for x, times_x in _sizes(a):
        for y, times_y in _sizes(b):
            s = 0.0
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = fact[x] + fact[y] + fact[n - x] + fact[n - y] - fact[n] - fact[k] - fact[x - k] - fact[y - k] - fact[n - x - y + k]
                s += k / n * math.log(n * k / (x * y)) * math.exp(p)
            total += s * times_x * times_y
    return total


def _sizes(x: Sequence[int]) -> list[tuple[int, int]]:
    s = pd.Series(list(x)).value_counts()
    return list(zip(s.index.tolist(), s.tolist(), strict=True))


def adjusted_mutual_information(labels: DataFrame, a: str, b: str) -> float:
    """(MI - EMI) / (mean entropy - EMI), 1 for equal partitions. Spark counts; the driver sees group sizes only."""
    c = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    mi = mutual_information(c, a, b, "n").first()[0]
    sizes = [[r[0] for r in c.groupBy(x).agg(F.sum("n")).select("sum(n)").collect()] for x in (a, b)]
    n = sum(sizes[0])
    entropy = [-sum(x / n * math.log(x / n) for x in s) for s in sizes]
    emi = expected_mutual_information(*sizes)
    mean = sum(entropy) / 2
    return 1.0 if abs(mean - emi) < 1e-12 else (mi - emi) / (mean - emi)


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds odds_ratio (of the sample; NULL where b or c is 0) and the two-sided p of each 2 x 2 table."""

    @F.pandas_udf("double")
    def p_value(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([fisher_p(*(int(v) for v in t)) for t in zip(w, x, y, z, strict=True)], dtype="float64")

    return df.withColumns({"odds_ratio": F.try_divide(F.col(a) * F.col(d), F.col(b) * F.col(c)), "p": p_value(a, b, c, d)})


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Sum of the chances of all tables with these margins that are no likelier than the one seen."""
    row, col, n = a + b, a + c, a + b + c + d
    f = math.lgamma
    chance = lambda k: math.exp(f(row + 1) - f(k + 1) - f(row - k + 1) + f(n - row + 1) - f(col - k + 1) - f(n - row - col + k + 1) - f(n + 1) + f(col + 1) + f(n - col + 1))
    seen = chance(a)
    return min(1.0, sum(p for p in map(chance, range(max(0, row + col - n), min(row, col) + 1)) if p <= seen * (1 + 1e-7)))


def permutation_p(observed: DataFrame, null: DataFrame, key: str, value: str) -> DataFrame:
    """(1 + draws at least as large) / (1 + draws) per key, with the effect z and the 95 % quantile of the draws."""
    j = observed.select(key, F.col(value).alias("__o")).join(null.select(key, F.col(value).alias("__v")), key, "left")
    g = j.groupBy(key, "__o").agg(F.count("__v").alias("draws"), F.count_if(F.col("__v") >= F.col("__o")).alias("ge"), F.avg("__v").alias("__mean"), F.stddev_samp("__v").alias("__sd"), F.percentile("__v", F.lit(0.95)).alias("q95"))
    return g.select(key, F.col("__o").alias(value), ((1 + F.col("ge")) / (1 + F.col("draws"))).alias("p"), F.when(F.col("__sd") > 0, (F.col("__o") - F.col("__mean")) / F.col("__sd")).alias("z"), "q95")
