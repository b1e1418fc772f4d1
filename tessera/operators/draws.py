"""Draws that any engine repeats: order and choice by a portable hash of integer keys; pools dealt by offsets; fuzzy joins by pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.strings import hamming, uniform_hash
from tessera.operators.rounds import settled

#: Rows of last stretches that every task may hold.
FEW = 1 << 16


def shuffled(df: DataFrame, keys: Sequence[str], id_col: str, seed: int = 0, out: str = "place") -> DataFrame:
    """A place for each row in a random order of its group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(uniform_hash(F.col(id_col), seed), id_col)))


def capped(df: DataFrame, keys: Sequence[str], id_col: str, most: int, seed: int = 0) -> DataFrame:
    """At most so many rows of a group, drawn without replacement; the rank limit drops rows before the exchange."""
    return shuffled(df, keys, id_col, seed, "__p").filter(F.col("__p") <= most).drop("__p")


def repeated_draws(df: DataFrame, keys: Sequence[str], id_col: str, size: int, draws: int) -> DataFrame:
    """`draws` samples of `size` rows of each group, with the number of the draw.

    A first pass counts the rows of each stretch of the hash, and only those of the stretches that hold the least `size`
    are ranked, so that a draw's rows are not sorted whole. The last stretches are written once and sent to all tasks where
    they are few; the rows of the draws are not, whose size is guessed from the table that they are made of."""
    h = uniform_hash(F.col(id_col) * 1009 + F.col("draw"))
    many = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__s", F.coalesce(F.floor(h / 2**22).cast("int"), F.lit(-1)))
    counts = many.groupBy(*keys, "draw", "__s").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys, "draw").orderBy("__s")) - F.col("__c")
    last = counts.withColumn("__before", before).filter(F.col("__before") < size).groupBy(*keys, "draw").agg(F.max("__s").alias("__last"))
    last, same = settled(last), F.lit(True)
    last = last.hint("broadcast" if last.count() <= FEW else "merge")
    for c in (*keys, "draw"):
        last = last.withColumnRenamed(c, f"__k_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    few = many.join(last, same & (F.col("__s") <= F.col("__last")), "left_semi").select(*df.columns, "draw")
    w = Window.partitionBy(*keys, "draw").orderBy(h, id_col)
    return few.withColumn("__p", F.row_number().over(w)).filter(F.col("__p") <= size).drop("__p")


def permuted_column(df: DataFrame, keys: Sequence[str], id_col: str, value: str, seed: int = 1) -> DataFrame:
    """The values of a column dealt anew among the rows of each group."""
    here = shuffled(df.drop(value), keys, id_col, 0, "__p")
    there = shuffled(df.select(*keys, id_col, value), keys, id_col, seed, "__p").drop(id_col)
    return here.join(there, [*keys, "__p"]).drop("__p")


def injected(df: DataFrame, id_col: str, share: float, seed: int = 0, out: str = "injected") -> DataFrame:
    """Marks a share of the rows."""
    return df.withColumn(out, uniform_hash(F.col(id_col), seed) < int(share * 2**32))


def consumed_slices(templates: DataFrame, pool: DataFrame, group: str, template: str, n: str, item: str) -> DataFrame:
    """(group, template, item): each template takes the next n items of its group's pool, so that no item is taken twice."""
    w = Window.partitionBy(group)
    end = F.sum(n).over(w.orderBy(template).rowsBetween(Window.unboundedPreceding, 0))
    want = templates.select(group, template, (end - F.col(n)).alias("__from"), end.alias("__to"))
    have = pool.select(group, item, (F.row_number().over(w.orderBy(uniform_hash(F.col(item)), item)) - 1).alias("__at"))
    return have.join(want, group).filter("__at >= __from and __at < __to").select(group, template, item)


def near_strings(queries: DataFrame, known: DataFrame, text: str, target: str, edits: int, length: int) -> DataFrame:
    """(text, target, distance): equal ones first, else the nearest known string with at most so many substitutions, the smallest on ties.

    Strings of one length are cut into edits + 1 pieces; two that differ in no more places share a piece whole, so pairs
    come from equal pieces and no pair of strings without one is made."""
    cuts = [length * i // (edits + 1) for i in range(edits + 2)]
    pieces = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring(c, a + 1, b - a).alias("s")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]))
    q = queries.filter(F.length(text) == length).select(text).distinct()
    k = known.filter(F.length(target) == length).select(target).distinct()
    same = q.join(k, q[text] == k[target]).select(text, target, F.lit(0).alias("distance"))
    left = q.join(same.select(text), text, "left_anti").select(text, pieces(text).alias("p"))
    pairs = left.join(k.select(target, pieces(target).alias("p")), "p").select(text, target).distinct()
    near = pairs.withColumn("distance", hamming(F.col(text), F.col(target))).filter(F.col("distance") <= edits)
    best = near.groupBy(text).agg(F.min(F.struct("distance", target)).alias("b")).select(text, F.col(f"b.{target}").alias(target), F.col("b.distance").alias("distance"))
    return same.unionByName(best)


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bin_size: int) -> DataFrame:
    """Every (range, point) with start <= point < end; ranges may overlap and each match counts. Both sides meet by bins, not by key alone."""
    p = points.withColumn("__bin", F.floor(F.col(at) / bin_size))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bin_size))))
    return p.join(r, [*keys, "__bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def profile_difference(df: DataFrame, key: str, feature: str, value: str, group: Column) -> DataFrame:
    """Per key its cosine with the mean profile of the good ones (group 1) and of the bad ones (group 0), and the difference.

    Sparse: absent features are zeros in every product and norm."""
    marked = df.withColumn("__g", group.cast("int"))
    profile = marked.groupBy("__g", feature).agg(F.sum(value).alias("__m"))
    norm = profile.groupBy("__g").agg(F.sqrt(F.sum(F.col("__m") * F.col("__m"))).alias("__pn"))
    dots = marked.drop("__g").join(profile, feature).groupBy(key, "__g").agg(F.sum(F.col(value) * F.col("__m")).alias("__d"))
    own = df.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("__n"))
    c = dots.join(F.broadcast(norm), "__g").join(own, key).withColumn("__c", F.try_divide(F.col("__d"), F.col("__n") * F.col("__pn")))
    at = lambda g: F.coalesce(F.max(F.when(F.col("__g") == g, F.col("__c"))), F.lit(0.0))
    return c.groupBy(key).agg(at(1).alias("good"), at(0).alias("bad")).withColumn("dif", F.col("good") - F.col("bad"))
