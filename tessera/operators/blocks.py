"""Readouts of co-assignment, diffusion over edges, guarded whitelists and registries, run grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import together as tg


def nonempty(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Entries of the rows and columns whose sums are above 0; NULL counts as 0."""
    keep = lambda c: df.groupBy(c).agg(F.sum(F.coalesce(value, F.lit(0))).alias("__s")).filter("__s > 0").select(c)
    return df.join(keep(row), row, "left_semi").join(keep(column), column, "left_semi")


def whitelisted(df: DataFrame, whitelist: DataFrame, key: str) -> DataFrame:
    """Rows of listed keys; fails, when it runs, where a listed key has no row at all."""
    n = whitelist.select(key).distinct().join(df.groupBy(key).agg(F.count("*").alias("__n")), key, "left")
    checked = n.withColumn("__n", F.when(F.col("__n").isNotNull(), F.col("__n")).otherwise(F.raise_error(F.lit("a listed key is missing"))))
    return df.join(checked.filter("__n > 0").select(key), key, "left_semi")


def per_length(df: DataFrame, widths: DataFrame, key: str, value: str, width: str, unit: float = 1000.0) -> DataFrame:
    """Values per unit of the key's length."""
    return df.join(widths.select(key, width), key).withColumn(value, F.try_divide(F.col(value), F.col(width) / unit)).drop(width)


def diffused(edges: DataFrame, values: DataFrame, hops: int) -> DataFrame:
    """(node, x) after so many steps over the symmetrised, row-normalised edges (src, dst, w)."""
    both = edges.select("src", "dst", "w").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    p = both.join(both.groupBy("src").agg(F.sum("w").alias("t")), "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))
    for _ in range(hops):
        values = p.join(values.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("p") * F.col("x")).alias("x"))
    return values


def block_means(f: DataFrame, blocks: DataFrame) -> DataFrame:
    """(bi, bj, mean, n): mean co-assignment within and between blocks of (i, j, f), each unordered pair once; absent pairs are zeros.

    blocks: (item, block)."""
    one, two = (blocks.select(F.col("item").alias(x), F.col("block").alias(f"b_{x}")) for x in "ij")
    seen = f.join(one, "i").join(two, "j").groupBy(F.least("b_i", "b_j").alias("bi"), F.greatest("b_i", "b_j").alias("bj")).agg(F.sum("f").alias("s"))
    return _means(seen, blocks)


def _of_runs(assigned: DataFrame, seed: str, item: str, label: str, blocks: DataFrame, inside: bool) -> DataFrame:
    """(gi, gj, f, n): pairs of items by their blocks and the share of seeds that put them together."""
    seeds = assigned.select(seed).distinct().agg(F.count("*").alias("seeds"))
    counts = tg.of_groups(assigned, seed, item, label, blocks.select("item", F.col("block").alias("g")), inside)
    return counts.crossJoin(F.broadcast(seeds)).select("gi", "gj", (F.col("together") / F.col("seeds")).alias("f"), "n")


def block_means_of_runs(assigned: DataFrame, seed: str, item: str, label: str, blocks: DataFrame) -> DataFrame:
    """What `block_means` gives for the co-assignment of (seed, item, label), without making its pairs."""
    counts = _of_runs(assigned, seed, item, label, blocks, False)
    return _means(counts.groupBy(F.col("gi").alias("bi"), F.col("gj").alias("bj")).agg(F.sum(F.col("f") * F.col("n")).alias("s")), blocks)


def _means(seen: DataFrame, blocks: DataFrame) -> DataFrame:
    size = blocks.groupBy("block").agg(F.count("*").alias("m"))
    a, b = (size.select(F.col("block").alias(f"b{x}"), F.col("m").alias(f"m{x}")) for x in "ij")
    grid = a.join(F.broadcast(b)).filter("bi <= bj").withColumn("n", F.when(F.col("bi") == F.col("bj"), F.col("mi") * (F.col("mi") - 1) / 2).otherwise(F.col("mi") * F.col("mj")))
    return grid.join(seen, ["bi", "bj"], "left").select("bi", "bj", F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("n")).alias("mean"), F.col("n").cast("long").alias("n"))


def block_confidence(f: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per block: members, mean co-assignment of its pairs, its spread over that of fair draws, share of pairs of 0.9 or more."""
    one, two = (blocks.select(F.col("item").alias(x), F.col("block").alias(f"b_{x}")) for x in "ij")
    inside = f.join(one, "i").join(two, "j").filter("b_i = b_j").groupBy(F.col("b_i").alias("block"))
    s = inside.agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("q"), F.count_if(F.col("f") >= 0.9).alias("high"))
    return _confidence(s, blocks)


def block_confidence_of_runs(assigned: DataFrame, seed: str, item: str, label: str, blocks: DataFrame) -> DataFrame:
    """What `block_confidence` gives for the co-assignment of (seed, item, label), without making its pairs."""
    f, n = F.col("f"), F.col("n")
    counts = _of_runs(assigned, seed, item, label, blocks, True).groupBy(F.col("gi").alias("block"))
    return _confidence(counts.agg(F.sum(f * n).alias("s"), F.sum(f * f * n).alias("q"), F.sum(F.when(f >= 0.9, n).otherwise(0)).alias("high")), blocks)


def _confidence(s: DataFrame, blocks: DataFrame) -> DataFrame:
    out = blocks.groupBy("block").agg(F.count("*").alias("m")).join(s, "block", "left").na.fill(0, ["s", "q", "high"]).withColumn("pairs", F.col("m") * (F.col("m") - 1) / 2)
    mean = F.try_divide(F.col("s"), F.col("pairs"))
    return out.select("block", "m", mean.alias("conf"), F.try_divide(F.try_divide(F.col("q"), F.col("pairs")) - mean * mean, mean * (1 - mean)).alias("stab"), F.try_divide(F.col("high"), F.col("pairs")).alias("frac_high"))


def registered(df: DataFrame, registry: dict[str, str], key: Column, out: str) -> DataFrame:
    """A parameter by the key's value; fails, when it runs, on a key that is not registered."""
    value = F.create_map(*[F.lit(x) for kv in registry.items() for x in kv])[key]
    return df.withColumn(out, F.coalesce(value, F.raise_error(F.concat(F.lit("not registered: "), F.coalesce(key, F.lit("NULL"))))))


def missing_chunks(samples: DataFrame, sample: str, chunks: int, seeds: int, done: DataFrame) -> DataFrame:
    """(sample, chunk, first, last): half-open seed ranges of ceil(seeds / chunks), clipped, without those done."""
    each = -(-seeds // chunks)
    grid = samples.select(sample).distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    grid = grid.withColumns({"first": F.least(F.col("chunk") * each, F.lit(seeds)), "last": F.least((F.col("chunk") + 1) * each, F.lit(seeds))}).filter("first < last")
    return grid.join(done.select(sample, "chunk"), [sample, "chunk"], "left_anti")


def agreeing(df: DataFrame, derived: Column, stated: str, allowed: Sequence[str]) -> DataFrame:
    """df as it is; fails, when it runs, on a row whose derived label is missing, not allowed, or not the stated one."""
    ok = F.coalesce((derived == F.col(stated)) & derived.isin(*allowed), F.lit(False))
    return df.withColumn(stated, F.when(ok, F.col(stated)).otherwise(F.raise_error(F.lit("a label disagrees with the design"))))
