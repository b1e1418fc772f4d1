"""Merkle manifest of a dataset by parent preimages.

Each row is a leaf. Per group (a language), leaves in order of id are hashed in runs of FAN until one node remains, the
subroot; subroots in order of group are hashed likewise up to the root. A level is a table of parents that stores each
parent's preimage, the concatenated hashes of its children. A leaf joins the preimages of its ancestors: what is left of
each after the 64 characters of its own slot are excised are its siblings, and with another hash spliced into the slot
the preimage folds to a new parent. No level gathers more than FAN nodes into a row.

Places in the order come from a sort by ranges and the sums of rows per range and group, so that a group of any size is
ranked by many tasks; groups are ranked in the same way for the upper tree. Preimages are passed down from parents to
children level by level, so each leaf is joined once, with its parent.

Defined results: null columns are written as `-`; a null id comes first in its group; rows of equal id are ordered by
leaf hash and all stay; the null group comes first; very long texts are hashed whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

FAN, HEX = 8, 64
LEAF_COLS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP, TOP = "__tessera_group", ""
PATH = "array<struct<slot: int, preimage: string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(*values: Column) -> Column:
    """Of the values in order: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    part = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return sha(F.concat(*[part(v.cast("string")) for v in values]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def group_key(col: Column) -> Column:
    """A group as a string that is never null: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds `pos`, from 0 without gaps in each group, in the order of the given columns, nulls first.

    Ranges of (group, order) lie in partitions; a row's place is its place within the partition and the rows of its
    group in the partitions before."""
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = scratch.table(rows.repartitionByRange(F.col(GROUP), *by).withColumn("part", F.spark_partition_id()), name)
    counts = dealt.groupBy(GROUP, "part").agg(F.count("*").alias("n"))
    before = counts.select(GROUP, "part", (F.sum("n").over(Window.partitionBy(GROUP).orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(GROUP, "part").orderBy(*by)) - 1
    return dealt.withColumn("inside", inside).join(before, [GROUP, "part"]).withColumn("pos", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def parents(nodes: DataFrame) -> DataFrame:
    """(group, pos, preimage, hash) above (group, pos, hash): one row for each run of FAN, none for a group of one node."""
    runs = nodes.groupBy(GROUP, F.expr(f"pos div {FAN}").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "hash"))).alias("kids"))
    level = runs.select(GROUP, "pos", F.array_join(F.col("kids.hash"), "").alias("preimage")).withColumn("hash", sha(F.col("preimage")))
    return level.filter((F.col("pos") > 0) | (F.length("preimage") > HEX))


@dataclass
class Tree:
    """Trees of all groups. sizes: (group, m leaves, top hash); levels: the parents above the leaves, by height."""

    leaves: DataFrame
    levels: list[DataFrame]
    sizes: DataFrame


def grow(leaves: DataFrame, scratch: Scratch, name: str) -> Tree:
    """Trees over (group, pos, hash) in written tables; a loop over heights, FAN times fewer nodes in each."""
    sizes = scratch.table(leaves.groupBy(GROUP).agg((F.max("pos") + 1).alias("m")), f"{name}_sizes")
    most = sizes.agg(F.max("m")).first()[0] or 0
    levels, nodes = [], leaves
    while FAN ** len(levels) < most:
        levels.append(nodes := scratch.table(parents(nodes), f"{name}{len(levels) + 1}"))
    tops = sizes.limit(0).select(GROUP, F.lit("").alias("hash"))
    for height, nodes in enumerate([leaves, *levels]):
        tops = tops.unionByName(nodes.filter("pos = 0").join(_ending(sizes, height), GROUP).select(GROUP, "hash"))
    return Tree(leaves, levels, scratch.table(sizes.join(tops, GROUP), f"{name}_tops"))


def _ending(sizes: DataFrame, height: int) -> DataFrame:
    """Groups whose last node stands at a height: with up to FAN**height leaves and more than a height less holds."""
    return sizes.filter(f"m <= {FAN**height}L and m > {FAN ** (height - 1) if height else 0}L")


def with_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves with `path`, (own slot, preimage) of each ancestor from the parent up, and `top`, their group's top hash.

    above: (group, path above its top). Preimages go down from parents to children; a group's top takes what lies above it."""
    ends = tree.sizes.withColumnRenamed("hash", "top").join(above, GROUP)
    known = None
    for height in range(len(tree.levels), -1, -1):
        nodes = (tree.leaves if height == 0 else tree.levels[height - 1]).withColumn("up", F.expr(f"pos div {FAN}"))
        up = _ending(ends, height).select(GROUP, F.lit(0).cast("long").alias("up"), F.lit(None).cast("string").alias("above_preimage"), "path", "top")
        if known is not None:
            up = up.unionByName(known.select(GROUP, F.col("pos").alias("up"), F.col("preimage").alias("above_preimage"), "path", "top"))
        slot = F.struct((F.col("pos") % FAN * HEX).cast("int").alias("slot"), F.col("above_preimage").alias("preimage"))
        own = F.when(F.col("above_preimage").isNull(), F.col("path")).otherwise(F.concat(F.array(slot), F.col("path"))).cast(PATH)
        known = nodes.join(up.hint("merge"), [GROUP, "up"]).withColumn("path", own).drop("up", "above_preimage")
    return known


def _around(step: Column, own: Column) -> Column:
    """A preimage with a node's own slot replaced."""
    return F.concat(F.substr(step["preimage"], F.lit(1), step["slot"]), own, F.substr(step["preimage"], step["slot"] + HEX + 1))


def siblings(path: Column) -> Column:
    """The hashes beside a node, level by level, left to right: each preimage without the node's own slot."""
    return F.array_join(F.transform(path, lambda step: _around(step, F.lit(""))), "")


def fold(path: Column, hashed: Column) -> Column:
    """The topmost hash when a node with this hash takes its slot in the preimages of its path, one after the other."""
    return F.aggregate(path, hashed, lambda h, step: sha(_around(step, h)))


def leaf_table(docs: DataFrame, cols=LEAF_COLS) -> DataFrame:
    """(id, group, hash, other): leaf hashes of the rows, and of the rows after tampering. cols: id, source, group, count, text."""
    key, _, lang, _, text = cols
    hit = F.crc32(docs[key].cast("string").cast("binary")) % 3 == 0
    other = F.when(hit, lower_ascii(docs[text])).otherwise(docs[text])
    hashed = lambda t: leaf_hash(*[t if c == text else docs[c] for c in cols])
    return docs.select(docs[key].alias("id"), group_key(docs[lang]).alias(GROUP), hashed(docs[text]).alias("hash"), hashed(other).alias("other"))


def manifest(docs: DataFrame, cols=LEAF_COLS, scratch: Scratch | None = None) -> tuple[Tree, Tree]:
    """The trees of the groups over all rows, and the tree over their subroots, as tables."""
    scratch = scratch or Scratch(docs.sparkSession)
    lower = grow(scratch.table(placed(scratch.table(leaf_table(docs, cols), "hashed"), ["id", "hash"], scratch, "dealt"), "leaves"), scratch, "lower")
    subroots = lower.sizes.select(F.lit(TOP).alias(GROUP), F.col(GROUP).alias("name"), "hash")
    return lower, grow(scratch.table(placed(subroots, ["name"], scratch, "names"), "subroots"), scratch, "upper")


def audit(docs: DataFrame, cols=LEAF_COLS, scratch: Scratch | None = None) -> DataFrame:
    """Per row its leaf, subroot, root, the hash of its siblings, and whether the tampered leaf folds to the root."""
    lower, upper = manifest(docs, cols, scratch)
    nothing = upper.sizes.select(GROUP, F.array().cast(PATH).alias("path"))
    above = with_paths(upper, nothing).select(F.col("name").alias(GROUP), "path", F.col("top").alias("root"))
    rows = with_paths(lower, above.select(GROUP, "path"))
    root = upper.sizes.select("hash").first()
    rows = rows.select(F.col("id").alias(cols[0]), F.col("hash").alias("leaf"), F.col("top").alias("subroot"), F.lit(root and root[0]).cast("string").alias("root"), sha(siblings(F.col("path"))).alias("proof_sha256"), fold(F.col("path"), F.col("other")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
