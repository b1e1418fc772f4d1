"""Cleaning of barcodes: which genomes a barcode may keep, which of its reads go, and what is left.

The public parameters are those of the outside tool that runs call; its formulas are not published, so the rules are
stated here. A barcode's allowed genomes follow from its call and the policies; with a design, the plate position in the
last `suffix` characters of the barcode says what it should hold, and under `strict` a barcode with another call loses
all reads. A read goes when its genome is not allowed, unless it is ambiguous or its lead over the next genome is at most
`safe_delta`. Floors on what is left are flags, not gates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Calls of barcodes, classes of reads.
SINGLE, DOUBLET, AMBIGUOUS, INDISTINGUISHABLE = "single", "doublet", "ambiguous", "indistinguishable"
UNSURE = "ambiguous"


@dataclass(frozen=True)
class Policy:
    """doublets and indistinguishable: top1 or both or drop; ambiguous: design_rescue, top1_rescue or drop."""

    ambiguous: str = "top1_rescue"
    doublets: str = "top1"
    indistinguishable: str = "top1"
    strict: bool = True
    suffix: int = 10
    safe_delta: int = 3
    min_reads: int = 100
    min_fraction: float = 0.9

    def __post_init__(self):
        if self.ambiguous not in ("design_rescue", "top1_rescue", "drop") or not {self.doublets, self.indistinguishable} <= {"top1", "both", "drop"}:
            raise ValueError(f"unknown policy in {self}")


def _kept(policy: str):
    both = F.array_compact(F.array("genome1", "genome2"))
    return {"top1": F.array_compact(F.array("genome1")), "both": both, "drop": F.array().cast("array<string>")}[policy]


def allowed(calls: DataFrame, policy: Policy, design: DataFrame | None = None) -> DataFrame:
    """(barcode, call, expected, matches, allowed) of calls (barcode, call, genome1, genome2); design: (position, genome).

    matches is null without a design or an entry in it. A position must have one genome."""
    c = calls.withColumn("position", F.right(F.col("barcode"), F.lit(policy.suffix)))
    if design is None:
        c = c.withColumn("expected", F.lit(None).cast("string"))
    else:
        one = design.groupBy("position").agg(F.when(F.count_distinct("genome") == 1, F.min("genome")).otherwise(F.raise_error(F.concat(F.lit("two genomes at "), F.first("position"))).cast("string")).alias("expected"))
        c = c.join(one, "position", "left")
    nothing = F.array().cast("array<string>")
    rescue = {"design_rescue": F.array_compact(F.array("expected")), "top1_rescue": _kept("top1"), "drop": nothing}[policy.ambiguous]
    by_call = F.when(F.col("call") == SINGLE, _kept("top1")).when(F.col("call") == DOUBLET, _kept(policy.doublets)).when(F.col("call") == INDISTINGUISHABLE, _kept(policy.indistinguishable)).when(F.col("call") == AMBIGUOUS, rescue).otherwise(nothing)
    # An ambiguous barcode has no call to hold against the design.
    matches = F.when(F.col("expected").isNotNull() & (F.col("call") != AMBIGUOUS), F.array_contains(by_call, F.col("expected")))
    keep = F.when(F.lit(policy.strict) & ~F.coalesce(matches, F.lit(True)), nothing).otherwise(by_call)
    return c.select("barcode", "call", "expected", matches.alias("matches"), keep.alias("allowed"))


def judged(reads: DataFrame, barcodes: DataFrame, policy: Policy) -> DataFrame:
    """reads (read, barcode, genome, assigned_class, delta) with `reason` to drop, null for those that stay. A barcode without a call loses its reads."""
    j = reads.join(barcodes, "barcode", "left")
    mismatch = F.lit(policy.strict) & (F.col("matches") == F.lit(False))
    none = F.coalesce(F.size("allowed"), F.lit(0)) == 0
    fine = F.array_contains("allowed", F.col("genome")) | (F.col("assigned_class") == UNSURE) | (F.col("delta") <= policy.safe_delta)
    reason = F.when(F.col("call").isNull(), "no call").when(mismatch, "design mismatch").when(none, "nothing allowed").when(~F.coalesce(fine, F.lit(False)), "other genome")
    return j.withColumn("reason", reason)


def drop_list(judged_reads: DataFrame) -> DataFrame:
    """(read, barcode, reason) of the reads that go."""
    return judged_reads.filter("reason is not null").select("read", "barcode", "reason")


def composition(judged_reads: DataFrame, barcodes: DataFrame, policy: Policy) -> DataFrame:
    """Per called barcode: reads before and after, those of allowed genomes after, their share, and whether both floors are met."""
    stays = F.col("reason").isNull()
    n = judged_reads.groupBy("barcode").agg(F.count("*").alias("pre"), F.count_if(stays).alias("post"), F.count_if(stays & F.array_contains("allowed", F.col("genome"))).alias("own"))
    out = barcodes.join(n, "barcode", "left").fillna(0, ["pre", "post", "own"])
    share = F.try_divide(F.col("own"), F.col("post"))
    return out.select("barcode", "call", "expected", "matches", F.array_join("allowed", "+").alias("allowed"), "pre", "post", share.alias("own_share"), ((F.col("post") >= policy.min_reads) & (F.coalesce(share, F.lit(0.0)) >= policy.min_fraction)).alias("passes"))
