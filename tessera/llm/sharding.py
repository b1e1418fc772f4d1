"""Sharding by minimax contiguous partition.

Equal texts form one atomic group. Groups are ordered: those larger than a fair share first, each a shard of its own,
then the rest by a 64-bit hash of the text. The smallest feasible shard capacity over that order is found by binary
search with a greedy check, and the order is cut there.

The groups are never collected. The driver sees sums per hash range (at most 2**first_bits of them) and, level by
level, finer sums of the ranges in which a cut can still fall, at most 2**first_bits again, until every such range holds
a single group; the result is the same as on the whole list. Groups of over 1/HEAVY of all bytes, fewer than HEAVY of
them, stand alone from the start: a range that holds one would leave the place of every later cut open by its size.
The ranges to look into go to the workers as a table, broadcast below those bounds.

Defined results: null text counts as empty (size 1, CRC 0) and shares the group of the empty text; repeated rows stay
and get slots of their own; an empty table gives an empty result; other columns are not read. With fewer groups than
shards the last shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, sqrt_buckets

HEAVY = 4096


@dataclass
class Span:
    """A hash range: all groups whose key, shifted right, is `bucket`."""

    low: int
    shift: int
    size: int
    groups: int


def _ends(prefix: list[int], spans: list[Span], capacity: int, n: int, split: bool) -> list[int]:
    """Byte positions after each greedy shard; split: a range of several groups may be cut anywhere."""
    at, out = 0, []
    for _ in range(n):
        to = at + capacity
        j = bisect_right(prefix, to) - 1
        if j >= len(spans):
            at = prefix[-1]
        else:
            at = to if split and spans[j].groups > 1 else prefix[j]
        out.append(at)
    return out


def _least(prefix: list[int], spans: list[Span], n: int, floor: int, split: bool) -> int:
    """Smallest capacity with which n greedy shards reach the end."""
    low, high = max(floor, -(-prefix[-1] // n)), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if _ends(prefix, spans, mid, n, split)[-1] >= prefix[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _prefix(spans: list[Span]) -> list[int]:
    out = [0]
    for s in spans:
        out.append(out[-1] + s.size)
    return out


def _collect(groups: DataFrame, shift: int, heavy: list[int], within: tuple[int, set[int]] | None = None) -> list[Span]:
    """Sums of groups per hash range, in the wider ranges `within` (a shift and its ranges) where given; a heavy key ends
    one part of its range and begins another."""
    session = groups.sparkSession
    if within is not None:
        wide = session.createDataFrame([(b,) for b in sorted(within[1])], "wide long")
        groups = groups.join(F.broadcast(wide), F.shiftright("key", within[0]) == F.col("wide"), "left_semi")
    groups = groups.withColumn("b", F.shiftright("key", shift))
    inside: dict[int, list[int]] = {}
    for k in heavy:
        inside.setdefault(k >> shift, []).append(k)
    if inside:
        groups = groups.join(F.broadcast(session.createDataFrame(list(inside.items()), "b long, own array<long>")), "b", "left").filter("not coalesce(array_contains(own, key), false)")
        groups = groups.withColumn("part", F.expr("coalesce(size(filter(own, x -> x < key)), 0)"))
    else:
        groups = groups.withColumn("part", F.lit(0))
    rows = groups.groupBy("b", "part").agg(F.min("key").alias("low"), F.sum("bytes").alias("size"), F.count("*").alias("groups")).collect()
    return [Span(r.low, shift, r.size, r.groups) for r in rows]


def _balanced(prefix: list[int], spans: list[Span], capacity: int, n: int) -> tuple[list[int], set[int]]:
    """Indices of spans that begin shards 1..n-1: close at the fair share of what is left where the rest still fits.

    Also the spans of several groups in which a fair share ends, as a finer look could cut there."""
    cuts, at, coarse = [], 0, set()
    for k in range(n - 1):
        left = n - k
        fair = prefix[at] + -(-(prefix[-1] - prefix[at]) // left)
        far = bisect_right(prefix, prefix[at] + capacity) - 1
        near = min(far, bisect_right(prefix, fair) - 1)
        if near < len(spans) and spans[near].groups > 1 and prefix[near] < fair:
            coarse.add(near)
        if near < far and fair - prefix[near] > prefix[near + 1] - fair:
            near += 1
        if near == at and far > at:
            near += 1

        def fits(j: int) -> bool:
            for _ in range(left - 1):
                j = bisect_right(prefix, prefix[j] + capacity) - 1
            return j >= len(spans)

        at = near if fits(near) else far
        cuts.append(at)
    return cuts, coarse


def minimax_cuts(groups: DataFrame, n: int, first_bits: int = 16) -> tuple[list[int | None], int, int]:
    """Keys at which shards 1.. begin over (key, bytes) ordered by key, how many shards, and the capacity."""
    top, total = groups.agg(F.max("bytes"), F.sum("bytes")).first()
    top, total = top or 0, total or 0
    alone = [Span(r.key, 0, r.bytes, 1) for r in groups.filter(F.col("bytes") * HEAVY > total).select("key", "bytes").collect()]
    heavy = sorted(s.low for s in alone)
    spans = sorted(alone + _collect(groups, 64 - first_bits, heavy), key=lambda s: s.low)
    while True:
        prefix = _prefix(spans)
        low, high = _least(prefix, spans, n, top, True), _least(prefix, spans, n, top, False)
        early, late = _ends(prefix, spans, low, n, False), _ends(prefix, spans, high, n, True)
        open_ = {j for a, b in zip(early, late, strict=True) for j in range(bisect_right(prefix, a) - 1, min(len(spans), bisect_right(prefix, b))) if spans[j].groups > 1 and prefix[j] < b and prefix[j + 1] > a}
        if not open_:
            capacity = _least(prefix, spans, n, top, False)
            cuts, open_ = _balanced(prefix, spans, capacity, n)
        if not open_:
            return [spans[j].low if j < len(spans) else None for j in cuts], n, capacity
        ranges: dict[int, set[int]] = {}
        for j in open_:
            ranges.setdefault(spans[j].shift, set()).add(spans[j].low >> spans[j].shift)
        kept = [s for s in spans if s.shift == 0 or s.low >> s.shift not in ranges.get(s.shift, ())]
        bits = max(1, first_bits - sum(map(len, ranges.values())).bit_length())
        for shift, buckets in ranges.items():
            kept += _collect(groups, max(0, shift - bits), heavy, (shift, buckets))
        spans = sorted(kept, key=lambda s: s.low)


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, first_bits: int = 16) -> DataFrame:
    """Assign every row a shard and a gapless slot in it; see the module's text for the defined results."""
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = scratch.table(docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "rows")
    groups = scratch.table(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    place = F.lit(0)
    if n_rows:
        large = groups.orderBy(F.desc("bytes"), "key").limit(n_shards).collect()
        own: list[int] = []
        while len(own) < min(len(large), n_shards - 1) and large[len(own)].bytes * (n_shards - len(own)) > total:
            total -= large[len(own)].bytes
            own.append(large[len(own)].key)
        rest = groups.filter(~F.col("key").isin(own)) if own else groups
        if total:
            starts, _, _ = minimax_cuts(rest, n_shards - len(own), first_bits)
            place = F.lit(len(own))
            for s in starts:
                if s is not None:
                    place = place + (F.col("key") >= s).cast("int")
        for i, k in enumerate(own):
            place = F.when(F.col("key") == k, i).otherwise(place)
    subs = sqrt_buckets((n_rows or 0) // n_shards)
    placed = rows.select("*", place.cast("int").alias("shard"), F.pmod(F.xxhash64("id", "key"), F.lit(subs)).alias("sub"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "sub").orderBy("id", "key")))
    return ranked.join(offsets, ["shard", "sub"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
