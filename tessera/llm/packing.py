"""Best-fit packing of documents into sequences, with large-item matching.

Documents are token ids and a closing id; those longer than the capacity are cut into full pieces after a shorter
first one. Packing needs only how many pieces each length has, at most `capacity` numbers, so the driver packs the
histogram: pieces above a third of the capacity are matched, largest first, each with the largest piece that still fits
beside it (at most two to a bin), then smaller pieces, largest first, go to the tightest gap that holds them. The
plan says which ranks of a length go where; every piece finds its rank within its length by a two-level count and looks
its place up. No task ever holds all pieces of a length.

Defined results: null text counts as empty: one piece with the closing id; repeated rows are packed each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.pretokens import whole

END_ID = (0).to_bytes(4, "little")


@dataclass
class Plan:
    """Runs of equal placements: ranks [rank, rank + bins * each) of a length go `each` to a bin from bin `first` on."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, first bin, each, offset
    bins: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, first: int, bins: int, each: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, first, each, offset))
        self.used[length] = rank + bins * each

    def open(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins


def pack(counts: dict[int, int], capacity: int) -> Plan:
    """Pack counts[length] pieces of each length; the number of steps depends on the capacity alone, not on the counts."""
    plan, left = Plan(), {k: v for k, v in counts.items() if v > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    order: list[int] = []

    def keep(gap: int, first: int, bins: int) -> None:
        if gap > 0 and bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, bins))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left.get(a, 0):
            b = next((x for x in large if x <= capacity - a and left.get(x, 0) - (x == a) > 0), None)
            if b is None:
                n = left.pop(a)
                first = plan.open(n)
                plan.put(a, first, n, 1, 0)
                keep(capacity - a, first, n)
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            first = plan.open(n)
            plan.put(a, first, n, 1, 0)
            plan.put(b, first, n, 1, a)
            for x in (a, b):
                left[x] -= n
            keep(capacity - a - b, first, n)
    for s in sorted((k for k, v in left.items() if v and 3 * k <= capacity), reverse=True):
        n = left[s]
        while n:
            j = bisect_left(order, s)
            if j == len(order):
                each = capacity // s
                bins = n // each
                if bins:
                    first = plan.open(bins)
                    plan.put(s, first, bins, each, 0)
                    keep(capacity - each * s, first, bins)
                    n -= bins * each
                if n:
                    first = plan.open(1)
                    plan.put(s, first, 1, n, 0)
                    keep(capacity - n * s, first, 1)
                    n = 0
                continue
            gap = order[j]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(j)
            # The tightest gap stays the tightest as it shrinks, so a bin takes as many as it holds.
            each = min(gap // s, n)
            full = min(bins, n // each)
            plan.put(s, first, full, each, capacity - gap)
            keep(gap - each * s, first, full)
            keep(gap, first + full, bins - full)
            n -= full * each
    return plan


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    head = n_tokens % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n_tokens, capacity)]


def piece_table(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, crc) of every document."""
    @F.pandas_udf("array<struct<piece:int,start:long,length:long,crc:long>>")
    def cut_texts(texts: pd.Series) -> pd.Series:
        out = []
        packed = whole(tokenizer_path).packed
        for t in texts.tolist():
            ids = packed(t) + END_ID
            out.append([{"piece": i, "start": s, "length": n, "crc": zlib.crc32(ids[4 * s : 4 * (s + n)])} for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))])
        return pd.Series(out, dtype="object")

    # Called nondeterministic, or the filter that Spark infers below the explode would run it a second time.
    cut_texts = cut_texts.asNondeterministic()
    cut_up = docs.select(docs[id_col].alias("id"), cut_texts(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("p"))
    return cut_up.select("id", F.explode("p").alias("p")).select("id", "p.*")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per piece with its sequence and offset; see the module's text."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.table(piece_table(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack(counts, capacity)
    runs = np.array(sorted(plan.runs) or [(0, 0, 0, 1, 0)], np.int64)
    held = docs.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = held.value
        wide = np.int64(1) << 50
        at = np.searchsorted(r[:, 0] * wide + r[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        inside = rank.to_numpy() - r[at, 1]
        return pd.DataFrame({"sequence_id": r[at, 2] + inside // r[at, 3], "offset": r[at, 4] + inside % r[at, 3] * r[at, 0]})

    # Square-root buckets keep both the rows ranked together and the bucket counts summed together few, for a hot length too.
    subs = F.element_at(F.array(*[F.lit(max(1, int(counts.get(k, 0) ** 0.5))) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    dealt = rows.withColumn("sub", F.pmod(F.xxhash64("id", "piece", "crc"), subs.cast("long")))
    before = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "sub").count().select("length", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("length", "sub").orderBy("id", "piece", "start", "crc")))
    ranked = ranked.join(offsets, ["length", "sub"]).withColumn("at", place("length", (F.col("base") + F.col("n") - 1).cast("long")))
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "at.sequence_id", "at.offset")
