"""Shards against the plain method on the whole list of groups, with sizes that differ widely."""

import random
from bisect import bisect_right
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


def least_capacity(sizes, n):
    """Smallest capacity with which n greedy contiguous shards hold all sizes."""
    prefix = [0, *accumulate(sizes)]

    def fits(c):
        at = 0
        for _ in range(n):
            at = bisect_right(prefix, prefix[at] + c) - 1
        return at == len(sizes)

    low, high = max(sizes), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def make(kind):
    r = random.Random(5)
    if kind == "one large among equal":
        return [f"{i:010d}" for i in range(40_000)] + ["x" * 20_000]
    if kind == "many large":
        return [f"{i:05d}" * r.choice([1, 2, 400]) for i in range(3000)]
    if kind == "equal texts":
        return [f"{i % 700:06d}" * (1 + i % 7) for i in range(5000)]
    return [str(i) for i in range(5)]


@pytest.mark.parametrize("kind", ["one large among equal", "many large", "equal texts", "fewer groups than shards"])
def test_largest_shard_is_least_capacity(spark, kind):
    texts = make(kind)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = docs.groupBy(F.xxhash64("text").alias("key")).agg(F.sum(F.octet_length("text") + 1).alias("bytes")).orderBy("key").collect()
    n, total = 16, sum(g.bytes for g in groups)
    # Groups beyond a fair share of what is left stand alone.
    rest, left = sorted(g.bytes for g in groups), n
    while left > 1 and rest and rest[-1] * left > total:
        total -= rest.pop()
        left -= 1
    gone = sorted((g.bytes for g in groups), reverse=True)[: n - left]
    ordered = [g.bytes for g in groups]
    for b in gone:
        ordered.remove(b)
    out = sharding.shard(docs, n).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert sum(x.n for x in out) == len(texts) and all((x.lo, x.hi) == (0, x.n - 1) for x in out)
    assert max(x.bytes for x in out) == max([*gone, least_capacity(ordered, left) if ordered else 0])
