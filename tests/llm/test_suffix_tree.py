"""The suffix tree's scores against a tree of tuples in memory; packing, places and dealing on their own."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix_tree as sx

SCHEMA = "doc_id long, text string, row long, held_out string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RARE, DEPTH = "<rare>", 3


def tokens(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), ""]


def plainly(rows, p_min, depth=DEPTH):
    side = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [tokens(t) for i, t in rows if not side(i)]
    c = Counter(w for t in train for w in t)
    N, V = sum(c.values()), len(c)
    floor = max(3, math.ceil(p_min * N))
    sym = lambda w: w if c[w] >= floor else RARE
    mass = N + 0.5 * (V + 1)
    p0 = lambda w: (c[w] + 0.5) / mass
    listed = {w for w in c if c[w] >= floor}
    root = {w: p0(w) for w in listed} | {RARE: 1 - sum(p0(w) for w in listed)}
    seen = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in train:
        h = [sym(""), *map(sym, t)]
        for i in range(1, len(h)):
            for d in range(1, min(depth, i) + 1):
                seen[d][tuple(h[i - d : i])][h[i]] += 1
    P, rest, keep = {}, {}, set()

    def p(s, x):
        if not s:
            return root[x]
        return P.get((s, x), 0) or rest.get(s, 1.0) * p(s[1:], x)

    for d in range(1, depth + 1):
        for s, nxt in seen[d].items():
            n = sum(nxt.values())
            if n < floor:
                continue
            often = {x: k for x, k in nxt.items() if k >= floor}
            rest[s] = (n - sum(k - sx.DISCOUNT for k in often.values())) / n
            for x, k in often.items():
                P[s, x] = (k - sx.DISCOUNT) / n + rest[s] * p(s[1:], x)
            below = {x: p(s[1:], x) for x in often}
            gain = sum(P[s, x] * math.log(P[s, x] / below[x]) for x in often) + rest[s] * math.log(rest[s]) * (1 - sum(below.values()))
            if often and n * gain > 0.5 * len(often) * math.log(n):
                keep |= {s[k:] for k in range(d)}
    out = []
    for i, t in rows:
        w = tokens(t)
        h, total = [sym(""), *map(sym, w)], 0.0
        for k in range(1, len(h)):
            state = next((s for d in range(min(depth, k), 0, -1) if (s := tuple(h[k - d : k])) in keep), ())
            total += math.log10(p(state, h[k]))
            if h[k] == RARE:
                total += math.log10(p0(w[k - 1])) - math.log10(root[RARE])
        out.append((i, side(i), len(w), sum(c[x] > 0 for x in w), N, sum(math.log10(p0(x)) for x in w), total))
    return out, keep, p, root


def corpus(n, seed=2):
    r = random.Random(seed)
    follow = {w: r.sample("abcdefgh", 3) for w in "abcdefgh"}
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A a\x1ca É é"), (None, "a b c"), (3, "A a\x1ca É é")]
    for i in range(10, n):
        w = [r.choice("abcdefgh")]
        for _ in range(r.randrange(80)):
            w.append(r.choice(follow[w[-1]]) if w[-1] in follow and r.random() < 0.8 else r.choice("abcdefgh") if r.random() < 0.7 else f"Word{r.randrange(400)}")
            if len(w) > 3 and w[-3:-1] == ["a", follow["a"][0]]:
                w[-1] = "THEN"
        rows.append((i, " ".join(w)))
    return [*rows, (7, "x " * 20_000 + "a b")]


def close(got, want):
    key = lambda r: str(r[:4])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("p_min", [2.0**-22, 1e-3, 0.2])
def test_scores_against_a_tree_of_tuples(spark, p_min):
    rows = corpus(260)
    df = sx.score(spark.createDataFrame([(*x, None, None, None) for x in rows], SCHEMA).repartition(4), p_min=p_min)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = [tuple(r) for r in df.collect()]
    want, keep, p, root = plainly(rows, p_min)
    close(got, want)
    for s in [(), *sorted(keep)[:40]]:
        assert sum(p(s, x) for x in root) == pytest.approx(1)
    if p_min < 0.01:
        assert max(map(len, keep)) >= 2
        held = [g for g in got if g[1]]
        assert sum(g[6] for g in held) > sum(g[5] for g in held) + 100


def test_nothing_to_learn_from(spark):
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = sx.score(spark.createDataFrame([(out, "a b", None, None, None)], SCHEMA)).collect()
    assert [tuple(x) for x in r] == [(out, True, 3, 0, 0, 0.0, 0.0)]
    assert sx.score(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50), st.integers(1, 70), st.integers(1, 40), st.data())
def test_dealt_pairs_come_back(contexts, width, parts, data):
    deal = sx.Deal(contexts, width, parts)
    pairs = data.draw(st.lists(st.tuples(st.integers(0, contexts - 1), st.integers(0, width - 1)), min_size=1))
    c, x = (np.array(k, np.int64) for k in zip(*pairs, strict=True))
    part, inside = np.divmod(deal.numbers(c, x), contexts * deal.span)
    assert all((deal.pairs(int(p), np.array([i])) == a * width + b).all() for p, i, a, b in zip(part, inside, c, x, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=50, unique=True), st.lists(st.integers(0, 2**45), max_size=50))
def test_places_and_packing(keys, others):
    keys = np.array(sorted(keys), np.int64)
    found = sx.Places(keys).find(np.array([*keys, *others], np.int64))
    assert list(found[: len(keys)]) == list(range(len(keys)))
    where = {int(k): i for i, k in enumerate(keys)}
    assert list(found[len(keys) :]) == [where.get(k, -1) for k in others]
    assert list(sx._unpack(sx._pack(keys), len(keys))) == list(keys)
