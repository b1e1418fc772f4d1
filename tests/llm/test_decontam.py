"""Benchmark matching against brute-force edit distances at random places, and its edge cases."""

import random
import re

from tessera.llm import decontam


def least_distance(p, t):
    """Fewest edits between p and any part of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, c in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != c)))
        row = new
    return min(row)


def distance(p, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        new = [i]
        for j, c in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != c)))
        row = new
    return row[-1]


def text(r, n):
    return " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(n))


def edited(r, s, edits):
    s = list(s)
    for _ in range(edits):
        i = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[i] = "z"
        elif kind == 1:
            s.insert(i, "y")
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def test_random_edits_and_places():
    r = random.Random(11)
    items = [(i, text(r, r.randint(6, 30))) for i in range(12)]
    match = decontam.Matcher(items, 0.07)
    found = 0
    for _ in range(400):
        i, item = r.choice(items)
        p = decontam.normal(item)
        k = int(len(p) * 0.07)
        leak = edited(r, p, r.randint(0, k + 2))
        if r.random() < 0.3:
            leak = leak[r.randint(0, k + 1) :]
        if r.random() < 0.3:
            leak = leak[: len(leak) - r.randint(0, k + 1)]
        t = r.choice(["", text(r, 8) + " "]) + leak + r.choice(["", " " + text(r, 8), " " + leak])
        got = match.find(t)
        for x in got:
            own = decontam.normal(dict(items)[x["item_id"]])
            assert distance(own, re.sub(r"\s+", " ", t[x["start"] : x["end"]]).lower()) <= x["distance"] <= int(len(own) * 0.07)
        n = decontam.normal(t)
        for j, other in items:
            own = decontam.normal(other)
            assert any(x["item_id"] == j for x in got) == (least_distance(own, n) <= int(len(own) * 0.07)), (t, other)
        found += len(got)
    assert found > 150


def test_starts_cut_and_repeats():
    item = "the quick brown fox jumps over the lazy dog near the old river bank and then runs home to sleep"
    match = decontam.Matcher([(1, item)], 0.07)
    for cut in range(0, 7):
        assert [x["start"] <= cut for x in match.find(item[cut:])] == [True]
        assert len(match.find(item[cut:] + " . " + item)) == 2
    assert match.find(item[7:]) == [] and len(match.find("zz " + item[5:])) == 1


def test_short_items_are_whole_words():
    match = decontam.Matcher([(1, "Yes it is"), (2, " \n"), (3, None), (4, "")], 0.07)
    assert [(x["start"], x["end"]) for x in match.find("oh YES\n it  is, well")] == [(3, 14)]
    assert match.find("byes it is") == [] and match.find("yes it isn") == []


def test_blocks_ids_and_edges(spark):
    items = [(f"item-{k}", text(random.Random(k), 20), 1) for k in range(7)] + [(None, "a null id never matches", 1), ("n", None, 1), ("b", " ", 1)]
    benchmark = spark.createDataFrame(items, "item_id string, text string, start int")
    rows = [(k, f"before {items[k % 7][1]} after", "x") for k in range(20)] + [(1, "before " + items[1][1] + " after", "x"), (50, None, None), (51, "", "x"), (52, "word " * 40_000 + items[3][1], "x"), (None, "clean", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    want = sorted([(k, f"item-{k % 7}", 7) for k in range(20)] + [(1, "item-1", 7), (52, "item-3", 200_000)])
    for size in (10, 200, 10**6):
        assert sorted((r.doc_id, r.item_id, r.start) for r in decontam.find_leaks(docs, benchmark, block_chars=size).collect()) == want
        clean = decontam.drop_leaks(docs, benchmark, block_chars=size)
        assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 50, 51]
    assert decontam.find_leaks(docs, benchmark.limit(0)).count() == 0 and decontam.drop_leaks(docs, benchmark.limit(0)).count() == len(rows)
    assert decontam.find_leaks(docs.limit(0), benchmark).count() == 0
