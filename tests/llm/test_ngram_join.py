"""The n-gram Jaccard join against brute force: leaves, hot families of near copies, boundary similarities, odd tables."""

import random

import numpy as np
import pytest

from tessera.llm import ngram_join
from tests.llm.test_llm import expected_components

SCHEMA = "doc_id long, text string, label string, node long, center string"


def family(r, n, words=90, edits=12):
    """A base text, near copies of it at many distances, and their own drift: links and near misses in one block."""
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(words)] = f"x{r.randrange(40)}"
        out.append(" ".join(w))
    return out


def test_uniting_links_are_links_and_lose_none():
    rng = np.random.default_rng(3)
    for trial in range(30):
        size = 6000 if trial % 3 == 0 else 400  # points of several resolutions meet
        pool = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        sets = [np.sort(rng.choice(pool, rng.integers(1, size - 20), replace=False)) for _ in range(9)]
        sets += [np.sort(rng.permutation(s)[: max(1, int(len(s) * share))]) for s in sets for share in (0.74, 0.75, 0.76, 0.95, 1.0)]
        sets = sets[:40]
        labels = [int(x) for x in rng.integers(0, 30, len(sets))]
        pack = lambda ids: ngram_join.Leaf(ngram_join.Leaf.pack([(labels[i], i, len(sets[i]), ngram_join._point(sets[i]), sets[i].tobytes()) for i in ids]))
        left, right = list(range(20)), list(range(20, len(sets))) if trial % 2 else list(range(20))
        alive = {i for _, i in ngram_join._alive(pack(left), pack(right), 5)}
        got = ngram_join.uniting_links(pack(left), pack(right))
        linked = {(i, j) for i in left for j in right if labels[i] != labels[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        assert set(got) <= linked and {i for x in linked for i in x} <= alive

        def classes(links):
            up = {x: x for x in labels}
            for i, j in links:
                a, b = labels[i], labels[j]
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[a] = b
            roots = {}
            for x in labels:
                y = x
                while up[y] != y:
                    y = up[y]
                roots.setdefault(y, set()).add(x)
            return sorted(map(sorted, roots.values()))

        assert classes(got) == classes(linked) and len(got) <= len(left) + len(right)


@pytest.mark.parametrize("parts", [5])
def test_hot_family(spark, parts):
    r = random.Random(7)
    texts = [t for n in (260, 90, 5) for t in family(r, n)] + family(r, 40, 7, 5) + [texts for texts in ["same text of a few words here"] * 60]
    r.shuffle(texts)
    rows = [(i, t, None, 7, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted(tuple(x) for x in ngram_join.components(docs, bits=8).collect())
    assert got == sorted(expected_components([x[:2] for x in rows]).elements())
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c in got})


def test_connected_in_one_task_and_in_many(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(up[a], up[b])
            changed |= up[a] != least or up[b] != least
            up[a] = up[b] = least
    df = spark.createDataFrame(links, "a long, b long")
    for each in (1 << 20, 40):
        assert dict(tuple(x) for x in ngram_join.connected(df, ngram_join.Scratch(spark), each).collect()) == up
