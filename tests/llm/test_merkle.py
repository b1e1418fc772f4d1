"""Merkle manifests against a plain tree in memory: groups of every size around the fan, nulls, ties, tampering."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, hash string, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def climb(nodes):
    """Top hash, and per node the runs on its way up as (run, own place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for p, k in zip(paths, at, strict=True):
            p.append((runs[k // 8], k % 8))
        nodes, at = [H(*r) for r in runs], [k // 8 for k in at]
    return nodes[0], paths


def lowered(t):
    return t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plainly(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = climb([tops[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), tops[g][1], strict=True):
            i, source, lang, n, text = x[3]
            hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            h = leaf(i, source, lang, n, lowered(text) if hit else text)
            beside = []
            for run, own in path + up:
                beside += run[:own] + run[own + 1 :]
                h = H(*run[:own], h, *run[own + 1 :])
            out.append((i, x[2], tops[g][0], root, H(*beside), h, h == root))
    return out


def table(sizes, r):
    rows = []
    for lang, m in sizes.items():
        for _ in range(m):
            i = r.randrange(10_000)
            rows.append((i, r.choice(["a", None, "é:1-"]), lang, r.choice([None, 5]), r.choice(["Text Ä A", "lower", None, "", f"😀 {i} Z"])))
    return rows


CASES = {
    "one": {"en": 1},
    "null only": {None: 3},
    "around the fan": {"a": 1, "b": 2, "c": 7, "d": 8, "e": 9, "": 64, "é": 65, None: 73},
    "hot": {"en": 700, "de": 5},
    "many groups": {f"g{k}": k % 3 + 1 for k in range(75)},
}


@pytest.mark.parametrize("case", CASES)
def test_rows_against_a_plain_tree(spark, case):
    rows = table(CASES[case], random.Random(4))
    if case == "hot":
        rows += [rows[0]] * 9 + [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (5, "s", "en", 1, "X" * 200_000)]
    df = merkle.audit(spark.createDataFrame([(*x, None, None, None) for x in rows], SCHEMA).repartition(5))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(plainly(rows), key=str)
    if len(rows) > 50:
        assert {x[-1] for x in got} == {True, False}


def test_preimages_are_stored_and_bounded(spark):
    rows = table({"en": 300, "de": 20}, random.Random(6))
    lower, upper = merkle.manifest(spark.createDataFrame([(*x, None, None, None) for x in rows], SCHEMA))
    assert [t.count() for t in lower.levels] == [38 + 3, 5 + 1, 1]
    for t in [*lower.levels, *upper.levels]:
        assert all(len(x.preimage) <= 512 and H(x.preimage) == x.hash for x in t.collect())


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []
