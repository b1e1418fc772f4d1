"""Fill-in-middle against a plain slicing of the list of units, ropes against strings, and the way back."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, h1 string, output string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(i, text):
    text = text or ""
    units = UNIT.findall(text)
    d = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out, pre, mid = "plain", text, None, None
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form, pre, mid = "spm" if h[3] % 100 < 80 else "psm", len(p), len(m)
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, n, form, pre, mid, sha(out), sha(text)


def texts():
    r = random.Random(5)
    out = [None, "", " ", "\n\t ", "x", " x", "x ", "a <P> b", "a<S>b", "<M>", "a < S> b <", "<P", "é😀 中文\x1cx y\x85z w  ", "a\x00b c", "﻿ x"]
    out += ["w" * 50_000, "w" * 50_000 + " " * 9_000 + "é" * 5_000 + " z", " " * 20_000]
    for n in (5, 100, 3000, 60_000):
        out += ["".join(r.choice(["ab", "é", "😀", "<", "P", "S>", "M"]) * r.randint(1, 3) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(n)) for _ in range(6)]
    return out * 2


def test_query_rows_against_slices(spark):
    rows = [(i if i != 3 else None, t, None, None, None, None) for i, t in enumerate(texts())]
    rows += [rows[4], rows[4]]
    df = fim.digests(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    key = lambda r: str(r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted((plainly(i, t) for i, t, *_ in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_transform_and_restore_keep_texts(spark):
    rows = [(i, t, None, None, None, None) for i, t in enumerate(texts()) if t is not None]
    back = fim.restore(fim.transform(spark.createDataFrame(rows, SCHEMA), seed=7, fim_rate=100, spm_rate=50)).collect()
    assert {r.doc_id: r.restored for r in back} == {r[0]: r[1] for r in rows}
    assert {r.form for r in back} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSM \n\té😀"), st.integers(0, 60), st.integers(1, 9))
def test_ropes_are_strings(text, rank, size):
    tree = fim.rope(text, size)
    units = UNIT.findall(text)
    assert (fim.flat(tree), tree.units, tree.chars) == (text, len(units), len(text))
    a, b = fim.split(tree, rank)
    assert (fim.flat(a), fim.flat(b), a.units, b.units) == ("".join(units[:rank]), "".join(units[rank:]), len(units[:rank]), len(units[rank:]))
    a, b = fim.split(tree, rank, "chars")
    assert (fim.flat(a), fim.flat(b)) == (text[:rank], text[rank:])
    for what in ("<P>", "ab", "P"):
        assert fim.find(tree, what) == text.find(what)


@pytest.mark.parametrize("draws", [(0, 0, 0, 0), (2**32 - 1, 5, 0, 99), (3, 3, 0, 80)])
def test_round_trip_at_edges(draws):
    for t in texts():
        n, form, _, _, out = fim.rearranged(t or "", draws, 50, 80)
        assert fim.restored(out, form) == (t or "")


def test_a_cut_is_a_path_not_a_copy():
    text = "word " * 100_000
    tree = fim.rope(text)
    a, b = fim.split(tree, 50_001)
    depth = lambda x: 1 + max(depth(x.left), depth(x.right)) if isinstance(x, fim.Node) else 0
    assert depth(a) + depth(b) <= 2 * (depth(tree) + 1)
    shared = {id(x) for x in fim.leaves(tree)}
    assert sum(id(x) not in shared for x in [*fim.leaves(a), *fim.leaves(b)]) <= 2
