"""Cleaning policies by hand: design, rescue, doublets, near ties, reads without a call."""

import pytest

from tessera.operators import cleaning as cl

CALLS = [("p1-AAAA", "single", "B73", "Mo17"), ("p1-CCCC", "single", "B73", None), ("p1-GGGG", "doublet", "B73", "Mo17"), ("p1-TTTT", "ambiguous", "B73", "Mo17"), ("p1-ACAC", "indistinguishable", "Mo17", "B73"), ("p1-none", "empty", None, None)]
DESIGN = [("AAAA", "B73"), ("CCCC", "Mo17"), ("TTTT", "Mo17"), ("TTTT", "Mo17")]


def allowed(spark, policy, design=DESIGN):
    d = design and spark.createDataFrame(design, "position string, genome string")
    calls = spark.createDataFrame(CALLS, "barcode string, call string, genome1 string, genome2 string")
    return cl.allowed(calls, policy, d)


def test_allowed_genomes(spark):
    p = cl.Policy(ambiguous="design_rescue", doublets="both", suffix=4)
    got = {r.barcode[3:]: (r.expected, r.matches, r.allowed) for r in allowed(spark, p).collect()}
    assert got == {"AAAA": ("B73", True, ["B73"]), "CCCC": ("Mo17", False, []), "GGGG": (None, None, ["B73", "Mo17"]), "TTTT": ("Mo17", None, ["Mo17"]), "ACAC": (None, None, ["Mo17"]), "none": (None, None, [])}
    loose = cl.Policy(strict=False, indistinguishable="drop", ambiguous="drop", suffix=4)
    got = {r.barcode[3:]: r.allowed for r in allowed(spark, loose).collect()}
    assert got == {"AAAA": ["B73"], "CCCC": ["B73"], "GGGG": ["B73"], "TTTT": [], "ACAC": [], "none": []}
    assert all(r.expected is None and r.matches is None for r in allowed(spark, cl.Policy(), None).collect())


def test_reads_and_composition(spark):
    p = cl.Policy(ambiguous="design_rescue", suffix=4, min_reads=2, min_fraction=0.5)
    reads = [(1, "p1-AAAA", "B73", "winner", 9), (2, "p1-AAAA", "Mo17", "winner", 9), (3, "p1-AAAA", "Mo17", "winner", 3), (4, "p1-AAAA", "Mo17", "ambiguous", 9), (5, "p1-CCCC", "B73", "winner", 9), (6, "p1-TTTT", "Mo17", "winner", None), (7, "other", "B73", "winner", 1), (8, "p1-none", "B73", "winner", 9), (9, "p1-AAAA", None, "winner", None)]
    b = allowed(spark, p)
    j = cl.judged(spark.createDataFrame(reads, "read long, barcode string, genome string, assigned_class string, delta int"), b, p)
    assert {r.read: r.reason for r in cl.drop_list(j).collect()} == {2: "other genome", 5: "design mismatch", 7: "no call", 8: "nothing allowed", 9: "other genome"}
    got = {r.barcode[3:]: (r.pre, r.post, r.own_share, r.passes) for r in cl.composition(j, b, p).collect()}
    assert got["AAAA"] == (5, 3, pytest.approx(1 / 3), False) and got["CCCC"] == (1, 0, None, False) and got["TTTT"] == (1, 1, 1.0, False) and got["GGGG"] == (0, 0, None, False)


def test_bad_policies_and_designs_stop(spark):
    with pytest.raises(ValueError, match="unknown policy"):
        cl.Policy(doublets="most")
    with pytest.raises(Exception, match="two genomes"):
        allowed(spark, cl.Policy(suffix=4), [("AAAA", "B73"), ("AAAA", "Mo17")]).collect()
