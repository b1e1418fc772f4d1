"""Column functions on barcodes, names, alignments and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def chop(col: Column, sep: str, fields: Sequence[int], joined: str | None = None) -> Column:
    """Pick 1-based fields of a split string and join them again; absent fields are skipped."""
    parts = F.split(col, _literal(sep))
    return F.array_join(F.array(*[F.try_element_at(parts, F.lit(i)) for i in fields]), sep if joined is None else joined)


def _literal(sep: str) -> str:
    return "".join("\\" + c if c in r".\+*?[^]$(){}|/-" else c for c in sep)


def reverse_complement(col: Column) -> Column:
    return F.reverse(F.translate(col, "ATCGatcg", "TAGCtagc"))


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the shorter length; N differs from everything."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differs = lambda i: ((F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))) | (F.substr(a, i, F.lit(1)) == "N")).cast("int")
    return F.aggregate(F.transform(places, differs), F.lit(0), lambda x, y: x + y)


def n_count(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("N"), F.lit("")))


def between_affixes(col: Column, prefix: str, suffix: str) -> Column:
    """The part between a prefix and a suffix; NULL where either is missing."""
    ok = col.startswith(prefix) & col.endswith(suffix) & (F.length(col) >= len(prefix) + len(suffix))
    return F.when(ok, F.substr(col, F.lit(len(prefix) + 1), F.length(col) - len(prefix) - len(suffix)))


def cigar_spans(cigar: Column) -> Column:
    """struct(ref_consumed, query_aligned) of a CIGAR string."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int"))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    total = lambda ops: F.aggregate(F.zip_with(n, op, lambda k, o: F.when(o.isin(*ops), k).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return F.struct(total("MDN=X").alias("ref_consumed"), total("MI=X").alias("query_aligned"))


def cut_site(start: Column, end: Column, reverse: Column) -> Column:
    """Transposase cut of an alignment: +4 on the forward strand, end - 5 on the reverse."""
    return F.when(reverse, end - 5).otherwise(start + 4)


def genotype(gt: Column) -> Column:
    """ref, alt or het of a diploid call, phased or not; NULL for anything else."""
    g = F.replace(gt, F.lit("|"), F.lit("/"))
    return F.when(g == "0/0", "ref").when(g == "1/1", "alt").when(g.isin("0/1", "1/0"), "het")


def dosage(gp: Column) -> Column:
    p = F.split(gp, ",")
    return F.try_element_at(p, F.lit(2)).cast("double") + 2 * F.try_element_at(p, F.lit(3)).cast("double")


def cut_left(col: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins [b0, b1), [b1, b2), ...; NULL outside."""
    out = F.lit(None).cast("string")
    for a, b, name in reversed(list(zip(breaks, breaks[1:], labels, strict=False))):
        out = F.when((col >= a) & (col < b), name).otherwise(out)
    return out


def cut_right(col: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins (b0, b1], (b1, b2], ...; NULL outside."""
    out = F.lit(None).cast("string")
    for a, b, name in reversed(list(zip(breaks, breaks[1:], labels, strict=False))):
        out = F.when((col > a) & (col <= b), name).otherwise(out)
    return out


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(otherwise)
    for cond, value in reversed(list(rules)):
        out = F.when(cond, value).otherwise(out)
    return out


def clean_sentinel(col: Column, sentinels: Sequence[str] = ("None", "none", "NA", "")) -> Column:
    return F.when(~col.isin(*sentinels), col)


def safe_name(col: Column) -> Column:
    return F.regexp_replace(col, "[^A-Za-z0-9]+", "_")


def polynomial_hash(col: Column, base: int = 131, modulus: int = 1_000_003) -> Column:
    """Rolling hash of the characters' code points, as the chunked sinks use it."""
    codes = F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * base + c) % modulus)


def uniform_hash(key: Column, seed: int = 0) -> Column:
    """A portable pseudo-random number in [0, 2**32) of an integer key: the same in any engine with 64-bit integers."""
    return F.pmod((key.cast("long") + seed) * F.lit(2654435761).cast("long"), F.lit(4294967296).cast("long"))
