"""Alleles that reads carry at known sites: sites inside the runs that a CIGAR aligns, by bins of position."""

from __future__ import annotations

import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.reads import kept_alignments

#: Positions of a bin. A site has one bin, a read a piece in each bin where it aligns bases, so that the two meet once.
BIN = 256
#: Bases of reads that a task lays out at once, besides those of one read.
ROOM = 1 << 18
#: Bases in upper case; what is not printable is no base of any site, so that 0 may stand for no base.
LETTERS = bytes(c if 32 <= c < 127 else 63 for c in range(256)).upper()
#: What stands at a site for an allele that is null and for one that is not a single printable letter; 0 is no site.
NULL, LONG = 1, 2
TALLY = ("n_ref", "n_alt", "n_other", "edits_ref", "edits_alt", "mapq_ref", "mapq_alt")


def aligned_runs(cigar: str) -> np.ndarray:
    """A row for each unbroken run of a CIGAR: places of the reference before it, its bases, bases of the read before it."""
    r, q, out = 0, 0, []
    for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            out.append((r, n, q))
        r += n if op in "M=XDN" else 0
        q += n if op in "M=XIS" else 0
    return np.array(out, np.int64).reshape(-1, 3)


#: CIGARs of so many letters are kept from batch to batch; longer ones are seldom alike and would fill a worker.
SHORT, _kept_runs = 64, lru_cache(1 << 14)(aligned_runs)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column, joined, and how many each row has."""
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)


def _bases(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As _flat, one byte for each letter of a text."""
    flat, size = _flat(column)
    if len(flat) and flat.max() > 127:
        flat, size = _flat(pa.array([s.encode("ascii", "replace") for s in column.to_pylist()], pa.binary()))
    return np.frombuffer(flat.tobytes().translate(LETTERS), np.uint8), size


def _pieces(batches):
    """Reads cut at the borders of bins: bases from the first aligned place of a bin to the last, 0 where none is aligned."""
    for whole in batches:
        cuts = [0, *np.flatnonzero(np.diff(np.cumsum(_flat(whole.column("seq"))[1]) // ROOM)) + 1, whole.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            batch = whole.slice(a, b - a)
            (raw, size), cigar = _bases(batch.column("seq")), batch.column("cigar").dictionary_encode()
            kinds = [(_kept_runs if len(c) <= SHORT else aligned_runs)(c) for c in cigar.dictionary.to_pylist()]
            per, code = np.array([len(k) for k in kinds], np.int64), cigar.indices.to_numpy()
            # Runs of reads, without what lies behind the end of the read's bases.
            k = per[code]
            read = np.repeat(np.arange(len(k)), k)
            before, n, q = np.concatenate([*kinds, np.empty((0, 3), np.int64)])[np.arange(len(read)) + np.repeat(_starts(per)[code] - _starts(k), k)].T
            n, at, q = np.clip(size[read] - q, 0, n), batch.column("pos").to_numpy()[read] + before, _starts(size)[read] + q
            # Runs cut at the borders of bins.
            k = np.where(n > 0, (at + n - 1) // BIN - at // BIN + 1, 0)
            if not k.sum():
                continue
            i = np.arange(k.sum()) - np.repeat(_starts(k), k)
            read, at, n, q = (np.repeat(x, k) for x in (read, at, n, q))
            bin_ = at // BIN + i
            lo = np.maximum(at, bin_ * BIN)
            n, q, at = np.minimum(at + n, (bin_ + 1) * BIN) - lo, q + lo - at, lo
            # What a read has in one bin is one piece.
            head = np.flatnonzero(np.r_[True, (np.diff(read) != 0) | (np.diff(bin_) != 0)])
            last = np.r_[head[1:], len(at)] - 1
            first, long = at[head], at[last] + n[last] - at[head]
            to = np.repeat(_starts(long) - first, last - head + 1) + at
            laid, step = np.zeros(long.sum(), np.uint8), np.arange(n.sum(), dtype=np.int32)
            laid[np.repeat((to - _starts(n)).astype(np.int32), n) + step] = raw[np.repeat((q - _starts(n)).astype(np.int32), n) + step]
            bases = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(np.r_[0, np.cumsum(long)].astype(np.int32)), pa.py_buffer(laid)])
            of = pa.array(read[head])
            grp, chrom, edits, mapq = (batch.column(c).take(of) for c in ("grp", "chrom", "edits", "mapq"))
            yield pa.RecordBatch.from_pydict({"grp": grp, "chrom": chrom, "bin": bin_[head], "start": first, "bases": bases, "edits": edits, "mapq": mapq})


def _tallies(batches, apart: bool):
    """Pieces and the alleles along them as sums for each group and, where apart, each site of a batch."""
    letters = pa.array([chr(c) for c in range(128)])
    for batch in batches:
        (bases, size), refs, alts = _flat(batch.column("bases")), _flat(batch.column("refs"))[0], _flat(batch.column("alts"))[0]
        hit = np.flatnonzero((bases != 0) & (refs != 0))
        if not len(hit):
            continue
        row, base, ref, alt = np.repeat(np.arange(len(size), dtype=np.int32), size)[hit], bases[hit], refs[hit], alts[hit]
        start, edits, mapq = (batch.column(c).to_numpy() for c in ("start", "edits", "mapq"))
        is_ref = base == ref
        kind = np.where(is_ref, 0, np.where(base == alt, 1, 2))
        odd = (ref <= LONG) | (alt <= LONG)
        if odd.any():
            kind[(kind == 2) & ((ref == NULL) | (alt == NULL))] = 3
        grp, chrom = (batch.column(c).dictionary_encode() for c in ("grp", "chrom"))
        if apart:
            # Rows of one group, chromosome and bin have one number, their sites one of BIN places behind it.
            keys = (start // BIN, chrom.indices.to_numpy(), grp.indices.to_numpy())
            order = np.lexsort(keys)
            new = np.r_[False, np.any([np.diff(x[order]) != 0 for x in keys], axis=0)]
            same = np.empty(len(size), np.int64)
            same[order] = np.cumsum(new)
            place = (same * BIN + start % BIN - _starts(size))[row] + hit
            there = np.zeros((same.max() + 1) * BIN, bool)
            there[place] = True
            site = (np.cumsum(there, dtype=np.int32) - 1)[place]
        else:
            site = np.unique(grp.indices.to_numpy()[row], return_inverse=True)[1]
        one = np.empty(site.max() + 1, np.int64)
        one[site] = np.arange(len(site))
        sums = lambda of=None: np.bincount(site * 4 + kind, of, len(one) * 4).reshape(-1, 4).astype(np.int64)
        n, e, m = sums(), sums(edits[row]), sums(mapq[row])
        at = row[one]
        out = {"grp": batch.column("grp").take(pa.array(at))}
        if apart:
            pos, odd = start[at] + hit[one] - _starts(size)[at], odd[one]
            ref, alt = letters.take(pa.array(ref[one])), letters.take(pa.array(alt[one]))
            if odd.any():
                named = [next(o for o in batch.column("others")[int(r)].as_py() if o["pos"] == p) for r, p in zip(at[odd], pos[odd], strict=True)]
                ref, alt = (pc.replace_with_mask(x, pa.array(odd), pa.array([o[c] for o in named], pa.string())) for c, x in (("ref", ref), ("alt", alt)))
            out |= {"chrom": batch.column("chrom").take(pa.array(at)), "pos": pos, "ref": ref, "alt": alt}
        yield pa.RecordBatch.from_pydict(out | dict(zip(TALLY, [*n.T[:3], *e.T[:2], *m.T[:2]], strict=True)))


def observed(alignments: DataFrame, sites: DataFrame, groups: DataFrame, tag: str = "CB", min_mapq: int = 10, apart: bool = True) -> DataFrame:
    """(grp, chrom, pos, ref, alt, n_ref, n_alt, n_other, edits_ref, edits_alt, mapq_ref, mapq_alt): kept reads with a base at a site.

    A group and site may have several rows, whose sums count; sites are not told apart, and have no columns, if that is not
    wanted. alignments: as of `scans.sam` or `alignments.bam`; sites:
    (chrom, pos, ref, alt), positions from 1, of several rows at one position the least (ref, alt) counts; groups: (cell,
    grp), reads of other cells go, a cell in two groups counts in both. Neither table is broadcast by hand; a bin that many
    reads cover is left to the split of skewed joins. Reads meet all sites of a bin in one row, and what is shuffled after
    that are sums."""
    own = kept_alignments(alignments, min_mapq, tag).filter("seq <> '*' and cigar is not null and chrom is not null and pos is not null")
    nm = F.coalesce(F.try_element_at("tags", F.lit("NM")).cast("int"), F.lit(0))
    own = own.select(F.try_element_at("tags", F.lit(tag)).alias("cell"), "chrom", F.col("pos").cast("long").alias("pos"), "cigar", "seq", nm.cast("long").alias("edits"), F.col("mapq").cast("long").alias("mapq"))
    reads = own.join(groups.select(F.col("cell").cast("string").alias("cell"), "grp").filter("cell is not null and grp is not null").distinct(), "cell")
    kind = {c: reads.schema[c].dataType.simpleString() for c in ("grp", "chrom")}
    pieces = reads.drop("cell").mapInArrow(_pieces, f"grp {kind['grp']}, chrom {kind['chrom']}, bin long, start long, bases binary, edits long, mapq long")

    one = sites.filter("pos is not null").groupBy("chrom", F.col("pos").cast("long").alias("pos")).agg(F.min(F.struct(F.upper("ref").alias("ref"), F.upper("alt").alias("alt"))).alias("s"))
    one = one.select("chrom", "pos", "s.ref", "s.alt", F.floor(F.col("pos") / BIN).alias("bin"))
    plain = lambda c: F.coalesce((F.length(c) == 1) & F.col(c).between(" ", "~"), F.lit(False))
    letter = lambda c: F.when(plain(c), F.col(c)).when(F.col(c).isNull(), chr(NULL)).otherwise(chr(LONG))
    placed = F.collect_list(F.struct((F.col("pos") - F.col("bin") * BIN).cast("int").alias("place"), F.struct(letter("ref").alias("refs"), letter("alt").alias("alts")).alias("letters")))
    others = F.collect_list(F.when(~plain("ref") | ~plain("alt"), F.struct("pos", "ref", "alt")))
    full = one.groupBy("chrom", "bin").agg(F.map_from_entries(placed).alias("at"), others.alias("others"))
    along = lambda c: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BIN - 1)), lambda i: F.coalesce(F.try_element_at("at", i)[c], F.lit("\0"))), "").cast("binary").alias(c)
    lanes = full.select("chrom", "bin", along("refs"), along("alts"), "others")

    part = lambda c: F.substring(F.col(c), (F.col("start") - F.col("bin") * BIN).cast("int") + 1, F.length("bases")).alias(c)
    # Sorted by bins, reads of a site lie side by side and a batch has few sums; without sites their order does not matter.
    met = pieces.join(lanes.hint("merge") if apart else lanes, ["chrom", "bin"]).select("grp", "chrom", "start", "bases", part("refs"), part("alts"), "others", "edits", "mapq")
    where = f", chrom {kind['chrom']}, pos long, ref string, alt string" if apart else ""
    return met.mapInArrow(partial(_tallies, apart=apart), f"grp {kind['grp']}{where}, " + ", ".join(f"{c} long" for c in TALLY))


def allele_counts(seen: DataFrame) -> DataFrame:
    """(grp, chrom, pos, ref, alt, n_ref, n_alt, n_other) of what was observed."""
    return seen.groupBy("grp", "chrom", "pos", "ref", "alt").agg(*[F.sum(c).alias(c) for c in TALLY[:3]])


def allele_bias(seen: DataFrame) -> DataFrame:
    """(grp, allele, n, mean_edits, mean_mapq) of the observations of either allele: reads with the alternative should not map worse."""
    sums = seen.groupBy("grp").agg(*[F.sum(c).alias(c) for c in TALLY])
    side = lambda a: F.struct(F.lit(a).alias("allele"), F.col(f"n_{a}").alias("n"), F.try_divide(f"edits_{a}", f"n_{a}").alias("mean_edits"), F.try_divide(f"mapq_{a}", f"n_{a}").alias("mean_mapq"))
    return sums.select("grp", F.inline(F.array(side("ref"), side("alt")))).filter("n > 0")
