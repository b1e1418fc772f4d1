"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with each run of white space as one space. An item of m characters may
differ by k = floor(m * error_rate) edits. Cut into k + 1 pieces, it has a piece that any such occurrence holds
unchanged, so an Aho-Corasick search for all pieces finds a hit in each; around a hit, Myers' bit-parallel distance
decides. Hits that point at the same place of the same item are verified once.

An item too short for one edit (k = 0) has to stand on word boundaries, else it would be found inside words.

Items go to the workers in blocks of at most `block_chars` characters (or one longer item), a broadcast of proven size;
a larger benchmark takes a pass over the documents for each block, and a pass is written and its broadcast let go before
the next one begins.

Defined results: null and empty texts match nothing; very long texts are searched whole; null, empty and blank items and
items without an id match nothing; repeated rows each get their result; equal items all report; of places of an item
that overlap the first stands; empty tables give empty results; ids may be of any type; other columns are not read by
`find_leaks` and pass through `drop_leaks`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small_batches

NOWHERE = -(1 << 60)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def spots(text: str) -> tuple[str, list[int]]:
    """Normal form and, per character of it, the place in the text it comes from."""
    out, at, gap = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(" ")
            at.append(i - 1)
            gap = False
        for x in c.lower():
            out.append(x)
            at.append(i)
    return "".join(out), at


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of near equal length with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(end, distance) of the best occurrence of the pattern in text with at most k edits, first end on ties; Myers 1999."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= k and (best is None or score < best[1]):
            best = (j + 1, score)
    return best


class Matcher:
    def __init__(self, items: list[tuple], error_rate: float):
        import ahocorasick

        self.items, self.auto = [], ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normal(text or "")
            if not t:
                continue
            k = int(len(t) * error_rate)
            self.items.append((item_id, t, k, masks(t), masks(t[::-1])))
            for offset, piece in pieces(t, k):
                by_piece.setdefault(piece, []).append((len(self.items) - 1, offset))
        for piece, where in by_piece.items():
            self.auto.add_word(piece, (len(piece), where))
        if by_piece:
            self.auto.make_automaton()

    def find(self, text: str) -> list[dict]:
        """Best occurrence per item and place, by item and start; positions in code points of the text."""
        if not self.items or not text:
            return []
        t = normal(text)
        places: dict[int, set[int]] = {}
        for end, (n, where) in self.auto.iter(t):
            for item, offset in where:
                places.setdefault(item, set()).add(end - n + 1 - offset)
        found: list[tuple[int, int, int, int]] = []
        for item, starts in places.items():
            item_id, pattern, k, peq, rev = self.items[item]
            m, done = len(pattern), NOWHERE
            for s in sorted(starts):
                if s < done:
                    continue
                if s >= 0 and t.startswith(pattern, s):
                    if not k and (_joins(t, s) or _joins(t, s + m)):
                        continue
                    found.append((item_id, s, s + m, 0))
                    done = s + m - k
                    continue
                if not k:
                    continue
                low = max(0, s - k)
                hit = myers(peq, m, t[low : s + m + k], k)
                if hit:
                    end = low + hit[0]
                    back = myers(rev, m, t[max(0, end - m - k) : end][::-1], k)
                    begin = end - back[0] if back else max(0, end - m)
                    found.append((item_id, begin, end, hit[1]))
                    done = end - k
        if not found:
            return []
        _, at = spots(text)
        unique = {(i, a, b): d for i, a, b, d in found}
        return [{"item_id": i, "start": at[a], "end": at[b - 1] + 1, "distance": d} for (i, a, b), d in sorted(unique.items())]


def _joins(t: str, i: int) -> bool:
    """Whether the place i lies inside a word."""
    return 0 < i < len(t) and t[i - 1].isalnum() and t[i].isalnum()


_held: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple], error_rate: float) -> Matcher:
    """A worker keeps the automaton of the block it searches for, and no other."""
    if name not in _held:
        _held.clear()
        _held[name] = Matcher(items, error_rate)
    return _held[name]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """Items with a text, in blocks of bounded size; only one block and the item after it are on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select(benchmark[item_col].alias("i"), benchmark[text_col].cast("string").alias("t")).filter("t is not null and i is not null").toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def _search(docs: DataFrame, block: list[tuple], error_rate: float, kind: str, result):
    """A broadcast of the block, and a function of a text column that gives result(hits)."""
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, error_rate))

    @F.pandas_udf(kind)
    def hits(texts: pd.Series) -> pd.Series:
        find = _matcher(*held.value).find
        return pd.Series([result(find(t)) for t in texts.tolist()], dtype="object" if kind != "boolean" else "bool")

    # Called nondeterministic, or the filter that Spark infers below an explode would run it a second time.
    return held, hits.asNondeterministic()


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.07, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1_000_000, scratch: Scratch | None = None) -> DataFrame:
    """One row per leak: (id, item_id, start, end, distance), positions in code points of the whole text."""
    small_batches(docs.sparkSession)
    pruned = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    kind = f"array<struct<item_id:{benchmark.schema[item_col].dataType.simpleString()},start:int,end:int,distance:int>>"
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    block, out = next(blocks, []), None
    while True:
        after = next(blocks, None)
        held, search = _search(docs, block, error_rate, kind, lambda found: found)
        leaks = pruned.select("id", F.explode(search("text")).alias("h")).select(F.col("id").alias(id_col), F.col("h.item_id").alias("item_id"), "h.start", "h.end", "h.distance")
        if after is not None:
            scratch = scratch or Scratch(docs.sparkSession)
            leaks = scratch.table(leaks, "leaks")
            held.destroy()
        out = leaks if out is None else out.union(leaks)
        if after is None:
            return out
        block = after


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.07, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1_000_000, scratch: Scratch | None = None) -> DataFrame:
    """docs without the rows in which an item is found."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        held, leaky = _search(docs, block, error_rate, "boolean", bool)
        docs = docs.filter(~leaky(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
        if after is None:
            return docs
        scratch = scratch or Scratch(docs.sparkSession)
        docs = scratch.table(docs, "clean")
        held.destroy()
        block = after
