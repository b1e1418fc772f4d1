"""Language-model scores by a probabilistic suffix tree over words.

Tokens are words with A-Z lower-cased, then one end for each text. Words whose share of the training tokens is at least
`p_min`, and that occur MIN_COUNT times, are the tree's symbols; the rest share the symbol `rare`, within which a word
has its smoothed share of all tokens, so that every word and the unknown one keep a probability of their own. The
candidates for states are the contexts of up to `depth` symbols with the same least share; a state's next symbols are
listed down to that share. So there are at most 1/p_min symbols, and at most 1/p_min states and listed next symbols of
each depth, whatever the corpus holds: that is the bound of what is broadcast. Which they are, and all counts, come from
every training text.

* P(x|s) = (c(s,x) - DISCOUNT) / N(s) for a listed x, plus rest(s) * P(x|s without its first symbol); rest(s) is the
  mass that is left. The state without symbols has (c + 0.5) / (N + 0.5 (V + 1)). Each is a distribution.
* A context is retained when N(s) times the divergence of P(.|s) from that of the context without its first symbol
  exceeds half ln N(s) for each listed symbol; the suffixes of a retained context stay with it.
* A token is scored from the longest retained suffix of its history. A text begins as if an end stood before it.

Spark counts words; texts become rows of symbol numbers in a table once; each depth is one pass over that table that
counts (context, next) pairs and keeps those with enough. A worker packs its counts into sorted runs, one for each part
of the pairs, so that a pair costs some 3 bytes of shuffle. The words outside the symbols, each with its own
count, are joined by word, and their parts of the scores summed per row.

Defined results: null text counts as empty and is its end alone; a null id is for training; rows of one id share their
side, repeated rows each count and get a row; ties in counts are ordered by word, which moves no score; very long texts
are read whole; with nothing to learn from, every token has probability 1; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, text_of

END = b""
DISCOUNT, MIN_COUNT = 0.5, 3
FLUSH_WORDS, CHUNK = 1 << 20, 1 << 22
#: Of pairs: parts that are dealt out, and pairs in one, about.
MOST_PARTS, PART = 1 << 15, 1 << 20


def words(raw: bytes) -> list[bytes]:
    """Of UTF-8 bytes; lower() and split() of bytes know A-Z and the six blanks only."""
    return raw.lower().split()


def _raw(column) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts, ends included."""

    def work(batches):
        held = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for raw in _raw(batch.column(0)):
                held.update(words(raw))
                held[END] += 1
                if len(held) >= FLUSH_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(text_of(docs, text_col).alias("text")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, symbols: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(row, id, held_out, n_tokens, ids, rare): symbol numbers of the tokens as packed int32, and the words that have none."""
    held = docs.sparkSession.sparkContext.broadcast(symbols)

    def work(batches):
        table = held.value
        other = len(table)
        for batch in batches:
            ids, rare, n = [], [], []
            for raw in _raw(batch.column(3)):
                w = [*words(raw), END]
                got = [table.get(x, other) for x in w]
                ids.append(np.array(got, np.int32).tobytes())
                rare.append([x for x, i in zip(w, got, strict=True) if i == other])
                n.append(len(w))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], ["row", "id", "held_out", "n_tokens", "ids", "rare"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), _held_out(docs[id_col]).alias("held_out"), text_of(docs, text_col).alias("text"))
    return source.mapInArrow(work, f"row long, id {source.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, ids binary, rare array<binary>")


def _held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


class Places:
    """Where a key stands in a sorted array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._start(keys)
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is missing."""
        out = np.full(len(keys), -1, np.int32)
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            here = self.slots[at]
            some = here >= 0
            left, at, here = left[some], at[some], here[some]
            same = self.keys[here] == keys[left]
            out[left[same]] = here[same]
            left, at = left[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out


@dataclass
class Level:
    """The pairs (context of d symbols, next symbol) by number; a pair is itself the context of d + 1 symbols of that number."""

    places: Places
    n: np.ndarray
    logp: np.ndarray | None = None
    #: Of the contexts of d symbols: log of the rest, whether it is a state, the number of the context less its first symbol.
    log_rest: np.ndarray | None = None
    state: np.ndarray | None = None
    suffix: np.ndarray | None = None


@dataclass
class Tree:
    symbols: int
    begin: int
    log0: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        """Symbols with `rare`."""
        return self.symbols + 1


def _laid(column) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a batch's texts in a row, and where each text begins. No text is without its end."""
    blobs = column.to_pylist()
    sizes = np.array([len(b) // 4 for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), np.int32).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if blobs else np.empty(0, np.int64)


def _chain(tree: Tree, syms: np.ndarray, starts: np.ndarray):
    """For depths 1, 2, ...: the context's number before each token and, for known levels, that of its pair with the token; -1 for none."""
    context, out = np.concatenate([[tree.begin], syms[:-1]]) if len(syms) else syms, []
    context[starts] = tree.begin
    for level in tree.levels:
        some = np.flatnonzero(context >= 0)
        pair = np.full(len(syms), -1, np.int64)
        pair[some] = level.places.find(context[some] * tree.width + syms[some])
        out.append((context, pair))
        context = np.concatenate([[-1], pair[:-1]]) if len(syms) else pair
        context[starts] = -1
    return out, context


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    width = 8 if len(values) and values.max() >= 1 << 32 else 4
    return bytes([width]) + pa.compress(np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    raw = pa.decompress(blob[1:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


@dataclass(frozen=True)
class Deal:
    """Pairs (context, next) dealt into parts; within a part pairs are dense numbers that grow with the pair.

    A part takes the next symbols of one remainder, another one for each context, so that neither a frequent context nor
    a frequent next symbol fills a part."""

    contexts: int
    width: int
    parts: int

    @property
    def span(self) -> int:
        return -(-self.width // self.parts)

    def numbers(self, context: np.ndarray, sym: np.ndarray) -> np.ndarray:
        return ((context * 7919 + sym) % self.parts * self.contexts + context) * self.span + sym // self.parts

    def pairs(self, part: int, inside: np.ndarray) -> np.ndarray:
        """context * width + next symbol."""
        context, high = inside // self.span, inside % self.span
        return context * self.width + high * self.parts + (part - context * 7919) % self.parts


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def count_pairs(encoded: DataFrame, tree: Tree, contexts: int, floor: int, tokens: int) -> DataFrame:
    """(pair, n) of the pairs of contexts one symbol longer than the tree's levels with a next symbol, at least `floor` times.

    A pair counts only where its own suffix is a pair of the last level: it cannot be more frequent than that."""
    session = encoded.sparkSession
    held = session.sparkContext.broadcast(tree)
    tasks = max(16, min(MOST_PARTS, tokens // PART))
    deal = Deal(contexts, tree.width, 4 * tasks)

    def runs(found):
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        part, inside = np.divmod(keys, deal.contexts * deal.span)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows = [(int(part[a]), int(b - a), _pack(np.diff(inside[a:b], prepend=0)), _pack(n[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "size", "pairs", "n"])

    def count(batches):
        found, size = [], 0
        for batch in batches:
            syms, starts = _laid(batch.column(0))
            known, context = _chain(held.value, syms, starts)
            use = context >= 0
            if known:
                use &= known[-1][1] >= 0
            if use.any():
                found.append(deal.numbers(context[use], syms[use]))
                size += len(found[-1])
            if size >= CHUNK:
                yield runs(found)
                found, size = [], 0
        if found:
            yield runs(found)

    def merge(batches):
        at, keys, n, size = None, [], [], 0

        def done():
            pairs, total = _summed(keys, n)
            often = total >= floor
            return pa.RecordBatch.from_arrays([pa.array(deal.pairs(at, pairs[often]), pa.int64()), pa.array(total[often], pa.int64())], ["pair", "n"])

        for batch in batches:
            for part, m, pairs, counts in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if part != at:
                    if keys:
                        yield done()
                    at, keys, n, size = part, [], [], 0
                keys.append(np.cumsum(_unpack(pairs, m)))
                n.append(_unpack(counts, m))
                size += m
                if size >= CHUNK:
                    keys, n = ([x] for x in _summed(keys, n))
                    size = 0
        if keys:
            yield done()

    packed = encoded.filter("not held_out").select("ids").mapInArrow(count, "part int, size long, pairs binary, n binary")
    return packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(merge, "pair long, n long")


def _estimate(tree: Tree, totals: np.ndarray) -> None:
    """Probabilities of the last level's pairs, its contexts' rest, suffix and state. totals: how often each context occurs."""
    level, d = tree.levels[-1], len(tree.levels)
    context, sym = np.divmod(level.places.keys, tree.width)
    with np.errstate(divide="ignore", invalid="ignore"):
        listed = np.bincount(context, minlength=len(totals))
        rest = np.where(listed > 0, (totals - np.bincount(context, level.n - DISCOUNT, len(totals))) / totals, 1.0)
        if d == 1:
            level.suffix = np.zeros(len(totals), np.int64)
            below = np.exp(tree.log0[sym])
        else:
            last = tree.levels[-2]
            before, newest = np.divmod(last.places.keys, tree.width)
            level.suffix = newest if d == 2 else tree.levels[-3].places.find(last.suffix[before] * tree.width + newest).astype(np.int64)
            below = np.exp(last.logp[last.places.find(level.suffix[context] * tree.width + sym)])
        p = (level.n - DISCOUNT) / totals[context] + rest[context] * below
        gain = np.bincount(context, p * np.log(p / below), len(totals)) + np.where(rest > 0, rest * np.log(rest), 0) * (1 - np.bincount(context, below, len(totals)))
        level.state = (listed > 0) & (totals * gain > 0.5 * listed * np.log(np.maximum(totals, 1)))
        level.logp, level.log_rest = np.log(p), np.log(rest)


def learn(encoded: DataFrame, tree: Tree, symbol_counts: np.ndarray, floor: int, depth: int) -> Tree:
    """Adds the levels. A level's arrays have at most 1/p_min entries, so they are laid out and broadcast from the driver."""
    totals, tokens = symbol_counts, int(symbol_counts.sum())
    for _ in range(depth):
        if not len(totals):
            break
        got = count_pairs(encoded, tree, len(totals), floor, tokens).toArrow()
        pairs, n = got["pair"].to_numpy(), got["n"].to_numpy()
        order = np.argsort(pairs)
        tree.levels.append(Level(Places(pairs[order]), n[order]))
        _estimate(tree, totals)
        totals = n[order]
    for level, longer in zip(reversed(tree.levels[:-1]), reversed(tree.levels[1:]), strict=True):
        level.state[longer.suffix[longer.state]] = True
    return tree


def log_probs(tree: Tree, syms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural log of each token's symbol after the longest suffix of its history that is a state."""
    known, _ = _chain(tree, syms, starts)
    out, open_, inside = np.zeros(len(syms)), np.ones(len(syms), bool), np.zeros(len(syms), bool)
    for level, (context, pair) in zip(reversed(tree.levels), reversed(known), strict=True):
        inside |= (context >= 0) & level.state[context]
        here = inside & open_
        hit = here & (pair >= 0)
        out[hit] += level.logp[pair[hit]]
        out[here & ~hit] += level.log_rest[context[here & ~hit]]
        open_ &= ~hit
    out[open_] += tree.log0[syms[open_]]
    return out


def _sums(encoded: DataFrame, tree: Tree) -> DataFrame:
    """(row, id, held_out, n_tokens, n_symbols, n_rare, base, score): parts of the scores by symbols, in log10."""
    held = encoded.sparkSession.sparkContext.broadcast(tree)
    kind = encoded.schema["id"].dataType.simpleString()

    def work(batches):
        tree = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            syms, starts = _laid(batch.column(4))
            rare = syms == tree.symbols
            total = lambda x: np.add.reduceat(x, starts)
            n_rare = total(rare.astype(np.int64))
            parts = [total((~rare).astype(np.int64)), n_rare, total(np.where(rare, 0.0, tree.log0[syms])) / math.log(10), total(log_probs(tree, syms, starts)) / math.log(10) - n_rare * tree.log0[-1] / math.log(10)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], *map(pa.array, parts)], ["row", "id", "held_out", "n_tokens", "n_symbols", "n_rare", "base", "score"])

    return encoded.select("row", "id", "held_out", "n_tokens", "ids").mapInArrow(work, f"row long, id {kind}, held_out boolean, n_tokens long, n_symbols long, n_rare long, base double, score double")


def score(docs: DataFrame, p_min: float = 2.0**-22, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, learned from those not held out."""
    scratch = scratch or Scratch(docs.sparkSession)
    vocabulary = scratch.table(count_words(docs.filter(~_held_out(docs[id_col])), text_col), "words")
    total, known = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = max(MIN_COUNT, math.ceil(p_min * total))
    often = vocabulary.filter(F.col("n") >= floor).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    counts = often["n"].to_numpy().astype(np.int64)
    symbols = {w: i for i, w in enumerate(often["word"].to_pylist())}
    left, mass = total - int(counts.sum()), total + 0.5 * (known + 1)
    log0 = np.log(np.concatenate([counts + 0.5, [left + 0.5 * (known - len(counts) + 1)]]) / mass)
    tree = Tree(len(symbols), symbols.get(END, len(symbols)), log0)
    encoded = scratch.table(encode(docs, symbols, id_col, text_col), "encoded")
    if total:
        learn(encoded, tree, np.append(counts, left), floor, depth)
    rare = encoded.select("row", F.explode("rare").alias("word")).join(vocabulary.filter(F.col("n") < floor).hint("merge"), "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    tails = rare.groupBy("row").agg(F.count_if(c > 0).alias("tail_known"), F.sum(F.log10((c + 0.5) / F.lit(mass))).alias("tail"))
    out = _sums(encoded, tree).join(tails, "row", "left")
    tail = F.coalesce(F.col("tail"), F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_symbols") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + tail).alias("base_score"), (F.col("score") + tail).alias("score"))
