"""Quality rules: counts a word-level rule can reject on, and bands of n-gram perplexity per language.

The perplexity comes from a modified Kneser-Ney model of character 6-grams over the texts' own code points, none folded.
Spark counts the 6-grams of every whole text, derives the lower orders and joins up the probabilities; the model grows
with the corpus. Each 6-gram has its probability with one occurrence of its own taken out of the counts, since the
texts that are scored are those the model is trained on. Up to MODEL_BOUND entries the model is broadcast as sorted
arrays of hashed 6-grams; beyond, it stays partitioned and the 6-grams of the texts are joined with it. log_ppl is the
log perplexity per word: words with marks hung on cost more, words cut up by marks less, whatever a character costs. Per
language, the quartiles of log_ppl over all documents of `min_words` words or more give the band [q1 - width, q3 + width]
with width = reach * max(q3 - q1, floor) + slack / sqrt(characters in words), the last part for the spread that a short
text's mean has by chance; a document outside is rejected.

Defined results: null and empty texts have no words, all counts 0, null log_ppl, and fail the base rule; a null
language is a language of its own; repeated rows each count and get equal verdicts; very long texts are read whole; a
log_ppl on the edge of its band is kept; an empty table gives an empty result; other columns pass through in `filter_quality` and are not read in `score`.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ORDER, BITS = 4, 5
SIZE = 1 << BITS
TABLE_END = 0x3000
MARKS = {".": 28, ",": 28, ";": 28, ":": 28, "!": 28, "?": 28, "'": 29, '"': 29, "-": 29, "(": 29, ")": 29}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"
MAX_LANGUAGES = 10_000
#: Characters of an n-gram of the corpus model: two longs of three symbols of 21 bits, a code point and 1 each.
REACH, POINT_BITS = 6, 21
POINT = (1 << POINT_BITS) - 1
MODEL_BOUND = 1 << 23
COUNT_CHARS = 1 << 21


@cache
def symbols() -> np.ndarray:
    """Code point to symbol: 0 blank, 1-26 letters without their accents, 27 digits, 28-29 marks, 30 other letters, 31 the rest."""
    out = np.full(TABLE_END + 1, 30, np.uint32)
    for cp in range(TABLE_END):
        c = chr(cp)
        base = unicodedata.normalize("NFD", c.lower())[:1]
        if c.isspace() or cp < 32:
            out[cp] = 0
        elif "a" <= base <= "z":
            out[cp] = ord(base) - 96
        elif c.isdigit():
            out[cp] = 27
        elif c in MARKS:
            out[cp] = MARKS[c]
        elif not c.isalpha():
            out[cp] = 31
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams that end at each character, a blank context before each text, and how many each text has."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    pad = np.full(ORDER - 1, 32, np.uint32)
    flat = np.concatenate([x for p in points for x in (pad, p)]) if points else pad
    s = symbols()[np.minimum(flat, TABLE_END)]
    code = s.copy()
    for k in range(1, ORDER):
        code[k:] |= s[:-k] << np.uint32(BITS * k)
    own = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        own[starts + k] = False
    return code[own], sizes


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    return discounts(*(int((counts == k).sum()) for k in (1, 2, 3, 4)))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.75, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.9]
    return np.array([0.0, *(min(max(x, 0.05), k) for x, k in zip(d, (1.0, 2.0, 3.0), strict=True))])


def train(gram: np.ndarray, n: np.ndarray) -> dict[str, list[np.ndarray]]:
    """Modified Kneser-Ney: sorted keys and log probabilities of seen n-grams per order, and log back-off weights of seen histories."""
    counts = np.zeros(SIZE**ORDER, np.int64)
    counts[gram] = n
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different symbols before
        levels.append((levels[-1].reshape(SIZE, SIZE**k) > 0).sum(0))
    lower = np.full(SIZE, 1.0 / SIZE)
    model: dict[str, list[np.ndarray]] = {"keys": [], "logp": [], "histories": [], "backoff": []}
    for k, c in enumerate(reversed(levels), 1):
        c2 = c.reshape(-1, SIZE)
        d = _discounts(c)
        total = c2.sum(1, keepdims=True)
        held = (d[1] * (c2 == 1) + d[2] * (c2 == 2) + d[3] * (c2 >= 3)).sum(1, keepdims=True)
        weight = np.where(total > 0, held / np.maximum(total, 1), 1.0)
        p = np.where(total > 0, np.maximum(c2 - d[np.minimum(c2, 3)], 0) / np.maximum(total, 1), 0.0)
        p = p + weight * (lower.reshape(-1, SIZE)[np.arange(len(c2)) % (SIZE ** max(0, k - 2))] if k > 1 else lower)
        keys = np.flatnonzero(c)
        model["keys"].append(keys.astype(np.uint32))
        model["logp"].append(np.log(p.reshape(-1)[keys]).astype(np.float32))
        seen = np.flatnonzero(total[:, 0])
        model["histories"].append(seen.astype(np.uint32))
        model["backoff"].append(np.log(np.maximum(weight[seen, 0], 1e-12)).astype(np.float32))
        lower = p
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def log_prob(model: dict[str, list[np.ndarray]], codes: np.ndarray) -> np.ndarray:
    """Log probability of packed 4-grams: the longest order seen, with the weights of the histories passed on the way."""
    out = np.zeros(len(codes))
    left = np.ones(len(codes), bool)
    for k in range(ORDER, 0, -1):
        gram = codes & np.uint32(SIZE**k - 1)
        at, hit = _find(model["keys"][k - 1], gram)
        hit &= left
        out[hit] += model["logp"][k - 1][at[hit]]
        left &= ~hit
        if k > 1:
            at, seen = _find(model["histories"][k - 1], gram >> np.uint32(BITS))
            seen &= left
            out[seen] += model["backoff"][k - 1][at[seen]]
        elif left.any():
            out[left] += np.log(1.0 / SIZE) + (model["backoff"][0][0] if len(model["backoff"][0]) else 0.0)
    return out


def char_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two longs of the 6-gram that ends at each character, zeros before each text, and how many each text has."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    pad = np.zeros(REACH - 1, np.int64)
    s = np.concatenate([x for p in points for x in (pad, p.astype(np.int64) + 1)]) if points else pad
    three = s.copy()
    three[1:] |= s[:-1] << POINT_BITS
    three[2:] |= s[:-2] << 2 * POINT_BITS
    ends = np.arange(sizes.sum()) + np.repeat((REACH - 1) * (np.arange(len(sizes)) + 1), sizes)
    return three[ends - 3], three[ends], sizes


def gram_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a 6-gram."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(32))) + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def count_char_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n) over every whole text."""

    def tally(texts):
        a, b, _ = char_grams(texts)
        t = pa.table({"a": a, "b": b}).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
        return pa.RecordBatch.from_arrays([t[c].combine_chunks().cast(pa.int64()) for c in ("a", "b", "count_all")], ["a", "b", "n"])

    def count(batches):
        held, chars = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.append(t)
                    chars += len(t)
                if chars >= COUNT_CHARS:
                    yield tally(held)
                    held, chars = [], 0
        if held:
            yield tally(held)

    return docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _history(df: DataFrame) -> DataFrame:
    """ha, hb: the n-gram without its last symbol."""
    return df.withColumns({"ha": F.expr(f"shiftright(a, {POINT_BITS})"), "hb": F.expr(f"shiftleft(a & {POINT}L, {2 * POINT_BITS}) | shiftright(b, {POINT_BITS})")})


def _shorter(df: DataFrame, k: int) -> DataFrame:
    """la, lb: an n-gram of k symbols without its first."""
    return df.withColumns({"la": F.expr(f"a & {(1 << POINT_BITS * max(0, k - 4)) - 1}L"), "lb": F.expr(f"b & {(1 << POINT_BITS * min(3, k - 1)) - 1}L")})


def train_corpus(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, logp) of every 6-gram: interpolated modified Kneser-Ney, less the one occurrence that is scored.

    p is the plain probability of an n-gram, q that after one of its counts is gone. While other counts of it remain the
    orders below keep theirs; with the last one its continuation goes too, so that the order below gives its own q."""
    levels = [scratch.table(counts, "grams6")]
    for k in range(REACH, 1, -1):
        levels.append(scratch.table(_shorter(levels[-1], k).groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.count("*").alias("n")), f"grams{k - 1}"))
    one = levels[-1].count() + 1
    below = counts.sparkSession.createDataFrame([(0, 0, 1.0 / one, 1.0 / one)], "la long, lb long, lp double, lq double")
    for k, counted in enumerate(reversed(levels), 1):
        d = discounts(*counted.agg(*[F.count_if(F.col("n") == x) for x in (1, 2, 3, 4)]).first())
        off = lambda n: f"case when {n} <= 0 then 0D when {n} = 1 then {d[1]}D when {n} = 2 then {d[2]}D else {d[3]}D end"
        level = _shorter(_history(counted), k)
        same = Window.partitionBy("ha", "hb")
        level = level.withColumns({"t": F.sum("n").over(same), "held": F.sum(F.expr(off("n"))).over(same)})
        p = f"(n - {off('n')} + held * lp) / t"
        q = f"case when t = 1 then lq else (n - 1 - {off('(n - 1)')} + (held - {off('n')} + {off('(n - 1)')}) * if(n = 1, lq, lp)) / (t - 1) end"
        both = level.join(below, ["la", "lb"])
        if k == REACH:
            model = scratch.table(both.select("a", "b", F.expr(f"cast(ln({q}) as float)").alias("logp")), "model")
        else:
            model = scratch.table(both.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.expr(p).alias("lp"), F.expr(q).alias("lq")), f"order{k}")
        del level, both
        for done in [counted] + [below] * (k > 1):
            scratch.drop(done)
        below = model
        scratch.settle()
    return below


def sorted_model(keys: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted hashes of the model's 6-grams, their values, and where the hashes of each highest part begin, about one to a part."""
    order = np.argsort(keys)
    keys, logp = keys[order], logp[order].astype(np.float32)
    bits = max(1, len(keys).bit_length())
    starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    return keys, logp, starts, bits


def _place(model: tuple, wanted: np.ndarray) -> np.ndarray:
    """Positions of hashes in the sorted array: the hashes of a part are looked through from its beginning."""
    keys, _, starts, bits = model
    at = starts[(wanted >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
    left = np.arange(len(wanted))
    while len(left):
        here = at[left]
        if here.max() >= len(keys):
            raise ValueError("texts hold 6-grams that the model was not trained on")
        found = keys[here]
        if (found > wanted[left]).any():
            raise ValueError("texts hold 6-grams that the model was not trained on")
        left = left[found != wanted[left]]
        at[left] += 1
    return at


def log_perplexity(model: tuple, texts: list[str]) -> np.ndarray:
    """Mean negative log probability per character by a sorted model; NaN for texts without any."""
    out = np.full(len(texts), np.nan)
    for k in range(0, len(texts), 256):
        part = texts[k : k + 256]
        a, b, sizes = char_grams(part)
        if not len(a):
            continue
        sums = np.concatenate([[0.0], np.cumsum(model[1][_place(model, gram_key(a, b))], dtype=np.float64)])
        ends = np.cumsum(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[k : k + len(part)] = -(sums[ends] - sums[ends - sizes]) / sizes
    return out


def joined_perplexity(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, log_ppl) of texts with characters, by a join with a model that is too large to broadcast."""

    def occur(batches):
        for batch in batches:
            hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for h, t in zip(hashes, texts, strict=True):
                if t:
                    a, b, _ = char_grams([t])
                    _, at, n = np.unique(gram_key(a, b), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h), pa.int64()), pa.array(a[at], pa.int64()), pa.array(b[at], pa.int64()), pa.array(n, pa.int64())], ["text_hash", "a", "b", "n"])

    text = docs[text_col].cast("string")
    grams_of = docs.select(_text_hash(text).alias("text_hash"), text.alias("text")).mapInArrow(occur, "text_hash long, a long, b long, n long")
    # Repeated texts add to both sums alike.
    return grams_of.hint("merge").join(model, ["a", "b"]).groupBy("text_hash").agg((-F.sum(F.col("n") * F.col("logp").cast("double")) / F.sum("n")).alias("log_ppl"))


def _text_hash(text):
    return F.xxhash64(text)


def word_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        often = Counter(triples)
        end = 0
        for i, t in enumerate(triples):
            if often[t] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def fit(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    return train_corpus(count_char_grams(docs, text_col), scratch)


def _scorer(docs: DataFrame, model: DataFrame, text_col: str, scratch: Scratch):
    """Adds the features of texts to rows of docs: a function of (columns to keep) that gives a DataFrame."""
    text = docs[text_col].cast("string")
    whole = model.count() <= MODEL_BOUND
    if whole:
        got = model.toArrow()
        held = docs.sparkSession.sparkContext.broadcast(sorted_model(gram_key(got["a"].to_numpy(), got["b"].to_numpy()), got["logp"].to_numpy()))
        del got
    else:
        held = None
        ppl = scratch.table(joined_perplexity(docs, model, text_col), "perplexity")

    @F.pandas_udf(FEATURES)
    def features(batches: "pd.Series") -> pd.DataFrame:
        texts = batches.fillna("").tolist()
        out = pd.DataFrame([word_counts(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
        if held is not None:
            out["log_ppl"] = log_perplexity(held.value, texts) * [len(t) for t in texts] / out["n_words"].where(out["n_words"] > 0)
        else:
            out["log_ppl"] = np.nan
        return out

    def add(*columns) -> DataFrame:
        out = docs.select(*columns, features(text).alias("f"), *([] if whole else [_text_hash(text).alias("__tessera_text"), F.length(text).alias("__tessera_n")]))
        kept = out.columns[: len(columns)]
        if whole:
            return out.select(*kept, "f.*")
        out = out.select(*kept, "f.*", "__tessera_text", "__tessera_n").drop("log_ppl")
        out = out.join(ppl.hint("merge"), F.col("__tessera_text") == F.col("text_hash"), "left")
        return out.withColumn("log_ppl", F.try_divide(F.col("log_ppl") * F.col("__tessera_n"), F.col("n_words"))).drop("__tessera_text", "__tessera_n", "text_hash")

    return add


FAILED = "(n_words < {0} or 100 * n_repeat_words > 50 * n_words)"


def _bands(scored: DataFrame, min_words: int, reach: float, floor: float) -> DataFrame:
    """(language, low, high), before the part for short texts, from an exact histogram of log perplexity in steps of 0.01 over all documents."""
    bins = scored.filter(f"n_words >= {min_words} and log_ppl is not null and not isnan(log_ppl)").groupBy("language", F.floor(F.least(F.col("log_ppl"), F.lit(1000.0)) * 100).alias("bin")).agg(F.count("*").alias("n"))
    # At most 100,001 bins a language, whatever the corpus holds.
    laid = bins.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("total"))
    at = lambda q: F.expr(f"aggregate(h, named_struct('c', 0L, 'v', cast(null as double)), (a, x) -> if(a.v is not null, a, named_struct('c', a.c + x.n, 'v', if(a.c + x.n >= total * {q}, cast(x.bin as double) / 100, null))), a -> a.v)")
    q = laid.select("language", at(0.25).alias("q1"), at(0.75).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(floor)) * reach
    return q.select("language", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def _with_bands(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """Joined on language; broadcast only after a check of how many languages there are."""
    bands = bands.withColumnRenamed("language", "band_language")
    if bands.count() <= MAX_LANGUAGES:
        bands = F.broadcast(bands)
    return scored.join(bands, F.col("language") == F.col("band_language"), "left").drop("band_language")


def _kept(min_words: int, slack: float):
    return F.expr(f"not {FAILED.format(min_words)} and coalesce(log_ppl between low - {slack} / sqrt(greatest(word_chars, 1)) and high + {slack} / sqrt(greatest(word_chars, 1)), true)")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, reach: float = 1.5, floor: float = 0.1, slack: float = 12.0, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: counts, log_ppl, base_failed and kept."""
    scratch = scratch or Scratch(docs.sparkSession)
    add = _scorer(docs, fit(docs, scratch, text_col), text_col, scratch)
    scored = scratch.table(add(docs[id_col].alias("id"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("language")), "scored")
    bands = scratch.table(_bands(scored, min_words, reach, floor), "bands")
    return _with_bands(scored, bands).select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(FAILED.format(min_words)).alias("base_failed"), _kept(min_words, slack).alias("kept"), "log_ppl")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = 50, reach: float = 1.5, floor: float = 0.1, slack: float = 12.0, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that `score` keeps, with their columns; texts are scored again rather than shuffled."""
    scratch = scratch or Scratch(docs.sparkSession)
    add = _scorer(docs, fit(docs, scratch, text_col), text_col, scratch)
    language = F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("language")
    bands = scratch.table(_bands(add(language), min_words, reach, floor), "bands")
    return _with_bands(add(F.struct(*[docs[c] for c in docs.columns]).alias("row"), language), bands).filter(_kept(min_words, slack)).select("row.*")
