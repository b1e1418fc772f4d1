"""Fill-in-middle over ropes: a text is a tree of leaves, cut at two unit ranks, put together in another order, and back.

A unit is a word with the white space before it, or white space at the end. A leaf holds some LEAF characters that end
at a unit's end (a longer unit stays whole in one leaf) and caches its units and code points; an inner node caches the
sums of its two sides. Cutting walks down one path by the cached counts and looks into the text of one leaf only;
putting together makes inner nodes, no copies. The way back builds a rope over the output, finds the sentinels leaf by
leaf, and cuts by code points. Every text is transformed where it lies; nothing is shuffled.

Defined results: null text counts as empty; the empty text and texts that hold a sentinel stay plain; a null id draws
as the id `null`; rows of one id draw alike, repeated rows each get a row; equal ranks give an empty middle; very long
texts are read whole, one at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_of

LEAF = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    chars: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int


NOTHING = Leaf("", 0, 0)


def leaf(text: str) -> Leaf:
    """Of text that begins at a unit's beginning; bytes.split() knows the same white space as UNIT."""
    return Leaf(text, len(text.encode("utf-8", "surrogatepass").split()) + (text[-1:] in BLANK and text != ""), len(text))


def mark(text: str) -> Leaf:
    """A sentinel: characters that are no unit."""
    return Leaf(text, 0, len(text))


def joined(left, right):
    if not left.chars:
        return right
    if not right.chars:
        return left
    return Node(left, right, left.units + right.units, left.chars + right.chars)


def rope(text: str, size: int = LEAF):
    """A balanced tree over the leaves of a text."""
    level, at = [], 0
    while at < len(text):
        end = WORD_END.search(text, at + size - 1)
        cut = end.end() if end else len(text)
        level.append(leaf(text[at:cut]))
        at = cut
    while len(level) > 1:
        level = [joined(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else NOTHING


def _cut_leaf(node: Leaf, rank: int, by: str):
    if by == "units":
        at = next(islice(UNIT.finditer(node.text), rank - 1, None)).end()
        return Leaf(node.text[:at], rank, at), Leaf(node.text[at:], node.units - rank, node.chars - at)
    return leaf(node.text[:rank]), leaf(node.text[rank:])


def split(node, rank: int, by: str = "units"):
    """The rope before and after a rank in units or chars: down one path, with the sides beside it joined on the way back."""
    before, after = [], []
    while 0 < rank < getattr(node, by) and isinstance(node, Node):
        if rank <= getattr(node.left, by):
            after.append(node.right)
            node = node.left
        else:
            before.append(node.left)
            rank -= getattr(node.left, by)
            node = node.right
    if rank <= 0:
        left, right = NOTHING, node
    elif rank >= getattr(node, by):
        left, right = node, NOTHING
    else:
        left, right = _cut_leaf(node, rank, by)
    for side in reversed(before):
        left = joined(side, left)
    for side in reversed(after):
        right = joined(right, side)
    return left, right


def leaves(node) -> Iterator[Leaf]:
    held = [node]
    while held:
        x = held.pop()
        if isinstance(x, Node):
            held += (x.right, x.left)
        else:
            yield x


def flat(node) -> str:
    return "".join(x.text for x in leaves(node))


def find(node, what: str) -> int:
    """Code points before the first place of `what`, -1 without; it may lie across leaves."""
    at, tail = 0, ""
    for x in leaves(node):
        seen = tail + x.text
        here = seen.find(what)
        if here >= 0:
            return at - len(tail) + here
        at += x.chars
        tail = seen[-(len(what) - 1) :]
    return -1


def rearranged(text: str, h: tuple[int, int, int, int], fim_rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, characters of prefix and middle, and the output of one text under four draws."""
    tree = rope(text)
    n = tree.units
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= fim_rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, rest = split(tree, low)
    middle, suffix = split(rest, high - low)
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    order = [(SUFFIX, suffix), (PREFIX, prefix)] if form == "spm" else [(PREFIX, prefix), (SUFFIX, suffix)]
    out = NOTHING
    for sentinel, part in [*order, (MIDDLE, middle)]:
        out = joined(joined(out, mark(sentinel)), part)
    return n, form, prefix.chars, middle.chars, flat(out)


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made from."""
    if form == "plain":
        return output
    tree, parts = rope(output), {}
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    _, tree = split(tree, len(first), "chars")
    for name, until in ((first, second), (second, MIDDLE)):
        parts[name], rest = split(tree, find(tree, until), "chars")
        _, tree = split(rest, len(until), "chars")
    return flat(joined(joined(parts[PREFIX], tree), parts[SUFFIX]))


def _draws(seed: int, id_col):
    """Four numbers from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, fim_rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every text. Rates are in percent."""
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            ids, text, *h = (batch.column(k) for k in range(6))
            rows = [rearranged(t, d, fim_rate, spm_rate) for t, d in zip(text.to_pylist(), zip(*[x.to_pylist() for x in h], strict=True), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    source = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"), *_draws(seed, docs[id_col]))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(out: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds `restored`, the texts from before `transform`, from output and form alone."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return outputs.combine(forms, restored)

    return out.withColumn("restored", back(out[output_col], out[form_col]))


def digests(docs: DataFrame, **options) -> DataFrame:
    """Counts and forms of `transform`, with the sha256 of each output and of the text restored from it."""
    out = restore(transform(docs, **options))
    return out.withColumns({"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(F.col("restored").cast("binary"), 256)}).drop("output", "restored")
