"""Token lengths and ids of whole texts, equal to the tokenizer library's own: by pre-token lookups, or by rank merging.

Two tiers: a table of frequent pre-tokens (the vocabulary's own entries, frequent by how a vocabulary is made) that
every worker gets from the vocabulary file, and a worker cache for the rest, filled by the library in batches and
emptied at `CACHE` entries. Texts with characters whose class the splitting pattern might see otherwise than the
library does, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same on texts of nothing but ASCII, Latin letters and a few marks, for the faster standard library.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf" ?[{LETTERS}]+|'(?:[sdmt]|re|ve|ll)| ?[0-9]+| ?[^ \t\n\r{LETTERS}0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
ODD = re.compile(rf"[^\t\n\r\x20-\x7E{LETTERS[6:]}¡¿«»©–—‘’“”…€]")
CACHE = 150_000
PART = 128

_OPEN: dict[tuple[str, bool], "Pieces"] = {}


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, other bytes from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def frequent(path: str, ids: bool) -> dict:
    """Vocabulary entries that are whole pre-tokens, with what the library gives for them: the first tier."""
    from tokenizers import Tokenizer

    tok, back, split = Tokenizer.from_file(path), byte_chars(), regex.compile(PATTERN)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    texts = []
    for entry in tok.get_vocab():
        if entry in special or any(c not in back for c in entry):
            continue
        try:
            text = bytes(back[c] for c in entry).decode()
        except UnicodeDecodeError:
            continue
        if not ODD.search(text) and split.findall(text) == [text]:
            texts.append(text)
    return dict(zip(texts, map(_packed if ids else _length, tok.encode_batch_fast(texts, add_special_tokens=False)), strict=True))


def ranks(tok):
    """The vocabulary as merge ranks: a byte-level vocabulary numbers its entries in the order of their merges, so a
    piece's bytes merge by lowest entry number; a rank merger does so several times faster than the library's calls."""
    import tiktoken

    back, special = byte_chars(), {t.content for t in tok.get_added_tokens_decoder().values()}
    table = {bytes(back[c] for c in entry): i for entry, i in tok.get_vocab().items() if entry not in special}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe


def _packed(encoding) -> bytes:
    return np.array(encoding.ids, "<u4").tobytes()


def _length(encoding) -> int:
    return len(encoding.ids)


class Pieces:
    """One worker's table, cache and library for a vocabulary file."""

    def __init__(self, path: str, ids: bool, table: dict | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.tier = table if table is not None else frequent(path, ids)
        self.known = dict(self.tier)
        self.make = _packed if ids else _length
        self.ids = ids
        self.whole = b"".join if ids else sum
        self.ranks = ranks(self.tok)

    def learn(self, missing: list[str]) -> None:
        """Merge what the table lacks by the vocabulary's ranks."""
        merge = self.ranks.encode_single_piece
        missing = [(p, p.encode("utf-8")) for p in missing]
        if self.ids:
            self.known.update((p, array("I", merge(b)).tobytes()) for p, b in missing)
        else:
            self.known.update((p, len(merge(b))) for p, b in missing)

    def encode(self, texts: list[str]) -> list:
        """Per text the number of tokens, or its ids packed in little-endian 32-bit."""
        out: list = [None] * len(texts)
        cut: list[int] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            (whole if ODD.search(t) or any(s in t for s in self.special) else cut).append(i)
        for i, e in zip(whole, self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = self.make(e)
        for k in range(0, len(cut), PART):
            gaps: list[tuple[int, list[str], list]] = []
            missing: set[str] = set()
            if len(self.known) > len(self.tier) + CACHE:
                self.known = dict(self.tier)
            get = self.known.get
            for i in cut[k : k + PART]:
                p = PLAIN.findall(texts[i])
                got = list(map(get, p))
                if None in got:
                    gaps.append((i, p, got))
                    missing.update(x for x, v in zip(p, got, strict=True) if v is None)
                else:
                    out[i] = self.whole(got)
            if missing:
                self.learn(list(missing))
            get = self.known.__getitem__
            for i, p, got in gaps:
                out[i] = self.whole([get(x) if v is None else v for x, v in zip(p, got, strict=True)])
        return out


class Whole:
    """Ids of whole texts, merged by rank where the pattern's classes are certain and by the library elsewhere; no cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranks = ranks(self.tok)

    def packed(self, text: str) -> bytes:
        if ODD.search(text) or any(s in text for s in self.special):
            return _packed(self.tok.encode_batch_fast([text], add_special_tokens=False)[0])
        return array("I", self.ranks.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def whole(path: str) -> Whole:
    """This worker's."""
    return Whole(path)


def pieces(path: str, ids: bool, table: dict | None = None) -> Pieces:
    """This worker's, kept between batches and tasks."""
    if (path, ids) not in _OPEN:
        _OPEN[path, ids] = Pieces(path, ids, table)
    return _OPEN[path, ids]
