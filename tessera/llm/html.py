"""Main-text extraction by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags, each with the path of open elements above
it. A bidirectional LSTM in numpy reads the sequence of a page's blocks, each as a vector of its tag path (hashed
names, classes and ids), its words (hashed) and a few sizes, and labels every block main text or not with the whole
page as context. It is trained on the driver by back-propagation on generated pages of many layouts, `TRAINING`
of them from a fixed seed; pages of the corpus are not needed and never sampled.

Scripts, styles and other elements without text of their own never become blocks. Character references are decoded,
white space inside a block becomes one space, blocks are trimmed and joined by \\n in page order.

Defined results: null html counts as empty and gives the empty text with 0 characters, as does a page without main
blocks; a very long page is read whole, in a batch of its own; repeated rows each get a row; an empty table gives an
empty result; other columns are not read. <br> is white space inside its block. A tag whose quote never closes takes the
rest of the page, as in browsers.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

# Fixed sets of element names.
SILENT = frozenset("script style noscript template head title textarea select option svg math iframe object canvas audio video map datalist".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img button input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tr article section div main body td aside nav".split())

# Attributes as browsers read them: a quote counts only after "=", and one that never closes takes the rest of the page.
ATTRIBUTES = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]*+))?+|=)*+"""
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|<({"|".join(RAW)})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\b[^>]*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)({ATTRIBUTES})(?:>|\Z)""", re.S | re.I)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

HASHED, WIDTH, HIDDEN = 1024, 32, 24
SIZES = 6
TRAINING, EPOCHS, SEED = 1000, 4, 11


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path names, text, share of characters inside links) of every block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    quiet = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text:
            out.append((stack[-1][1] if stack else (), text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not quiet:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal quiet, links
        if any(t not in INLINE for t, _ in stack[to:]):
            flush()
        for t, _ in stack[to:]:
            quiet -= t in SILENT
            links -= t == "a"
        del stack[to:]

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P or tag in SAME:
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == "p" and tag in CLOSES_P or t in SAME.get(tag, ()):
                    pop(i)
                    break
                if t in SCOPE and t not in SAME.get(tag, ()):
                    break
        if tag == "body":
            # A head left open ends here.
            pop(next((i for i, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        if tag in VOID:
            continue
        if m[4].rstrip().endswith("/") and tag not in CLOSES_P:
            continue
        path = (*stack[-1][1], tag) if stack else (tag,)
        if m[4]:
            for a in NAMED.finditer(m[4]):
                path += tuple(f".{x}" for x in PART.findall((a[2] or a[3] or a[4] or "").lower()))
        stack.append((tag, path))
        quiet += tag in SILENT
        links += tag == "a"
    add(page[at:])
    flush()
    return out


@lru_cache(maxsize=200_000)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % HASHED


@lru_cache(maxsize=20_000)
def _path_slots(path: tuple[str, ...]) -> tuple[int, ...]:
    """Of all names; inline elements say nothing about a block."""
    return tuple(_slot("p" + n) for n in path if n not in INLINE) or (_slot("p"),)


EDGE = ".,:;!?()|"


def page_input(page_blocks: list[tuple[tuple[str, ...], str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed path names and hashed words of a page's blocks on end, how many each block has, and the blocks' sizes."""
    paths, words, n_paths, n_words, sizes = [], [], [], [], []
    last = max(1, len(page_blocks) - 1)
    for i, (path, text, link) in enumerate(page_blocks):
        own = _path_slots(path)
        paths += own
        n_paths.append(len(own))
        w = text.split()
        words += [_slot("w" + x.strip(EDGE)) for x in w]
        n_words.append(len(w))
        sizes.append((math.log1p(len(text)) / 6, math.log1p(len(w)) / 4, link, text[-1] in ".!?…", i / last, 1.0))
    return np.array(paths), np.array(words), np.array(n_paths), np.array(n_words), np.array(sizes, np.float32).reshape(-1, SIZES)


class Labeller:
    """A bidirectional LSTM over blocks; parameters in a dict of float32 arrays."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d = 2 * WIDTH + SIZES
        s = lambda *k: (r.standard_normal(k) / np.sqrt(k[0])).astype(np.float32)
        self.p = {"path": s(HASHED, WIDTH) * np.float32(np.sqrt(HASHED)) * np.float32(0.1), "word": s(HASHED, WIDTH) * np.float32(np.sqrt(HASHED)) * np.float32(0.05), "out": s(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": s(d, 4 * HIDDEN), f"u{side}": s(HIDDEN, 4 * HIDDEN), f"c{side}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def vectors(self, paths, words, n_paths, n_words, sizes) -> np.ndarray:
        """Every block has a path name and a word, so no part that reduceat sums is empty."""
        one = np.add.reduceat(self.p["path"][paths], np.cumsum(n_paths) - n_paths, axis=0)
        two = np.add.reduceat(self.p["word"][words], np.cumsum(n_words) - n_words, axis=0) / n_words[:, None].astype(np.float32)
        return np.concatenate([one, two, sizes], 1)

    def _run(self, x: np.ndarray, side: str, keep: bool):
        """x: (time, pages, width)."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, past = [], []
        xw = x @ self.p[f"w{side}"] + self.p[f"c{side}"]
        for t in range(len(x)):
            z = xw[t] + h @ self.p[f"u{side}"]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            h = o * np.tanh(c)
            out.append(h)
            if keep:
                past.append((before, i, f, o, g, c))
        return np.stack(out), past

    @staticmethod
    def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page's first `length` steps in reverse order."""
        at = lengths[None, :] - 1 - np.arange(len(x))[:, None]
        at = np.where(at >= 0, at, np.arange(len(x))[:, None])
        return np.take_along_axis(x, at[:, :, None], 0)

    def logits(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        f, past_f = self._run(x, "f", keep)
        b, past_b = self._run(self._reverse(x, lengths), "b", keep)
        h = np.concatenate([f, self._reverse(b, lengths)], 2)
        return (h @ self.p["out"])[:, :, 0] + self.p["bias"][0], h, past_f, past_b

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Main text or not for every block; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):
            group = order[k : k + 64]
            longest = len(pages[group[-1]])
            if longest > 2000:  # few very long pages: one at a time
                group = order[k : k + 1]
                longest = len(pages[group[0]])
            k += len(group)
            x = np.zeros((longest, len(group), 2 * WIDTH + SIZES), np.float32)
            for j, i in enumerate(group):
                x[: len(pages[i]), j] = self.vectors(*page_input(pages[i]))
            z, *_ = self.logits(x, np.array([len(pages[i]) for i in group]))
            for j, i in enumerate(group):
                out[i] = z[: len(pages[i]), j] > 0
        return out

    def _back(self, x, side: str, past, dh_all, grads) -> np.ndarray:
        dx = np.zeros_like(x)
        dh_next = dc_next = np.zeros((x.shape[1], HIDDEN), np.float32)
        w, u = self.p[f"w{side}"], self.p[f"u{side}"]
        for t in range(len(x) - 1, -1, -1):
            (h0, c0), i, f, o, g, c = past[t]
            dh = dh_all[t] + dh_next
            tc = np.tanh(c)
            dc = dh * o * (1 - tc * tc) + dc_next
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"w{side}"] += x[t].T @ dz
            grads[f"u{side}"] += h0.T @ dz
            grads[f"c{side}"] += dz.sum(0)
            dx[t] = dz @ w.T
            dh_next, dc_next = dz @ u.T, dc * f
        return dx

    def step(self, inputs, labels, state, rate: float) -> float:
        """One Adam step on a batch of pages; the mean loss."""
        lengths = np.array([len(y) for y in labels])
        x = np.zeros((lengths.max(), len(labels), 2 * WIDTH + SIZES), np.float32)
        y, mask = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
        for j, (one, lab) in enumerate(zip(inputs, labels, strict=True)):
            x[: len(lab), j], y[: len(lab), j], mask[: len(lab), j] = self.vectors(*one), lab, 1
        z, h, past_f, past_b = self.logits(x, lengths, True)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = (p - y) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = np.einsum("tbh,tb->h", h, dz)[:, None]
        g["bias"] = np.array([dz.sum()], np.float32)
        dh = dz[:, :, None] * self.p["out"][:, 0]
        dx = self._back(x, "f", past_f, dh[:, :, :HIDDEN], g)
        rev = self._reverse(x, lengths)
        dx += self._reverse(self._back(rev, "b", past_b, self._reverse(dh[:, :, HIDDEN:], lengths), g), lengths)
        for j, (paths, words, n_paths, n_words, _) in enumerate(inputs):
            d = dx[: len(n_paths), j]
            np.add.at(g["path"], paths, np.repeat(d[:, :WIDTH], n_paths, axis=0))
            np.add.at(g["word"], words, np.repeat(d[:, WIDTH : 2 * WIDTH] / n_words[:, None], n_words, axis=0))
        state["n"] += 1
        for k, v in self.p.items():
            m, s = state.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            v -= (rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(s / (1 - 0.99 ** state["n"])) + 1e-8)).astype(np.float32)
        loss = -(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)) * mask
        return float(loss.sum() / mask.sum())


# Fixed word lists of the generated pages.
SYLLABLES = "th er on an in re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve che ung sch ent ción que la eux ment".split()
BOILER = {
    "nav": "home about contact news products login menu search help blog start inicio accueil startseite".split(),
    "footer": "copyright all rights reserved privacy terms imprint contact site powered by".split(),
    "ad": "buy now sale offer discount sponsored advertisement free shipping deal subscribe today".split(),
    "notice": "cookies we use accept settings consent privacy policy notice agree this site".split(),
    "aside": "related popular posts tags archive categories recent more share follow trending".split(),
    "comments": "reply says comment posted by user thanks great post i agree reader wrote".split(),
    "form": "email name submit send subscribe password sign up newsletter your address".split(),
}
FRAMES = {
    "nav": ["nav", "div.menu", "div.nav", "ul.menu", "div.navbar", "div.breadcrumb", "div.topnav", "div.navigation", "div#nav", "div#menu", "ol.breadcrumbs", "div.pagination"],
    "header": ["header", "div.header", "div#header", "div.masthead", "div.banner", "div.logo", "div.topbar", "header.site-header"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.bottom"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsored", "div.promo", "section.ad", "div.ad-banner", "div#ad", "ins.ads"],
    "notice": ["div.notice", "div.cookie", "div.cookie-banner", "div.popup", "div.alert", "div#cookies", "div.consent", "section.notice", "div.gdpr", "div.modal", "p.notice", "div.newsletter"],
    "aside": ["aside", "div.sidebar", "div.related", "div#sidebar", "div.widget", "section.related", "div.share", "div.social", "div.tags", "aside.sidebar", "div.author", "div.recommended"],
    "comments": ["div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "section#comments", "ul.replies", "div.discussion", "div.responses"],
    "form": ["form", "form.search", "div.form", "form.subscribe", "form.login", "fieldset"],
}
MAIN = ["article", "main", "div.content", "div.post", "div.article", "div#content", "section.article", "div.entry-content", "div.post-body", "div#main", "main.content", "div.story", "div.text", "article.post", "div.body", "section"]
INSIDE = ("ad", "notice", "aside", "form", "comments", "nav")


def generated_page(r: np.random.Generator) -> tuple[list, list[bool]]:
    """Blocks and labels of a made-up page: a marked article among menus, adverts and the like, in many layouts."""
    word = lambda: "".join(r.choice(SYLLABLES, r.integers(1, 4)))

    def sentence(n: int) -> str:
        w = [word() for _ in range(n)]
        form = r.random()
        if form < 0.12:
            return " | ".join(w).capitalize() + str(r.choice(["", " |", "."]))
        if form < 0.2:
            return " ".join(x + str(r.choice(["%%%", "###", "$$$", "***", ""])) for x in w)
        return " ".join(w).capitalize() + str(r.choice([".", ".", ".", ",", "", "###"]))

    def mark(frame: str) -> tuple[str, str]:
        tag, _, name = frame.replace("#", ".").partition(".")
        kind = "id" if "#" in frame else "class"
        return (f'<{tag} {kind}="{name}">' if name else f"<{tag}>"), f"</{tag}>"

    def noise(kind: str) -> str:
        a, b = mark(str(r.choice(FRAMES[kind])))
        say = lambda: " ".join([*(str(x) for x in r.choice(BOILER.get(kind, BOILER["nav"]), r.integers(1, 5)))] if r.random() < 0.5 else [sentence(int(r.integers(1, 14)))])
        form = r.integers(0, 4)
        if kind in ("nav", "aside") and form < 3 or form == 0:
            inner = "<ul>" + "".join(f'<li><a href="/x">{word()}</a></li>' for _ in range(r.integers(1, 8))) + "</ul>"
        elif kind in ("comments", "aside", "notice") and form < 3:
            inner = "".join(f"<p>{sentence(int(r.integers(3, 40)))}</p>" for _ in range(r.integers(1, 5)))
        elif kind == "footer" and form < 3:
            inner = f"&copy; {word()}.{word()}.example &middot; {sentence(int(r.integers(1, 16)))}"
        elif form == 1:
            inner = f"<h3>{say()}</h3><p>{say()}</p>"
        else:
            inner = say()
        return a + inner + b

    def article() -> list[str]:
        out = [f"\1<h1>{sentence(int(r.integers(2, 12)))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.integers(1, 14)):
            n = int(r.integers(1, 120)) if r.random() < 0.7 else int(r.integers(1, 5))
            form = r.random()
            body = sentence(n)
            if form < 0.65:
                out.append(f"\1<p>{body}</p>")
            elif form < 0.72:
                out.append(f"\1<p><b>{body}<br><p>")
            elif form < 0.8:
                out.append(f"\1<h2>{sentence(int(r.integers(1, 8)))}</h2>")
            elif form < 0.86:
                out.append("".join(["\1<ul>", *(f"\1<li>{sentence(int(r.integers(1, 20)))}</li>" for _ in range(r.integers(1, 6))), "</ul>"]))
            elif form < 0.9:
                out.append(f"\1<blockquote>{body}</blockquote>")
            elif form < 0.94:
                out.append(f'\1<p>{body} <a href="/y">{word()}</a> {sentence(4)}</p>')
            elif form < 0.97:
                out.append(f"\1<table><tr><td>{word()}</td><td>{word()} {word()}</td></tr></table>")
            else:
                out.append(f"\1<div>{body}</div>")
        if r.random() < 0.4:
            for _ in range(r.integers(1, 3)):
                out.insert(int(r.integers(0, len(out) + 1)), noise(str(r.choice(INSIDE))))
        return out

    a, b = mark(str(r.choice(MAIN)))
    middle = a + "".join(f"\2{x}\3" if x.startswith("\1") else x for x in article()) + b
    if r.random() < 0.4:
        x, y = mark(str(r.choice(["div.container", "div.wrapper", "div.page", "div#page", "section", "div.row"])))
        middle = x + (noise("aside") if r.random() < 0.4 else "") + middle + (noise("aside") if r.random() < 0.4 else "") + y
    before = "".join(noise(str(k)) for k in r.choice(["nav", "header", "ad", "notice", "form", "nav"], r.integers(0, 5)))
    after = "".join(noise(str(k)) for k in r.choice(["footer", "comments", "aside", "ad", "notice", "form", "footer"], r.integers(0, 5)))
    page = f"<html><head><title>{word()}</title></head><body>{before}{middle}{after}"
    # The marks \2 and \3 around main parts show in the text of blocks and are read off again.
    found, labels, inside = [], [], False
    for names, text, link in blocks(page):
        main = inside or "\2" in text or "\1" in text
        for c in text:
            if c == "\2":
                inside = True
            elif c == "\3":
                inside = False
        bare = " ".join(re.sub("[\1\2\3]", "", text).split())
        if bare:
            found.append((names, bare, link))
            labels.append(main)
    return found, labels


@cache
def trained(pages: int = TRAINING, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    r = np.random.default_rng(seed)
    made = [m for m in (generated_page(r) for _ in range(pages)) if m[0]]
    inputs, labels = [page_input(b) for b, _ in made], [y for _, y in made]
    model, state = Labeller(seed), {"n": 0}
    order = sorted(range(len(made)), key=lambda i: len(labels[i]))
    batches = [order[k : k + 12] for k in range(0, len(order), 12)]
    for e in range(epochs):
        for k in r.permutation(len(batches)):
            model.step([inputs[i] for i in batches[k]], [labels[i] for i in batches[k]], state, 0.01 if e < epochs - 1 else 0.003)
    return model


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def main_text(raw: pd.Series) -> pd.Series:
        out = []
        raw = raw.tolist()
        for k in range(0, len(raw), 256):
            cut = [blocks(h) for h in raw[k : k + 256]]
            out += ["\n".join(b[1] for b, y in zip(p, keep, strict=True) if y) for p, keep in zip(cut, held.value.label(cut), strict=True)]
        return pd.Series(out, dtype="object")

    text = main_text(F.coalesce(pages[html_col].cast("string"), F.lit("")))
    return pages.select(pages[id_col], pages[url_col], text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
