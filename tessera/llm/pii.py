"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are found by their fixed patterns and always stay. Further candidates (numbers that
look like local phones, social-security and bank account numbers, names, handles) are judged: labelers vote for, against
or not at all, by the form, a gazetteer of first names, words around, and what the characters beside are. Spark counts
how often each pattern of votes occurs over all candidates of the corpus (fewer than 2**12 patterns whatever the
corpus), and expectation-maximisation estimates each labeler's reliability from the counts, with priors that hold where
candidates are few. A logistic span classifier is then trained with the posteriors as labels. It reads the span itself:
its shape, length and digits, the words and characters around it, all hashed, beside the votes. Its training rows are
the TRAINED candidates of smallest hash, spread over all documents; every candidate is classified. Those it gives
`threshold` or more become spans, unless they touch a base span.

Defined results: null text counts as empty and has no spans; no span gives the SHA-256 of the empty string and an empty
`spans`; repeated rows each get a row and each count; very long texts are read whole; of candidates of one kind that
overlap the leftmost stands, those of different kinds all do; equal hashes are drawn in order of their votes and
features; an empty table gives an empty result; other columns are not read. A name has 20 letters at most, a handle 30.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

# Fixed patterns of the contract, written so that no start is tried twice in a run of digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
KINDS = ("email", "ip", "card", "phone")

EXTRA = (
    ("local_phone", re.compile(r"(?<![0-9.+-])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])")),
    ("handle", re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_.@])")),
)
# Fixed word lists of the labelers.
FIRST_NAMES = "Adam Alain Alberto Alejandro Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anke Anna Anne Antoine Antonio Barbara Beatriz Benjamin Bernd Brian Bruno Carlos Carmen Carol Catherine Chantal Charles Charlotte Christian Christine Christopher Claire Claudia Cristina Daniel David Deborah Denis Diego Dieter Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Florian Francisco Frank Franz Gabriel George Gerard Hannah Hans Heike Helen Helga Henri Ines Isabel Jacques James Jan Janet Jason Javier Jean Jennifer Jessica Joan John Jorge Jose Joseph Juan Juergen Julia Julie Julien Karen Karin Karl Katharina Kevin Klaus Kurt Laura Laurent Lena Linda Lisa Louis Lucas Lucia Luis Luisa Manfred Manuel Marc Margaret Maria Marie Marina Mark Markus Marta Martin Mary Matthew Melissa Michael Michel Miguel Monika Nancy Nathalie Nicole Nina Olga Oliver Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philippe Pierre Pilar Rafael Ralf Raul Rebecca Richard Robert Rosa Ruth Ryan Sabine Samuel Sandra Sara Sarah Sergio Sofia Sophie Stefan Stephanie Steven Susan Susanne Sven Sylvie Teresa Thomas Timothy Tobias Ursula Uwe Valerie Victor Werner William Wolfgang Yves".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora Don Doña".split()
FOR_WORDS = {"phone": "phone tel telephone mobile cell call fax telefon handy anruf téléphone appeler teléfono móvil llame", "id": "ssn social security iban account bank konto compte cuenta", "name": "mr mrs ms dr dear name contact herr frau monsieur madame señor señora", "handle": "follow twitter instagram contact user"}
AGAINST_WORDS = "isbn version serial order invoice item page section figure table chapter ref model part issue volume".split()
TITLED = "|".join(rf"(?<={t}\x20)|(?<={t}\.\x20)" for t in TITLES)
NAME = re.compile(rf"(?<!\w)(?=[A-Z])(?:(?:{TITLED})[A-Z][a-z]{{1,20}}|(?:{'|'.join(FIRST_NAMES)}))\x20[A-Z][a-z]{{2,20}}(?!\w)")
GAZETTEER = frozenset(FIRST_NAMES)
CONTEXT = re.compile(r"\w+")
GROUP = {"local_phone": "phone", "ssn": "id", "iban": "id", "name": "name", "handle": "handle"}
NAMES = tuple(GROUP)
CUES = {k: frozenset(v.split()) for k, v in FOR_WORDS.items()}
AGAINST = frozenset(AGAINST_WORDS)
LABELERS = 4
HASHED, TRAINED = 4096, 20_000

FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, extra array<struct<kind:int,start:int,end:int,code:int,seen:array<int>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """By the @: the longest run of allowed characters before it, back to the match before, and a domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The four base kinds: leftmost matches that do not overlap within a kind, failing ones dropped."""
    ip = [m.span() for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    card = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    phone = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return {"email": emails(text), "ip": ip, "card": card, "phone": phone}


def _byte(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def votes(text: str, kind: str, start: int, end: int) -> list[int]:
    """1 for, 2 against, 0 no vote: form, gazetteer, words around, characters beside."""
    value = text[start:end]
    digits = DIGIT.findall(value)
    if kind == "local_phone":
        form = 1 if 9 <= len(digits) <= 11 else 2
    elif kind == "ssn":
        form = 2 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" else 1
    elif kind == "iban":
        bare = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in bare[4:] + bare[:4])
        form = 1 if int(number) % 97 == 1 else 2
    else:
        form = 0
    gazetteer = 0 if kind != "name" else 1 if value.split(" ")[0] in GAZETTEER else 2
    around = {w.lower() for w in CONTEXT.findall(text[max(0, start - 60) : start])[-5:]} | {w.lower() for w in CONTEXT.findall(text[end : end + 40])[:2]}
    words = 1 if around & CUES[GROUP[kind]] else 2 if around & AGAINST else 0
    beside = 2 if len(digits) == end - start or text[max(0, start - 1) : start] in ("/", "=", "#", "_") or text[end : end + 1] in ("/", "=", "_") else 0
    return [form, gazetteer, words, beside]


def seen(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: its shape, length, digits and parts, the words before and after, the characters beside."""
    value = text[start:end]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", value)))
    before = CONTEXT.findall(text[max(0, start - 60) : start])[-3:]
    after = CONTEXT.findall(text[end : end + 40])[:2]
    out = [f"shape {shape}", f"runs {re.sub('9+', '9', shape)}", f"long {min(30, end - start)}", f"digits {len(DIGIT.findall(value))}", f"head {value[:2]}"]
    out += [f"left {text[max(0, start - 1) : start]}", f"right {text[end : end + 1]}", *(f"before {w.lower()}" for w in before), *(f"after {w.lower()}" for w in after)]
    return sorted({zlib.crc32(f"{kind} {f}".encode("utf-8", "surrogatepass")) % HASHED for f in out})


def candidates(text: str, base: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(kind, start, end, code, features) of further candidates that touch no base span; code packs kind and votes."""
    out = []
    for kind, pattern in (*EXTRA, ("name", NAME)):
        if kind == "handle" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(x < b and a < y for x, y in base):
                continue
            k = NAMES.index(kind)
            code = k
            for v in votes(text, kind, a, b):
                code = code * 3 + v
            out.append((k, a, b, code, seen(text, kind, a, b)))
    return out


def unpack(code: int) -> tuple[int, list[int]]:
    v = []
    for _ in range(LABELERS):
        code, x = divmod(code, 3)
        v.append(x)
    return code, v[::-1]


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: P(vote | personal or not) per labeler, and each pattern's posterior.

    The priors stand for 20 candidates a labeler that votes rightly in 8 of 10 cases in which it votes."""
    v = np.array([unpack(int(c))[1] for c in codes]).reshape(-1, LABELERS)
    prior = 20 * np.array([[0.5, 0.1, 0.4], [0.5, 0.4, 0.1]])  # not personal: none, for, against; personal
    theta = np.repeat((prior / 20)[:, None, :], LABELERS, axis=1)
    share = 0.3
    post = np.zeros(len(codes))
    for _ in range(rounds):
        like = [np.log(theta[c][np.arange(LABELERS)[None, :], v]).sum(1) for c in (0, 1)]
        odds = like[1] - like[0] + np.log(share / (1 - share))
        post = 1 / (1 + np.exp(-odds))
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            for j in range(LABELERS):
                seen = np.bincount(v[:, j], weights=w, minlength=3) + prior[c]
                theta[c, j] = seen / seen.sum()
        share = (6 + (counts * post).sum()) / (20 + counts.sum())
    return theta, post


def _features(codes: np.ndarray) -> np.ndarray:
    """Bias, kind, and both directions of each vote."""
    out = np.zeros((len(codes), 1 + len(NAMES) + 2 * LABELERS))
    for i, c in enumerate(codes):
        k, v = unpack(int(c))
        out[i, 0] = 1
        out[i, 1 + k] = 0.3
        for j, x in enumerate(v):
            if x:
                out[i, 1 + len(NAMES) + 2 * j + x - 1] = 1
    return out


def span_classifier(codes: np.ndarray, post: np.ndarray, features: list[list[int]], rounds: int = 150) -> np.ndarray:
    """Weights over votes and hashed features of a logistic classifier trained on posteriors, with a ridge; full gradient steps with momentum."""
    votes = 1 + len(NAMES) + 2 * LABELERS
    beta = np.zeros(votes + HASHED)
    if not len(codes):
        return beta
    x = _features(codes)
    rows = np.repeat(np.arange(len(codes)), [len(f) for f in features])
    cols = np.concatenate([np.asarray(f, np.int64) for f in features])
    speed = np.zeros_like(beta)
    for _ in range(rounds):
        z = x @ beta[:votes] + np.bincount(rows, weights=beta[votes + cols], minlength=len(codes))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) / len(codes)
        grad = np.concatenate([x.T @ off, np.bincount(cols, weights=off[rows], minlength=HASHED)]) + np.concatenate([np.full(votes, 1e-4), np.full(HASHED, 1e-3)]) * beta
        speed = 0.9 * speed - 0.5 * grad
        beta += speed
    return beta


def span_scores(beta: np.ndarray, codes: np.ndarray, features: list[list[int]]) -> np.ndarray:
    votes = 1 + len(NAMES) + 2 * LABELERS
    z = _features(codes) @ beta[:votes] + np.array([beta[votes + np.asarray(f, np.int64)].sum() for f in features])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans; n_added counts what the method added."""
    scratch = scratch or Scratch(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts.tolist():
            base = base_spans(t)
            flat = [(k, a, b) for k in KINDS for a, b in base[k]]
            extra = candidates(t, [(a, b) for _, a, b in flat])
            out.append((*(len(base[k]) for k in KINDS), joined(flat), [{"kind": k, "start": a, "end": b, "code": c, "seen": f} for k, a, b, c, f in extra]))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "extra"])

    rows = docs.select(docs[id_col].alias("id"), found(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("f")).select("id", "f.*")
    rows = scratch.table(rows, "found")
    patterns = rows.select(F.explode("extra").alias("e")).groupBy("e.code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r["code"] for r in patterns], np.int64), np.array([r["n"] for r in patterns], np.float64)
    # The training rows: few columns of a bounded number of candidates, the same ones whatever the partitions.
    drawn = rows.select("id", F.explode("extra").alias("e")).select(F.xxhash64(F.col("id").cast("string"), "e.start", "e.kind").alias("h"), F.col("e.code").alias("code"), F.col("e.seen").alias("seen"))
    drawn = drawn.orderBy("h", "code", "seen").limit(TRAINED).collect()
    posterior = dict(zip(codes.tolist(), reliabilities(codes, counts)[1].tolist(), strict=True)) if len(codes) else {}
    beta = span_classifier(np.array([r["code"] for r in drawn], np.int64), np.array([posterior[r["code"]] for r in drawn]), [r["seen"] for r in drawn])

    @F.pandas_udf("array<boolean>")
    def accepted(code: pd.Series, features: pd.Series) -> pd.Series:
        out = []
        for c, f in zip(code, features, strict=True):
            out.append((span_scores(beta, np.asarray(c, np.int64), list(f)) >= threshold).tolist() if len(c) else [])
        return pd.Series(out, dtype="object")

    rows = rows.withColumn("yes", F.when(F.size("extra") > 0, accepted("extra.code", "extra.seen")))
    chosen = F.expr("filter(transform(extra, (e, i) -> if(yes[i], named_struct('kind', e.kind, 'start', e.start, 'end', e.end), null)), e -> e is not null)")
    names = F.array(*[F.lit(n) for n in NAMES])
    added = F.array_join(F.transform(F.array_sort(chosen), lambda e: F.concat(F.element_at(names, e["kind"] + 1), F.lit(":"), e["start"], F.lit(":"), e["end"])), ",")
    out = rows.withColumn("added", added)
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("added") != "", F.col("added")))
    return out.select(F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), both.alias("spans"), F.size(chosen).cast("long").alias("n_added"), (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.size(chosen)).cast("long").alias("n_spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
