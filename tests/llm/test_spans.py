"""Secrets by ownership and personal data by weak supervision, held against brute force and simulated votes."""

import random
import re

import numpy as np

from tessera.llm import pii, secrets

SCHEMA = "doc_id long, text string, lang string, source string, spans string"


def generic(t):
    """Spans of generic candidates that touch no base span."""
    base = [m.span() for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    base += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [m.span() for m in re.finditer("[0-9a-f]{32,}", t)]
    found = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", t) if len(set(m[0])) >= 10 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return [s for s in found if not any(a < s[1] and s[0] < b for a, b in base)]


def test_ownership_against_brute_force(spark):
    r = random.Random(8)
    keys = ["".join(r.choice("ABCDEFGHJKabcdefghjk23456789") for _ in range(r.randint(20, 30))) for _ in range(12)]
    rows = []
    for i in range(120):
        k = r.choice(keys[: 1 + i // 8])
        rows.append((i, r.choice(["see {} now", "é😀 {} password={} {}", "token: abcdefgh1 {}"]).format(*[k] * 3), r.choice(["en", "de", None]), f"s{r.randrange(1 + keys.index(k))}", "x"))
    rows += [(900, None, "en", None, "x"), (901, "", None, None, "x"), rows[0]]
    owners, repos = {}, {}
    for _, t, lang, source, _ in rows:
        for a, b in generic(t or ""):
            owners.setdefault(t[a:b], set()).add(source or "")
            repos.setdefault(t[a:b], set()).add((source or "", lang or ""))
    out = secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {x[0]: x[1] or "" for x in rows}
    live = 0
    assert len(out) == len(rows)
    for x in out:
        t = text[x.doc_id]
        want = {f"live:{a}:{b}" for a, b in generic(t) if len(owners[t[a:b]]) <= 2 and len(repos[t[a:b]]) <= 4}
        got = {s for s in x.spans.split(",") if s.startswith("live")}
        assert got == want
        live += len(got)
    assert 0 < live < sum(len(generic(t)) for t in text.values())


def test_many_repositories_of_one_owner_are_an_example(spark):
    key = "k9Zx8Wv7Uu6Tt5Ss4Rr3Qq2"
    rows = [(i, f"see {key}A1" if i < 6 else f"own {key}B2", f"l{i}", "one", "x") for i in range(8)]
    got = {x.doc_id: (x.n_live, x.n_example) for x in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: (0, 1) for i in range(6)}, 6: (1, 0), 7: (1, 0)}


def test_reliabilities_recover_simulated_labelers():
    rng = np.random.default_rng(5)
    truth = rng.random(40_000) < 0.4
    right = (0.95, 0.8, 0.9, 0.65)
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < p) == truth, 1, 2)) for p in right], 1)
    code = votes @ np.array([27, 9, 3, 1])
    codes, counts = np.unique(code, return_counts=True)
    theta, post = pii.reliabilities(codes, counts.astype(float))
    for j, p in enumerate(right):
        assert abs(theta[1, j, 1] / (theta[1, j, 1] + theta[1, j, 2]) - p) < 0.04
        assert abs(theta[0, j, 2] / (theta[0, j, 1] + theta[0, j, 2]) - p) < 0.04
    said = dict(zip(codes, post > 0.5, strict=True))
    assert np.mean([said[c] == y for c, y in zip(code, truth, strict=True)]) > 0.85


def test_classifier_reads_the_span():
    """Candidates with one vote pattern and two kinds of context: the classifier tells them apart by what it reads."""
    good = [pii.seen(f"call me at 030 5551 {i:04d} tonight", "local_phone", 11, 24) for i in range(200)]
    bad = [pii.seen(f"part no {i:04d} 5551 2345 in stock", "local_phone", 8, 22) for i in range(200)]
    beta = pii.span_classifier(np.zeros(400, np.int64), np.r_[np.full(200, 0.9), np.full(200, 0.1)], good + bad)
    held = pii.span_scores(beta, np.zeros(2, np.int64), [pii.seen("call me at 030 5551 9999 tonight", "local_phone", 11, 24), pii.seen("part no 0999 5551 2345 in stock", "local_phone", 8, 22)])
    assert held[0] > 0.75 and held[1] < 0.25


def test_names_by_gazetteer_or_title(spark):
    texts = ["contact Dr. Zyxw Quorn soon", "dear Anna Miller hello", "the Big House stands", None, ""] * 6
    out = pii.scan(spark.createDataFrame([(i, t, None, None, "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(out) == 30 and all(x.n_spans == (x.doc_id % 5 == 1) or x.doc_id % 5 == 0 for x in out)
