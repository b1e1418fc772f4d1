"""The pipeline's stages in order on the smallest tables: columns, effects and the packed rows."""

from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for i, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on a small table with nulls, empties, copies, near copies, repeated passages, leaks and other columns."""
    import random
    import re

    import corpus_pipeline as p
    from tessera.llm import quality
    from tests.llm.test_decontam import least_distance
    from tests.llm.test_llm import expected_components, expected_line_dedup, words

    r = random.Random(12)
    base = [words(r, r.randint(60, 200)) for _ in range(30)]
    passage = "\n".join([words(r, 40), words(r, 20), words(r, 5)])
    items = [(k, words(r, 20), "x") for k in range(4)]
    near = [" ".join(w if r.random() > 0.02 else "changed" for w in base[0].split()) for _ in range(8)]
    texts = [*base, base[1], base[1], *near, *[words(r, 60) + "\n" + passage + "\n" + words(r, 60) for _ in range(5)], *[words(r, 70) + " " + i[1].upper() + " " + words(r, 70) for i in items], None, "", "short text"]
    rows = [(i, t, "en", "s", len(t or ""), "other") for i, t in enumerate(texts)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, more string").write.parquet(f"{at}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in p.STAGES:
        before = {x.doc_id: x.text for x in docs.collect()}
        verdict = {x.doc_id: x.kept for x in quality.score(docs).collect()} if name == "quality_rules" else {}
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if name == "best_fit_packing":
            break
        after = {x.doc_id: x.text for x in docs.collect()}
        assert docs.columns == p.COLUMNS
        if name == "quality_rules":
            assert after == {i: t for i, t in before.items() if verdict[i]} and 20 < len(after) < len(before)
            # The bands of so small a table drop copies; the other stages get them back.
            docs = spark.read.parquet(f"{at}/documents.parquet").filter("text is not null").select(p.COLUMNS)
        elif name == "line_dedup":
            assert after == expected_line_dedup(before.items()) and after != before
            assert all(x.n_chars == len(x.text) for x in docs.collect())
        elif name == "ngram_jaccard_join":
            assert after == {i: before[i] for i, _, c in expected_components(list(before.items())) if i == c} and len(after) < len(before)
        else:
            leaks = {i for i, t in before.items() for _, item, _ in items if least_distance(item, re.sub(r"\s+", " ", t.lower())) <= int(len(item) * 0.07)}
            assert leaks and after == {i: t for i, t in before.items() if i not in leaks}
        seen[name] = after
    assert {x.doc_id for x in docs.collect()} == set(seen["benchmark_decontamination"])
