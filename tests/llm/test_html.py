"""Cutting of pages into blocks on broken markup, and the extraction's edge cases."""

import pytest

from tessera.llm import html

MAIN = "<article><h1>News of the day in the town</h1><p>Something long happened in the town today, people said.</p></article>"


def texts(page):
    return [b[1] for b in html.blocks(page)]


@pytest.fixture(scope="module")
def model():
    return html.trained(150, 2)


def test_broken_markup():
    assert texts('<p>a <a href="x>b</a> tail</p>') == ["a"]
    assert texts("<p title=it's>a</p><p>it's b</p>") == ["a", "it's b"]
    assert texts('<p title="a>b">c</p>') == ["c"]
    assert texts("<p data-x='1' hidden>a</ >b</p><!x>c") == ["ab", "c"]
    assert texts("a < b and 1<2") == ["a < b and 1<2"]
    assert texts("<script>x</script><scripty>a</scripty>") == ["a"]
    assert texts("<p>a<!-- b") == ["a"]
    assert html.blocks('<div data-id="menu" id="main">a</div>')[0][0] == ("div", ".main")


def test_every_word_and_name_is_read():
    words = [f"w{i}" for i in range(500)]
    path = tuple(f"x{i}" for i in range(40))
    paths, hashed, n_paths, n_words, _ = html.page_input([(path, " ".join(words), 0.0)])
    assert list(n_words) == [500] and list(hashed) == [html._slot("w" + w) for w in words]
    assert list(n_paths) == [40] and list(paths) == [html._slot("p" + p) for p in path]


def test_edge_cases(spark, model):
    long = "<body>" + MAIN + "<p>x y z</p>" * 5000
    rows = [(1, "u", None, "t", 5), (2, None, "", "t", 5), (3, "u", MAIN, "t", 5), (3, "u", MAIN, "t", 5), (None, "u", long, "t", 5), (4, "u", "no markup at all", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = html.extract(pages, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(out.collect(), key=lambda r: (r.page_id or 0, r.text))
    assert len(got) == len(rows) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert [r.text for r in got if r.page_id == 3] == [got[-3].text] * 2 and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(pages.limit(0), model).count() == 0
