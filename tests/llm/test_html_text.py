"""Extraction by minimum cut: what the cut decides, pages made to be slow, reading errors."""

import time

import pytest

pytest.importorskip("tintlake.llm")

from tintlake.llm import html_text  # noqa: E402

PAGES = "/root/testdata/sf0.01/pages.parquet"


def brute_text(page):
    """The cheapest labelling of all, of equal ones that with most boilerplate."""
    blocks = html_text.split_blocks(page or "")
    lean, edges = html_text.costs(blocks), html_text.smoothness(blocks)
    best = None
    for m in range(1 << len(blocks)):
        label = [bool(m >> i & 1) for i in range(len(blocks))]
        cost = sum(abs(x) for x, y in zip(lean, label) if (x > 0) != y) + sum(w for i, j, w in edges if label[i] != label[j])
        key = (round(cost, 9), sum(label))
        if best is None or key < best[0]:
            best = (key, label)
    return " ".join(b.text for b, keep in zip(blocks, best[1]) if keep)


def test_query_equals_enumeration_and_the_cut_changes_labels(spark):
    pages = spark.read.parquet(PAGES)
    want = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(want)
    changed = 0
    for i, page in want.items():
        assert got[i].n_chars == len(got[i].text)
        blocks = html_text.split_blocks(page)
        lean = html_text.costs(blocks)
        label = html_text.cut(lean, html_text.smoothness(blocks))
        changed += sum((x > 0) != y for x, y in zip(lean, label))
        if len(blocks) <= 12:
            assert got[i].text == brute_text(page)
    assert changed >= 20


def test_one_name_does_not_outweigh_the_rest():
    page = '<article><h1>Title</h1><p>The first paragraph of it.</p><p data-id="share">A second one.</p><p class="related-work">Related work was done.</p><p id="search">Search is hard.</p><p class="ad">Buy now</p><div class="share">Tweet</div><p>Last words.</p></article>'
    assert html_text.main_text(page) == "Title The first paragraph of it. A second one. Related work was done. Search is hard. Last words."
    assert html_text.main_text('<article title="x id=share class=ad"><p>Text, and more text.</p></article>') == "Text, and more text."


def test_letters_that_grow_when_lowered():
    page = "<p>" + "İ" * 60 + "</p><script>var a = '<p>no</p>'</SCRIPT ><article><p>Opening of the article.</p><p>And more of it.</p></article>"
    assert html_text.main_text(page).endswith("Opening of the article. And more of it.") and "var a" not in html_text.main_text(page)


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 170_000, "<p a=\"'>y" * 110_000, "<p a='>y" * 125_000, "<p " * 330_000, "<!" * 500_000, "<li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000, "<div>" * 100_000 + "</x>" * 100_000, "<p>" + "<b>" * 300_000 + "<div>" * 20_000],
    ids=["nested", "both quotes", "one quote", "open tags", "declarations", "list items", "end tags", "inline"],
)
def test_a_megabyte_made_to_be_slow(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 15  # quadratic reading took an hour


def test_reading_errors_lose_no_text():
    assert html_text.main_text('<article><p title="never closed>First words here.</p><p>Second words here.</p></article>') == "First words here. Second words here."
    assert html_text.main_text("<article><p>One is here.<li>Two is here.<li>Three is here.<p") == "One is here. Two is here. Three is here."
    assert html_text.main_text("<article><table><tr><td>a cell of text.<td>another cell.<tr><td>a third cell.</table></article>") == "a cell of text. another cell. a third cell."


def test_clashing_columns_and_ties(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b.</p></article>", 7), (1, "u", "<article><p>a b.</p></article>", 8), (None, None, None, 9)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, html_text.extract(pages).collect()), key=str) == sorted([(1, "u", "a b.", 4), (1, "u", "a b.", 4), (None, None, "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).collect() == []
    assert html_text.cut([0.0, 0.0], [(0, 1, 1.0)]) == [False, False]
