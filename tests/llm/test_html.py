"""Main-text extraction: awkward pages, exact marginals, held-out labelled pages, and the articles of the given pages."""

import html
import math
import re
import time
from itertools import product

import pytest

pytest.importorskip("public_tokenizers")
from lumenfold.llm import html_extract, labelled_pages  # noqa: E402
from lumenfold.llm.dom import blocks, parse  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return html_extract.train(labelled_pages.pages(html_extract.TRAINING_PAGES))


def texts(page):
    return [text for _, text, _ in blocks(parse(page))]


@pytest.mark.parametrize("page, want", [
    ("<p>One <a title=it's>Hello</a> don't stop</p>", ["One Hello don't stop"]),
    ("<p t='x>a</p>b", ["a", "b"]), ("1 < 2 <3 &lt;b&gt; &#65;&amp;", ["1 < 2 <3 <b> A&"]), ("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;", ["�A"]),
    ("<p>a <math><mi>x</mi><br></math> b<svg/> c<svg><text>d</text><p>e", ["a x b cd", "e"]), ("a<noscript><p>b</p></noscript><object>c</object>", ["a", "b", "c"]),
    ("<xmp><b>&amp;</xmp><textarea><i>&amp;</textarea>", ["<b>&amp;", "<i>&"]), ("<script>x</script >a<style>b", ["a"]), ("<title>a<p>b", ["a", "b"]),
    ("<p>a<b>b</b> <i>c</i>\n d<br>e<wbr>f<!-- g -->h</p>", ["ab c d efh"]), ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("a <p x=1 y='2' \"z\" <q>b", ["a", "b"]), ("cut <a href='x", ["cut"]), ("", []), (" \n ", []),
])
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "<a " * 340_000, "<b><div>x</div>" * 30_000, "<title>" * 100_000, '<p t="x>a</p>' * 50_000, "<a" + " " * 1_000_000,
    "<" * 1_000_000, "<!--" * 200_000, "<p>" * 200_000, "&" * 1_000_000, "</b>" * 200_000, "<a='" * 200_000, "x" * 2_000_000,
])
def test_large_pages_take_linear_time(model, page):
    began = time.process_time()
    model.content(page)
    assert time.process_time() - began < 20


def test_marginals_equal_enumeration():
    parent, node, (alike, both) = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.7, 2.0, -0.4], (0.8, 0.5)
    weight = {}
    for y in product((0, 1), repeat=5):
        edges = sum(alike * (y[i] == y[p]) + both * y[i] * y[p] for i, p in enumerate(parent) if p >= 0)
        weight[y] = math.exp(sum(a * b for a, b in zip(node, y, strict=True)) + edges)
    total = sum(weight.values())
    out, equal, pair = html_extract.marginals(parent, node, (alike, both))
    for i, p in enumerate(parent):
        assert abs(out[i] - sum(w for y, w in weight.items() if y[i]) / total) < 1e-9
        if p >= 0:
            assert abs(equal[i] - sum(w for y, w in weight.items() if y[i] == y[p]) / total) < 1e-9
            assert abs(pair[i] - sum(w for y, w in weight.items() if y[i] and y[p]) / total) < 1e-9


def test_held_out_labelled_pages(model):
    right = n = 0
    for page in labelled_pages.pages(150, seed=99):
        dom = parse(page, labelled_pages.LABEL)
        tree = html_extract.tree_of(dom)
        p, _, _ = html_extract.marginals(tree.parent, model.odds(tree), model.edge)
        for text, q, y in zip(tree.text, p, html_extract._labels(dom, tree), strict=True):
            if text is not None:
                right, n = right + ((q >= html_extract.KEEP_FROM) == y), n + 1
    assert right / n > 0.97


ARTICLE = "<article><h1>A title here</h1><p>This is the text of an article, long enough to be one.</p>"


@pytest.mark.parametrize("page, want", [
    (f"<nav><a href=x>home</a></nav>{ARTICLE}<ul><li><a href=/a>first source</a><li><a href=/b>second one here</a></ul></article><footer>&copy; me</footer>",
     ["A title here", "This is the text of an article, long enough to be one.", "first source", "second one here"]),
    (f"{ARTICLE}<table><tr><td>x one<td><a href=x>some link</a></table></article>", ["A title here", "This is the text of an article, long enough to be one.", "x one", "some link"]),
    ("<body>Text right in the body of the page, which goes on for some time.</body>", ["Text right in the body of the page, which goes on for some time."]),
    ("Text without elements at all, which goes on for some time.", ["Text without elements at all, which goes on for some time."]),
    ("<body><nav><ul><li><a href=x>home</a></li><li><a href=x>about us</a></li></ul></nav>Text right in the body. <p>More text in a paragraph.</p> and more<footer>&copy; 2020 me</footer></body>",
     ["Text right in the body.", "More text in a paragraph.", "and more"]),
])
def test_link_lists_of_articles_and_bare_text(model, page, want):
    assert model.content(page) == want


def test_pages_with_unknown_class_names(model):
    """Held-out accuracy where no class name was seen in training."""
    right = n = 0
    for page in labelled_pages.pages(150, seed=77):
        page = re.sub(r'(class|id)="[^"]*"', r'\1="qx zv"', page)
        dom = parse(page, labelled_pages.LABEL)
        tree = html_extract.tree_of(dom)
        p, _, _ = html_extract.marginals(tree.parent, model.odds(tree), model.edge)
        pairs = [((q >= html_extract.KEEP_FROM) == y) for t, q, y in zip(tree.text, p, html_extract._labels(dom, tree), strict=True) if t is not None]
        right, n = right + sum(pairs), n + len(pairs)
    assert right / n > 0.85


def test_articles_of_the_given_pages(spark, model):
    """Brute force: these pages mark their article, whose blocks are paragraphs and headings."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    border = r"</?(?:p|h[1-6]|li|ul|ol|blockquote|pre|table|tr|td)(?:\s[^>]*)?>"
    for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet"), model).collect():
        article = re.search(r"<article[^>]*>(.*)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(border, article)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark, model):
    article = "<article><h1>A title of some words</h1><p>This is the text of an article, long enough to be one.</p></article>"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", article, "x", 1), (4, "u", article, "x", 1), (4, "u", article, "x", 1),
            (5, "u", "<nav><a href=x>home</a></nav>", "x", 1), (6, "u", "<div>" * 5000 + article, "x", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.extract(table, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r["page_id"] or 0, r["text"].count("\n\n"), r["n_chars"] > 0) for r in got.collect())
    assert found == [(0, 1, True), (1, 0, False), (2, 0, False), (4, 1, True), (4, 1, True), (5, 0, False), (6, 1, True)]
    assert html_extract.extract(table.limit(0), model).count() == 0
