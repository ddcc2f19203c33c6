from __future__ import annotations

import numpy as np
import pytest
from helpers import with_clashes
from pagetide.llm import mainpage

PAGES = "page_id long, url string, html string"
TEXTS = ["The river was high in spring.", "Nobody came to the old mill any more.", "Die Tür stand offen, und er ging.",
         "Three boats lay on the sand near the pier.", "She had read the letter twice before noon."]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return mainpage.train_field([mainpage.fill_layout(layout, TEXTS, rng) for layout in mainpage.LAYOUTS for _ in range(6)])


def test_held_out_pages(model):
    rng = np.random.default_rng(2)
    right = total = 0
    for layout in mainpage.LAYOUTS:
        for _ in range(4):
            blocks, states = mainpage.fill_layout(layout, TEXTS, rng)
            found = model.decode(blocks)
            right += sum(a == b for a, b in zip(states, found))
            total += len(states)
    assert right / total > 0.97


def test_layout_never_seen(model):
    page = ("<html><head><title>No</title><style>p{}</style></head><body><div class='topnav'><a>Home</a> <a>News</a></div>"
            "<div class='article-content'><h1>A title &amp; more</h1><p>First paragraph of the text, with some <b>bold</b> words in it."
            "<p>Second   paragraph\n with an <a href='x'>inner link</a> and enough words to look like prose.</div>"
            "<div class='sidebar-widget'><ul><li><a>One</a><li><a>Two</a></ul></div><script>var a='<p>no</p>';</script>"
            "<div class='comments-area'><p>I liked this very much, thanks.</p></div><footer>&copy; 2024 X</footer></body></html>")
    assert mainpage.main_text(page, model) == (
        "A title & more\n\nFirst paragraph of the text, with some bold words in it.\n\n"
        "Second paragraph with an inner link and enough words to look like prose.")


def test_viterbi_is_the_best_sequence(model):
    import itertools

    blocks = mainpage.leaf_blocks("<nav><a>x</a></nav><p>Some words here.</p><h1>T</h1><p>More words here, and more.</p><p>© y</p>")
    scores = model.scores(blocks)
    value = lambda s: sum(scores[i, v] for i, v in enumerate(s)) + sum(model.follow[a, b] for a, b in zip(s, s[1:]))
    best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
    assert value(best) == pytest.approx(value(model.decode(blocks)))


def test_odd_pages(spark, model):
    long_one = "<article>" + "<p>Words go on and on here.</p>" * 5000
    data = [(1, None, None), (2, "u", ""), (3, "u", "   "), (4, "u", "<<<>< <p"), (5, "u", "plain words only"), (None, "u", "</p></div><b>"),
            (6, "u", long_one), (7, "u", "<p>same page text, twice.</p>"), (7, "u", "<p>same page text, twice.</p>"), (8, "u", "<!-- <p>x</p>"),
            (9, "u", "<script>never closed <p>x"), (10, "u", "<div " * 3000), (11, "u", "<div>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in mainpage.extract(with_clashes(spark.createDataFrame(data, PAGES)), model).collect()}
    assert got[1]["text"] == got[2]["text"] == got[3]["text"] == got[8]["text"] == "" and got[1]["n_chars"] == 0
    assert got[6]["text"].count("Words go on") == 5000 and got[6]["n_chars"] == len(got[6]["text"])
    assert mainpage.extract(spark.createDataFrame([], PAGES), model).count() == 0


def test_given_pages(spark, sf_dir):
    """Title and paragraphs of the article element, for the layout that the given pages have."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in mainpage.extract(pages, mainpage.train(pages)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?(?:b|i|a)\b[^>]*>", "", inner.replace("<br>", " ")))
        assert got[r["page_id"]] == "\n\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


OPEN_LISTS = {
    "li": "<ul>" + "<li><p>entry {}".join([""] * 5001) + "</ul>",
    "dd": "<dl>" + "<dt><p>term {}<dd><div>told".join([""] * 5001) + "</dl>",
    "tr": "<table>" + "<tr><td>cell {}<td><div>more".join([""] * 5001) + "</table>",
    "tbody": "<table>" + "<tbody><tr><th>cell {}".join([""] * 5001) + "</table>",
    "p": "<div>" + ("<p>" + "<b>" * 20 + "entry").join([""] * 5001) + "</div>",
    "h4": "<ul>" + "<li><h4>entry {}".join([""] * 5001) + "</ul>",
    "section": "<section>entry" * 5000,
}


@pytest.mark.parametrize("kind", OPEN_LISTS)
def test_omitted_end_tags(model, kind):
    """Elements without end tags leave nothing open beyond the element around them."""
    prose = [f"{t} And there is more to say about it, in as many words." for t in TEXTS]
    paragraphs = "".join(f"<p>{t}</p>" for t in prose)
    blocks = mainpage.leaf_blocks(f"<html><body><nav class='menu'>{OPEN_LISTS[kind]}</nav><article><h1>A title</h1>{paragraphs}"
                                  f"</article><div class='comments'><p>I liked it, thanks.</p></div></body></html>")
    at = [b.text for b in blocks].index("A title")
    assert at >= 5000 and all("nav" in b.tags for b in blocks[:at])
    assert [b.text for b in blocks[at:]] == ["A title", *prose, "I liked it, thanks."]
    assert all(set(b.tags) == {"html", "body", "article", "h1" if b is blocks[at] else "p"} and not b.roles for b in blocks[at:-1])
    assert set(blocks[-1].tags) == {"html", "body", "div", "p"} and blocks[-1].roles == {"comments"}
    states = model.decode(blocks)
    assert not any(states[:at]) and all(states[at:-1]) and not states[-1]


def test_items_end_where_html_ends_them():
    """An item ends the open one of its own list, row or table only."""
    def tags(page):
        return [sorted(set(b.tags)) for b in mainpage.leaf_blocks(page)]

    assert tags("<ul><li><p>a<ul><li>b<li>c</ul>d<li>e</ul>f") == [
        ["li", "p", "ul"], ["li", "ul"], ["li", "ul"], ["li", "ul"], ["li", "ul"], []]
    assert tags("<table><tr><td><table><tr><td>a<tr><th>b</table>c<td>d<tr><td>e<tfoot><tr><td>f</table>g") == [
        ["table", "td", "tr"], ["table", "td", "th", "tr"], ["table", "td", "tr"], ["table", "td", "tr"],
        ["table", "td", "tr"], ["table", "td", "tfoot", "tr"], []]
    assert tags("<ul><li><section><p>a<li>b</section><li>c</ul>") == [["li", "p", "section", "ul"], ["li", "section", "ul"], ["li", "ul"]]
    assert tags("<select><optgroup><option>a<option>b<optgroup><option>c</select>d") == [
        ["optgroup", "option", "select"]] * 3 + [[]]
    assert [b.text for b in mainpage.leaf_blocks("<ul><li>a<p>b<video><p>no<li>no</video>c<svg><text><p>no</svg><li>d</ul>")] == [
        "a", "b", "c", "d"]


def test_digits_of_the_whole_block():
    """A block is judged by all of its text, not by how it begins."""
    prose, figures = "Words without any figures. " * 40, "1234 5678 " * 40
    found = mainpage.block_features(mainpage.leaf_blocks(f"<p>{figures[:200]}{prose}</p><p>{prose[:260]}{figures * 3}</p>"))
    assert ["digits" in f for f in found] == [False, True]
