"""HTML extraction on pages with known main text."""

import html
import re

import pytest

from rollbook.llm import html_crf as H
from rollbook.session import read_table


@pytest.fixture(scope="module")
def field(spark, small):
    return H.fit_field(read_table(spark, small, "pages"))


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site name</h1></header>"
    "<nav><a href=x>Home</a> <a href=y>About</a></nav>"
    '<div class="cookie-banner">We use cookies to improve. Accept</div>'
    '<script>var a = "</p><p>not text</p>";</script>'
    "<main><h1>Title &lt;here&gt;</h1><p>First &amp; para&nbsp;one,\n   with&#32;words.</p>"
    '<div class="ad-slot">Buy now the best things in the world today.</div><p>Second <i>para</i>graph.<br>New line</p></main>'
    '<aside class="sidebar"><p>Some other stories that you may like to read today in the paper.</p></aside>'
    '<section id="comments"><h2>3 comments</h2><div class="comment"><p>I think this is a great article, thanks.</p></div></section>'
    "<form><label>Name</label><textarea>foo</textarea></form><footer><p>All rights</p></footer></body></html>"
)


def test_surroundings_are_left_out(field):
    assert H.main_text(PAGE, field, {}) == "Title <here> First & para one, with words. Second paragraph. New line"


def test_new_layouts(field):
    layout = H.Layout(["A sentence of some words that ends here.", "Short one.", "Another, longer sentence; it goes on and on."], seed=9)
    pairs = [layout.page() for _ in range(150)]
    wrong = sum(a != b for blocks, labels in pairs for a, b in zip(field.labels(blocks, {}), labels, strict=True))
    assert wrong <= 0.01 * sum(len(labels) for _, labels in pairs)


def test_given_pages(spark, small, field):
    pages = read_table(spark, small, "pages")
    got = {r["page_id"]: r for r in H.extract(pages, field).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        text = re.sub(r"<[^>]+>", "", re.sub(r"</?(h1|p|br)>", " ", body))
        want = " ".join(html.unescape(text).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_viterbi_and_gradient_by_brute_force(field):
    import itertools

    blocks = H.blocks_of(PAGE)[:7]
    known: dict = {}

    def total(labels):
        out = float(field.start[labels[0]]) + float(field.end[labels[-1]])
        for k, (block, label) in enumerate(zip(blocks, labels, strict=True)):
            out += field._sum(H.path_features(block.path))[label] + field._sum(H.text_features(block, k, len(blocks)))[label]
            out += float(field.step[labels[k - 1], label]) if k else 0
        return out

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
    assert field.labels(blocks, known) == list(best)


def test_odd_pages(spark, field):
    rows = [
        (1, "u", None, "x"),
        (2, None, "", "x"),
        (3, "u", "plain text without tags", "x"),
        (4, "u", "<p>open <b>tags <article><p>in an article & more", "x"),
        (5, "u", "<!-- never closed <p>x</p>", "x"),
        (6, "u", "<article><p>" + "word " * 200_000 + "</p></article>", "x"),
        (6, "u", '<article><p title="unclosed>text</p></article>', "x"),
        (None, "u", "<main><p>No id, but a page with a text.</p></main>", "x"),
        (8, "u", "<ul><li>" * 3000, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages, field).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] != 6}
    assert by[1] == by[2] == by[5] == by[8] == "" and by[None] == "No id, but a page with a text."
    assert max(r["n_chars"] for r in got) == 999_999
    assert H.extract(pages.limit(0)).count() == 0


def test_formulas_xmp_and_long_blocks_are_text():
    page = "<p>The area is <math><mi>E</mi><mo>=</mo><mn>5</mn><annotation>x</annotation></math> here.</p><xmp>a &amp; <b></xmp>"
    assert [b.text for b in H.blocks_of(page)] == ["The area is E=5 here.", "a &amp; <b>"]
    middle = "word " * 200 + "all rights reserved " + "word " * 200
    found = H.text_features(H.Block(middle.strip(), (), 0), 0, 1)
    assert ("phrase True" in found) == bool(H.PHRASES.search(middle))
