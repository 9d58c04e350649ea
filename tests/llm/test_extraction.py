"""Main text: the parser against stated trees, the decoding against brute force, the model on layouts it hasn't seen."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from sparkgrade.llm import extraction
from sparkgrade.llm.boosting import BoostedTrees
from sparkgrade.llm.dom import Nodes
from sparkgrade.llm.extraction import MAIN, Batch

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "page_id long, url string, html string, text string, n_chars int, label string"


def blocks(page):
    nodes = Nodes()
    nodes.add(0, page)
    return list(zip((nodes.tags[n] for n in nodes.block_nodes), nodes.block_texts, strict=True))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain  text", [("#root", "plain text")]),
        ("<p>a <b>b</b>\n c<p>d", [("p", "a b c"), ("p", "d")]),
        ("<p><b>one<br><p>two</b> three</p>", [("p", "one"), ("p", "two three")]),
        ("a<br>b<hr>c", [("#root", "a b"), ("#root", "c")]),
        ("<div>x<div>y</div>z</div>w", [("div", "x"), ("div", "y"), ("div", "z"), ("#root", "w")]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
        ("<table><tr><td>1<td>2<tr><th>3</table>4", [("td", "1"), ("td", "2"), ("th", "3"), ("#root", "4")]),
        ("<dl><dt>k<dd>v<dt>l</dl>", [("dt", "k"), ("dd", "v"), ("dt", "l")]),
        ("&lt;p&gt; &amp;amp; &eacute;&#233;&#x4e2d; &copy &unknown; &am", [("#root", "<p> &amp; éé中 © &unknown; &am")]),
        ("a<!-- <p>no</p> -->b<!-->c<!--->d<!-- open", [("#root", "abcd")]),
        ("<script>var t='</p><p>x';</script>y<STYLE>p{}</sTyle >z<script>open", [("#root", "yz")]),
        ("<head><title>t</title><p>no</head><body>yes", [("body", "yes")]),
        ("<head><title>t</title><body>yes", [("body", "yes")]),
        ("<object>a<object>b</object>c</object>d", [("#root", "d")]),
        ('<p title="a>b" class=\'x\'>c</p></p></b></ >d', [("p", "c"), ("#root", "d")]),
        ("1 < 2 <3 <p", [("#root", "1 < 2 <3")]),
        ("<h1>a<h2>b</h2>", [("h1", "a"), ("h2", "b")]),
        ("<a href=x>l<div>m</div></a>n", [("#root", "l"), ("div", "m"), ("#root", "n")]),
        ("<p>a  b\tc</p>", [("p", "a b c")]),
        ("<!DOCTYPE html><?xml a?><![CDATA[x]]>y", [("#root", "y")]),
    ],
)
def test_blocks(page, want):
    assert blocks(page) == want


def test_deep_and_long_pages_end():
    assert blocks("<div>" * 30_000 + "x" + "</div>" * 30_000) == [("div", "x")]
    assert len(blocks("<p>" + "<b>a" * 30_000)) == 1
    assert len(blocks("<li>a" * 30_000)) == 30_000
    assert blocks("<" * 50_000 + "&" * 50_000)[0][1] == "<" * 50_000 + "&" * 50_000
    assert blocks('<a "' * 10_000 + ">x")


def legal(states, parents):
    return all(p < 0 or s >= states[p] for s, p in zip(states, parents, strict=True))


def test_decoding_is_the_best_legal_labelling():
    draw = random.Random(2)
    for _ in range(30):
        page = ""
        for _ in range(draw.randint(1, 4)):
            page += draw.choice(("<div><p>a</p>b</div>", "<section><div><p>a</p></div><p>c</p></section>", "<p>d</p>", "<div></div>"))
        batch = Batch([page, "<p>other page</p>"])
        scores = np.random.default_rng(draw.randint(0, 999)).normal(size=(len(batch.page), 3))
        own = batch.page == 0
        weight = batch.upwards(np.bincount(batch.block_node, minlength=len(batch.page))) > 0
        states, parents = batch.decoded(scores)[own], batch.parent[own]
        if len(parents) > 9:
            continue
        worth = lambda s: sum(scores[i, x] for i, x in enumerate(s) if weight[i])
        assert legal(states, parents)
        assert worth(states) == pytest.approx(max(worth(s) for s in itertools.product(range(3), repeat=len(parents)) if legal(s, parents)))


def test_trees_learn_what_no_single_split_tells():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int) + (x[:, 2] > 1)
    model = BoostedTrees(x[:1500], y[:1500], 3)
    p = np.exp(model.log_probabilities(x[1500:]))
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y[1500:]).mean() > 0.93
    assert BoostedTrees(x[:0], y[:0], 3).log_probabilities(x[:2]).shape == (2, 3)


@pytest.fixture(scope="module")
def given():
    return [r[0] for r in duckdb.sql(f"SELECT html FROM '{FOLDER}/pages.parquet' ORDER BY page_id").fetchall()]


@pytest.fixture(scope="module")
def model(given):
    return extraction.fitted(given[:150])


def test_unseen_layouts(given, model):
    """Held-out pages in layouts drawn anew: nearly every block is kept or left rightly."""
    batch = Batch(extraction.training_pages(given[1000:1100]))
    got, want = (s[batch.block_node] == MAIN for s in (batch.decoded(model.log_probabilities(batch.features())), batch.marked()))
    assert (got & want).sum() / want.sum() > 0.98 and (got & want).sum() / got.sum() > 0.98


def test_a_page_of_another_site(model):
    side = '<div id="sidebar"><h3>Popular</h3><ul><li><a href="/a">One thing</a></li><li><a href="/b">Another thing</a></li></ul></div>'
    main = "<div class='post-content'><h1>The title &amp; more</h1><p>The first paragraph is long enough to be read, and it has commas, too.</p><div class='ad'>Buy this now.</div><p>Second\n paragraph, with <a href=x>a link</a> in it.</p><ul><li>an item</li><li>the next item</li></ul></div>"
    after = "<section id='comments'><h3>2 comments</h3><div class='comment'><p>I liked that very much, thank you for it.</p></div><div class='comment'><p>Me too, though not the end.</p></div></section><form class='newsletter'><label>Your name</label></form>"
    page = f"<html><head><title>x</title></head><body><div class='cookie-notice'>We use cookies here.</div><div class='masthead'><a href='/'>My site</a></div><div class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/c'>Contact</a></li></ul></div><div class='container'>{main}{side}</div>{after}<div class='footer'>&copy; 2020 My site</div></body></html>"
    assert extraction.texts_of([page], model) == ["The title & more\n\nThe first paragraph is long enough to be read, and it has commas, too.\n\nSecond paragraph, with a link in it.\n\nan item\n\nthe next item"]


def test_rows(spark, given, model):
    long = given[0].replace("</article>", "<p>" + "more words here. " * 60_000 + "</p></article>")
    rows = [(1, "u", given[0]), (1, "u", given[0]), (None, None, given[1]), (2, "v", None), (3, None, ""), (4, "w", " \n "), (5, "x", "<div></div>"), (6, "y", long)]
    got = extraction.extract(spark.createDataFrame([(*r, "t", 1, "l") for r in rows], SCHEMA).repartition(3), model).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == "" and by[i].n_chars == 0 for i in (2, 3, 4, 5))
    assert by[1].text and by[6].text.startswith(by[1].text) and by[6].text.endswith("more words here.") and by[6].n_chars > 1_000_000
    assert all(r.n_chars == len(r.text) for r in got)


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert extraction.extract(none, extraction.trained(none)).collect() == []
    assert extraction.texts_of([], extraction.fitted([])) == []
