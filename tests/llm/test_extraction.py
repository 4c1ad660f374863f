"""Blocks, the random field and the main text of pages."""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from claimscope.llm import extraction as x

PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return x.trained(spark.read.parquet(PAGES))


def texts(page):
    return [b.text for b in x.leaf_blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        (" \n ", []),
        ("plain  text\n", ["plain text"]),
        ("<p>one<p>two</p>three", ["one", "two", "three"]),
        ("<p>a <b>bold</b>\n move &amp; &lt;x&gt; &eacute;&#233;&nbsp;&copy &unknown; &am</p>", ["a bold move & <x> éé © &unknown; &am"]),
        ("<p>line<br>break</p><hr>after", ["line break", "after"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("<script>var t='</p>';</script><style>p{}</style><title>t</title><!-- <p>no</p> --><p>yes", ["yes"]),
        ("<SCRIPT>never ended <p>x", []),
        ("<p>3 < 4 and 5 > 4</p>", ["3 < 4 and 5 > 4"]),
        ('<p title="a > b">quoted</p><a href="never ended>text</a><p>on</p>', ["quoted", "text", "on"]),
        ("<b><p>one</b> two</p></i></div>three", ["one two", "three"]),
        ("<h1>a</h2><p>b", ["a", "b"]),
        ("<div>outer <p>inner</p> rest</div>", ["outer", "inner", "rest"]),
        ("<!-- never ended <p>x", []),
        ("<p>\ud83d</p>".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), ["�"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_names_and_ancestors():
    block = x.leaf_blocks('<div class="siteFooter dark"><section id=Comments role="x"><p hidden>t')[0]
    assert block.tags == ("div", "section", "p")
    assert block.names == {"site", "footer", "dark", "comment", "x", "hidden"}
    assert block.near == ("hidden",)
    assert x.leaf_blocks("<p>a <a>link</a> b")[0].linked == 4


def random_field(size, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=size), rng.normal(size=2), rng.normal(size=(2, 2))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_sums_equal_those_over_all_labelings(size):
    scores, start, steps = random_field(size, size)
    weight = {}
    for labels in itertools.product((0, 1), repeat=size):
        total = start[labels[0]] + sum(s for s, y in zip(scores, labels) if y)
        weight[labels] = np.exp(total + sum(steps[a][b] for a, b in itertools.pairwise(labels)))
    z = sum(weight.values())
    # One page of this length, and a shorter one that is padded.
    mask = np.array([[True] * size, [True] + [False] * (size - 1)])
    both = np.stack([scores, np.r_[scores[:1], np.zeros(size - 1)]])
    whole, main, first, pairs = x._sums(both, mask, start, steps)
    one = np.exp(start + np.array([0, scores[0]]))
    assert np.isclose(whole, np.log(z) + np.log(one.sum()))
    assert np.allclose(main[0], [sum(w for y, w in weight.items() if y[t]) / z for t in range(size)])
    assert np.allclose(main[1], np.r_[one[1] / one.sum(), np.zeros(size - 1)])
    want = [[sum(w * sum(p == (a, b) for p in itertools.pairwise(y)) for y, w in weight.items()) / z for b in (0, 1)] for a in (0, 1)]
    assert np.allclose(pairs, want) and np.isclose(first[1], main[:, 0].sum())


def test_decoding_equals_the_best_of_all_labelings():
    for seed in range(40):
        size = seed % 7 + 1
        blocks = [x.Block(("p",), frozenset({f"n{k}"}), (), "text", 0) for k in range(size)]
        scores, start, steps = random_field(size, seed)
        model = x.Model({f"name n{k}": s for k, s in enumerate(scores)}, tuple(start), tuple(map(tuple, steps)))
        best = max(
            itertools.product((0, 1), repeat=size),
            key=lambda y: start[y[0]] + sum(s for s, v in zip(scores, y) if v) + sum(steps[a][b] for a, b in itertools.pairwise(y)),
        )
        assert model.decode(blocks) == [bool(v) for v in best]


def test_held_out_layouts(spark, model):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id >= 100").collect()]
    right = blocks = 0
    for some, labels in x.labelled_pages(pages, layouts=300, seed=77):
        got = model.decode(some)
        right += sum(a == b for a, b in zip(got, labels))
        blocks += len(labels)
    assert right >= 0.98 * blocks


def test_pages_of_the_table(spark, model):
    """All have one layout; the article's text, found by patterns instead."""
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert x.main_text(row["html"], model) == "\n".join(p for p in want if p)


PROSE = "This is what the article says, and it says it at some length. It goes on for a while."
WHOLE = f"""<html><body><div id="header"><h1>The Site</h1><p>Its motto is here.</p></div><div class="menu"><a href="/">Home</a> <a href="/a">About</a></div>
<div class="cookie-banner"><p>{PROSE}</p><button>Accept</button></div><div class="layout"><div class="post-content"><h1>A title</h1><p>{PROSE}</p>
<div class="advertisement"><p>{PROSE}</p></div><p>Second &amp; last: {PROSE}</p><ul><li>first item of it</li><li>second item of it</li></ul></div>
<aside class="sidebar"><p>{PROSE}</p></aside><form class="login"><label>Name</label><p>{PROSE}</p></form>
<div id="comments"><div class="comment"><p>{PROSE}</p></div><div class="comment"><p>Me too, {PROSE}</p></div></div></div>
<div class="footer"><p>&copy; {PROSE}</p></div></body></html>"""


def test_a_page_with_every_kind_of_boilerplate(model):
    want = ["A title", PROSE, f"Second & last: {PROSE}", "first item of it", "second item of it"]
    assert x.main_text(WHOLE, model) == "\n".join(want)


def test_table_edges(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars string, `_row` string"
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "t", "n", "r"), (None, None, "", "t", "n", "r"), (3, "u", long, None, None, None), (4, "u", WHOLE, "t", "n", "r"), (4, "u", WHOLE, "t", "n", "r"), (5, "u", "<nav><a>x</a></nav>", "", "", "")]
    out = x.extract(spark.createDataFrame(rows, schema), model=model)
    assert out.columns == ["page_id", "url", "row_text", "row_n_chars", "_row", "text", "n_chars"]
    got = out.collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[1] == by_id[None] == by_id[5] == "" and by_id[3] == "\n".join([PROSE] * 20_000)
    assert x.extract(spark.createDataFrame([], schema)).collect() == []
    assert x.extract(spark.createDataFrame([(WHOLE,), (None,)], "html string")).count() == 2
