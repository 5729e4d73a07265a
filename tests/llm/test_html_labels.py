"""Main text against pages labelled by hand: `+` marks a block of the article, `-` one of the rest."""

import re
import time

import pyarrow.parquet as pq
import pytest

from rolefit.llm import html_text as T

PAGES = [
    """<html><head><title>- River levels fall</title></head><body><nav><a href="/">- Home</a> <a href="/n">News</a> <a href="/c">Contact</a></nav>
    <article><header><h1>+ River levels fall again in the valley</h1></header><p>+ The river fell by another four centimetres on Monday, the third week of decline in a row, the water office said.</p>
    <p>+ Farmers along the lower bank have been asked to draw less water until the first heavy rain of the autumn has come.</p></article><footer>- © 2024 Valley Herald. All rights reserved.</footer></body></html>""",
    """<body><div class="menu"><a href="/">- Home</a> | <a href="/news">News</a> | <a href="/about">About us</a> | <a href="/mail">Contact</a></div>
    <div class="content"><h1>+ How to keep bread fresh</h1><p>+ Bread dries out because its starch slowly takes on a firmer form, not only because the water leaves it.</p><p>+ Keep it in a cloth bag at room temperature, and never in the fridge, where the change goes fastest of all.</p>
    <p>+ Freezing works.</p><p>+ Cut the loaf into slices first, so that each can be taken out and toasted as it is, without thawing the rest of it.</p></div><div class="footer">- © Bakers' Guild</div></body>""",
    """<body><header><p>- The Daily Lens</p></header><nav><ul><li><a href="/w">- World</a></li><li><a href="/s">- Sport</a></li><li><a href="/a">- Arts</a></li></ul></nav>
    <main><h1>+ A museum opens its cellar</h1><p>+ For the first time in forty years visitors may walk through the vaults below the old museum, where thousands of casts are kept.</p>
    <h2>+ What is shown</h2><p>+ The tour begins with the casts of temple friezes, goes on to a room of weights and measures and ends in the former coal store.</p><ul><li>+ Plaster casts of the eastern frieze</li><li>+ Weights from the harbour market</li></ul>
    <p>+ Tickets are sold at the side door only, and groups of more than ten people have to call the day before they come.</p></main>
    <aside><ul><li><a href="/1">- Ten parks to see in spring</a></li><li><a href="/2">- Why trams are coming back</a></li><li><a href="/3">- A walk along the wall</a></li></ul></aside><footer><p>- © The Daily Lens. Imprint and privacy.</p></footer></body>""",
    """<body><div class="cookie notice"><p>- We use cookies to make this site work. <a href="/c">More</a></p></div><nav><ul><li><a href="/">- Start</a></li><li><a href="/b">- Blog</a></li></ul></nav>
    <article><h1>+ Notes on a slow bicycle trip</h1><p class="a>+ We left the town at six in the morning with far too much in the bags, as one does on the first day of any long trip.</p>
    <p title=it's>+ By noon the road had turned to gravel and the hills had begun, so we pushed the bicycles for most of the afternoon.</p><p>+ Nobody complained, which was a surprise to all of us, for the heat on the southern slope was hard to bear without shade.</p></article>
    <section class="comments"><div class="comment"><p>- Great trip!</p></div><div class="comment"><p>- I did the same route last year.</p></div></section><footer>- © Slow Wheels</footer></body>""",
    """<body><nav><ul><li><a href="/">- Index</a></li><li><a href="/x">- Archive</a></li></ul></nav><div class="ad">- Cheap flights every day</div><iframe src=x>
    <article><h1>+ The new reading room</h1><p>+ The library has moved its reading room to the upper floor, where the light is better and the noise of the street is far away.</p>
    <p>+ Sixty seats stand along the windows and another twenty around a long table in the middle, each with a lamp of its own.</p></article><footer><p>- © City Library &middot; Opening hours</p></footer></body>""",
]


def nameless(page: str) -> str:
    """The page with plain `div`s in place of telling tags, and without classes."""
    page = re.sub(r"(</?)(?:nav|header|footer|aside|article|main|section)\b", r"\1div", page)
    return re.sub(r' class="[^">]*"', "", page)


@pytest.fixture(scope="module")
def model():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    return T.Labeller().fit(T.teaching_pages([p for p in pages if p][:200]) + T.nameless_pages([p for p in pages if p][:200]))


def verdicts(model, page):
    leaves = T.blocks(page)
    x, mask = T.padded([T.features(leaves)])
    return leaves, model.chances(x, mask)[0] > 0.5


@pytest.mark.parametrize("named", [True, False])
def test_hand_labelled_pages(model, named):
    right = total = 0
    for page in PAGES:
        leaves, kept = verdicts(model, page if named else nameless(page))
        assert {b.text[0] for b in leaves} <= {"+", "-"}, [b.text for b in leaves]
        right += sum((b.text[0] == "+") == k for b, k in zip(leaves, kept, strict=True))
        total += len(leaves)
    assert total >= 45 and right >= 0.95 * total, (right, total)


def test_plain_page(model):
    page = (
        "<html><body><div><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/c'>Contact</a></div><div>The council voted on Tuesday to rebuild the old bridge over the canal, which has been shut since the flood of last spring.</div>"
        "<div>Work is to begin in March and will take about a year, said the head of the roads office, who asked drivers for patience.</div></body></html>"
    )
    leaves, kept = verdicts(model, page)
    assert list(kept) == [False, True, True]


@pytest.mark.parametrize("piece", ["<div>", "<a ", "<div><p>a", '<p class="a>', "<!--", "<iframe>x", "</p <", '<p "', "<script", "<tr><td>x<table>", "<svg><table>"])
def test_time_grows_with_the_length(piece):
    took = []
    for size in (1 << 17, 1 << 20):
        page = piece * (size // len(piece))
        start = time.process_time()
        T.blocks(page)
        took.append(time.process_time() - start)
    assert took[1] < 8 and took[1] < 32 * max(took[0], 0.02)


def test_broken_markup():
    def read(page):
        return [b.text for b in T.blocks(page)]

    assert read('<p class="a>Hello there reader</p><p class="b">x</p>') == ["Hello there reader", "x"] and read("<p title=it's>ok</p>") == ["ok"]
    assert read("<iframe src=x><p>rest</p>") == ["rest"] and read("<p>a<iframe>no</iframe>b</p>") == ["a b"]
    assert read('<a title="x > y" href=q>link</a> t') == ["link t"] and read('<img alt="<b>no</b>">yes') == ["yes"]
    assert read("a < b & c &lt; d<!-- x > y") == ["a < b & c < d y"] and read("<p") == [] and read("x<script>never ends<p>y") == ["x"]
    assert read("<ul><li>a<li>b<ul><li>c</ul>d</ul><noscript>e</noscript>f") == list("abcdef")
    assert read("<head><title>T &amp; x</title><p>y") == ["T & x", "y"] and read("<table><tr><td>a<td>b<tr><td>c</table>d") == list("abcd")


def test_labels_of_names():
    def labels(page):
        return {b.text: T.teaching_label(b) for b in T.blocks(page)}

    assert labels("<nav>Home</nav><article><header><h1>T</h1></header><p>x</p><footer>f</footer></article><header>s</header>") == {"Home": 0, "T": 1, "x": 1, "f": 0, "s": 0}
    assert labels("<body class='has-sidebar'><article class='social'><p>x</p></article><article class='comment'>c</article>") == {"x": 1, "c": 0}
