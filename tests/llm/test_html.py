import html
import re
from itertools import product

import numpy as np

from ostrakon.llm import htmlcrf as c
from ostrakon.llm.common import table
from ostrakon.llm.htmlpages import labelled_pages
from ostrakon.llm.htmltree import parse, text_of


def article_text(page):
    """The blocks of the article element, by the plainest reading of the pages at hand."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|li|ul)\b[^>]*>", inner)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(b for b in blocks if b)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    parent, depth = np.array([-1, 0, 0, 1, 1, 2, -1]), np.array([0, 1, 1, 2, 2, 2, 0])
    kind, unary, pair = rng.integers(0, 3, 7), rng.normal(size=7), rng.normal(size=(3, 2, 2))
    total, _, _ = c.Messages(parent, depth, kind).run(unary, pair)
    weight, on = 0.0, np.zeros(7)
    for y in product((0, 1), repeat=7):
        w = np.exp(sum(u * v for u, v in zip(unary, y)) + sum(pair[kind[i], y[p], y[i]] for i, p in enumerate(parent) if p >= 0))
        weight += w
        on += w * np.array(y)
    assert np.allclose(1 / (1 + np.exp(-total)), on / weight)


def test_gradient_equals_differences():
    flat = c.flatten([parse(p) for p in labelled_pages(2, 5)])
    y, messages = c.labels_of(flat), c.Messages(np.array(flat.parent), np.array(flat.depth), np.array(flat.kind))
    names = sorted(set(flat.names))
    x = np.array(flat.rows), np.array([names.index(n) for n in flat.names])
    rng = np.random.default_rng(1)
    w, pair = rng.normal(0, 0.1, len(names)), rng.normal(0, 0.1, (c.N_KINDS, 2, 2))

    def likelihood(w, pair):
        u = np.bincount(x[0], w[x[1]], minlength=len(y))
        joint = (u * y).sum() + sum(pair[flat.kind[i], int(y[p]), int(y[i])] for i, p in enumerate(flat.parent) if p >= 0)
        part = np.zeros((len(y), 2))
        part[:, 1] = u
        for i in range(len(y) - 1, -1, -1):
            if flat.parent[i] >= 0:
                part[flat.parent[i]] += np.logaddexp(pair[flat.kind[i], :, 0] + part[i, 0], pair[flat.kind[i], :, 1] + part[i, 1])
        return joint - sum(np.logaddexp(*part[i]) for i, p in enumerate(flat.parent) if p < 0)

    by_weight, by_pair = c.gradient(messages, x, len(names), y, w, pair)
    for i in rng.integers(0, len(names), 5):
        d = np.zeros(len(names))
        d[i] = 1e-5
        assert abs((likelihood(w + d, pair) - likelihood(w - d, pair)) / 2e-5 - by_weight[i]) < 1e-4
    d = np.zeros((c.N_KINDS, 2, 2))
    d[1, 1, 0] = 1e-5
    assert abs((likelihood(w, pair + d) - likelihood(w, pair - d)) / 2e-5 - by_pair[1, 1, 0]) < 1e-4


def test_held_out_pages():
    flat = c.flatten([parse(p) for p in labelled_pages(200, 77)])
    told = c.trained().marginals(flat) >= 0.5
    assert (told == (c.labels_of(flat) > 0.5)).mean() > 0.97


def test_all_pages(spark, sf):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in c.extract_pages(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_parts_that_are_not_the_article():
    prose = "<p>One two three, four five six seven. Eight nine ten eleven.</p>"
    page = f"""<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies. Read more.</div>
    <main><article><h1>Title</h1>{prose}<div class="ad">Buy this now. It is cheap.</div><p>A &lt;b&gt; &amp;
      c&nbsp;d<br>e <b>bold</b></p><form class="newsletter"><label>Mail</label><input></form></article>
    <section id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this, at all. Bad text.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=x>More</a></li></ul></aside><footer>&copy; me</footer><script>var x="<p>no</p>"</script>"""
    assert c.extract([page], c.trained()) == ["Title\n\nOne two three, four five six seven. Eight nine ten eleven.\n\nA <b> & c d e bold"]


def test_broken_and_empty_pages(spark):
    pages = [None, "", "<", "<p>", "plain text only", "<div>" * 3000 + "deep" + "</div>" * 10, "<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>" + "long. " * 100_000]
    frame = spark.createDataFrame([(i, "u", p, 3) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in c.extract_pages(frame).collect()}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows.values())
    assert rows[0].text == rows[1].text == rows[3].text == "" and rows[6].n_chars == 3 + 6 * 100_000 - 1
    assert c.extract_pages(frame.limit(0)).count() == 0
    tree = parse("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><p>f<p>g<script>x</script>h")
    assert text_of(tree) == "abcdefgh" and [n.tag for n in tree.children] == ["ul", "table", "p", "p"]
