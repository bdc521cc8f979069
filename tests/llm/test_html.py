import html
import math
import re

import pytest

from quorumframe.llm.html import ROOT, TreeModel, _labelled, extract, main_text, parse, trained
from quorumframe.llm.html_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now. It is cheap!</div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b>\n paragraph, long enough to look like one. It goes on.<br>After the break.</p>
<div class="ad">Advert inside.</div><p>Second&nbsp;paragraph &lt;here&gt;.</article>
<section class="comments"><p>I think this is wrong. Really!</p></section><footer>&copy; Someone. All rights.</footer></body></html>"""


def test_a_page():
    assert main_text(PAGE) == "A title & more\nFirst bold paragraph, long enough to look like one. It goes on. After the break.\nSecond paragraph <here>."
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<!-- x") == ""


def test_marginals_equal_enumeration():
    nodes = parse("<body><div class='ad'>x y.</div><article><p>Some text.</p></article></body>")
    model = trained()
    got = model.marginals(nodes)
    total, one = 0.0, [0.0] * len(nodes)
    for code in range(1 << (len(nodes) - 1)):
        labels = [0] + [code >> k & 1 for k in range(len(nodes) - 1)]
        weight = math.exp(sum(model._potential(n)[labels[n.parent]][labels[k]] for k, n in enumerate(nodes) if k != ROOT))
        total += weight
        one = [o + weight * label for o, label in zip(one, labels)]
    assert all(abs(g - o / total) < 1e-6 for g, o in zip(got, one))


def test_labelled_pages_are_learned():
    right = total = 0
    for page in labelled_pages():
        nodes = _labelled(page)
        for node, p in zip(nodes, trained().marginals(nodes)):
            if node.kind == "text":
                right, total = right + ((p >= 0.5) == (node.label == 1)), total + 1
    assert right / total > 0.98


@pytest.mark.parametrize("fold", range(3))
def test_pages_that_were_not_learned(fold):
    pages = labelled_pages()
    model = TreeModel.counted([_labelled(page) for k, page in enumerate(pages) if k % 3 != fold])
    right = total = 0
    for page in pages[fold::3]:
        nodes = _labelled(page)
        for node, p in zip(nodes, model.marginals(nodes)):
            if node.kind == "text":
                right, total = right + ((p >= 0.5) == (node.label == 1)), total + 1
    assert right / total > 0.97


def test_nothing_after_an_unclosed_element_is_lost():
    after = "<p>This paragraph follows it. It is long enough to look like one.</p>"
    for tag in ("button", "select", "option", "template", "textarea", "iframe", "svg", "noscript"):
        said = "This paragraph follows it. It is long enough to look like one."
        first = "The first paragraph of the article, which is long enough."
        for element in (f"<{tag}>", f'<{tag} class="x">', f"<{tag}/>", f"<{tag}>gone</{tag}>", f"<{tag}><{tag}>gone</{tag}>"):
            assert main_text(f"<body><article><h1>Title of it</h1><p>{first}</p>{element}{after}</article></body>") == f"Title of it\n{first}\n{said}", element
    options = "<p>One paragraph that stands first. It is long.</p><select><option>a<option>b<option selected>c</select>" + after
    assert main_text(f"<article>{options}</article>") == "One paragraph that stands first. It is long.\nThis paragraph follows it. It is long enough to look like one."
    assert main_text("<article><p>Kept text of some length. It goes on.</p><svg><title>No</title></svg><button><div>No</div></button></article>") == "Kept text of some length. It goes on."
    parse("<option>x" * 100_000)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|h2|ul|li)\b[^>]*>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    edge = spark.createDataFrame([(1, "u", None, 0), (1, "u", None, 0), (None, None, PAGE, 0), (2, "v", "<div>" * 3000 + "deep" + "<p>x" * 20000, 0)], "page_id long, url string, html string, text int")
    assert extract(edge).count() == 4 and extract(edge.where("false")).count() == 0


def test_stray_end_tags_take_linear_time():
    import time

    from quorumframe.llm.html import parse

    page = "<div>" * 20_000 + "</p></section>" * 20_000 + "<li>x</li>" * 100 + "text"
    began = time.perf_counter()
    assert len(parse(page)) > 20_000 and time.perf_counter() - began < 8
