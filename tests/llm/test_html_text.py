import html as H
import itertools
import re

import numpy as np

from skeinrank.llm.html_text import default_model, extract, features, labelled_pages, read

from .helpers import SF


def article_text(page):
    """The article of the driver's pages, which are of one layout, by rule."""
    a = page[page.index("<article>") : page.index("</article>")]
    parts = re.split(r"<(?:/?p|/?h1|/?article)>", a)
    out = [" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n".join(x for x in out if x)


def test_messages_give_the_exact_marginals():
    model = default_model()
    tree = read("<article><h1>A b</h1><p>Some text.</p><div class=ad>x</div></article><footer>y</footer>")
    x = features(tree)
    content, pair = model.beliefs(tree.parent, x)
    score, n = x @ model.weights, len(tree.parent)
    total, each = 0.0, np.zeros(n)
    for states in itertools.product([0, 1], repeat=n):
        w = np.exp(sum(score[i] for i in range(n) if states[i]) + sum(model.table[states[tree.parent[i]], states[i]] for i in range(1, n)))
        total += w
        each += w * np.array(states)
    assert np.allclose(content, each / total)
    assert np.allclose(pair[1:].sum((1, 2)), 1)


def test_held_out_layouts():
    model = default_model()
    pages = [(set(model.text(h).split("\n")) - {""}, wanted) for h, wanted in labelled_pages(200, seed=77)]
    assert sum(got == wanted for got, wanted in pages) >= 0.82 * len(pages)
    blocks = sum(len(w) for _, w in pages)
    assert sum(len(w - g) for g, w in pages) <= 0.03 * blocks and sum(len(g - w) for g, w in pages) <= 0.05 * blocks


def test_pages_with_hardly_any_markup_and_misleading_names():
    model, said = default_model(), "A sentence that is all the page has to say, and no more."
    for shape in ("%s", "<html><body>%s</body></html>", "<div>%s</div>", "<span>%s</span>", "<body><div class=wrap>%s</div></body>"):
        assert model.text(shape % said) == said, shape
    assert model.text(f"<main><section class='legal-text'><h2>Terms</h2><p>{said}</p></section></main>") == f"Terms\n{said}"
    assert model.text(f"<article><h1>T</h1><p class='top'>{said}</p><p>{said}</p></article><footer>x</footer>") == f"T\n{said}\n{said}"


def test_whole_pages(spark):
    got = {r.page_id: r.text for r in extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[r.page_id] == article_text(r.html)


def test_parts_that_are_not_text():
    p = "A sentence of the article that goes on for a while, as sentences do, and ends here."
    page = (
        f"<html><head><title>t</title></head><body><header><p>Site name and slogan.</p></header><nav><a href=/>Home</a></nav><div class=cookie-notice><p>We use cookies to make this better.</p></div>"
        f"<article><h1>Title</h1><p>{p} Tom &amp; J&#246;rg&nbsp;x</p><script>var a='<p>no</p>'</script><p>{p}\n\t  more</p></article>"
        f"<aside><h3>Related</h3><p>Other story of interest.</p></aside><div id=comments><p>I liked this article very much.</p></div><form><p>Sign up.</p><input></form><footer>&copy; x</footer></body></html>"
    )
    assert default_model().text(page).split("\n") == ["Title", f"{p} Tom & Jörg x", f"{p} more"]


def test_odd_pages_and_empty(spark):
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (3, None, "<div" * 5), (4, "u", "<div>" * 2500 + "deep"), (5, "u", "</p></article>&bogus; &#xZZ;"), (6, "u", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text", "2 n")
    got = extract(df).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id <= 2] == [""] * 3
    assert extract(df.limit(0)).count() == 0


def test_head_left_open_and_embedded_text():
    texts = lambda page: [t for _, t in read(page).runs]
    assert texts("<html><head><title>t</title><article><p>One two.</p></article>") == ["One two."]
    assert texts("<head><meta charset=utf-8><noscript><style>a{}</style></noscript><script>x<p>y</script>Plain text.") == ["Plain text."]
    assert texts("<article><p>Let <math><mi>x</mi></math> be <object>a thing</object><noscript> seen</noscript>.</p></article>") == ["Let x be a thing seen."]


def test_depth_costs_no_more_than_length():
    import time

    from skeinrank.llm.html_text import read

    def seconds(n):
        began = time.process_time()
        tree = read("<div><p>" * n + "deep" + "</div>" * n)
        assert len(tree.parent) == 2 * n + 1 and tree.runs == [(2 * n, "deep")]
        return time.process_time() - began

    seconds(1000)
    assert seconds(64_000) < 12 * max(0.2, seconds(8_000))
