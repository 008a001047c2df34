import html
import re

import pytest

from tenderspring.llm import html_tree as H
from tenderspring.llm.html_pages import labelled_pages
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return H.fit(labelled_pages())


def test_messages_give_exact_marginals(model):
    """On a small tree the marginals equal those of all labellings, weighed one by one."""
    t = H.trees(["<body><nav><a href=x>go</a></nav><article><h1>T</h1><p>One, two.</p></article></body>"])
    n = len(t.parent)
    weights = [[0.0, sum(model.unary[f] for a, f in zip(t.at, t.feature, strict=True) if a == i)] for i in range(n)]
    total, one = 0.0, [0.0] * n
    import math

    for code in range(2**n):
        x = [code >> i & 1 for i in range(n)]
        w = math.exp(sum(weights[i][x[i]] for i in range(n)) + sum(model.tie[t.kind[i]][x[t.parent[i]]][x[i]] for i in range(n) if t.parent[i] >= 0))
        total += w
        for i in range(n):
            one[i] += w * x[i]
    assert model.marginals(t) == pytest.approx([v / total for v in one], rel=1e-9)


def test_held_out_labelled_pages(model):
    t = H.trees(labelled_pages(200, seed=99))
    p = model.marginals(t)
    right = [(p[n] >= 0.5) == (t.label[n] == 1) for n, _ in t.texts]
    assert sum(right) / len(right) > 0.97
    assert sum(len(x) for (_, x), ok in zip(t.texts, right, strict=True) if ok) / sum(len(x) for _, x in t.texts) > 0.96


SAID = ["The council met again in spring, and after a long debate it agreed to build the new bridge over the river, which is to open in two years.", "A second paragraph follows the first, with some more words about the cost of it."]
SIDE = '<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Other things happen</a></li><li><a href="/2">And more</a></li></ul></div>'
AD = '<div class="ad">Buy now</div>'


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        (f"<article><h1>Bridge</h1><div><div><p>{SAID[0]}</p></div>{AD}</div>{AD}</article>", ["Bridge", SAID[0]]),
        (f"<article><h1>Bridge</h1><div><div><div><p>{SAID[0]}</p></div>{AD}</div>{AD}</div>{AD}</article>", ["Bridge", SAID[0]]),
        (f"<div class=row><div class=col><h2>Bridge</h2><div><img src=x><div><p>{SAID[0]}</p><p>{SAID[1]}</p></div></div></div>{SIDE}</div>", ["Bridge", *SAID]),
        (f"<div class=row><div class=col><h2>Bridge</h2><div><img src=x><div><p>{SAID[0]}</p></div></div></div>{SIDE}</div>", ["Bridge", SAID[0]]),
        (f'<div id="cookie-banner"><p>We use cookies to make the site better for you.</p></div><main><p>{SAID[0]}</p></main>', [SAID[0]]),
        (f'<table><tr><td><a href="/">Home</a><br><a href="/a">About us</a><br><a href="/c">Contact</a></td><td><h1>Bridge</h1><p>{SAID[0]}</p><p>{SAID[1]}</p></td></tr></table>', ["Bridge", *SAID]),
        (f'<article><h1>Bridge</h1><p>{SAID[0]}</p><div class="werbung">Jetzt kaufen</div><p>{SAID[1]}</p></article>', ["Bridge", *SAID]),
        (f'<article><h1>Bridge</h1><p>{SAID[0]}</p><div class="publicite">Achetez maintenant</div><p>{SAID[1]}</p><section class="commentaires"><div><p>Tres bien, merci a tous.</p></div></section></article>', ["Bridge", *SAID]),
    ],
)
def test_ordinary_layouts(model, body, wanted):
    page = f'<html><body><header><h2>Daily Site</h2></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>{body}<footer><p>&copy; 2024 Site</p></footer></body></html>'
    assert H.main_text([page], model)[0][0] == "\n\n".join(wanted)


def test_given_pages(spark):
    pages = table(spark, SF, "pages")
    found = {r.page_id: r for r in H.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n\n".join(b for b in blocks if b)
        assert found[r.page_id].text == expected and found[r.page_id].n_chars == len(expected)


def test_frames_and_markup(model):
    page = """<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-banner"><p>We use cookies, as all do.</p></div>
    <article><h1>Title &amp; more</h1><p>First para,<br>with <b>bold</b>&nbsp;words.<p>Second.<script>var x = "<p>no</p>"</script><!-- <p>no</p> --></article>
    <aside class="sidebar"><h3>Other</h3><p>Read this too.</p></aside><section class="comments"><div class="comment"><p>Nice, thanks a lot.</p></div></section>
    <form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 Site</footer>"""
    assert H.main_text([page], model)[0][0] == "Title & more\n\nFirst para, with bold words.\n\nSecond."


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4, 5, 8, 20, 50, 500, 5000])
def test_article_text_stays_however_deep_it_lies(model, depth):
    """Wrappers around one paragraph, around two, and each paragraph in wrappers of its own."""
    one, two = "The council met again in spring, and after a long debate it agreed to build the new bridge, which is to open in two years. " * 2, "A second paragraph follows the first, with some more words."
    wrapped = lambda x: "<div>" * depth + x + "</div>" * depth
    around = '<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>{}<footer><p>&copy; 2024 Site</p></footer></body></html>'
    head, paragraphs = "<h1>The new bridge</h1>", [f"<p>{one}</p>", f"<p>{two}</p>"]
    for inside, wanted in (
        (head + wrapped(paragraphs[0]), ["The new bridge", one]), (head + wrapped("".join(paragraphs)), ["The new bridge", one, two]),
        (head + "".join(map(wrapped, paragraphs)), ["The new bridge", one, two]), (wrapped(head + "".join(map(wrapped, paragraphs))), ["The new bridge", one, two]),
    ):
        assert H.main_text([around.format(f"<article>{inside}</article>")], model)[0][0] == "\n\n".join(x.strip() for x in wanted)


def test_halves_of_halves_in_wrappers(model):
    def tree(parts, level):
        return parts[0] if len(parts) == 1 else "".join(f"<div>{tree(p, level + 1)}</div>" for p in (parts[: len(parts) // 2], parts[len(parts) // 2 :]))

    said = [f"Paragraph number {k} tells what happened then, at some length, and who was there." for k in range(16)]
    page = f'<body><header><h2>Site</h2></header><article>{tree([f"<p>{x}</p>" for x in said], 0)}</article><aside class="sidebar"><h3>More</h3><ul><li><a href="/">x</a></li></ul></aside></body>'
    assert H.main_text([page], model)[0][0] == "\n\n".join(said)


def test_end_tags_close_the_right_element_at_any_depth(model):
    page = "<body><article><p>Before the deep part, a sentence.</p>" + "<div>" * 1200 + "<p>Deep words are here, in a sentence.</p>" + "</div>" * 1200 + "</article><footer>&copy; Site</footer><nav><a href=/>x</a></nav>"
    t = H.trees([page])
    assert [t.depth[n] for n, _ in t.texts][0] <= 4 and H.main_text([page], model)[0][0] == "Before the deep part, a sentence.\n\nDeep words are here, in a sentence."


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x y.</p></article>"), (4, "u", "<<<>>&&&"), (5, "u", "<div>" * 3000 + "deep"), (5, "u", "<p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    found = H.extracted(df).collect()
    assert len(found) == 6 and all(r.n_chars == len(r.text) for r in found) and found[0].text == "" and found[1].text == ""
    assert H.extracted(df.limit(0)).count() == 0
