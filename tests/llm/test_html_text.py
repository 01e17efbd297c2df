"""Extraction against the article's own text; other markup; broken pages."""

import html
import random
import re

import pytest

from veritrim.llm import html_text as H
from veritrim.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def article(page):
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    if not found:
        return ""
    body = re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", found[1].replace("<br>", " ")))
    blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"<[^>]+>", body))
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def trees(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    return H.fit(H.sample(pages))


def text(trees, source):
    page = H.parse(source)
    return H.main_text(page, H.keep_elements(page, trees.scores(H.features(page))))


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op4_html_text"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert r.text == article(pages[r.page_id].html)


def test_parts_beside_the_article_go(spark, trees):
    rng = random.Random(8)
    sources = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if "</article>" in r.html]
    right = 0
    for source in sources:
        page = H.parse(H.varied(source, rng))
        want = H.main_text(page, H.labels(page) > 0)
        H._without_marks(page)
        right += H.main_text(page, H.keep_elements(page, trees.scores(H.features(page)))) == want
    assert right / len(sources) >= 0.9


def test_decoding_keeps_no_element_below_a_dropped_one():
    page = H.parse("<body><div><p>a</p><p>b</p></div><div><p>c</p></div></body>")
    rng = random.Random(4)
    for _ in range(100):
        scores = H.np.array([rng.uniform(-1, 1) for _ in page.nodes])
        kept = H.keep_elements(page, scores)
        assert all(kept[n.parent] for n, k in zip(page.nodes[1:], kept[1:], strict=True) if k)


def test_odd_pages(spark, trees):
    rows = [(1, None), (2, ""), (3, "<"), (4, "<div"), (5, "<!-- never ends"), (6, "<script>x<p>"), (7, "</p></div>" * 50), (8, "<div>" * 3000)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, html string, text string, n_chars int")
    got = {r.page_id: r for r in H.extract(df, trees).collect()}
    assert len(got) == 8 and got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert H.extract(df.filter("false"), trees).collect() == []
    assert H.fit([]).scores(H.features(H.parse("<p>x</p>"))).min() > 0


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<svg>", "<noscript>", "<template>", "<textarea>", "<iframe src='x'>"])
def test_what_is_not_closed_does_not_hide_the_page(tag):
    texts = lambda source: "".join(t for _, t in H.parse(source).pieces)
    assert "seen" in texts(f"<body>{tag}<p>seen</p></body>")
    assert "unseen" not in texts(f"<body><p>a</p>{tag.replace('/>', '>')}unseen</{tag[1:].split()[0].strip('>')}><script>unseen")


def test_all_classes_of_an_element_are_tokens():
    node = H.parse(f'<div class="{" ".join(f"u{c}" for c in "abcdefghijklmnop")} comments">x</div>').nodes[1]
    assert "comments" in node.tokens


def test_parse_closes_paragraphs_and_decodes():
    page = H.parse("<body><p><b>one &amp; two<br><p>three&nbsp;&lt;3 &am")
    assert H.main_text(page, H.np.ones(len(page.nodes), bool)) == "one & two\n\nthree <3 &am"


FIRST = [
    "The first words of the text stand here, and more of them follow.",
    "Second of the paragraphs, with some more to read in it.",
    "A third one is here; it says little but it is long enough.",
    "The fourth has a few words, too, and an end.",
]
WITHIN = [
    "<h2>Some heading here</h2>", "<h3>Some heading here</h3>", "<pre>some code here</pre>", "<ul><li>one item</li><li>two items</li></ul>",
    "<table><tr><td>cell one</td><td>cell two</td></tr></table>", "<blockquote>quoted words here</blockquote>",
    "<figure><figcaption>caption words</figcaption></figure>", "<div>plain words in a div</div>", "<section>words in a section</section>",
    '<p>A sentence <a href="/x">with a link</a> in it.</p>', "<details>an element that no page for training has</details>", "<dl><dt>term</dt><dd>its meaning</dd></dl>",
]
AROUND = [
    ('<div class="post">', "</div>"), ('<div class="post content">', "</div>"), ('<div id="main">', "</div>"), ("", ""), ("<main>", "</main>"),
    ("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>"), ('<div class="unheard of">', "</div>"),
]


def made_page(body):
    return (
        '<html><head><title>T</title></head><body><nav><a href="/">Home</a> <a href="/b">Blog</a></nav>'
        f'{body}<footer>Imprint <a href="/p">Privacy</a></footer></body></html>'
    )


def bare(markup):
    return " ".join(re.sub(r"<[^>]+>", " ", markup).split())


@pytest.fixture(scope="module")
def many_trees(spark):
    """From as many pages as a bounded sample of a larger table has; none of the pages below is among them."""
    return H.fit(H.sample(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


@pytest.mark.parametrize("within", WITHIN)
def test_elements_within_an_article_stay(many_trees, within):
    paragraphs = [f"<p>{x}</p>" for x in FIRST]
    inside = "<h1>Title of it</h1>" + "".join(paragraphs[:2]) + within + "".join(paragraphs[2:])
    got = text(many_trees, made_page(f"<article>{inside}</article>"))
    assert " ".join(got.split()) == bare(inside)


@pytest.mark.parametrize("count", [2, 8])
@pytest.mark.parametrize("around", AROUND)
def test_articles_in_other_containers(many_trees, around, count):
    inside = "".join(f"<p>{x}</p>" for x in (FIRST * 2)[:count])
    got = text(many_trees, made_page(f"{around[0]}{inside}{around[1]}"))
    assert " ".join(got.split()) == bare(inside)


def test_unclosed_elements_take_linear_time():
    import time

    def seconds(n):
        source = "<body>" + "<svg><iframe src='x'><p>words of the page</p>" * n
        began = time.process_time()
        assert len(H.parse(source).pieces) >= n
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 12 * max(seconds(1000), 0.02)


def test_trees_over_their_own_features_score_alike(many_trees):
    page = H.parse(made_page("<article><p>some words</p></article>"))
    trees, places = many_trees.local()
    assert (trees.scores(H.features(page, places)) == many_trees.scores(H.features(page))).all()
