"""Extraction from hand-made pages, and agreement of a host's pages."""

import os
import random
from html.parser import HTMLParser

import pytest

from wayfold.llm import html

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

SHELL = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div>{}<footer>&copy; me</footer></body></html>'


def texts(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, path int")
    return {r.page_id: (r.text, r.n_chars) for r in html.extract(frame).collect()}


def test_article_only(spark):
    article = '<article><h1>Head &amp; line</h1><p><b>Bold<br><p>One  two\n three</p><!-- no --><form><p>Mail</p></form><p>fo<i>ur</i> &lt;five&gt; <span class="share">tweet</span></p><section class="comments"><p>First!</p></section></article>'
    got = texts(spark, [(1, "http://a.example/1", SHELL.format(article), 0), (2, None, None, 0), (3, "x", "", 0), (4, "http://b.example", "plain & text < 5", 0)])
    want = "Head & line Bold One two three four <five>"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain & text < 5", 16)}


def test_host_agrees_on_a_path(spark):
    body = '<div class="story p{0}"><p>{1}</p></div><div class="more"><p>{2}</p></div>'
    pages = [(i, "https://c.example:80/p", SHELL.format(body.format(i, "long story " * 30, "other matter")), 0) for i in range(5)]
    pages.append((9, "https://c.example/q", SHELL.format(body.format(9, "short story", "other matter " * 40)), 0))
    got = texts(spark, pages)
    assert got[9][0] == "short story" and got[0][0] == ("long story " * 30).strip()


def test_broken_markup(spark):
    assert html.parse("<" * 5000)[0][0][0] == "<" * 5000
    for page in ("<p", "<a href='x", "<script>x", "</div></p>a", "<div class=\"x>a</div>", "<!-- open", "&#0;&#x110000;&nope;a"):
        html.best_container(*html.parse(page))
    assert texts(spark, []) == {}


def test_text_beside_the_inner_container_stays(spark):
    long = "long story " * 60
    nested = "<h1>Head</h1><p>{1}</p><div class=body><div class=i><div class=j><p>{0}</p></div><p>{1}</p></div><p>{1}</p></div>"
    closing = "<section class=closing><p>The end</p></section>"
    lead = "lead words " * 10
    want = " ".join(["Head", *(lead + long + lead * 2).split()])
    bodies = {1: f"<article>{nested}{closing}</article>", 2: f"<div class=page>{nested}</div>", 3: f"<div class=page>{nested}</div>{closing}", 4: f"<article>{nested}</article><p>Beside it</p>"}
    pages = [(i, f"http://{i}.example/{n}", SHELL.format(b.format(long, lead)), 0) for i, b in bodies.items() for n in range(2)]
    got = texts(spark, pages)
    assert {i: got[i][0] for i in bodies} == {1: want + " The end", 2: want, 3: want, 4: want}


@pytest.mark.parametrize("name", ["content no-sidebar", "post side-by-side", "has-ads content", "entry with-comments", "post-header-image story", "alert-news", "skip-lazy story", "search-result-page", "header", "comments"])
@pytest.mark.parametrize("tag", ["div", "article", "section", "main"])
def test_no_name_bars_the_article_itself(name, tag):
    own = "<h1>Head</h1>" + "<p>long story about it</p>" * 20 + '<div class="comment-list"><p>First!</p></div><div class="social share"><a href=x>tweet</a></div><aside>Beside</aside><form>Mail us</form>'
    page = SHELL.format(f'<{tag} class="{name}">{own}</{tag}>')
    blocks, elements = html.parse(page)
    assert html._text(blocks, [html.best_container(blocks, elements)]) == "Head" + " long story about it" * 20


def test_headers_in_an_article_and_pages_in_one_form(spark):
    long = "<p>long story about it</p>" * 20
    want = "Head" + " long story about it" * 20
    bodies = [
        f'<article><div class="article-header"><h1>Head</h1></div>{long}</article>',
        f"<article><header><h1>Head</h1></header>{long}<footer>Filed under x</footer></article>",
        f'<div class="post"><div class="post-header"><h2>Head</h2></div>{long}<section id="comments">{"<p>They said a lot more than the story</p>" * 30}</section></div>',
        f'<div class="wrap"><h1>Head</h1>{long}<div class="relatedPosts"><a href="/1">One more</a></div></div>',
    ]
    pages = [(i, f"http://{i}.example/", SHELL.format(b), 0) for i, b in enumerate(bodies)]
    pages += [(10 + i, f"http://form{i}.example/", "<html><body><form id=aspnetForm>" + SHELL.format(b)[len("<!DOCTYPE html><html>") :].replace("<body>", "").replace("</body></html>", "") + "</form></body></html>", 0) for i, b in enumerate(bodies)]
    got = texts(spark, pages)
    assert {i: t for i, (t, _) in got.items()} == {i: want for i, *_ in pages}


class Reference(HTMLParser):
    """Blocks of the article element alone, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.blocks, self.text = 0, 0, [], ""

    def cut(self):
        self.blocks, self.text = self.blocks + ([" ".join(self.text.split())] if self.text.split() else []), ""

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "form", "nav", "aside")
        if tag not in html.INLINE:
            self.cut() if tag != "br" else self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.cut()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style", "form", "nav", "aside")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.text += data


def test_same_as_another_parser_on_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        reader = Reference()
        reader.feed(r.html or "")
        reader.cut()
        assert got[r.page_id] == " ".join(reader.blocks)


def test_long_pages_ties_and_repeated_rows(spark):
    r = random.Random(2)
    words = " ".join(f"w{r.randrange(9999)}" for _ in range(200_000))
    pages = [(1, "http://l.example", SHELL.format(f"<article><p>{words}</p></article>"), 0)] * 2
    # two paths with one vote each of one score: the smaller path wins and each page still has its own
    tie = ["<div class=b><p>same long text here</p></div>", "<div class=a><p>same long text here</p></div>"]
    pages += [(2 + i, "http://t.example", SHELL.format(b), 0) for i, b in enumerate(tie)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, path int")
    got = [(x.page_id, x.text, x.path.rsplit(".", 1)[-1]) for x in html.extract(frame).collect()]
    assert sorted(got)[:2] == [(1, words, "/html/body/article")] * 2
    assert sorted(got)[2:] == [(2, "same long text here", "a"), (3, "same long text here", "a")]
