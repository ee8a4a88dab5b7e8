import time
from html.parser import HTMLParser

import pytest

from tarn.llm import html_extraction as H
from tarn.llm.queries import op4_block_rule_extraction

LONG = "The house that was built by the river and the people of the town are in it for all of the year. " * 2


class Article(HTMLParser):
    """Blocks of the article element of the given pages, which nest nothing else in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "article", "footer") else None
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def parsed(page):
    reader = Article()
    reader.feed(page)
    reader.close()
    return "\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b)


def test_query_equals_a_parser(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = op4_block_rule_extraction(spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == parsed(pages[r.page_id].html)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


@pytest.mark.parametrize("junk", [
    "<nav><p>{}</p></nav>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<aside>{}</aside>", "<form><p>{}</p></form>",
    '<div class="sidebar">{}</div>', '<div id="comments"><p>{}</p></div>', '<section class="ad-box ads"><p>{}</p></section>',
    '<div class=cookie-notice>{}</div>', "<script>{}</script>", "<style>{}</style>", "<!-- {} -->", '<div role="navigation">{}</div>',
    "<ul><li><a href=x>{}</a></li></ul>", "<noscript>{}</noscript>", "<textarea>{}</textarea>", '<p class="advert">{}</p>',
])
@pytest.mark.parametrize("inside", [False, True])
def test_boilerplate_goes(junk, inside):
    if inside and junk.startswith("<header"):
        pytest.skip("an article's own header holds its title")
    bad = junk.format("Of the many of it: " + LONG)
    body = f"<h1>A title</h1><p>{LONG}</p>{bad if inside else ''}<p>Short.</p><p>{LONG}</p>"
    want = "\n".join(["A title", LONG.strip(), "Short.", LONG.strip()])
    assert H.main_text(f"<html><body>{'' if inside else bad}<article>{body}</article></body></html>") == want


def test_ambiguous_blocks_inherit_from_the_nearest_decided():
    menu = "".join(f"<li><a href='/{i}'>The page of it {i}</a></li>" for i in range(5))
    page = f"<body><ul>{menu}</ul><p>Top</p><p>One</p><p>{LONG}</p><p>Two</p><p>{LONG}</p><p>Three</p><p>Four</p><ul>{menu}</ul></body>"
    assert H.main_text(page) == "\n".join(["One", LONG.strip(), "Two", LONG.strip(), "Three"])


@pytest.mark.parametrize("page,want", [
    ("", ""), ("<", ""), ("plain", ""), ("<article>a &lt;b&gt; &amp;amp; &copy;&am</article>", "a <b> &amp; ©&am"),
    ("<article><p>One<p>Two\n\t three<br>four", "One\nTwo three four"), ("<article>x<!-- y", "x"), ("<article>x<script>y", "x"), ('<article><p class="advert">a<p>b<p class=share>c<div>d</div></article>', "b\nd"),
    ('<div class="page-header">a</div><article><div class="entry-header"><h1>T</h1></div>x<span class="ad">y</span>z</article>', "T\nxz"),
    ("<ARTICLE>x<b>y</b> z</ARTICLE><footer>f", "xy z"), ("<article><h2> \n </h2>1 < 2</article>", "1 < 2"),
    ('<article><img alt="a > b">x</article>', "x"), ("<article><p>" + "w " * 100_000 + "</p></article>", "w " * 99_999 + "w"),
])
def test_markup(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<main>é</main>")]])
def test_rows(spark, rows):
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    found = H.extracted(pages).collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(
        repr((i, u, "é" if h and "é" in h else "", 1 if h and "é" in h else 0)) for i, u, h in rows
    )


@pytest.mark.parametrize("before", [
    "<html><head><title>x</title><body>", "<html><head><title>x</title><style>y</style><meta name=a>", "<head><link href=x><script>z</script>",
    "<body><select><option>a<option>b", "<body><object data=x>a", "<body><svg><text>a", "<body><math><mi>a", "<body><svg/>",
    "<body><select><option>a</select>", "<body><svg><svg>a</svg>b</svg>", "<body><object><p>a</p></object>",
])
def test_elements_without_a_closing_tag(before):
    assert H.main_text(f"{before}<article><h1>A title</h1><p>{LONG}</p></article>") == "A title\n" + LONG.strip()


@pytest.mark.parametrize("page", [
    '<body class="no-sidebar"><article>{}</article>', '<body class="search"><div>{}</div>', '<html class="modal-open"><main id="widget">{}</main>',
    '<div class="content has-sidebar">{}</div>', '<article class="post comments-open">{}</article>', '<article id="related">{}</article>',
    '<div class="sidebar"><div><article>{}</article></div></div>', '<article><section id="legal-history">{}</section></article>',
    '<article><section class="related-work">{}</section></article>',
])
def test_hints_do_not_condemn_content(page):
    for heading in ('<h2>Related</h2>', '<h2 id="related-work">Related</h2>', '<h3 id="search">Related</h3>', '<h4 id="comments">Related</h4>'):
        body = f"<p>{LONG}</p>{heading}<p>{LONG}</p>"
        assert H.main_text(page.format(body)) == "\n".join([LONG.strip(), "Related", LONG.strip()])


@pytest.mark.parametrize("page,want", [
    ('<table><tr><td class="sidebar">menu<td>{}</table>', "{}"), ('<ul><li class="ad">buy<li>{}</ul>', "{}"),
    ('<dl><dt class="promo">buy<dd>{}</dl>', "{}"), ('<table><tr class=menu><td>a<td>b<tr><td>{}</table>', "{}"),
    ('<table><tbody class=nav><tr><td>a<tbody><tr><td>{}</table>', "{}"),
    ('<ul><li class="ad">buy<ul><li>{}</ul></ul>', ""), ('<li class="ad"><div><li>{}', "{}"), ("<select><option>a<option>b</select><div>{}</div>", "{}"),
    ('<div><p class="advert">x<table><tr><td>{}</table></div>', "{}"), ('<a title="x>y" href=z>b</a><div>{}</div>', "{}"),
    ('<a title="x>y</a><div>{}</div>', "{}"), ("<div>{}</div><a href=x", "{}"), ('<div>{}</div><a b="', "{}"),
])
def test_elements_end_where_browsers_end_them(page, want):
    assert H.main_text(f"<body>{page.format(LONG)}</body>") == want.format(LONG.strip())


def test_a_teaser_article_is_not_the_page():
    story = f"<div>{LONG}</div>" * 4
    assert H.main_text(f"<article><h2>Teaser</h2><p>{LONG}</p></article>{story}") == "\n".join(["Teaser"] + [LONG.strip()] * 5)
    assert H.main_text(f"{story}<article>{f'<p>{LONG}</p>' * 5}</article>") == "\n".join([LONG.strip()] * 5)


@pytest.mark.parametrize("text", ["В нижней части города жили рыбаки и торговцы, которые каждое утро приходили к реке. " * 3, "城市的下游住着渔民和商人他们每天早晨来到河边" * 9])
def test_other_languages(text):
    menu = "".join(f"<li><a href=/{i}>Раздел {i}</a>" for i in range(6))
    page = f"<body><nav>{menu}</nav><ul>{menu}</ul><div><div>{text}</div><h2>Река</h2><div>{text}</div></div><footer>{text}</footer></body>"
    assert H.main_text(page) == "\n".join([text.strip(), "Река", text.strip()])


@pytest.mark.parametrize("piece", [
    "<a", "<a ", '<a "', '<a "b>"', "<a 'b>\"", "<div>", "<div>x", "<div class=ad>x", "<td>", "<tr><td>x", "<li>x", "<li><ul>x", "<article>", "<div class=ad><article>x",
    "<svg>", "<svg><math>", "</svg ", "<script", "<script>", "</script ", "<select><option>", "<span class=share>x", "<!--", "<!", "</", "<p class=ad>x", "<a href=x>y", "&", "&amp", "<b><i>x</b>",
])
def test_any_markup_takes_linear_time(piece):
    """A megabyte of it; also behind many open elements, and with the closing tag of another."""
    for page in (piece * (1_000_000 // len(piece)), "<div>" * 20_000 + "<li><ul>" + piece * (200_000 // len(piece)), (piece + "</td></li></em>") * 10_000):
        start = time.perf_counter()
        H.main_text(page)
        assert time.perf_counter() - start < 10
