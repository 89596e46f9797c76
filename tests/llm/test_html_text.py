import pytest

from signalrank.llm import html_text as h

ARTICLE = "<article><h1>Head &amp; more</h1><p>First   paragraph\nof the text &lt;b&gt;.<p>Second <a href='/x'>one</a>, with words enough to count.</article>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar"><header class="site"><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now and save</div><div id="cookie-notice">We use cookies on this page.</div>
<div class="wrap">{ARTICLE}<form><input name=q><label>Search</label></form></div><aside>Side text that is long enough to be read.</aside>
<section id="comments"><p>Reader says a lot of things in this comment here.</p></section><div class="userComments"><p>More talk</p></div><footer>&copy; all</footer></body></html>"""
TEXT = "Head & more\nFirst paragraph of the text <b>.\nSecond one, with words enough to count."


def pages(spark, rows):
    return spark.createDataFrame([(i, u, x, "p", "h") for i, u, x in rows], "page_id long, url string, html string, path string, host string")


def alone(html):
    blocks = h.blocks_of(html)
    return h.text_of(blocks, h.best_path(blocks))


def test_article_alone():
    assert alone(PAGE) == TEXT
    assert alone(PAGE.replace("article", "div")) == TEXT
    assert alone(PAGE.replace("article>", "ARTICLE >")) == TEXT


def test_unclosed_and_cut_off():
    assert alone("<html><body><article><p><b>One two three.<br><p>Four five six.") == "One two three.\nFour five six."
    assert alone("<p>a <b>b</p><p>c</b> d</p><scr") == "a b\nc d"
    assert alone("<article><p>x</p><script>if (a<b) { '</p>' }") == "x"
    assert alone("plain text only") == "plain text only"


def test_references_and_space():
    assert alone("<div><p>a&nbsp;b &#x41;&#66;&eacute; &notaref; &amp;lt; five words here now</p></div>") == "a b ABé ¬aref; &lt; five words here now"


def test_hosts_vote(spark):
    body = lambda main, other: f"<html><body><div class='main-{main}'><p>{'word ' * 20}{main}.</p></div><div class='teaser'><p>{other}</p></div></body></html>"
    rows = [(k, "http://h.com/a", body(k, "short text")) for k in range(5)]
    rows.append((9, "http://H.com/b", body(9, "long teaser " * 60)))
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows)).collect()}
    assert got[9].endswith("9.") and "teaser" not in got[9] and got[0].endswith("0.")
    assert {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows), max_broadcast=0).collect()} == got


LONG = "Many words of a long text stand here. " * 40
PARTS = ["A title of four", "An intro that tells in short what this is about.", LONG.strip()]


def test_title_and_intro_beside_a_nested_body(spark):
    inner = "<h1>{}</h1><p>{}</p><div class=body><p>{}</p></div>".format(*PARTS)
    for outer in ("<article>{}</article>", "<main>{}</main>", "<div class=wrap>{}</div>", "{}", "<article class='post-7 post tag-news category-search'>{}</article>", "<article id='share-prices'>{}</article>"):
        page = f"<html><body>{outer.format(inner)}<div class=links><a href=/a>One link</a><a href=/b>Another link</a></div></body></html>"
        assert alone(page) == "\n".join(PARTS), outer
    rows = [(k, "http://h.com/a", f"<body><article class='post-{k} tag-{'xyz'[k]}'>{inner}</article><div class=teaser>Other text</div></body>") for k in range(3)]
    assert {r["text"] for r in h.extract(pages(spark, rows)).collect()} == {"\n".join(PARTS)}


def test_sections_of_one_text():
    for kind in ("section", "section class=s{}", "blockquote", "div class=part{}"):
        parts = "".join(f"<{kind.format('abc'[k])}><p>{x}</p></{kind.split()[0]}>" for k, x in enumerate(PARTS))
        for outer in ("article", "main", "div"):
            assert alone(f"<body><{outer}>{parts}</{outer}></body>") == "\n".join(PARTS), (kind, outer)
    sections = "".join(f"<section class={'abc'[k]}><p>{x}</p></section>" for k, x in enumerate(PARTS))
    assert alone(f"<body>{sections}</body>") == "\n".join(PARTS)
    cells = "".join(f"<tr><td><p>{x}</p></td></tr>" for x in PARTS)
    assert alone(f"<article><h1>Head of table</h1><table>{cells}</table></article>") == "\n".join(["Head of table", *PARTS])


def test_links_and_notices_beside_the_text_stay_out():
    links = "<div class=more><p><a href=/a>Five words in a link here</a></p><p><a href=/b>Five more words in a link</a></p></div>"
    page = f"<body><div class=wrap><h1>{PARTS[0]}</h1><div class=body><p>{LONG}</p></div>{links}</div></body>"
    assert alone(page) == PARTS[0] + "\n" + LONG.strip()
    assert alone(f"<body><article class=promo><p>{LONG}</p></article><div><p>{PARTS[1]}</p></div></body>") == PARTS[1]


def test_parts_of_an_article_that_are_no_boilerplate_stay():
    parts = ["Filed under things", "By someone on a day", "Nothing was found for it", "x + y", "An end of five words here"]
    page = "<article><p class='tags'>{}</p><p class='meta'>{}</p><div class='search-results'>{}</div><math><mi>x</mi> + <mi>y</mi></math><p class=copyright>{}</p></article>"
    assert alone(page.format(*parts[:3], parts[4])) == "\n".join(parts)


def test_unclosed_quote():
    assert alone("<article><p>One two three four five.</p><a href=\"x>six seven</a><p>eight</p></article>") == "One two three four five.\nsix seven\neight"


def test_depth_costs_no_square():
    import time

    began = time.perf_counter()
    for n in (20_000, 100_000):
        deep = "<div class=x>" * n + "deep text of five words" + "</i></div>" * n
        assert alone(deep) == "deep text of five words"
    assert time.perf_counter() - began < 30
    assert alone("<div>words " * 5000) == "\n".join(["words"] * 5000)


def test_nulls_and_empty(spark):
    rows = [(1, None, PAGE), (2, "http://x.org/", None), (3, "http://x.org/", ""), (None, "http://x.org/", "<p>a b c d e f</p>"), (4, "http://x.org/", "<div>" * 3000 + "deep text of five words" + "</div>" * 3000), (4, None, PAGE)]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in h.extract(pages(spark, rows)).collect()}
    assert got[(1, None)] == got[(4, None)] == (TEXT, len(TEXT))
    assert got[(2, "http://x.org/")] == got[(3, "http://x.org/")] == ("", 0)
    assert got[(4, "http://x.org/")][0] == "deep text of five words"
    assert h.extract(pages(spark, [])).count() == 0


def test_whole_articles(spark, sf):
    import html
    import re

    from signalrank.session import table

    got = {r["page_id"]: r["text"] for r in h.op4_html_text(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


@pytest.mark.parametrize(
    "wrap",
    [
        "<div style='overflow:hidden'>{}</div>", "<div style=\"visibility: visible; overflow: hidden\">{}</div>", "<div data-hidden=no>{}</div>", "<div data-role='form'>{}</div>", "<div data-id=menu-1>{}</div>",
        "<div title='role=\"form\" class=nav'>{}</div>", "<div title='the hidden cost'>{}</div>", "<div data-class=sidebar aria-label='hidden'>{}</div>", "<div class=main class=nav>{}</div>", "<div CLASS='Text' = hidden-x>{}</div>",
    ],
)
def test_words_in_values_are_no_attributes(wrap):
    inner = f"<h1>{PARTS[0]}</h1><p>{PARTS[1]}</p><p>{LONG}</p>"
    assert alone(f"<html><body>{wrap.format(inner)}</body></html>") == "\n".join(PARTS)
    assert alone(f"<main style='overflow-x: hidden'>{inner}</main>") == "\n".join(PARTS)


def test_words_in_values_of_small_elements():
    page = "<article><p title='the hidden cost'>One two three four five.</p><p data-id='menu-1'>Six seven.</p><p data-role=form>Eight <a title='hidden' href=/x>nine</a> ten.</p><p hidden>Gone</p><p HIDDEN=''>Gone</p><p class=nav>Gone</p><p role='search'>Gone</p><p aria-hidden=true>Gone</p></article>"
    assert alone(page) == "One two three four five.\nSix seven.\nEight nine ten."


def test_names_that_only_hold_such_a_word_stay():
    kept = ["related-work", "comments-on-theory", "social-history", "share-price", "notice-board", "navigation-history", "ad-hoc", "menuitem", "head-of-state", "footnotes", "cookie-recipe", "modalVerbs", "no-sidebar"]
    page = "<article>" + "".join(f"<div class='{n}'><p>Words about {n} in five.</p></div><p id={n}>More of {n} here too.</p>" for n in kept) + "</article>"
    assert alone(page) == "\n".join(x for n in kept for x in (f"Words about {n} in five.", f"More of {n} here too."))
    gone = ["related", "relatedPosts", "related-articles-2", "comments", "comment-list", "site-footer", "social-links", "share-buttons", "nav-menu", "mainNav", "cookie_notice", "ad", "ad-slot-top", "sidebar-right", "newsletter-signup", "post-12 promo", "breadcrumbs"]
    page = "<body><article><p>One two three four five.</p></article>" + "".join(f"<div class='{n}'><p>Words about this in five or more.</p></div>" for n in gone) + "</body>"
    assert alone(page) == "One two three four five."


def test_labels_and_pictures_of_an_article_stay():
    page = "<article><p>One two three four five.</p><label>A label</label><video>No such film.</video><svg><title>Gone</title><text>Axis of years</text></svg></article>"
    assert alone(page) == "One two three four five.\nA labelNo such film.Axis of years"
