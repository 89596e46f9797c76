"""Listing and detail pages of paper series: cards, anchors and ordered fallbacks, as regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalrank.functions import dates, text

LEAST_ABSTRACT, MOST_ABSTRACT = 60, 5000


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _first(html: Column, patterns: list[str]) -> Column:
    """First pattern that gives something, stripped."""
    return F.coalesce(*[F.nullif(text.strip_html(F.regexp_extract(html, p, 1)), F.lit("")) for p in patterns])


def listing_cards(pages: DataFrame, link: str = r"/publications?/dp/(\d+)") -> DataFrame:
    """(paper_number, title, authors, date, url) of the article cards of listing pages (url, html); pages without cards give their anchors instead.

    Authors are the card's text without its title, number and date.
    """
    cards = _all(F.col("html"), r"(?is)<article\b[^>]*>(.*?)</article>")
    anchors = _all(F.col("html"), rf'(?is)(<a\b[^>]*href="[^"]*{link}[^"]*"[^>]*>.*?</a>)')
    each = pages.select(F.col("url").alias("page"), F.explode(F.when(F.size(cards) > 0, cards).otherwise(anchors)).alias("card"))
    href = F.regexp_extract("card", r'(?is)href="([^"]*)"', 1)
    title = text.anchor_text(F.regexp_extract("card", rf'(?is)<a\b[^>]*href="[^"]*{link}[^"]*"[^>]*>(.*?)</a>', 2))
    plain = text.strip_html(F.col("card"))
    day = F.regexp_extract(plain, r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b", 1)
    rest = F.regexp_replace(F.replace(F.replace(plain, title, F.lit(" ")), day, F.lit(" ")), r"(?i)IZA\s+DP\s+No\.?\s*\d+:?|\b\d+\b", " ")
    rows = each.select(
        F.regexp_extract(href, link, 1).cast("string").alias("paper_number"), title.alias("title"), text.split_authors(text.squeeze(F.regexp_replace(rest, r"(?i)^\s*by\s+", ""))).alias("authors"),
        F.date_format(dates.parse_long(day), "yyyy-MM-dd").alias("published_at"), text.absolute_link(href, F.col("page")).alias("url"),
    )
    return rows.where("paper_number <> '' and title <> ''").dropDuplicates(["paper_number"])


def detail_fields(pages: DataFrame) -> DataFrame:
    """(paper_number, title, authors, abstract, date, doi, jel_codes, keywords) of detail pages (paper_number, html), each by the first form that is there."""
    html = F.col("html")
    meta = lambda name: rf'(?is)<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"'
    abstract = F.coalesce(*[
        F.when(F.length(a) >= LEAST_ABSTRACT, F.substring(a, 1, MOST_ABSTRACT))
        for p in (r'(?is)<div[^>]*class="[^"]*abstract[^"]*"[^>]*>(.*?)</div>', r"(?is)<h\d[^>]*>\s*Abstract\s*</h\d>\s*<p[^>]*>(.*?)</p>", meta("citation_abstract"), meta("description"))
        for a in [text.strip_html(F.regexp_extract(html, p, 1))]
    ])
    return pages.select(
        "paper_number", _first(html, [meta("citation_title"), r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title>(.*?)</title>"]).alias("title"), F.array_distinct(_all(html, meta("citation_author"))).alias("authors"),
        abstract.alias("abstract"), F.date_format(dates.parse_any(F.replace(_first(html, [meta("citation_publication_date"), meta("citation_date")]), F.lit("/"), F.lit("-"))), "yyyy-MM-dd").alias("published_at"),
        F.coalesce(text.blank_to_null(F.regexp_extract(html, meta("citation_doi"), 1)), text.doi_in_text(text.strip_html(html))).alias("doi"), text.jel_codes(text.strip_html(html)).alias("jel_codes"),
        F.filter(F.transform(F.split(F.coalesce(_first(html, [meta("citation_keywords"), meta("keywords")]), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "").alias("keywords"),
    )


def completed(cards: DataFrame, details: DataFrame, last_number: int, since: Column | None = None) -> DataFrame:
    """Cards beyond the last stored number, with details where the page was read; old ones go."""
    new = cards.where(F.col("paper_number").cast("long") > last_number).alias("c").join(details.alias("d"), "paper_number", "left")
    rows = new.select(
        "paper_number", F.coalesce("c.title", "d.title").alias("title"), F.when(F.size("d.authors") > 0, F.col("d.authors")).otherwise(F.col("c.authors")).alias("authors"), "d.abstract",
        F.coalesce("d.published_at", "c.published_at").alias("published_at"), "d.doi", "d.jel_codes", "d.keywords", "c.url",
    )
    return rows if since is None else rows.where(F.col("published_at").isNull() | (F.col("published_at") >= F.date_format(since, "yyyy-MM-dd")))


def between_anchors(pages: DataFrame, link: str) -> DataFrame:
    """Papers of pages (url, html) on which each paper is an anchor and the text up to the next one: (source_id, title, authors, date, jel_codes, url).

    The page is cut before every paper anchor, so a cut holds one anchor and what follows it.
    """
    cuts = F.slice(F.split("html", rf'(?i)(?=<a\b[^>]*href="[^"]*{link})'), 2, 1_000_000)
    each = pages.select(F.col("url").alias("page"), F.posexplode(cuts).alias("pos", "part"))
    href = F.regexp_extract("part", r'(?is)^<a\b[^>]*href="([^"]*)"', 1)
    title = text.anchor_text(F.regexp_extract("part", r"(?is)^<a\b[^>]*>(.*?)</a>", 1))
    after = text.strip_html(F.regexp_replace("part", r"(?is)^<a\b[^>]*>.*?</a>", " "))
    authors = text.split_authors(F.regexp_replace(F.regexp_extract(after, r"^(?:by\s+)?([^.;(\[]*?)(?:[.;(\[]|\b(?:19|20)\d\d\b|$)", 1), r"[,\s]+$", ""))
    rows = each.select(
        text.short_hash(href, 12).alias("source_id"), title.alias("title"), authors.alias("authors"), F.date_format(dates.season_or_month(F.regexp_extract(after, r"((?:[A-Za-z]+\s+)?(?:19|20)\d\d)", 1)), "yyyy-MM-dd").alias("published_at"),
        text.jel_codes(after).alias("jel_codes"), text.absolute_link(href, F.col("page")).alias("url"), "page", "pos",
    )
    return rows.where("title <> ''").dropDuplicates(["source_id"]).drop("page", "pos")
