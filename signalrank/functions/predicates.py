"""Filters as boolean Columns. Word lists are parameters with defaults; null counts as missing and never fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalrank.functions.text import doi_in_text, normalize_doi, url_host, whole_phrase

# What captions begin with, econ terms and journals, repositories, places, editorial notices.
CAPTION = (
    r"(?i)^\s*(the|this|an?)\s+(image|photo|picture|graphic|graph|chart|visual(?![\p{L}\p{N}_])|visualization|infographic|screenshot|tweet|post|figure|map|table|data visualization|accompanying)"
)
ECON_TERMS = (
    r"(?i)\b(econom(ic|ics)|development|poverty|inequality|labor|labour|employment|wage|inflation|gdp|productivity|public finance|tax|fiscal|monetary|trade|"
    r"urban|housing|migration|education|health economics|microfinance|randomized|rct|difference-in-differences|instrumental variable|firm|household|consumption|expenditure|prices|policy)\b"
)
ECON_JOURNALS = r"(?i)\b(economic|econometrica|economics|journal of|review of|development|labor|labour|public economics|urban economics|political economy|european economic)\b"
BLOCKED_DOIS = ["10.5281/", "10.17632/", "10.6084/"]
BLOCKED_DOMAINS = ["zenodo.org", "hal.science", "figshare.com", "osf.io", "arxiv.com", "researchsquare.com"]
INDIA = r"(?i)\bindia\b|india|iit|iim\b|isi\b|jnu\b|delhi|mumbai|ncaer|\bcpr\b|icrier|bangalore|kolkata|chennai|hyderabad|pune"
ANNOUNCEMENT = r"(?i)\b(new\s+(working\s+)?paper|working\s+paper|just\s+published|forthcoming)\b"
EDITORIAL_EXACT = ["front matter", "back matter", "editorial", "editorial board", "erratum", "corrigendum", "issue information", "announcement", "masthead"]
EDITORIAL_START = r"^(correction to|corrigendum to|erratum to|retraction|report of the|editor'?s? (note|report)|book review|call for papers)"


def yes(fits: Column) -> Column:
    """A predicate of which null means no."""
    return F.coalesce(fits, F.lit(False))


def is_caption(text: Column) -> Column:
    return yes(F.rlike(text, F.lit(CAPTION)))


def is_known_handle(handle: Column, instances: list[str], handles: list[str]) -> Column:
    """The handle is on a known instance, or its stem before the host is known."""
    low = F.lower(F.coalesce(handle, F.lit("")))
    stem = F.substring_index(F.regexp_replace(low, "^@+", ""), "@", 1)
    on = [F.contains(low, F.lit(i)) for i in instances]
    fits = stem.isin(handles) if handles else F.lit(False)
    for one in on:
        fits = fits | one
    return fits


def names_topic(text: Column, topics: list[str]) -> Column:
    """Some topic stands as a whole phrase in the text."""
    if not topics:
        return F.lit(False)
    return yes(F.rlike(F.lower(text), F.lit(whole_phrase([t.lower() for t in topics]))))


def is_econ_post(content: Column, handle: Column, paper_id: Column, instances: list[str], handles: list[str], core: list[str]) -> Column:
    """No caption, and linked to a paper, or with what looks like a DOI, a known handle or a core topic."""
    has_doi = F.contains(F.lower(content), F.lit("doi.org/")) | F.rlike(content, F.lit(r"10\.\d{4,}/"))
    return ~is_caption(content) & (paper_id.isNotNull() | yes(has_doi) | is_known_handle(handle, instances, handles) | names_topic(content, core))


def passes_gate(content: Column, handle: Column, allowed: list[str], tags: list[str], keyword_score: Column) -> Column:
    """Known account, DOI, hashtag or some keyword."""
    fits = F.lower(F.coalesce(handle, F.lit(""))).isin([a.lower() for a in allowed]) | doi_in_text(content).isNotNull() | (keyword_score > 0)
    for tag in tags:
        fits = fits | F.contains(F.lower(content), F.lit(f"#{tag.lower()}"))
    return yes(fits)


def is_clean_deadline(name: Column, due: Column, curated: Column) -> Column:
    """No caption; dated, or rolling and curated."""
    return ~is_caption(name) & F.coalesce(name != "", F.lit(False)) & (due.isNotNull() | yes(curated))


def is_econ_paper(doi: Column, jel: Column, text: Column) -> Column:
    """Not from a blocked registrant, and with a code or an econ term."""
    return ~is_blocked_doi(doi) & (yes(F.size(jel) > 0) | yes(F.rlike(text, F.lit(ECON_TERMS))))


def is_blocked_doi(doi: Column, prefixes: list[str] = BLOCKED_DOIS) -> Column:
    bare = F.coalesce(normalize_doi(doi), F.lit(""))
    fits = F.lit(False)
    for prefix in prefixes:
        fits = fits | bare.startswith(prefix)
    return fits


def is_blocked_link(url: Column, domains: list[str] = BLOCKED_DOMAINS) -> Column:
    """The link's host is a blocked domain or below one."""
    host = F.regexp_replace(url_host(url), r":\d+$", "")
    fits = F.lit(False)
    for domain in domains:
        fits = fits | (host == domain) | host.endswith(f".{domain}")
    return fits


def is_editorial(title: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return low.isin(EDITORIAL_EXACT) | F.rlike(low, F.lit(EDITORIAL_START))


def names_india(text: Column) -> Column:
    """Text names the country or an institution in it; alternatives are not anchored, as the source has them."""
    return yes(F.rlike(text, F.lit(INDIA)))


def since(day: Column, cutoff: Column) -> Column:
    """A DATE column against a date: this reaches the scan as a pushed filter."""
    return day >= cutoff


def is_announcement(text: Column) -> Column:
    return yes(F.rlike(text, F.lit(ANNOUNCEMENT)))


def feed_filter(sources: list[str] | None, least: float, topics: list[str], search: str, india_only: bool, starred_only: bool, show_hidden: bool) -> Column:
    """Of feed rows (source, score, topics, title, authors, abstract, india, starred, hidden): chosen source, score, all topics, search text, flags."""
    fits = F.coalesce(F.col("score"), F.lit(0.0)) >= least
    if sources:
        fits = fits & F.col("source").isin(sources)
    if topics:
        fits = fits & (F.size(F.array_except(F.array(*map(F.lit, topics)), F.coalesce("topics", F.array().cast("array<string>")))) == 0)
    if search:
        fits = fits & F.contains(F.lower(F.concat_ws(" ", "title", F.array_join("authors", " "), "abstract")), F.lit(search.lower()))
    if india_only:
        fits = fits & yes(F.col("india"))
    if starred_only:
        fits = fits & yes(F.col("starred"))
    return fits if show_hidden else fits & ~yes(F.col("hidden"))
