"""Text, name and identifier normalisation as Catalyst expressions.

Every function takes and returns a Column and stays inside the JVM, but for the exact accent folding and entity
decoding at the end, which are Arrow UDFs. Null input gives null, or the empty value where that is said.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters without a decomposition and what they are written as.
LETTER_PAIRS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ŋ": "ng"}
LETTER_SINGLES = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i"}
# Names of working-paper series that are no part of a title.
SERIES = [
    r"nber\s+working\s+paper\s*(no\.?\s*)?\d*",
    r"working\s+paper\s*(no\.?\s*)?\d*",
    r"discussion\s+paper\s*(no\.?\s*)?\d*",
    r"technical\s+report\s*\d*",
    r"research\s+paper\s*\d*",
    r"\bnber\b",
    r"\bcepr\b",
    r"\bimf\b",
    r"\bwber\b",
]
#: A text without any of these words holds no series name.
SERIES_WORDS = ["paper", "report", "nber", "cepr", "imf", "wber"]
#: Passes over the series patterns that all titles get. One removal can make another pattern appear; what still has one then goes on until none is left.
SERIES_PASSES = 2
NAME_SUFFIX = r"\b(jr\.?|sr\.?|ii|iii|iv|phd|ph\.d\.?)\b"
DOI_FORMS = r"^(https?://(dx\.)?doi\.org/|doi\.org/|doi:)"
# Forms of DOIs in free text.
DOI_MARKED = r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)(10\.\d{4,9}/[^\s\"'<>]+)"
DOI_BARE = r"(?<![/\p{L}\p{N}_])(10\.\d{4,9}/[^\s\"'<>]{4,})"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&")]
JEL_CODE = r"\b([A-Z]\d{1,2})\b"
# Fixed value: a character of a word in any script. What \b means differs by Java version.
WORD = r"[\p{L}\p{N}_]"


#: No character from here on decomposes to ASCII.
LAST_FOLDED = 0x1F300


def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters that Unicode decomposes to one ASCII character, those characters, and what decomposes to several: tables made by rule."""
    accented, plain, several = [], [], {}
    for char in map(chr, range(0x80, LAST_FOLDED)):
        if not unicodedata.decomposition(char) or char in LETTER_PAIRS or char in LETTER_SINGLES:
            continue
        base = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(base) == 1:
            accented.append(char)
            plain.append(base)
        elif base:
            several[char] = base
    return "".join(accented), "".join(plain), several


ACCENTED, PLAIN, SEVERAL = _folding()
_SEVERAL = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in SEVERAL) + "]"
_NO_ASCII_NOR_SEVERAL = "[^\\x00-\\x7F" + _SEVERAL[1:]
NOT_ASCII = "[^\\x00-\\x7F]"


def _ranges(chars: str) -> str:
    """Body of a character class that holds `chars`, by ranges."""
    codes, body = sorted(map(ord, chars)), ""
    held = set(codes)
    for first in (c for c in codes if c - 1 not in held):
        last = next(c for c in range(first, codes[-1] + 1) if c + 1 not in held)
        body += f"\\x{{{first:X}}}-\\x{{{last:X}}}"
    return body


#: Latin letters that become ASCII without a look at each, by LETTER_PAIRS or character by character.
_NOT_LATIN = "[^\\x00-\\x7F" + _ranges("".join(c for c in [*ACCENTED, *LETTER_PAIRS, *LETTER_SINGLES] if c < "\u0250")) + "]"


def let(value: Column, body) -> Column:
    """body(value), with `value` made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def whole_phrase(phrases: list[str]) -> str:
    """Pattern of one of `phrases` with no character of a word, in any script, before or after it."""
    return rf"(?<!{WORD})(?:" + "|".join(rf"\Q{p}\E" for p in phrases) + rf")(?!{WORD})"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def strip_accents(text: Column) -> Column:
    """ASCII form of a text by Unicode's decompositions; characters without one are left out.

    ASCII texts pass as they are, and texts of Latin letters meet one table; only others are searched for ligatures and the like.
    """
    latin = text
    for letter, pair in LETTER_PAIRS.items():
        latin = F.replace(latin, F.lit(letter), F.lit(pair))
    latin = F.translate(latin, "".join(LETTER_SINGLES) + ACCENTED, "".join(LETTER_SINGLES.values()) + PLAIN)
    return F.when(~F.rlike(text, F.lit(NOT_ASCII)), text).when(~F.rlike(text, F.lit(_NOT_LATIN)), latin).otherwise(let(latin, _spelled))


def _spelled(text: Column) -> Column:
    """A text with characters that stand for several ASCII ones spelled out, the rest outside ASCII left out."""
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in SEVERAL.items())), F.lit("\x01"), F.lit("\x02"))
    each = F.transform(F.split(F.regexp_replace(text, _NO_ASCII_NOR_SEVERAL, ""), ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(known, c), c)))
    return F.regexp_replace(F.when(F.rlike(text, F.lit(_SEVERAL)), F.array_join(each, "")).otherwise(text), NOT_ASCII, "")


def normalize_title(title: Column) -> Column:
    """Lower-case ASCII title without series names and punctuation; null gives the empty string."""

    def once(text: Column) -> Column:
        for pattern in SERIES:
            text = F.regexp_replace(text, pattern, "")
        return text

    def cleared(text: Column) -> Column:
        passed = text
        for _ in range(SERIES_PASSES):
            passed = once(passed)
        # Each further pass takes away a name of three letters at least.
        rest = lambda t: F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(t) / 3).cast("int")), t, lambda x, _: once(x))
        return let(passed, lambda t: F.when(F.rlike(t, F.lit("|".join(SERIES))), rest(t)).otherwise(t))

    may_name = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(word)) for word in SERIES_WORDS])
    text = let(F.lower(strip_accents(F.coalesce(title, F.lit("")))), lambda t: F.when(may_name(t), cleared(t)).otherwise(t))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalize_name(name: Column) -> Column:
    """Lower-case ASCII name without suffixes; hyphens within a name stay; the order of parts is kept."""
    text = F.regexp_replace(F.lower(strip_accents(F.coalesce(name, F.lit("")))), NAME_SUFFIX, "")
    text = F.regexp_replace(F.replace(text, F.lit(","), F.lit(" ")), r"[^a-z0-9\s-]", "")
    return squeeze(F.regexp_replace(text, r"(?<!\w)-|-(?!\w)", " "))


def last_name(name: Column) -> Column:
    """Family name: the first part before a comma, else the last part; empty when there is none."""
    head = F.split(normalize_name(F.substring_index(name, ",", 1)), " ")
    tail = F.split(normalize_name(name), " ")
    return F.coalesce(F.when(F.contains(name, F.lit(",")), F.element_at(head, 1)).otherwise(F.element_at(tail, -1)), F.lit(""))


def last_names(names: Column) -> Column:
    """Sorted family names of an array of names, repeats kept, empty ones left out."""
    return F.array_sort(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), last_name), lambda x: x != ""))


def canonical_id(title: Column, names: Column) -> Column:
    """16 hex digits of the SHA-256 of normalised title and sorted family names."""
    return F.substring(F.sha2(F.concat(normalize_title(title), F.lit("|"), F.array_join(last_names(names), ",")), 256), 1, 16)


def title_tokens(title: Column) -> Column:
    """Distinct tokens of a title, normalised here."""
    return tokens_of(normalize_title(title))


def tokens_of(normalized: Column) -> Column:
    """Distinct tokens of a title that is normalised already."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def shared_last_names(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(last_names(a), last_names(b)))


def normalize_doi(doi: Column) -> Column:
    """Bare lower-case identifier; null when nothing is left."""
    return blank_to_null(F.regexp_replace(F.lower(F.trim(doi)), DOI_FORMS, ""))


def bare_doi(doi: Column) -> Column:
    """Identifier without its URL form, case kept."""
    return blank_to_null(F.regexp_replace(doi, r"^https?://(dx\.)?doi\.org/", ""))


def doi_in_text(text: Column) -> Column:
    """First DOI in free text: a URL or doi: form before a bare one, which ends in four characters at least; closing punctuation is no part of it. Null when there is none."""
    marked = F.regexp_extract(text, DOI_MARKED, 1)
    bare = F.regexp_extract(text, DOI_BARE, 1)
    return F.nullif(F.regexp_replace(F.coalesce(F.nullif(marked, F.lit("")), bare), r"[.,;)]+$", ""), F.lit(""))


def nber_doi(text: Column) -> Column:
    """DOI of a working paper whose landing page is linked in the text."""
    number = F.regexp_extract(text, r"(?i)nber\.org/papers/(w\d+)", 1)
    return F.when(number != "", F.concat(F.lit("10.3386/"), F.lower(number)))


def decode_entities(text: Column) -> Column:
    """The common character references, decoded once; `&amp;` last."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def decode_twice(text: Column) -> Column:
    """For doubly encoded feeds."""
    return decode_entities(decode_entities(text))


def _without_raw(html_text: Column) -> Column:
    return F.regexp_replace(html_text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")


def strip_html_inline(html_text: Column) -> Column:
    """Text of an inline fragment: blocks and breaks part words, other tags do not."""
    text = F.regexp_replace(_without_raw(html_text), r"(?i)<br\s*/?>|</?(p|div|li|ul|ol|h[1-6]|blockquote)\b[^>]*>", " ")
    return squeeze(decode_entities(F.regexp_replace(text, r"<[^>]+>", "")))


def strip_html(html_text: Column) -> Column:
    """Text of a page: every tag parts words."""
    return squeeze(decode_entities(F.regexp_replace(_without_raw(html_text), r"<[^>]+>", " ")))


def strip_html_capped(html_text: Column, most: int) -> Column:
    """Text of a page, of which only hard spaces are decoded, at most `most` characters: a feature of the funding reader."""
    text = F.regexp_replace(_without_raw(html_text), r"<[^>]+>", " ")
    return F.substring(squeeze(F.replace(text, F.lit("&nbsp;"), F.lit(" "))), 1, most)


def strip_markup(text: Column) -> Column:
    """Abstract without its XML tags."""
    return squeeze(F.regexp_replace(text, r"<[^>]+>", " "))


def anchor_text(html_text: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(html_text, r"<[^>]+>", "")))


def snippet(text: Column, most: int, tail: str = "…") -> Column:
    """At most `most` characters of squeezed text, then the tail if any were cut; null gives the empty string."""
    clean = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most)), F.lit(tail))).otherwise(clean)


def from_inverted(index: Column) -> Column:
    """Text of an inverted index {token: [positions]}; of two tokens at one position the later in the map stays."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    last = F.map_entries(F.aggregate(placed, F.create_map().cast("map<int,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["p"]), F.create_map(x["p"].cast("int"), x["t"]))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(last), lambda e: e["value"]), " "))


def last_segment(url: Column) -> Column:
    """Last path segment of an identifier URL."""
    return F.nullif(F.substring_index(F.rtrim(F.regexp_replace(url, r"/+$", "")), "/", -1), F.lit(""))


def url_host(url: Column) -> Column:
    """Lower-case network location; empty for what is no URL."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def arxiv_id(url: Column) -> Column:
    """Identifier in an abstract or PDF link, its version included; null when there is none."""
    return F.nullif(F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([^\s?#]+?)(?:\.pdf)?$", 1), F.lit(""))


def strip_version(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"v\d+$", "")


def repec_handle(link: Column) -> Column:
    """Handle in a percent-encoded link; null when there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(F.try_url_decode(link), link), r"(?i)(repec:[^&\s]+)", 1), F.lit(""))


def split_byline(title: Column) -> Column:
    """struct(title, authors) of "Title -- by A, B and C"; without a byline the authors are empty."""
    parts = F.split(title, r"\s+--\s+by\s+", 2)
    names = F.filter(F.transform(F.split(F.coalesce(F.get(parts, 1), F.lit("")), r",\s*|\s+and\s+|\s*&\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.trim(F.get(parts, 0)).alias("title"), names.alias("authors"))


def working_paper_number(link: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(link, r"(?i)/papers/(w\d+)", 1)), F.lit(""))


def split_authors(text: Column, least: int = 2, most: int = 80) -> Column:
    """Names in a list written with commas, semicolons, "and" or "&": trimmed, of bounded length, ordered and distinct."""
    parts = F.transform(F.split(F.regexp_replace(text, r"(?i)\s+and\s+|\s*&\s*|;", ","), ","), squeeze)
    return F.array_distinct(F.filter(parts, lambda x: F.length(x).between(least, most)))


def jel_codes(text: Column) -> Column:
    """Distinct codes behind a "JEL" label, in order of appearance."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?i)JEL(?:\s+(?:codes?|classification))?\s*(?:\([^)]*\))?\s*[:\-]?\s*((?:[A-Z]\d{1,2}[\s,;]*)+)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b: F.regexp_extract_all(F.upper(b), F.lit(JEL_CODE), F.lit(1)))))


def strip_title_chrome(title: Column, chrome: str, least: int = 15) -> Column:
    """Title without what matches `chrome`, if at least `least` characters are left."""
    short = squeeze(F.regexp_replace(title, chrome, ""))
    return F.when(F.length(short) >= least, short).otherwise(squeeze(title))


def short_hash(text: Column, digits: int, kind: str = "md5") -> Column:
    """Leading hex digits of an md5, sha1 or sha256."""
    return F.substring({"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}[kind](text.cast("binary")), 1, digits)


def request_key(request: Column, digits: int = 16) -> Column:
    """Cache key of a request struct; its fields must be sorted by name."""
    return F.substring(F.sha2(F.to_json(request), 256), 1, digits)


def library_tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case terms of three or more characters, repeats kept, stop words left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z0-9\-]{2,})"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(stop)) if stop else found


def library_name(name: Column) -> Column:
    """Name as the library writes it: lower case, apostrophes and hyphens kept."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z'\s-]", " "))


def library_last_name(name: Column) -> Column:
    return F.element_at(F.split(library_name(name), " "), -1)


def score_bar(score: Column, width: int = 10) -> Column:
    """#### ---- bar of a score between 0 and 1; halves round to even."""
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.rint(score * width).cast("int")))
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def author_line(names: Column, most: int = 3) -> Column:
    """First names joined by a comma, and how many more there are."""
    more = F.size(names) - most
    line = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(more > 0, F.concat(line, F.lit(" +"), more.cast("string"))).otherwise(line)


def type_label(kind: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(kind, F.lit("")), F.lit("_"), F.lit(" ")))


def paper_link(url: Column, doi: Column) -> Column:
    """The URL, else the DOI's resolver link, else the empty string."""
    return F.coalesce(blank_to_null(url), F.concat(F.lit("https://doi.org/"), blank_to_null(doi)), F.lit(""))


def escape_html(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def handle_label(handle: Column) -> Column:
    """Handle with exactly one leading at sign."""
    return F.concat(F.lit("@"), F.regexp_replace(handle, r"^@+", ""))


def cache_key(doi: Column, paper_id: Column, title: Column) -> Column:
    """doi:..., else id:..., else title:... with the SHA-1 of the normalised title; null when all are missing."""
    named = F.when(normalize_title(title) != "", F.concat(F.lit("title:"), F.sha1(normalize_title(title).cast("binary"))))
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), F.concat(F.lit("id:"), paper_id.cast("string")), named)


def window_around(text: Column, heading: str, before: int, after: int) -> Column:
    """Text around the first match of `heading`; null when there is none."""
    at = F.regexp_instr(text, F.lit(heading))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.trim(F.substr(text, start, at + after - start)))


def absolute_link(href: Column, page_url: Column) -> Column:
    """Link on a page made absolute by the page's scheme and host."""
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), url_host(page_url))
    return (
        F.when(F.rlike(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace(page_url, r"[^/]*$", ""), href))
    )


def first_paragraph(html_text: Column, keywords: list[str], least: int = 60, most: int = 500) -> Column:
    """Text of the first paragraph of more than `least` characters that names a keyword; null when there is none."""
    found = F.transform(F.regexp_extract_all(html_text, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), strip_html)
    fit = F.filter(found, lambda p: (F.length(p) > least) & F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(p), k)))
    return F.substring(F.get(fit, 0), 1, most)


@F.pandas_udf(StringType())
def strip_accents_exact(text: pd.Series) -> pd.Series:
    """As strip_accents, for every script: Unicode's own decompositions."""
    table = str.maketrans(LETTER_PAIRS | LETTER_SINGLES)
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s.translate(table)).encode("ascii", "ignore").decode("ascii"))


@F.pandas_udf(StringType())
def decode_entities_exact(text: pd.Series) -> pd.Series:
    """All named and numeric character references, decoded twice."""
    return text.map(lambda s: None if s is None else html.unescape(html.unescape(s)))
