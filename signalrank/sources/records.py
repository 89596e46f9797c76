"""JSON payloads of bibliographic services to paper records. Input is text, one JSON document a row in `value`; what does not parse gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalrank.functions import dates, text
from signalrank.functions.predicates import is_blocked_doi, is_blocked_link, is_editorial
from signalrank.sources.schemas import CROSSREF_WORK, OPENALEX_WORK, PAPER_COLUMNS, RECOMMENDATIONS, SEARCH_RESULT, WDS, WDS_DOCUMENT

# Work types and what they are stored as.
WORK_TYPES = {"article": "journal_article", "journal-article": "journal_article", "review": "journal_article", "book-chapter": "book_chapter", "dissertation": "dissertation"}


def no_texts() -> Column:
    return F.array().cast("array<string>")


def parsed(rows: DataFrame, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fields of the JSON objects in `value`, and the columns to carry, which say where a row is from; fields that do not fit are null."""
    # By a generator, as Spark puts the conditions of later steps before a projection, where they parse the text once for each field they ask.
    return rows.select(*carry, "value", F.inline(F.array_compact(F.array(F.from_json("value", schema)))))


def _names(items: Column) -> Column:
    return F.filter(F.transform(F.coalesce(items, no_texts()), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def openalex_works(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Papers with an extra column author_details (name, openalex_id, orcid, affiliation, country). Fields of levels 0 and 1 and the source's name are keywords."""
    work = parsed(rows, OPENALEX_WORK, carry)
    doi = text.bare_doi(F.col("doi"))
    source_url = F.coalesce(text.blank_to_null(F.col("primary_location.landing_page_url")), text.blank_to_null(F.col("id")))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), source_url)
    named = F.filter(F.coalesce("authorships", F.array().cast("array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string,country_code:string>>>>")), lambda a: F.trim(F.coalesce(a["author"]["display_name"], F.lit(""))) != "")
    details = F.transform(
        named,
        lambda a: F.struct(
            F.trim(a["author"]["display_name"]).alias("name"), text.last_segment(a["author"]["id"]).alias("openalex_id"),
            text.blank_to_null(F.regexp_replace(a["author"]["orcid"], r"^https?://orcid\.org/", "")).alias("orcid"),
            text.blank_to_null(F.get(a["institutions"], F.lit(0))["display_name"]).alias("affiliation"), text.blank_to_null(F.get(a["institutions"], F.lit(0))["country_code"]).alias("country"),
        ),
    )
    fields = F.transform(F.filter(F.coalesce("concepts", F.array().cast("array<struct<display_name:string,level:int>>")), lambda c: c["level"] <= 1), lambda c: c["display_name"])
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in WORK_TYPES.items()], F.lit("working_paper"))
    found = work.select(
        *carry, F.trim(F.coalesce("title", "display_name")).alias("title"), F.transform(details, lambda d: d["name"]).alias("authors"), F.nullif(text.from_inverted(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        doi.alias("doi"), url.alias("url"), F.nullif("publication_date", F.lit("")).alias("published_at"), kind.alias("paper_type"), no_texts().alias("jel_codes"),
        F.concat(_names(fields), _names(F.array(F.col("primary_location.source.display_name")))).alias("keywords"), F.lit("openalex").alias("source"), text.last_segment(F.col("id")).alias("source_id"), source_url.alias("source_url"),
        details.alias("author_details"),
    )
    return found.where("title <> ''")


def without_repositories(papers: DataFrame) -> DataFrame:
    return papers.where(~(is_blocked_doi(F.col("doi")) | is_blocked_link(F.col("url")) | is_blocked_link(F.col("source_url"))))


def work_gate(from_date: str, fields: list[str], kinds: list[str], venues: list[str] | None, countries: list[str] | None) -> Column:
    """The service's filter on parsed works (published_at, field, paper_type, venue, country) as one pushed condition; None asks nothing."""
    fits = (F.col("published_at") >= from_date) & F.col("field").isin(fields) & F.col("paper_type").isin(kinds)
    if venues is not None:
        fits = fits & F.col("venue").isin(venues)
    if countries is not None:
        fits = fits & F.col("country").isin(countries)
    return fits


def message_items(rows: DataFrame) -> DataFrame:
    """Works of journal pages, whose answers hold them as message.items: rows with one work in `value` and `item`, its place; other columns stay."""
    items = F.from_json("value", "message struct<items:array<string>>")["message"]["items"]
    return rows.select(*[c for c in rows.columns if c != "value"], F.posexplode(items).alias("item", "value"))


def crossref_works(rows: DataFrame, as_of: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Journal articles; those without title or DOI, and editorial matter, go. The date is the earlier of online and created, never after tomorrow."""
    work = parsed(rows, CROSSREF_WORK, carry)
    day = lambda c: dates.from_parts(F.col(f"`{c}`.`date-parts`"))
    published = dates.published_on(day("published-online"), day("created"), [day("issued"), day("published-print")], as_of)
    title = F.trim(F.get("title", F.lit(0)))
    names = F.transform(F.coalesce("author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", text.blank_to_null(a["given"]), text.blank_to_null(a["family"])))
    doi = text.blank_to_null(F.col("DOI"))
    url = F.coalesce(text.blank_to_null(F.col("URL")), F.concat(F.lit("https://doi.org/"), doi))
    found = work.select(
        *carry, title.alias("title"), _names(names).alias("authors"), F.nullif(text.strip_markup(F.col("abstract")), F.lit("")).alias("abstract"), doi.alias("doi"), url.alias("url"),
        F.date_format(published, "yyyy-MM-dd").alias("published_at"), F.lit("journal_article").alias("paper_type"), no_texts().alias("jel_codes"), no_texts().alias("keywords"), F.lit("crossref").alias("source"),
        doi.alias("source_id"), url.alias("source_url"),
    )
    return found.where(F.coalesce(F.col("title") != "", F.lit(False)) & F.col("doi").isNotNull() & ~is_editorial(F.col("title")))


def worldbank_documents(rows: DataFrame) -> DataFrame:
    """Papers of responses whose documents are a map that also holds facets; entries without id or title go. Extra columns repnb, pdfurl, guid."""
    each = parsed(rows, WDS).select(F.explode("documents").alias("key", "value"))
    doc = parsed(each.select("value"), WDS_DOCUMENT)
    title = text.squeeze(F.coalesce(text.blank_to_null(F.col("display_title")), F.try_element_at("docna", F.lit("0"))["docna"]))
    ordered = F.array_sort(F.transform(F.map_entries("authors"), lambda e: F.struct(e["key"].cast("int").alias("n"), e["value"]["author"].alias("name"))))
    found = doc.select(
        title.alias("title"), _names(F.transform(ordered, lambda a: a["name"])).alias("authors"), F.nullif(text.squeeze(F.try_element_at("abstracts", F.lit("cdata!"))), F.lit("")).alias("abstract"),
        text.blank_to_null(F.col("dois")).alias("doi"), text.blank_to_null(F.col("url")).alias("url"), F.when(F.length("docdt") >= 10, F.substring("docdt", 1, 10)).alias("published_at"),
        F.lit("working_paper").alias("paper_type"), no_texts().alias("jel_codes"), no_texts().alias("keywords"), F.lit("worldbank").alias("source"), text.blank_to_null(F.col("id")).alias("source_id"),
        text.blank_to_null(F.col("url")).alias("source_url"), "repnb", "pdfurl", "guid",
    )
    return found.where("title <> '' and source_id is not null")


def recommended_papers(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Papers of recommendation responses; those without id or title go. One with an arXiv id and no DOI is a working paper."""
    each = parsed(rows, RECOMMENDATIONS, carry).select(*carry, F.explode("recommendedPapers").alias("r")).select(*carry, "r.*")
    ids = lambda k: text.blank_to_null(F.try_element_at("externalIds", F.lit(k)))
    url = text.blank_to_null(F.col("url"))
    found = each.select(
        *carry, F.trim("title").alias("title"), _names(F.transform("authors", lambda a: a["name"])).alias("authors"), text.blank_to_null(F.col("abstract")).alias("abstract"), ids("DOI").alias("doi"), url.alias("url"),
        F.date_format(dates.year_start(F.col("year")), "yyyy-MM-dd").alias("published_at"), F.when(ids("DOI").isNull() & ids("ArXiv").isNotNull(), "working_paper").otherwise("journal_article").alias("paper_type"),
        no_texts().alias("jel_codes"), no_texts().alias("keywords"), F.lit("semantic_scholar").alias("source"), text.blank_to_null(F.col("paperId")).alias("source_id"), url.alias("source_url"),
    )
    return found.where("title <> '' and source_id is not null")


def seeds(papers: DataFrame, most: int) -> DataFrame:
    """(doi, rank) of the best papers (doi, rank) to recommend from: each DOI at its best rank."""
    return papers.where("doi <> ''").groupBy("doi").agg(F.min("rank").alias("rank")).orderBy("rank", "doi").limit(most)


CRUFT = r"(?i),?\s*WP/\d{2}/\d+\s*(?:,\s*[A-Za-z]+\s+\d{4})?\s*$"
DATED_URL = r"(?i)/publications/wp/issues/\d{4}/\d{2}/\d{2}/|/wp/\d{4}/"
SLUG = r"(?i)wpiea\d{7}"
NUMBER = r"(?i)\bwp/\d{2}/\d+"


def search_papers(rows: DataFrame) -> DataFrame:
    """Papers of search results whose authors are a text, a list of texts or a list of objects, and whose fields have several names. Section pages and stubs go."""
    each = parsed(rows, SEARCH_RESULT)
    first = lambda *cs: F.coalesce(*[text.blank_to_null(F.col(c)) for c in cs])
    raw = first("author", "authors")
    as_texts = F.from_json(raw, "array<string>")
    as_objects = F.from_json(raw, "array<struct<name:string,author:string,display_name:string>>")
    names = (
        F.when(F.startswith(raw, F.lit("[{")), F.transform(as_objects, lambda a: F.coalesce(a["name"], a["author"], a["display_name"])))
        .when(F.startswith(raw, F.lit("[")), as_texts).otherwise(F.split(raw, r"[,;]|\band\b"))
    )
    url = first("url", "id")
    doi = F.coalesce(first("doi"), text.doi_in_text(F.when(F.contains(F.lower(url), F.lit("doi.org/")), url)))
    abstract = first("text", "summary", "description")
    rows = each.select(
        F.trim("title").alias("title"), _names(names).alias("authors"), abstract.alias("abstract"), doi.alias("doi"), url.alias("url"),
        F.date_format(dates.parse_any(F.substring(first("publishedDate", "published_date", "publishedAt", "date"), 1, 10)), "yyyy-MM-dd").alias("published_at"), F.lit("working_paper").alias("paper_type"),
        no_texts().alias("jel_codes"), no_texts().alias("keywords"), F.lit("imf").alias("source"), F.concat(F.lit("imf-exa-"), text.short_hash(F.coalesce(first("id"), first("url"), F.trim("title")), 8)).alias("source_id"), url.alias("source_url"),
    )
    numbered = F.rlike(F.coalesce("url", F.lit("")), F.lit(DATED_URL)) | F.rlike(F.coalesce("url", F.lit("")), F.lit(SLUG)) | F.rlike("title", F.lit(NUMBER))
    content = (F.size("authors") > 0) | F.col("abstract").isNotNull()
    kept = rows.where((F.lower("title") != "imf working papers") & (F.length("title") >= 20) & (numbered | content))
    return kept.withColumn("title", F.trim(F.regexp_replace("title", CRUFT, ""))).dropDuplicates(["source_id"]).select(*PAPER_COLUMNS)


def venue_of(meta: Column) -> Column:
    """Venue in stored metadata (JSON text): a text, the first of a list, or a nested name, under one of several keys."""
    one = lambda p: text.blank_to_null(F.get_json_object(meta, p))
    plain = [F.when(~F.rlike(F.coalesce(one(p), F.lit("")), F.lit(r"^[\[{]")), one(p)) for p in ("$.journal", "$.venue", "$.journal_name", "$.container_title")]
    lists = [one(p) for p in ("$['container-title'][0]", "$.container_title[0]")]
    nested = [one(p) for p in ("$.primary_location.source.display_name", "$.host_venue.display_name", "$.journal.name", "$.primary_location.display_name")]
    return F.coalesce(*lists, *nested, *plain)


def venue_words(meta: Column) -> Column:
    """All venue names in stored metadata as one text, for term matching."""
    paths = ["$.journal", "$.venue", "$.journal_name", "$.container_title", "$['container-title']", "$.host_venue", "$.primary_location"]
    return F.lower(F.regexp_replace(F.concat_ws(" ", *[F.get_json_object(meta, p) for p in paths]), r'[\[\]{}":,]+', " "))


def listed_field(value: Column, separator: str = ",") -> Column:
    """A list stored as JSON or joined by a separator, as a trimmed array."""
    return _names(F.when(F.startswith(F.trim(value), F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.split(value, F.lit(rf"\Q{separator}\E"))))
