"""XML feeds: Atom, RSS 2.0 and RDF (RSS 1.0) files to paper records. Malformed files give no rows; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.functions import dates, text
from signalrank.operators.resolve import keep_first
from signalrank.sources.schemas import ATOM_ENTRY, PAPER_COLUMNS, RDF_ITEM, RSS_ITEM



def no_texts() -> Column:
    return F.array().cast("array<string>")


def read_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements `tag` of the XML files under `path`, namespaces dropped; elements that are no XML go."""
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").option("ignoreNamespace", "true").schema(schema).load(path)
    return rows.select("*", file_order().alias("seq"))


def file_order() -> Column:
    """Place of a row in the files it is read from: file, part of the file, row. Only the last comes from the partition, where it follows the part."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))


def _clean_list(items: Column) -> Column:
    return F.coalesce(F.filter(F.transform(items, text.squeeze), lambda x: x != ""), no_texts())


def arxiv_papers(entries: DataFrame) -> DataFrame:
    """Papers of Atom entries. Versions are no part of the id; of repeated ids the first in the files stays, or by id and title where `seq` is not given. Extra columns: arxiv_id, pdf_url, primary_category, comment."""
    paper_id = text.arxiv_id(F.trim("id"))
    base = text.strip_version(paper_id)
    last = lambda fits: F.element_at(F.filter("link", fits), -1)["_href"]
    page = last(lambda x: (x["_rel"] == "alternate") & F.coalesce(x["_type"] != "application/pdf", F.lit(True)))
    pdf = last(lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf"))
    some_link = F.size(F.coalesce("link", F.array().cast("array<struct<_href:string,_rel:string,_type:string,_title:string>>"))) > 0
    rows = (entries if "seq" in entries.columns else entries.withColumn("seq", F.struct("id", "title"))).select(
        text.squeeze(F.col("title")).alias("title"), _clean_list(F.transform("author", lambda a: a["name"])).alias("authors"), F.nullif(text.squeeze(F.col("summary")), F.lit("")).alias("abstract"),
        text.blank_to_null(F.col("doi")).alias("doi"), F.when(some_link, F.try_element_at(F.transform(F.array(page), lambda x: x), F.lit(1))).alias("page"),
        F.date_format(dates.parse_iso(F.col("published")), "yyyy-MM-dd").alias("published_at"), F.lit("working_paper").alias("paper_type"), no_texts().alias("jel_codes"),
        _clean_list(F.transform("category", lambda c: c["_term"])).alias("keywords"), F.lit("arxiv").alias("source"), F.coalesce(base, text.blank_to_null(F.col("id"))).alias("source_id"),
        paper_id.alias("arxiv_id"), F.trim("id").alias("id_url"), pdf.alias("pdf_url"), F.col("primary_category._term").alias("primary_category"), F.nullif(text.squeeze(F.col("comment")), F.lit("")).alias("comment"), "seq",
    )
    url = F.coalesce("page", F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id")), F.nullif("id_url", F.lit("")))
    rows = rows.withColumns({"url": url, "source_url": url}).where("title <> '' and source_id is not null")
    return keep_first(rows, "source_id", "seq").select(*PAPER_COLUMNS, "arxiv_id", "pdf_url", "primary_category", "comment")


def nber_papers(items: DataFrame) -> DataFrame:
    """Papers of RSS items with a byline in the title; items without a paper number go."""
    link = F.coalesce(text.blank_to_null(F.col("link")), text.blank_to_null(F.col("guid")))
    parts = text.split_byline(F.trim("title"))
    url = F.nullif(F.substring_index(link, "#", 1), F.lit(""))
    rows = items.select(
        parts["title"].alias("title"), parts["authors"].alias("authors"), text.blank_to_null(F.col("description")).alias("abstract"), F.lit(None).cast("string").alias("doi"), url.alias("url"),
        F.lit(None).cast("string").alias("published_at"), F.lit("working_paper").alias("paper_type"), no_texts().alias("jel_codes"), no_texts().alias("keywords"), F.lit("nber").alias("source"),
        text.working_paper_number(link).alias("source_id"), url.alias("source_url"),
    )
    return rows.where("title <> '' and source_id is not null")


def enriched(papers: DataFrame, pages: DataFrame) -> DataFrame:
    """papers with date and DOI of their landing pages (source_id, html), where the page names them."""
    meta = lambda name: F.nullif(F.regexp_extract("html", rf'(?i)<meta\s+name="{name}"\s+content="([^"]*)"', 1), F.lit(""))
    found = pages.select("source_id", F.date_format(dates.parse_any(F.replace(meta("citation_publication_date"), F.lit("/"), F.lit("-"))), "yyyy-MM-dd").alias("page_date"), meta("citation_doi").alias("page_doi"))
    rows = papers.join(found.groupBy("source_id").agg(F.max("page_date").alias("page_date"), F.max("page_doi").alias("page_doi")), "source_id", "left")
    return rows.withColumns({"published_at": F.coalesce("page_date", "published_at"), "doi": F.coalesce("page_doi", "doi")}).drop("page_date", "page_doi")


def within_lookback(papers: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Papers of the last `days`, undated ones too; 0 keeps all."""
    if days <= 0:
        return papers
    return papers.where(F.col("published_at").isNull() | (dates.parse_iso(F.col("published_at")).cast("date") >= F.date_sub(as_of, days)))


def nep_papers(items: DataFrame, code: str) -> DataFrame:
    """Papers of RDF items of one list: keyed by their archive handle, else by list and title hash; codes are read from the abstract."""
    link = F.coalesce(text.blank_to_null(F.col("link")), text.blank_to_null(F.col("_about")))
    handle = text.repec_handle(link)
    title = F.trim("title")
    keywords = F.filter(F.transform(F.split(F.coalesce("subject", F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = items.select(
        title.alias("title"), _clean_list(F.col("creator")).alias("authors"), text.blank_to_null(F.col("description")).alias("abstract"), F.lit(None).cast("string").alias("doi"), link.alias("url"),
        F.date_format(dates.parse_any(F.col("date")), "yyyy-MM-dd").alias("published_at"), F.lit("working_paper").alias("paper_type"), text.jel_codes(F.coalesce("description", F.lit(""))).alias("jel_codes"),
        keywords.alias("keywords"), F.lit("repec_nep").alias("source"), F.coalesce(F.lower(handle), F.concat(F.lit(f"{code}:"), text.short_hash(title, 10, "sha1"))).alias("source_id"), link.alias("source_url"),
    )
    return rows.where("title <> ''")


def list_codes(listed: str) -> list[str]:
    """Codes of a configured list: lower case, in order, once each."""
    return list(dict.fromkeys(c.strip().lower() for c in listed.replace(";", ",").split(",") if c.strip()))


def rss_posts(items: DataFrame, entries: DataFrame, feed: str) -> DataFrame:
    """Posts of a feed's RSS items and Atom entries (schemas RSS_ITEM, ATOM_ENTRY): keyed by the link, content of at most 2000 characters."""
    as_items = items.select(F.trim("link").alias("url"), "title", F.col("description").alias("body"), F.date_format(dates.parse_mail_date(F.col("pubDate")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    as_entries = entries.select(F.trim(F.get("link", F.lit(0))["_href"]).alias("url"), "title", F.col("summary").alias("body"), F.date_format(dates.parse_iso(F.col("published")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    rows = as_items.unionByName(as_entries).where("url <> ''")
    content = F.when(F.coalesce("body", F.lit("")) != "", F.substring(text.strip_html(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("body"))), 1, 2000)).otherwise(F.coalesce("title", F.lit("")))
    rows = rows.select(
        F.lit("rss").alias("source"), F.concat(F.lit("rss:"), text.short_hash(F.col("url"), 12)).alias("source_id"), F.lit(feed).alias("author_handle"), content.alias("content"), "url",
        text.doi_in_text(content).alias("doi"), F.lit(0.0).alias("engagement_score"), "published_at",
    )
    return rows.dropDuplicates(["source_id"])


def rss_of(spark: SparkSession, path: str) -> DataFrame:
    return read_rows(spark, path, "item", RSS_ITEM)


def atom_of(spark: SparkSession, path: str) -> DataFrame:
    return read_rows(spark, path, "entry", ATOM_ENTRY)


def rdf_of(spark: SparkSession, path: str) -> DataFrame:
    return read_rows(spark, path, "item", RDF_ITEM)
