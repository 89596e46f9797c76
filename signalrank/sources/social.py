"""Posts of social services, and papers announced in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalrank.functions import dates, text
from signalrank.functions.predicates import is_announcement
from signalrank.sources.records import parsed
from signalrank.sources.schemas import BSKY_POST, POST_COLUMNS, STATUS

MOST_CHARS = 2000
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _stamp(raw: Column) -> Column:
    """UTC stamp of an ISO time with any zone; its first 19 characters where it does not parse."""
    time = F.try_to_timestamp(raw)
    return F.when(raw != "", F.coalesce(F.date_format(time, STAMP), F.concat(F.substring(raw, 1, 19), F.lit("Z"))))


def mastodon_posts(rows: DataFrame) -> DataFrame:
    """Posts of statuses; local accounts are qualified by the URL's host; without URL or text they go. First of each URL by row order."""
    status = parsed(rows, STATUS)
    url = F.coalesce(text.blank_to_null(F.col("url")), text.blank_to_null(F.col("uri")))
    acct = text.blank_to_null(F.col("account.acct"))
    handle = F.concat(F.lit("@"), F.when(F.contains(acct, F.lit("@")), acct).otherwise(F.concat_ws("@", acct, F.nullif(F.regexp_replace(text.url_host(url), r":\d+$", ""), F.lit("")))))
    content = text.strip_html_inline(F.col("content"))
    found = status.select(
        F.lit("mastodon").alias("source"), url.alias("source_id"), handle.alias("author_handle"), F.substring(content, 1, MOST_CHARS).alias("content"), url.alias("url"), text.doi_in_text(content).alias("doi"),
        dates.engagement(F.coalesce("favourites_count", F.lit(0)) + F.coalesce("reblogs_count", F.lit(0))).alias("engagement_score"), _stamp(F.col("created_at")).alias("published_at"),
    )
    return found.where("url is not null and content <> ''").dropDuplicates(["source_id"])


def bluesky_posts(rows: DataFrame) -> DataFrame:
    """Posts with a web link made from their address; a working-paper link stands for its DOI."""
    post = parsed(rows, BSKY_POST)
    did, key = (F.regexp_extract("uri", r"^at://([^/]+)/[^/]+/([^/]+)$", k) for k in (1, 2))
    handle = F.coalesce(text.blank_to_null(F.col("author.handle")), did)
    body = F.col("record.text")
    found = post.where(key != "").select(
        F.lit("bluesky").alias("source"), F.col("uri").alias("source_id"), handle.alias("author_handle"), F.substring(body, 1, MOST_CHARS).alias("content"),
        F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), key).alias("url"), F.coalesce(text.doi_in_text(body), text.nber_doi(body)).alias("doi"),
        dates.engagement(F.coalesce("likeCount", F.lit(0)) + F.coalesce("repostCount", F.lit(0)) + F.coalesce("replyCount", F.lit(0))).alias("engagement_score"),
        _stamp(F.coalesce(text.blank_to_null(F.col("record.createdAt")), F.col("indexedAt"))).alias("published_at"),
    )
    return found.where("content <> ''").dropDuplicates(["source_id"])


def tracked_posts(feeds: DataFrame, authors: DataFrame) -> DataFrame:
    """Posts of landed author feeds (handle, value) whose handle a tracked author (is_tracked, bluesky_handle) has; each post once."""
    wanted = authors.where("is_tracked").select(F.trim("bluesky_handle").alias("handle")).where("handle <> ''").distinct()
    return bluesky_posts(feeds.withColumn("handle", F.trim("handle")).join(wanted, "handle", "left_semi").select("value"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Posts of both, those of `second` only where `first` lacks their id."""
    return first.select(*POST_COLUMNS).unionByName(second.select(*POST_COLUMNS).join(first.select("source_id"), "source_id", "left_anti"))


def linked(posts: DataFrame, papers: DataFrame) -> DataFrame:
    """posts with the paper_id of their DOI; of papers that share a DOI the least id. Posts without a match have null."""
    ids = papers.select(text.normalize_doi(F.col("doi")).alias("_doi"), "paper_id").where("_doi is not null").groupBy("_doi").agg(F.min("paper_id").alias("paper_id"))
    return posts.withColumn("_doi", text.normalize_doi(F.col("doi"))).join(ids, "_doi", "left").drop("_doi")


def announced(posts: DataFrame, results: DataFrame, chrome: str, most: int = 12) -> DataFrame:
    """Papers announced in posts: the first `most` announcements (seq, source_id, content) with their search result (source_id, title, url, text, author, published).

    A result needs a DOI, or a title of 15 characters once the page's chrome is off it; each DOI or title comes once.
    """
    first = posts.where(is_announcement(F.col("content"))).orderBy("seq").limit(most).select("seq", "source_id")
    title = text.strip_title_chrome(F.col("title"), chrome)
    rows = first.join(results, "source_id").withColumns({"title": title, "doi": F.coalesce(text.doi_in_text(F.col("url")), text.doi_in_text(F.col("text")))})
    rows = rows.where(F.col("doi").isNotNull() | (F.length("title") >= 15)).withColumn("key", F.coalesce(F.lower("doi"), text.normalize_title(F.col("title"))))
    once = rows.groupBy("key").agg(F.min_by(F.struct("title", "url", "text", "author", "published", "doi"), "seq").alias("r")).select("r.*")
    return once.withColumns({"authors": text.split_authors(F.coalesce("author", F.lit(""))), "canonical_id": text.canonical_id(F.col("title"), text.split_authors(F.coalesce("author", F.lit(""))))})
