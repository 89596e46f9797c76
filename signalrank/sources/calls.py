"""Deadlines: grant hits, funder and conference pages with curated fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalrank.functions import dates, text
from signalrank.operators import features
from signalrank.sources.records import parsed
from signalrank.sources.schemas import GRANTS

GRANT_TERMS = r"(?i)\b(econom|urban|housing|poverty|development|social science|research|policy|land|migration)"
CONTEXT_WORDS = ["deadline", "due", "closes?", "closing", "submissions?", "apply by", "applications?"]


def grant_calls(rows: DataFrame, terms: str = GRANT_TERMS) -> DataFrame:
    """Dated calls of grant search responses whose title names a term."""
    hits = parsed(rows, GRANTS).select(F.explode("data.oppHits").alias("h")).select("h.*")
    due = dates.parse_slash(F.col("closeDate"))
    found = hits.select(
        F.lit("grant").alias("type"), text.squeeze(text.decode_twice(F.col("title"))).alias("name"), F.trim("agency").alias("organization"), due.alias("deadline_date"),
        F.concat(F.lit("https://www.grants.gov/search-results-detail/"), F.col("id")).alias("url"), F.array_join("cfdaList", ", ").alias("programs"),
    )
    fits = found.where(F.rlike("name", F.lit(terms)) & F.col("deadline_date").isNotNull())
    return fits.groupBy("name").agg(F.min(F.struct("deadline_date", "url", *(c for c in found.columns if c not in ("name", "deadline_date", "url")))).alias("x")).select("name", "x.*").select(*found.columns)


def scored_calls(rows: DataFrame, gate: float = features.GATE) -> DataFrame:
    """Calls (name, organization, description, tier, eligibility, india_eligible) with their `relevance`; those without a tier need the gate."""
    text_of = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("organization", F.lit("")))
    found = rows.withColumn("relevance", features.funding_score(text_of, F.col("tier"), F.col("eligibility"), F.col("india_eligible")))
    return found.where(F.col("tier").isNotNull() | (F.col("relevance") >= gate))


def funding_calls(hits: DataFrame, registry: DataFrame, today: Column) -> DataFrame:
    """Grant hits and the dates of a registry (name, organization, url, description, tier, eligibility, india_eligible, explicit, month, second_month, recurrence), scored; of one name and date the registry's stays."""
    columns = ["name", "organization", "url", "description", "tier", "eligibility", "india_eligible", "deadline_date"]
    none = F.lit(None).cast("string")
    found = hits.select("name", "organization", "url", F.lit("").alias("description"), none.alias("tier"), none.alias("eligibility"), none.cast("boolean").alias("india_eligible"), "deadline_date")
    known = curated_calls(registry, today).select(*columns)
    same = F.lower(F.trim("k.name")) == F.lower(F.trim("h.name"))
    rest = found.alias("h").join(known.alias("k"), same & F.col("k.deadline_date").eqNullSafe(F.col("h.deadline_date")), "left_anti")
    return scored_calls(known.unionByName(rest.select(*columns)))


def curated_calls(registry: DataFrame, today: Column) -> DataFrame:
    """Dated rows of a registry (name, organization, url, explicit, month, second_month, recurrence), one for each date; without any date one rolling row."""
    due = dates.curated_dates(F.col("explicit"), F.col("month"), F.col("second_month"), F.col("recurrence"), today)
    return registry.withColumn("deadline_date", F.explode_outer(due)).withColumn("is_rolling", F.col("deadline_date").isNull())


def scraped_calls(pages: DataFrame, registry: DataFrame, today: Column, keep_days: int = 30) -> DataFrame:
    """Dates and descriptions of funder pages (name, html), else the registry's; dates more than `keep_days` past go."""
    plain = text.strip_html_capped(F.col("html"), 200_000)
    found = pages.select("name", dates.deadline_dates(plain, CONTEXT_WORDS).alias("dates"), text.first_paragraph(F.col("html"), ["research", "grant", "fund", "support"]).alias("page_text"))
    recent = F.filter("dates", lambda d: d >= F.date_sub(today, keep_days))
    rows = registry.join(found, "name", "left")
    curated = dates.curated_dates(F.col("explicit"), F.col("month"), F.col("second_month"), F.col("recurrence"), today)
    due = F.when(F.size(recent) > 0, recent).otherwise(curated)
    return rows.select("name", "organization", "url", F.coalesce("page_text", F.lit("")).alias("description"), F.explode_outer(due).alias("deadline_date")).withColumn("is_rolling", F.col("deadline_date").isNull())


def conference_calls(pages: DataFrame, registry: DataFrame, today: Column) -> DataFrame:
    """Conferences (name, organization, url, deadline_month, event_month) with the dates on their pages (name, html, sub_html); a call's own page comes first.

    Without a date on a page the typical month stands in, and an event is never before its deadline.
    """
    body = text.strip_html(F.coalesce(text.blank_to_null(F.col("sub_html")), F.col("html")))
    around = text.window_around(body, r"(?i)(call for papers|submission deadline|important dates)", 0, 600)
    after = lambda words: dates.first_date(F.regexp_extract(body, rf"(?is)\b(?:{words})\b(.{{0,160}})", 1))
    link = F.regexp_extract("html", r'(?is)<a\b[^>]*href="([^"]+)"[^>]*>[^<]*call for papers', 1)
    found = pages.select("name", after("deadline|submit by|submission|due").alias("due"), after("conference dates?|will be held|takes place|held on").alias("event"), around.alias("snippet"), F.nullif(link, F.lit("")).alias("href"))
    rows = registry.join(found, "name", "left")
    due = F.coalesce("due", dates.month_start_from(F.col("deadline_month"), today))
    rows = rows.withColumn("deadline_date", due)
    return rows.select(
        "name", "organization", F.coalesce(text.absolute_link(F.col("href"), F.col("url")), F.col("url")).alias("url"), "deadline_date",
        F.coalesce(F.when(F.col("event") >= F.col("deadline_date"), F.col("event")), dates.month_start_from(F.col("event_month"), F.col("deadline_date"))).alias("event_date"), "snippet",
    )
