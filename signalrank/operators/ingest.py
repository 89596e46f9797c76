"""Composed ingest: a batch of records is matched to the store, merged or inserted, with its sightings, authors and links.

The store is four tables: papers (id, title, doi, abstract, url, published_at, paper_type, jel_codes, keywords), sources
(source, source_id, paper_id, source_url, raw_metadata), authors (author_id, name, name_normalized, affiliation) and links
(paper_id, author_id, position). A record takes the paper that the match cascade finds; records that find none are one
paper where they are the same work, under the least of their ids. Where a loop would let each record meet those before it,
a batch lets all of them meet, so a chain of similar records becomes one paper whatever their order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalrank.functions import text
from signalrank.operators import resolve, store
from signalrank.session import cut

METADATA = ["doi", "abstract", "paper_type", "jel_codes", "keywords", "published_at"]


class Store(NamedTuple):
    papers: DataFrame
    sources: DataFrame
    authors: DataFrame
    links: DataFrame


def named(papers: DataFrame, authors: DataFrame, links: DataFrame) -> DataFrame:
    """(id, title, doi, authors) of stored papers, names by position."""
    each = links.join(authors.select("author_id", "name"), "author_id").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("position", "author_id", "name"))).alias("x"))
    names = F.coalesce(F.transform("x", lambda a: a["name"]), F.array().cast("array<string>"))
    return papers.join(each, F.col("id") == F.col("paper_id"), "left").select("id", "title", "doi", names.alias("authors"))


def placed(batch: DataFrame, match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, paper_id, is_new) for each record of `batch` (id, title, doi, authors): the stored paper that `match` (id, existing_id) finds it to be, or the first record of its own work."""
    asked = batch.select("id", "title", "doi", "authors")
    found = cut(match(asked))
    works = resolve.same_work(asked.join(found, "id", "left_anti"))
    old = found.select("id", F.col("existing_id").alias("paper_id"), F.lit(False).alias("is_new"))
    return old.unionByName(works.select("id", F.col("cluster").alias("paper_id"), (F.col("id") == F.col("cluster")).alias("is_new")))


class Changes(NamedTuple):
    """What a batch does to a store: papers and authors as they are after it, the sources and links that it adds, and where each record went (id, paper_id, is_new)."""

    papers: DataFrame
    authors: DataFrame
    sources: DataFrame
    links: DataFrame
    went: DataFrame


def changes(batch: DataFrame, held: Store, match: Callable[[DataFrame], DataFrame] | None = None) -> Changes:
    """What `batch` does to the store. match, where given, finds its stored papers, as `TitleIndex.match` does; else all stored papers are gone through.

    batch: (id, title, authors, doi, abstract, url, published_at, paper_type, jel_codes, keywords, affiliations, source,
    source_id, source_url, raw_metadata). Its ids are numbers from 0 on that no stored paper has, in the order of arrival.
    """
    went = cut(placed(batch, match or (lambda asked: resolve.match_existing(asked, named(held.papers, held.authors, held.links)))))
    rows = cut(batch.join(went, "id"))
    touched = held.papers.join(went.select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi")
    history = touched.select(F.col("id").alias("paper_id"), F.lit(-1).cast("long").alias("at"), *METADATA).unionByName(rows.select("paper_id", F.col("id").cast("long").alias("at"), *METADATA))
    merged = resolve.merged_all(history, "paper_id", "at")
    base = touched.select("id", "title", "url").unionByName(rows.where("is_new").select("id", "title", "url"))
    changed = base.join(merged.withColumnRenamed("paper_id", "id"), "id").select(*held.papers.columns)
    papers = held.papers.join(base.select("id"), "id", "left_anti").select(*held.papers.columns).unionByName(changed)
    seen = rows.select("source", "source_id", "paper_id", "source_url", "raw_metadata", F.col("id").alias("_at"))
    sources = store.new_rows(seen, held.sources, ["source", "source_id"], "_at").drop("_at")
    each = rows.select("paper_id", "id", "affiliations", F.posexplode("authors").alias("position", "name"))
    each = each.select("paper_id", "id", "position", "name", text.normalize_name(F.col("name")).alias("name_normalized"), F.nullif(F.get("affiliations", F.col("position")), F.lit("")).alias("affiliation"))
    each = cut(each)
    longest = F.max_by("affiliation", F.struct(F.length(F.coalesce("affiliation", F.lit(""))), -F.col("id"), -F.col("position")))
    people = each.groupBy("name_normalized").agg(F.min_by("name", F.struct("id", "position")).alias("name"), longest.alias("affiliation")).withColumn("author_id", F.xxhash64("name_normalized"))
    rules = store.AUTHOR_RULES | {"name": store.first_of, "author_id": store.first_of}
    authors = cut(store.upsert(people.select(*held.authors.columns), held.authors, ["name_normalized"], rules).select(*held.authors.columns))
    pairs = each.join(authors.select("name_normalized", "author_id"), "name_normalized").select("paper_id", "author_id", "position", F.struct("id", "position").alias("_at"))
    links = store.new_rows(pairs, held.links, ["paper_id", "author_id"], "_at").drop("_at")
    return Changes(papers, authors, sources, links, went)


def ingest(batch: DataFrame, held: Store) -> tuple[Store, DataFrame]:
    """The store with `batch` in it, and where each record went. See `changes`."""
    found = changes(batch, held)
    return Store(found.papers, held.sources.unionByName(found.sources), found.authors, held.links.unionByName(found.links)), found.went
