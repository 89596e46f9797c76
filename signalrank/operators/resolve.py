"""Entity resolution in batch: the match cascade, merging of metadata, collapse of the same work, suppression of what was seen.

Papers carry (id, title, authors, doi, ...). The cascade takes the first step that hits: equal DOI, equal normalised
title, title similarity of 0.85, title similarity of 0.70 with two shared family names; within a step the lowest id.
Its OR of criteria is a union of equi joins; nothing is compared pairwise beyond what a shared key or rare token brings.
Titles that normalise to nothing match no other title. Where a per-row cascade looks only at titles with the longest
word, this finds every pair at the thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalrank.functions import text
from signalrank.operators.components import groups
from signalrank.operators.similarity import matches, represented, representative_pairs
from signalrank.session import cut, scratch

HIGH, LOW, SHARED = 0.85, 0.70, 2
# Rank of paper types, most authoritative first.
TYPE_RANK = {"journal_article": 2, "working_paper": 1}


def keyed(papers: DataFrame) -> DataFrame:
    """papers with their normalised title, DOI, title tokens and family names."""
    rows = papers.withColumns({"title_key": text.normalize_title(F.col("title")), "doi_key": text.normalize_doi(F.col("doi")), "families": F.array_distinct(text.last_names(F.col("authors")))})
    return rows.withColumns({"tokens": text.tokens_of(F.col("title_key")), "title_key": F.nullif("title_key", F.lit(""))})


def match_existing(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, existing_id, step) for the papers of `new` that are in `stored`. Keys and tokens of both are made once, in written tables; an empty store costs no comparison."""
    with scratch(new.sparkSession) as kept:
        b = cut(keyed(stored).select(F.col("id").alias("existing_id"), "title_key", F.col("doi").alias("doi_key"), "tokens", F.col("families").alias("stored_families")))
        if b.isEmpty():
            return kept(b.where(F.lit(False)).join(new.select("id"), F.lit(True)).select("id", "existing_id", F.lit(1).alias("step")), narrow=True)
        a = cut(keyed(new).select("id", "title_key", F.col("doi").alias("doi_key"), "tokens", "families"))
        hit = lambda df, step: df.select("id", "existing_id", F.lit(step).alias("step"))
        # The lowest id of a key decides, so many stored papers with one key are one row.
        lowest = lambda *keys: b.groupBy(*keys).agg(F.min("existing_id").alias("existing_id"))
        by_doi = hit(a.where("doi_key <> ''").join(lowest("doi_key"), "doi_key"), 1)
        by_title = hit(a.join(lowest("title_key"), "title_key"), 2)
        sets = a.where(F.size("tokens") > 0).select("id", F.array_sort("tokens").alias("tokens"), F.array_sort("families").alias("families"))
        firsts = sets.groupBy("tokens", "families").agg(F.min("id").alias("first"))
        known = lowest(F.array_sort("tokens").alias("tokens"), F.array_sort("stored_families").alias("stored_families"))
        near = matches(firsts.select(F.col("first").alias("id"), "tokens"), known.select(F.col("existing_id").alias("id"), "tokens"), LOW)
        near = near.select(F.col("a").alias("first"), F.col("b").alias("existing_id"), "jaccard").join(firsts, "first").join(known.select("existing_id", "stored_families"), "existing_id")
        shared = F.size(F.array_intersect("families", "stored_families"))
        step = F.when(F.col("jaccard") >= HIGH - 1e-12, 3).when(shared >= SHARED, 4)
        best = near.select("tokens", "families", "existing_id", step.alias("step")).where("step is not null").groupBy("tokens", "families").agg(F.min(F.struct("step", "existing_id")).alias("x"))
        fuzzy = sets.join(best, ["tokens", "families"]).select("id", "x.existing_id", "x.step")
        every = by_doi.unionByName(by_title).unionByName(fuzzy)
        return kept(every.groupBy("id").agg(F.min(F.struct("step", "existing_id")).alias("x")).select("id", "x.existing_id", "x.step"), narrow=True)


def same_work_edges(papers: DataFrame) -> DataFrame:
    """(a, b) of papers that are the same work by one of the criteria. Equal keys are joined to their first paper, not to each other."""
    rows = cut(keyed(papers).select("id", "title_key", "doi_key", "tokens", "families"))  # made once for all criteria
    star = lambda key: (
        rows.where(F.col(key).isNotNull()).select("id", key).join(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("first")), key)
        .where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    )
    # One paper stands for all with the same tokens and families; the others are tied to it by their title.
    firsts = rows.where(F.size("tokens") > 0).groupBy("tokens", "families").agg(F.min("id").alias("id"))
    copies = rows.alias("r").join(firsts.alias("f"), ["tokens", "families"]).where("r.id <> f.id").select(F.col("f.id").alias("a"), F.col("r.id").alias("b"))
    # Papers with equal tokens are the same work whatever their families, so they are tied to one of them, which stands for all in a similar pair.
    sets = firsts.select("id", "tokens")
    members = represented(sets)
    equal = members.where("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"))
    near = representative_pairs(sets, LOW)
    families = firsts.select("id", "families").join(members, "id")
    fa, fb = (families.select(F.col("representative").alias(s), F.col("families").alias(f"f{s}")).distinct() for s in "ab")
    some = near.where(F.col("jaccard") < HIGH - 1e-12).join(fa, "a").join(fb, "b").where(F.size(F.array_intersect("fa", "fb")) >= SHARED).select("a", "b").distinct()
    near = near.where(F.col("jaccard") >= HIGH - 1e-12).select("a", "b").unionByName(some)
    return star("doi_key").unionByName(star("title_key")).unionByName(copies).unionByName(equal).unionByName(near)


def same_work(papers: DataFrame) -> DataFrame:
    """(id, cluster): cluster is the least id of the papers that are, directly or by others, the same work."""
    with scratch(papers.sparkSession) as kept:
        found = groups(papers.select(F.col("id").alias("node")).distinct(), same_work_edges(papers))
        return kept(found.select(F.col("node").alias("id"), F.col("label").alias("cluster")), narrow=True)


def completeness(row: str = "") -> Column:
    """How many of DOI, abstract, date and codes a record has."""
    has = lambda c: (F.coalesce(F.col(f"{row}{c}"), F.lit("")) != "").cast("int")
    return has("doi") + has("abstract") + has("published_at") + F.coalesce((F.size(f"{row}jel") > 0).cast("int"), F.lit(0))


def collapse(papers: DataFrame, prestige: Column) -> DataFrame:
    """One row per work of papers (id, pos, title, authors, doi, abstract, published_at, source, jel).

    The canonical record has the most prestige, then fields, then abstract, then the first place. It gets the first DOI
    when it has none, the longest abstract, the earliest date, and `also_in`, the other members' sources. A work stands
    where its first member stood.
    """
    rows = papers.join(same_work(papers), "id").withColumns({"prestige": prestige, "complete": completeness(), "abstract_len": F.length(F.coalesce("abstract", F.lit("")))})
    best = F.max_by(F.struct(*papers.columns), F.struct("prestige", "complete", "abstract_len", -F.col("pos")))
    by_length = F.struct("abstract_len", (F.col("prestige")), "complete", -F.col("pos"))
    found = rows.groupBy("cluster").agg(
        best.alias("best"), F.min("pos").alias("place"), F.count(F.lit(1)).alias("members"),
        F.min_by(F.nullif("doi", F.lit("")), F.when(F.coalesce("doi", F.lit("")) != "", F.col("pos"))).alias("any_doi"),
        F.max_by("abstract", by_length).alias("long_abstract"), F.min(F.nullif("published_at", F.lit(""))).alias("first_date"),
        F.collect_list(F.struct("pos", "source")).alias("sources"),
    )
    others = F.filter("sources", lambda s: s["pos"] != F.col("best.pos"))
    also = F.array_sort(F.array_distinct(F.filter(F.transform(others, lambda s: s["source"]), lambda s: F.coalesce(s, F.lit("")) != "")))
    kept = [F.col(f"best.{c}").alias(c) for c in papers.columns if c not in ("doi", "abstract", "published_at", "pos")]
    return found.select(
        *kept, F.coalesce(F.nullif("best.doi", F.lit("")), "any_doi").alias("doi"), F.col("long_abstract").alias("abstract"), F.col("first_date").alias("published_at"),
        also.alias("also_in"), F.col("place").alias("pos"), "cluster", "members",
    )


def suppress_seen(papers: DataFrame, seen: DataFrame) -> DataFrame:
    """papers without those whose DOI or normalised title is in seen (doi, title). Empty keys suppress nothing."""
    rows = papers.withColumns({"own_doi": text.normalize_doi(F.col("doi")), "own_title": F.nullif(text.normalize_title(F.col("title")), F.lit(""))})
    dois = seen.select(text.normalize_doi(F.col("doi")).alias("own_doi")).where("own_doi is not null").distinct()
    titles = seen.select(F.nullif(text.normalize_title(F.col("title")), F.lit("")).alias("own_title")).where("own_title is not null").distinct()
    return rows.join(dois, "own_doi", "left_anti").join(titles, "own_title", "left_anti").drop("own_doi", "own_title")


def merged_metadata(old: str = "old", new: str = "new") -> Column:
    """struct(doi, abstract, paper_type, jel_codes, keywords, published_at) of a stored record and a new one.

    DOI is only filled; the longer abstract stays; a type is never lowered; codes and keywords are ordered unions,
    keywords without regard to case; the earlier date stays, compared as text so that partial dates order too.
    """
    o, n = (lambda c, s=s: F.col(f"{s}.{c}") for s in (old, new))
    blank = lambda c: F.nullif(c, F.lit(""))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    rank = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in TYPE_RANK.items()], F.lit(0))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    known = F.transform(listed(o("keywords")), F.lower)
    added = F.filter(listed(n("keywords")), lambda x: ~F.array_contains(known, F.lower(x)))
    return F.struct(
        F.coalesce(blank(o("doi")), blank(n("doi"))).alias("doi"),
        F.when(size(n("abstract")) > size(o("abstract")), n("abstract")).otherwise(o("abstract")).alias("abstract"),
        F.when(rank(n("paper_type")) > rank(o("paper_type")), n("paper_type")).otherwise(F.coalesce(blank(o("paper_type")), n("paper_type"))).alias("paper_type"),
        F.array_distinct(F.concat(listed(o("jel_codes")), listed(n("jel_codes")))).alias("jel_codes"),
        F.concat(listed(o("keywords")), added).alias("keywords"),
        F.least(blank(o("published_at")), blank(n("published_at"))).alias("published_at"),
    )


def merged_all(rows: DataFrame, key: str, order: str, rank: Column | None = None) -> DataFrame:
    """`key` and the fields of merged_metadata, folded over all rows of each key by `order` (numbers, none twice in a key).

    rows: (key, order, doi, abstract, paper_type, jel_codes, keywords, published_at). Each field is a grouped aggregate, so
    no key's rows are gathered. `rank` orders the types; TYPE_RANK when it is not given.
    """
    if rank is None:
        rank = F.coalesce(*[F.when(F.col("paper_type") == k, F.lit(v)) for k, v in TYPE_RANK.items()], F.lit(0))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    first = -F.col(order)
    fields = rows.groupBy(key).agg(
        F.min_by("doi", F.when(blank("doi").isNotNull(), F.col(order))).alias("doi"),
        F.max_by("abstract", F.struct(F.length(F.coalesce("abstract", F.lit(""))), first)).alias("abstract"),
        F.max_by("paper_type", F.struct(rank, blank("paper_type").isNotNull(), first)).alias("paper_type"),
        F.min(blank("published_at")).alias("published_at"),
    )
    # A keyword stays as the first record that has it writes it, each time that this one record does; a code stays once.
    each = lambda c: rows.select(key, F.col(order).alias("at"), F.posexplode(c).alias("pos", "word"))
    words = each("keywords").groupBy(key, F.lower("word").alias("low"), "at").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    words = words.groupBy(key, "low").agg(F.min(F.struct("at", "words")).alias("x")).select(key, F.explode(F.transform("x.words", lambda w: F.struct(F.col("x.at").alias("at"), w["pos"].alias("pos"), w["word"].alias("word")))).alias("x"))
    codes = each("jel_codes").groupBy(key, "word").agg(F.min(F.struct("at", "pos")).alias("m")).select(key, F.struct("m.at", "m.pos", "word").alias("x"))
    listed = lambda df, name: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["word"]).alias(name))
    found = fields.join(listed(codes, "jel_codes"), key, "left").join(listed(words, "keywords"), key, "left")
    none = F.array().cast("array<string>")
    return found.select(key, "doi", "abstract", "paper_type", F.coalesce("jel_codes", none).alias("jel_codes"), F.coalesce("keywords", none).alias("keywords"), "published_at")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key by `order`, without a sort; null keys are one key."""
    found = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(F.col(order))).alias("row"))
    return found.select("row.*")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key by `order`, without a sort: the greatest by order among the rows."""
    found = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(order)).alias("row"))
    return found.select("row.*")
