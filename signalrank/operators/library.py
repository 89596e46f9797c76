"""Profile of a personal library: pivot of its items, weighted terms and authors, lexical affinity of candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalrank.functions import text
from signalrank.functions.text import library_last_name, library_name, library_tokens
from signalrank.operators.features import small
from signalrank.operators.versions import Tables
from signalrank.session import cut, scratch

LEAST_TF, MOST_DF, MOST_TERMS, MOST_AUTHORS = 3, 0.25, 4000, 40
LAST_NAME_FACTOR, TOP_TERMS, TERM_DIVISOR = 0.7, 12, 4.0


def pivot_items(values: DataFrame, fields: list[str]) -> DataFrame:
    """One row per item of (item_id, field, value); fields that an item lacks are null."""
    return values.groupBy("item_id").pivot("field", fields).agg(F.max("value"))


def term_counts(items: DataFrame, stop: list[str]) -> DataFrame:
    """(term, tf, df) of items (item_id, title, abstract); title terms count twice."""
    words = lambda c, n: items.select("item_id", F.explode(library_tokens(F.col(c), stop)).alias("term"), F.lit(n).alias("n"))
    return words("title", 2).unionByName(words("abstract", 1)).groupBy("term").agg(F.sum("n").alias("tf"), F.countDistinct("item_id").alias("df"))


def weights_of(counts: DataFrame, total: DataFrame, least_tf: int = LEAST_TF, most_df: float = MOST_DF, most_terms: int = MOST_TERMS) -> DataFrame:
    """(term, weight) of counts (term, tf, df) among `total` items, one row (total): frequent and rare terms go; weights are tf-idf, greatest 1."""
    weighted = counts.join(F.broadcast(total), F.lit(True), "left").where((F.col("tf") >= least_tf) & (F.col("df") / F.col("total") <= most_df))
    raw = F.col("tf") * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1)
    top = weighted.select("term", raw.alias("raw")).orderBy(F.desc("raw"), "term").limit(most_terms)
    return top.join(F.broadcast(top.agg(F.max("raw").alias("most"))), F.lit(True), "left").select("term", (F.col("raw") / F.col("most")).alias("weight"))


def term_weights(items: DataFrame, stop: list[str], least_tf: int = LEAST_TF, most_df: float = MOST_DF, most_terms: int = MOST_TERMS) -> DataFrame:
    """(term, weight) of items (item_id, title, abstract); see `term_counts` and `weights_of`."""
    total = items.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    return weights_of(term_counts(items, stop), total, least_tf, most_df, most_terms)


def _over_greatest(counts: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("most"))), F.lit(True), "left").select("name", (F.col("n") / F.col("most")).alias("weight"))


def _name_counts(creators: DataFrame, name: Column) -> DataFrame:
    return creators.select(name.alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def author_weights(creators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, weight) by full and by family name of creators (item_id, name): counts over the greatest count."""
    return tuple(_over_greatest(_name_counts(creators, form(F.col("name")))) for form in (library_name, library_last_name))


class Profile:
    """A library's profile kept up to date: each batch of items adds its own counts, and weights come from their sums.

    Counts of terms and names of a batch are rows of the table `profile`; an item that was taken out, or the old form of
    one that changed, is subtracted. An item is in one batch only. The profile is then what a pass over all items gives.
    """

    COUNT = "kind string, key string, a long, b long"

    def __init__(self, tables: Tables, stop: list[str]):
        self.tables, self.stop = tables, stop

    def _counted(self, items: DataFrame, creators: DataFrame, sign: int) -> DataFrame:
        signed = lambda c: (F.col(c) * sign).cast("long")
        terms = term_counts(items, self.stop).select(F.lit("term").alias("kind"), F.col("term").alias("key"), signed("tf").alias("a"), signed("df").alias("b"))
        names = [_name_counts(creators, form(F.col("name"))).select(F.lit(kind).alias("kind"), F.col("name").alias("key"), signed("n").alias("a"), F.lit(0).cast("long").alias("b")) for kind, form in (("full", library_name), ("last", library_last_name))]
        size = items.agg(F.count(F.lit(1)).alias("n")).select(F.lit("items").alias("kind"), F.lit("").alias("key"), signed("n").alias("a"), F.lit(0).cast("long").alias("b"))
        return terms.unionByName(names[0]).unionByName(names[1]).unionByName(size)

    def add(self, items: DataFrame, creators: DataFrame, done: tuple[str, int] | None = None) -> bool:
        """Counts a batch of items (item_id, title, abstract) and creators (item_id, name). False when batch `done` of a stream is in already."""
        return self.tables.publish(append={"profile": self._counted(items, creators, 1)}, done=done)

    def replace(self, old_items: DataFrame, old_creators: DataFrame, items: DataFrame, creators: DataFrame) -> None:
        """Takes the old form of some items out and puts the new one in; either may be empty."""
        self.tables.publish(append={"profile": self._counted(old_items, old_creators, -1).unionByName(self._counted(items, creators, 1))})

    def _sums(self) -> DataFrame:
        held = self.tables.read("profile", self.COUNT)
        return held.groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 0")

    def compact(self) -> None:
        """Makes the counts of all batches one table of sums."""
        self.tables.publish(replace={"profile": self._sums()})

    def terms(self, **limits) -> DataFrame:
        """(term, weight), as `term_weights` gives them."""
        sums = self._sums()
        total = sums.where("kind = 'items'").agg(F.greatest(F.coalesce(F.max("a"), F.lit(0)), F.lit(1)).alias("total"))
        return weights_of(sums.where("kind = 'term'").select(F.col("key").alias("term"), F.col("a").alias("tf"), F.col("b").alias("df")), total, **limits)

    def authors(self) -> tuple[DataFrame, DataFrame]:
        """(name, weight) by full and by family name, as `author_weights` gives them."""
        sums = self._sums()
        return tuple(_over_greatest(sums.where(F.col("kind") == kind).select(F.col("key").alias("name"), F.col("a").alias("n"))) for kind in ("full", "last"))


def top_authors(full: DataFrame, most: int = MOST_AUTHORS) -> DataFrame:
    return full.orderBy(F.desc("weight"), "name").limit(most)


def dois(items: DataFrame) -> DataFrame:
    return items.select(text.normalize_doi(F.col("doi")).alias("doi")).where("doi is not null").distinct()


def author_scores(papers: DataFrame, full: DataFrame, last: DataFrame) -> DataFrame:
    """(paper_id, author) of papers (paper_id, authors): the best full-name weight, or family-name weight times .7."""
    names = papers.select("paper_id", F.explode("authors").alias("raw")).select("paper_id", library_name(F.col("raw")).alias("name"), library_last_name(F.col("raw")).alias("family"))
    hit = names.join(small(full).withColumnRenamed("weight", "by_full"), "name", "left").join(small(last).withColumnsRenamed({"name": "family", "weight": "by_last"}), "family", "left")
    best = F.greatest(F.coalesce("by_full", F.lit(0.0)), F.coalesce("by_last", F.lit(0.0)) * LAST_NAME_FACTOR)
    return hit.groupBy("paper_id").agg(F.least(F.lit(1.0), F.max(best)).alias("author"))


def content_scores(papers: DataFrame, terms: DataFrame, stop: list[str]) -> DataFrame:
    """(paper_id, content) of papers (paper_id, title, abstract): the sum of the twelve greatest weights of their terms, over 4."""
    tokens = F.array_union(library_tokens(F.col("title"), stop), library_tokens(F.col("abstract"), stop))
    hit = papers.select("paper_id", F.explode(tokens).alias("term")).join(small(terms), "term")
    best = F.slice(F.sort_array(F.collect_list("weight"), asc=False), 1, TOP_TERMS)
    return hit.groupBy("paper_id").agg(F.least(F.lit(1.0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / TERM_DIVISOR).alias("content"))


def lexical_affinity(author: Column, content: Column, scale: float = 10.0) -> Column:
    return F.least(F.lit(0.7), F.coalesce(author, F.lit(0.0)) * 0.4 + F.coalesce(content, F.lit(0.0)) * 0.3) * scale


def item_hash() -> Column:
    """Content hash of an item (title, abstract): null and the empty text differ, and no text can pass for a border between the two."""
    part = lambda c: F.concat(F.coalesce(F.char_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(part("title"), part("abstract")), 256)


#: Items under a leaf of the digest tree, about; a node above has FAN_OUT children, one more hexadecimal digit each.
LEAF_ITEMS, FAN_OUT = 4096, 16


def corpus_hash(items: DataFrame) -> DataFrame:
    """(hash): one content hash of a library (title, abstract), the same for every order of its rows and no other for any other multiset of items.

    Equal items are counted. Their hashes are dealt into ranges by leading digits, so many that a range holds some
    thousands; a range's digest is over its sorted hashes and counts, a node's over its children's digests, up to the root.
    """
    with scratch(items.sparkSession) as kept:
        counted = cut(items.groupBy(item_hash().alias("h")).agg(F.count(F.lit(1)).alias("n")), narrow=True)
        total, digits = counted.count(), 0
        while total > LEAF_ITEMS * FAN_OUT**digits:
            digits += 1
        folded = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))), lambda s: F.concat_ws(":", s["h"], s["n"])), "\n"), 256)
        nodes = counted.groupBy(F.substring("h", 1, digits).alias("range")).agg(folded(counted).alias("digest"), F.sum("n").alias("n"))
        while digits > 0:
            digits -= 1
            each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "digest", "n"))), lambda s: F.concat_ws(":", s["range"], s["digest"], s["n"])), "\n")
            nodes = nodes.groupBy(F.substring("range", 1, digits).alias("range")).agg(F.sha2(each, 256).alias("digest"), F.sum("n").alias("n"))
        root = nodes.groupBy().agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("hash"))  # one node, or none
        return kept(root, narrow=True)


class VectorCache:
    """Vectors of items by model and content: a library that was seen as a whole is read as one table, of others only new texts are embedded.

    The tables' folder is shared; a model's vectors are never mixed with another's. Items with the same title and
    abstract share a vector. An item whose text could not be embedded has none and is asked again the next time.
    """

    VECTOR, ITEM, WHOLE = "item string, vector array<double>", "model string, item string, vector array<double>", "model string, hash string"

    def __init__(self, tables: Tables):
        self.tables = tables

    def _name(self, model: str, digest: str) -> str:
        return f"library-{hashlib.sha256(model.encode()).hexdigest()[:16]}-{digest}"

    def vectors(self, items: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(item, vector) of the distinct items (title, abstract); item is their `item_hash`. embed: (item, title, abstract) to (item, vector), null or no row where it failed."""
        digest = corpus_hash(items).first()["hash"]
        name, held = self._name(model, digest), self.tables.manifest()
        if name in held["tables"]:
            return self.tables.read(name, self.VECTOR, held)
        with scratch(items.sparkSession) as kept:
            asked = cut(items.select(item_hash().alias("item"), "title", "abstract").groupBy("item").agg(F.first("title").alias("title"), F.first("abstract").alias("abstract")))
            known = self.tables.read("items", self.ITEM, held).where(F.col("model") == model).select("item", "vector").join(asked.select("item"), "item", "left_semi")
            fresh = cut(embed(asked.join(known.select("item"), "item", "left_anti")).select("item", F.col("vector").cast("array<double>")).where("vector is not null"))
            every = kept(known.unionByName(fresh))
            whole = {name: every} if every.count() == asked.count() else {}  # a library with gaps is put together anew, so that they are asked for
            self.tables.publish(replace=whole, append={"items": fresh.select(F.lit(model).alias("model"), "item", "vector")})
            return every
