"""A stored index of the match cascade, so that the work of a batch follows the batch and not the store.

The order of title tokens is frozen when the index is built: by how often the titles of that moment hold them, tokens that
they lack before all others. Any order that both sides share finds the same pairs, so later titles only make prefixes
less rare, until a rebuild. Entries stand under DOI, normalised title and the tokens of the title's prefix; they carry
tokens and family names, so no stored paper is read again. They lie in folders by a hash of their key: a batch reads the
folders of its own keys. Entries of a paper that a later batch changed are added beside its old ones; as its DOI is
only filled and its names only grow, the old ones find nothing that the new ones would not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalrank.operators import resolve, similarity
from signalrank.operators.versions import Tables
from signalrank.session import cut, scratch

BUCKETS = 256
ENTRY = "kind string, key string, id long, tokens array<string>, families array<string>, bucket int"
ORDER = "token string, df long, bucket int"
#: How the index lies in its tables, for `Tables.publish`.
BY = {"entries": "bucket", "token_order": "bucket"}


class TitleIndex:
    """Entries and token order, as tables `entries` and `token_order` of a folder that the store may share."""

    def __init__(self, tables: Tables, buckets: int = BUCKETS):
        self.tables, self.buckets = tables, buckets

    def build(self, stored: DataFrame) -> None:
        """Makes the index anew from stored papers (id, title, doi, authors)."""
        with scratch(stored.sparkSession):
            rows = cut(self._keyed(stored))
            order = cut(similarity.document_frequency(rows).withColumn("bucket", self._bucket("token")))
            self.tables.publish(replace={"entries": self._entries(rows, order), "token_order": order}, by=BY)

    def entries(self, papers: DataFrame) -> DataFrame:
        """Entries to append for papers (id, title, doi, authors) that are new or have changed."""
        rows = cut(self._keyed(papers))
        return self._entries(rows, self._order_of(rows))

    def add(self, papers: DataFrame) -> None:
        with scratch(papers.sparkSession):
            self.tables.publish(append={"entries": self.entries(papers)}, by=BY)

    def match(self, new: DataFrame) -> DataFrame:
        """(id, existing_id, step) for the papers of `new` (id, title, doi, authors) that are in the store, as `resolve.match_existing` gives them."""
        with scratch(new.sparkSession) as kept:
            rows = cut(self._keyed(new))
            asked = cut(self._entries(rows, self._order_of(rows)))
            held = self.tables.read_some("entries", ENTRY, "bucket", self._buckets_of(asked))
            step = F.when(F.col("kind") == "doi", 1).otherwise(2)
            lowest = held.where("kind <> 'token'").groupBy("kind", "key").agg(F.min("id").alias("existing_id"))
            exact = asked.where("kind <> 'token'").join(lowest, ["kind", "key"]).select("id", "existing_id", step.alias("step"))
            side = lambda df, s: df.where("kind = 'token'").groupBy(F.col("key").alias("token"), F.col("tokens").alias(f"tokens_{s}"), F.col("families").alias(f"families_{s}")).agg(F.min("id").alias(s))
            pairs = similarity.near(side(asked, "a"), side(held, "b"), resolve.LOW, "tokens_a", "families_a", "families_b")
            shared = F.size(F.array_intersect("families_a", "families_b"))
            step = F.when(F.col("jaccard") >= resolve.HIGH - 1e-12, 3).when(shared >= resolve.SHARED, 4)
            best = pairs.select("tokens_a", "families_a", F.struct(step.alias("step"), F.col("b").alias("existing_id")).alias("x")).where("x.step is not null")
            best = best.groupBy(F.col("tokens_a").alias("tokens"), F.col("families_a").alias("families")).agg(F.min("x").alias("x"))
            sets = asked.where("kind = 'token'").select("id", "tokens", "families").distinct()
            found = exact.unionByName(sets.join(best, ["tokens", "families"]).select("id", "x.existing_id", "x.step"))
            return kept(found.groupBy("id").agg(F.min(F.struct("step", "existing_id")).alias("x")).select("id", "x.existing_id", "x.step"), narrow=True)

    def _bucket(self, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most self.buckets

    def _keyed(self, papers: DataFrame) -> DataFrame:
        keyed = resolve.keyed(papers)
        return keyed.select("id", F.nullif("doi", F.lit("")).alias("doi"), "title_key", "tokens", F.array_sort("families").alias("families"))

    def _order_of(self, rows: DataFrame) -> DataFrame:
        tokens = rows.select(F.explode("tokens").alias("token")).distinct().withColumn("bucket", self._bucket("token"))
        return self.tables.read_some("token_order", ORDER, "bucket", self._buckets_of(tokens))

    def _entries(self, rows: DataFrame, order: DataFrame) -> DataFrame:
        none = F.lit(None).cast("array<string>")
        exact = lambda kind, column: rows.where(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), F.col(column).alias("key"), "id", none.alias("tokens"), none.alias("families"))
        each = rows.select("id", F.explode("tokens").alias("token")).join(order.select("token", "df"), "token", "left").select("id", "token", F.coalesce("df", F.lit(0)).alias("df"))
        sets = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
        prefixes = similarity.prefixes(sets, resolve.LOW).join(rows.select("id", "families"), "id").select(F.lit("token").alias("kind"), F.col("token").alias("key"), "id", "tokens", "families")
        return exact("doi", "doi").unionByName(exact("title", "title_key")).unionByName(prefixes).withColumn("bucket", self._bucket("kind", "key"))
