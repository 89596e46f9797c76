"""Exact dedup over a persistent digest index, bucketed and sorted by hash.

Texts are equal when they are identical; null counts as the empty text. The index keeps the digest of every text that it
was ever given, with the doc_id that stays and how many rows had it. It lives under a path: a later session that names
the same path goes on with it. New data is grouped by digest; digests that the index lacks are found by a sort-merge
anti-join, which does not shuffle the bucketed index, and appended with the largest doc_id of their rows. Rows of known
digests are dropped and only counted. The query hands a table over in two increments, larger ids first, so that the row
with the largest doc_id stays.

A null doc_id is the smallest. Rows that repeat both doc_id and text are the same document: exactly one of them stays.
Very long texts only pass through the hash. An empty table gives an empty report. Only id and text columns are read, so
other columns of any name do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import checkpoint_dir, cut, remove, scratch, sized, small_batches, table

#: Digests with at least this share of the rows handed over, and HOT_LEAST rows, are joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
HOT_LEAST = 1000


def digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


class DigestIndex:
    """digest -> (keep_id, copies) under `path`, as a table bucketed and sorted by digest so that a lookup does not shuffle it.

    A row with `first` names the keep_id of a digest; the others only count copies that came later. Two sessions must
    not append at once, and a batch that is handed over twice is counted twice.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = (path or f"{checkpoint_dir(spark).rstrip('/')}/{self.name}").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self._stored():
            self.buckets = spark.read.parquet(f"{self.path}/_buckets").first()["buckets"]
        else:
            spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_buckets")
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, copies BIGINT, first BOOLEAN) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
            )

    def _stored(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def drop(self) -> None:
        """Removes the index, its files included."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def firsts(self) -> DataFrame:
        """(digest, keep_id): one row for each digest."""
        return self.spark.table(self.name).where("first").select("digest", "keep_id")

    def rows(self) -> DataFrame:
        """(digest, keep_id, group_size): one row for each digest, with all copies so far; no shuffle."""
        keep = F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id")
        return self.spark.table(self.name).groupBy("digest").agg(keep, F.sum("copies").alias("group_size"))

    def append(self, found: DataFrame) -> None:
        """Adds `found` (digest, keep_id, copies; one row each): digests that the index lacks, by sort-merge anti-join, and counts of the others."""
        known = self.firsts().select("digest").hint("merge")
        fresh = found.join(known, "digest", "left_anti").withColumn("first", F.lit(True))
        again = found.join(known, "digest", "left_semi").withColumn("first", F.lit(False))
        fresh.unionByName(again).select("digest", "keep_id", "copies", "first").repartition(self.buckets, "digest").write.insertInto(self.name)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, copies): copies are rows that repeat both. The key spreads a large group of equal texts over all tasks."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))


def entered(batches: list[DataFrame], index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, copies, keep_id, group_size) of all rows of `batches`, which go into the index one after another."""
    own = []
    for batch in batches:
        own.append(cut(groups(batch, id_col, text_col), narrow=True))
        index.append(own[-1].groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("copies")))
    own = reduce(DataFrame.unionByName, own)
    total = own.agg(F.sum("copies")).first()[0] or 0
    often = own.groupBy("digest").agg(F.sum("copies").alias("n")).where(F.col("n") >= max(HOT_LEAST, int(total * HOT_SHARE))).select("digest")
    kept = index.rows()
    hot = F.broadcast(cut(kept.join(F.broadcast(often), "digest"), narrow=True))  # both at most 1 / HOT_SHARE rows, by the rows of these batches
    return own.join(hot, "digest").unionByName(own.join(hot.select("digest"), "digest", "left_anti").join(kept.hint("merge"), "digest"))


@contextmanager
def _opened(spark: SparkSession, index: DigestIndex | None) -> Iterator[DigestIndex]:
    """`index`, which stays, or a new one, which goes when the result is written."""
    held = index or DigestIndex(spark)
    try:
        yield held
    finally:
        if index is None:
            held.drop()


def report(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", increments: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index that already holds a text, its earlier keep_id stays, all new rows of that text but that document itself
    are dropped, and group_size counts all copies ever seen. Without one, a new index is made, and removed after it. `increments` hands the
    table over in as many parts by falling doc_id, nulls last.
    """
    spark = small_batches(docs.sparkSession)
    with scratch(spark) as keep, _opened(spark, index) as held:
        found = entered(parts_of(docs, id_col, increments), held, id_col, text_col)
        same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        every = found.select(
            "doc_id", "keep_id", "group_size", same.alias("same"),
            F.lower(F.hex("digest")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        )
        return keep(every.select("doc_id", "keep_id", "group_size", (F.col("same") & (F.col("copy") == 1)).alias("kept"), "text_sha256"), narrow=True)


def parts_of(docs: DataFrame, id_col: str, increments: int) -> list[DataFrame]:
    """`docs` in parts of about equal size by falling id, nulls in the last: no id is in two parts."""
    if increments <= 1:
        return [docs]
    bounds = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / increments for k in range(1, increments)], 1000)).first()[0] or []
    edges = sorted(set(bounds), reverse=True)
    own = F.col(id_col).cast("long")
    above = [own > e for e in edges]
    parts = [docs.where(a if k == 0 else a & (own <= edges[k - 1])) for k, a in enumerate(above)]
    return [*parts, docs.where((own <= edges[-1]) | own.isNull())] if edges else [docs]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """`docs` without the rows that `report` drops, all columns kept."""
    spark = small_batches(docs.sparkSession)
    with scratch(spark) as keep, _opened(spark, index) as held:
        found = cut(entered([docs], held, id_col, text_col), narrow=True)
        same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        named = [F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest")]
        gone = sized(keep(found.where(~same).select(*named), narrow=True))
        twice = keep(found.where(same & (F.col("copies") > 1)).select(*named), narrow=True)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), digest(text_col).alias("own_digest"))
    at = F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_digest") == F.col("found_digest"))
    left = rows.join(gone, at, "left_anti")
    if twice.isEmpty():
        return left.select("row.*")
    twice = sized(twice)
    once = left.join(twice, at, "left_anti").select("row.*")
    return once.unionByName(left.join(twice, at, "left_semi").groupBy("own_id", "own_digest").agg(F.first("row").alias("row")).select("row.*"))


#: Parts in which the query hands its table over.
INCREMENTS = 2


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), increments=INCREMENTS)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
