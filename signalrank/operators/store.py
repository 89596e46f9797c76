"""Store operators: idempotent appends and field-wise upserts as read-merge-overwrite. Tables are DataFrames; writing is a swap of folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """First row of each key in `rows` whose key `stored` lacks. Null keys count as one value, as '' does in the store."""
    first = F.min_by(F.struct(*rows.columns), F.col(order)) if order else F.any_value(F.struct(*rows.columns))
    once = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("row"))
    have = stored.select(*[F.col(k).alias(f"_have_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_{k}").eqNullSafe(F.col(f"_have_{k}"))
    return once.join(have, same, "left_anti").select("row.*")


def insert_ignore(rows: DataFrame, stored: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """`stored` with the new rows: a second run adds nothing."""
    return stored.unionByName(new_rows(rows, stored, keys, order), allowMissingColumns=True)


def with_ids(rows: DataFrame, key: str, into: str) -> DataFrame:
    """Stable ids by hash of the key; they need no count of what is stored and no single task."""
    return rows.withColumn(into, F.xxhash64(key))


def first_of(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def latest_of(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def longest_of(old: Column, new: Column) -> Column:
    """The longer text; the stored one on ties."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.when(size(new) > size(old), new).otherwise(old)


def either_of(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def upsert(rows: DataFrame, stored: DataFrame, keys: list[str], rules: dict[str, object]) -> DataFrame:
    """`stored` full-joined with rows (one per key), each column by its rule (old, new) -> value; columns without a rule take the new value if there is one."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    joined = stored.alias("o").join(rows.alias("n"), condition, "full")
    values = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    values += [rules.get(c, latest_of)(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in stored.columns if c not in keys]
    return joined.select(*values)


#: Rules of authors, and of deadlines: type and relevance are overwritten, the rest is kept where it is not given again.
AUTHOR_RULES = {"affiliation": longest_of, "is_tracked": either_of, "auto_discovered": first_of}


def collapse_duplicates(rows: DataFrame, edges: DataFrame, key: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per key, the one with the least id and the longest affiliation, and edges repointed to it, once each."""
    best = rows.groupBy(key).agg(F.min(id_col).alias("keep"), F.max_by("affiliation", F.struct(F.length(F.coalesce("affiliation", F.lit(""))), -F.col(id_col))).alias("longest"))
    same = (F.col(f"r.{key}") == F.col(f"b.{key}")) & (F.col(f"r.{id_col}") == F.col("b.keep"))
    kept = rows.alias("r").join(best.alias("b"), same).select(*[F.col(f"r.{c}") if c != "affiliation" else F.col("b.longest").alias(c) for c in rows.columns])
    names = rows.select(F.col(id_col), F.col(key)).join(best.select(key, "keep"), key).select(id_col, "keep")
    moved = edges.join(names, id_col).groupBy("paper_id", F.col("keep").alias(id_col)).agg(F.min("position").alias("position"))
    return kept, moved


def removed(before: DataFrame, after: DataFrame) -> int:
    """How many rows a cleaning took away."""
    return before.count() - after.count()


def write_scores(papers: DataFrame, scores: DataFrame, into: str = "relevance_score") -> DataFrame:
    """papers (id, ...) with the scores (paper_id, relevance) of those that were scored again; the others keep theirs."""
    new = scores.select(F.col("paper_id").alias("_id"), F.col("relevance").alias("_new"))
    return papers.join(new, F.col("id") == F.col("_id"), "left").withColumn(into, F.coalesce("_new", into)).drop("_id", "_new")


def mark_notified(deadlines: DataFrame, alerts: DataFrame) -> DataFrame:
    """deadlines (deadline_id, notified_days) with each alert's threshold (deadline_id, threshold) added, sorted and once."""
    added = alerts.groupBy("deadline_id").agg(F.collect_set("threshold").alias("_added"))
    merged = F.array_sort(F.array_union(F.coalesce("notified_days", F.array().cast("array<int>")), F.coalesce("_added", F.array().cast("array<int>"))))
    return deadlines.join(added, "deadline_id", "left").withColumn("notified_days", merged).drop("_added")


def run_log(spark: SparkSession, sensor: str, watch: str, started: str, finished: str, status: str, found: int, new: int, error: str | None = None) -> DataFrame:
    """One row of the run log, ready to append."""
    return spark.range(1).select(
        F.lit(sensor).alias("sensor"), F.lit(watch).alias("watch"), F.lit(started).cast("timestamp").alias("started_at"), F.lit(finished).cast("timestamp").alias("finished_at"),
        F.lit(status).alias("status"), F.lit(found).cast("long").alias("items_found"), F.lit(new).cast("long").alias("items_new"), F.lit(error).cast("string").alias("error"),
    )


def swap(rows: DataFrame, path: str) -> None:
    """Writes `rows` beside `path` and renames it into place, so that a table may be written from its own rows and a failed write leaves it whole."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    if fs.exists(place):
        fs.rename(place, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), place)
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
