"""Rank-space combination of scores, quotas, balanced lists and other windowed orderings. Every order ends in an id, so results are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalrank.session import cut


def percentile(value: str, by: list[str] | None = None) -> Column:
    """Average-rank percentile in (0, 1] within the batch, or within groups `by`: (least rank + greatest rank) / 2n; ties share it."""
    parts = [F.col(c) for c in by or []]
    whole = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    rank = F.rank().over(whole.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*parts, value))
    return (rank + (ties - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(whole)


def percentiles(rows: DataFrame, value: str, into: str) -> DataFrame:
    """As percentile over the whole table, but through counts of distinct values: only those are put in one order, the rows never are."""
    rows = cut(rows)  # used twice: for the counts, and to be joined with them
    return rows.join(value_percentiles(rows, value, into), value, "left")


def value_percentiles(rows: DataFrame, value: str, into: str) -> DataFrame:
    """(value, percentile) of the distinct values of a written table.

    They are range-partitioned and each partition's total is added to the running count of the partitions before it, so
    no task sorts them all.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    spread = cut(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))  # written, so that both uses see the same parts
    totals = spread.groupBy("_part").agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # over one row for each partition
    before = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    total = F.broadcast(spread.agg(F.sum("_n").alias("_total")))
    inner = F.sum("_n").over(Window.partitionBy("_part").orderBy(value))
    ranked = spread.join(F.broadcast(before), "_part").select(value, "_n", (F.col("_before") + inner - F.col("_n")).alias("_less"))
    return ranked.join(total, F.lit(True), "left").select(value, ((F.col("_less") + (F.col("_n") + 1) / F.lit(2.0)) / F.col("_total")).alias(into))


def combined(channels: list[str], by: list[str] | None = None) -> Column:
    """Mean of the channels' percentiles, for groups or for a table of bounded size; `personalized` is for tables of any size. Without channels there is nothing to combine."""
    if not channels:
        raise ValueError("no channel to combine")
    return sum((percentile(c, by) for c in channels[1:]), percentile(channels[0], by)) / F.lit(float(len(channels)))


def present(rows: DataFrame, channels: list[str]) -> list[str]:
    """Channels with some value above 0: one aggregation decides which take part."""
    top = rows.agg(*[F.max(c).alias(c) for c in channels]).first()
    return [c for c in channels if top[c] is not None and top[c] > 0]


def library_norm(score: Column, low: float = 3.0, high: float = 7.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low)))


def personalized(rows: DataFrame, channels: list[str]) -> DataFrame:
    """rows (pos, channels) by the mean percentile of the channels that are present, best first, ties by pos; `final` holds it."""
    used = present(rows, channels) or channels[:1]
    base = cut(rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in used}))
    found = base
    for c in used:
        found = found.join(value_percentiles(base, c, f"_p_{c}"), c, "left")
    mean = sum((F.col(f"_p_{c}") for c in used), F.lit(0.0)) / F.lit(float(len(used)))
    return found.withColumn("final", mean).drop(*(f"_p_{c}" for c in used)).orderBy(F.desc("final"), "pos")


def latest_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest `order`, without a sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(order)).alias("row")).select("row.*")


def recent_health(runs: DataFrame, most_runs: int = 50, most_sensors: int = 12) -> DataFrame:
    """Latest of the last `most_runs` finished runs (run_id, sensor, finished_at) for each sensor, newest first."""
    last = runs.where("finished_at is not null").orderBy(F.desc("finished_at"), F.desc("run_id")).limit(most_runs)
    rank = F.row_number().over(Window.partitionBy("sensor").orderBy(F.desc("finished_at"), F.desc("run_id")))
    return last.withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy(F.desc("finished_at"), F.desc("run_id")).limit(most_sensors)


def source_quota(posts: DataFrame, limit: int, key_chars: int = 80) -> DataFrame:
    """posts (post_id, source, content, published_at): newest of each source up to its share of `limit`, equal beginnings only once over all sources (first source by name)."""
    sources = posts.select("source").distinct().count()
    quota = max(limit // max(sources, 1), 3)
    newest = Window.partitionBy("source").orderBy(F.desc("published_at"), "post_id")
    fetched = posts.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= 2 * quota)
    key = F.lower(F.trim(F.substring(F.coalesce("content", F.lit("")), 1, key_chars)))
    once = fetched.withColumn("_key", key).withColumn("_seen", F.row_number().over(Window.partitionBy("_key").orderBy("source", "_n"))).where("_seen = 1")
    kept = once.withColumn("_q", F.row_number().over(Window.partitionBy("source").orderBy("_n"))).where(F.col("_q") <= quota)
    return kept.drop("_n", "_key", "_seen", "_q").orderBy(F.desc("published_at"), "post_id").limit(limit)


def balanced(rows: DataFrame, first: Column, order: list, each: int = 6, most: int = 10) -> DataFrame:
    """Up to `each` rows of the first track, then up to `each` of the other, then the best of the rest, `most` in all. order: columns ending in an id."""
    placed = rows.withColumn("_track", F.when(F.coalesce(first, F.lit(False)), 0).otherwise(1))
    # The best `most` of either track hold all that can be chosen; only those are ranked.
    tracks = [placed.where(F.col("_track") == k).orderBy(*order).limit(most) for k in (0, 1)]
    rank = F.row_number().over(Window.partitionBy("_track").orderBy(*order))
    placed = tracks[0].unionByName(tracks[1]).withColumn("_rank", rank)
    bucket = F.when(F.col("_rank") <= each, F.col("_track")).otherwise(F.lit(2))
    return placed.withColumn("_bucket", bucket).orderBy("_bucket", *order).limit(most).drop("_track", "_rank", "_bucket")


def widened(rows: DataFrame, day: str, as_of: Column, least: int, short: int = 1, long: int = 7) -> DataFrame:
    """Rows of the last `short` days, or of the last `long` days where those are fewer than `least`."""
    recent = rows.where(F.col(day) >= F.date_sub(as_of, long))
    days = short if recent.where(F.col(day) >= F.date_sub(as_of, short)).limit(least).count() >= least else long
    return recent.where(F.col(day) >= F.date_sub(as_of, days))
