"""Posts as a stream: idempotent append of micro-batches, windowed attention with a watermark, per-key folds of votes.

The batch operators do the same over landed tables; a replayed stream ends in the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalrank.operators import store
from signalrank.operators.incremental import DOWN, UP


def read_posts(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Posts that land as Parquet files under `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def append_new(posts: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Query that appends each batch's new keys to the table at `path`. A batch that runs twice adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        stored = spark.read.schema(batch.schema).parquet(path) if there else batch.limit(0)
        store.new_rows(batch, stored, keys).write.mode("append").parquet(path)

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def attention(posts: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(source, start, posts, engagement) by window of event time; rows later than the watermark are dropped by the engine."""
    windowed = posts.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "source")
    return windowed.agg(F.count(F.lit(1)).alias("posts"), F.sum("value").alias("engagement")).select("source", F.col("w.start").alias("start"), "posts", "engagement")


def unique_posts(posts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (source, source_id) once within the watermark."""
    return posts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "source_id"])


def vote_weights(votes: DataFrame, start: float = 0.1) -> DataFrame:
    """(code, weight, votes) after each batch of votes (code, seq, interesting): the weight is kept as state and moved by each vote in order."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, n = state.get if state.exists else (start, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for up in rows["interesting"]:
            weight = round((weight + UP * (1 - weight) if up else weight - DOWN * weight) * 1e6) / 1e6
            n += 1
        state.update((weight, n))
        yield pd.DataFrame({"code": [key[0]], "weight": [weight], "votes": [n]})

    return votes.groupBy("code").applyInPandasWithState(fold, "code string, weight double, votes long", "weight double, votes long", "update", GroupStateTimeout.NoTimeout)
