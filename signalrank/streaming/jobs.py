"""Collector jobs as streams: each micro-batch is one run that counts once, however often it comes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalrank.operators import jobs
from signalrank.operators.versions import Tables


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def ingest_stream(items: DataFrame, tables: Tables, sensor: str, watch: str, checkpoint: str, clock: Callable[[], str] = _now):
    """Writer that ingests a stream of items (value) batch by batch. The tables remember the last batch of `sensor`, so one that runs again after a crash adds nothing."""

    def ingest(batch: DataFrame, number: int) -> None:
        landed = batch.select(F.monotonically_increasing_id().alias("seq"), "value")
        _stop_on_error(jobs.run(tables, landed, sensor, watch, clock(), clock(), done=(sensor, number)))

    return items.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)


def collect_stream(responses: DataFrame, parse: Callable[[DataFrame], DataFrame], tables: Tables, sensor: str, watch: str, rule: str, checkpoint: str, order: tuple[str, ...] = ("turn", "page"), clock: Callable[[], str] = _now):
    """Writer over a stream of responses (key, turn, page, ok, value, mark): what they bring is ingested, and each key's mark moves by `rule`, to the greatest mark of its responses, in the same version."""

    def ingest(batch: DataFrame, number: int) -> None:
        items, answers = jobs.collected(batch, parse, order)
        held = tables.read("marks", jobs.SCHEMAS["marks"])
        through = jobs.moved(held.limit(0), answers, rule, F.lit("")).select("key")
        reached = batch.join(through, "key", "left_semi").groupBy("key").agg(F.max("mark").alias("mark"))
        marks = held.unionByName(reached).groupBy("key").agg(F.max("mark").alias("mark"))
        failed = batch.where("NOT coalesce(ok, false)").count()
        _stop_on_error(jobs.run(tables, items, sensor, watch, clock(), clock(), marks=marks, done=(sensor, number), failed=failed))

    return responses.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)


def _stop_on_error(result: dict) -> None:
    if result["status"] == "error":
        raise RuntimeError(result["error_message"])  # the batch comes again
