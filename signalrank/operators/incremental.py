"""Incremental operators: watermarks, TTL caches, ordered folds of feedback, alert suppression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalrank.functions.dates import alert_threshold
from signalrank.session import cut

UP, DOWN, NUDGE, LEAST_CHANGE = 0.1, 0.05, 0.05, 0.001


def after_watermark(rows: DataFrame, marks: DataFrame, key: str, order: str) -> DataFrame:
    """rows beyond their key's mark (key, mark); keys without a mark are new as a whole."""
    return rows.join(marks, key, "left").where(F.col("mark").isNull() | (F.col(order) > F.col("mark"))).drop("mark")


def advance(marks: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Marks moved to the greatest `order` seen; keys of which nothing came keep theirs, so a failed fetch skips nothing."""
    return marks.unionByName(seen.groupBy(key).agg(F.max(order).alias("mark"))).groupBy(key).agg(F.max("mark").alias("mark"))


def fresh(cache: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Entries of a cache (key, value, stored_at) that have not expired."""
    return cache.where(F.col("stored_at") > as_of - F.expr(f"INTERVAL {hours} HOURS"))


def answered(log: DataFrame, hours: int = 12) -> DataFrame:
    """(key, ts, answer) for each question of a log (key, ts, value): the last answer that was stored up to then and has not expired; null where there is none.

    Rows with a value are answers, rows without are questions.
    """
    before = Window.partitionBy("key").orderBy("ts", F.col("value").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("ts", "value")), ignorenulls=True).over(before)
    rows = log.select("key", "ts", "value", last.alias("last")).where("value is null")
    return rows.select("key", "ts", F.when(F.col("last.ts") > F.col("ts") - F.expr(f"INTERVAL {hours} HOURS"), F.col("last.value")).alias("answer"))


def memoized(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open): keys with a cached answer, an empty one included, and keys without."""
    return asked.join(cache, "key"), asked.join(cache, "key", "left_anti")


#: What the memo of an external answer says of a key. A failed one is asked again, an empty answer is an answer.
ANSWERED, EMPTY, FAILED = "answered", "empty", "failed"


def asked_once(rows: DataFrame, memo: DataFrame, ask: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """rows (key, ...) with `answer`, and the memo (key, state, answer) after that.

    Keys that the memo has an answer for, an empty one included, are not asked again; keys that it lacks and those that
    failed are, once each, by ask: (key, ...) to (key, reply), a null reply or no row being a failure. Empty and failed
    answers are null in the rows. Without `ask` nothing is asked and nothing fails.
    """
    settled = memo.where(F.col("state") != FAILED)
    opened = rows.join(settled.select("key"), "key", "left_anti").where("key is not null")
    if ask is None:
        return rows.join(memo.select("key", "answer"), "key", "left"), memo
    opened = cut(opened.groupBy("key").agg(F.any_value(F.struct(*rows.columns)).alias("row")).select("row.*"))
    replies = ask(opened).groupBy("key").agg(F.max("reply").alias("reply"))
    state = F.when(F.col("reply").isNull(), FAILED).when(F.trim("reply") == "", EMPTY).otherwise(ANSWERED)
    fresh = cut(opened.select("key").join(replies, "key", "left").select("key", state.alias("state"), F.when(state == ANSWERED, F.trim("reply")).alias("answer")))
    after = memo.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)
    return rows.join(after.select("key", "answer"), "key", "left"), after


def vote_fold(start: Column, votes: Column) -> Column:
    """A weight after an ordered array of boolean votes: each moves it towards 1 by UP, or towards 0 by DOWN, rounded to 6 digits."""
    return F.aggregate(votes, start, lambda w, up: F.rint(F.when(up, w + F.lit(UP) * (F.lit(1.0) - w)).otherwise(w - F.lit(DOWN) * w) * 1e6) / 1e6)


def folded_weights(votes: DataFrame, start: DataFrame, default: float = 0.1) -> DataFrame:
    """(code, weight) after all votes (seq, code, interesting) in order of seq, from start weights (code, weight); codes without votes keep theirs."""
    ordered = votes.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "interesting"))), lambda s: s["interesting"]).alias("votes"))
    both = start.join(ordered, "code", "full")
    empty = F.array().cast("array<boolean>")
    return both.select("code", vote_fold(F.coalesce("weight", F.lit(default)), F.coalesce("votes", empty)).alias("weight"))


def nudged(score: Column, boost: Column) -> Column:
    """Score moved a little towards score + boost, at most 1; unchanged where it would move less than LEAST_CHANGE."""
    new = (1 - NUDGE) * score + NUDGE * F.least(F.lit(1.0), score + boost)
    return F.when(F.abs(new - score) > LEAST_CHANGE, new).otherwise(score)


def due_alerts(deadlines: DataFrame, as_of: Column) -> DataFrame:
    """deadlines (deadline_id, name, deadline_date, notified_days) with `days` and the `threshold` that they newly reached, most urgent first."""
    days = F.date_diff("deadline_date", as_of)
    rows = deadlines.where("deadline_date is not null").withColumns({"days": days}).withColumn("threshold", alert_threshold(F.col("days")))
    known = F.array_contains(F.coalesce("notified_days", F.array().cast("array<int>")), F.col("threshold"))
    return rows.where(F.col("threshold").isNotNull() & ~known).orderBy("threshold", "days", "deadline_id")


def latest_votes(votes: DataFrame) -> DataFrame:
    """(paper_id, interesting): the last vote of each paper by seq, its place in the log."""
    return votes.groupBy("paper_id").agg(F.max_by("interesting", "seq").alias("interesting"))


def votes_of_export(exports: DataFrame) -> DataFrame:
    """(paper_id, interesting, at) of export text (value): a JSON map by paper id; entries without a vote, or with a key that is no number, go."""
    entries = exports.select(F.explode(F.from_json("value", "map<string,struct<starred:boolean,vote:string,hidden:boolean,votedAt:string>>")).alias("key", "entry"))
    return entries.select(F.expr("try_cast(key AS BIGINT)").alias("paper_id"), (F.col("entry.vote") == "up").alias("interesting"), F.col("entry.votedAt").alias("at")).where("paper_id is not null and interesting is not null")
