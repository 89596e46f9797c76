"""Queries over events as posts, run log and votes: latest rows, quotas, folds, appends, watermarks, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalrank.functions import dates
from signalrank.operators import features, incremental, ranking, store
from signalrank.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT event_type AS sensor, max(event_id) AS run_id, arg_max(user_id, event_id) AS user_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY event_type""")
def latest_run_per_sensor(spark, sf_dir):
    """W03."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor"), F.col("event_id").alias("run_id"), "user_id", "value")
    return ranking.latest_per(runs, "sensor", "run_id").select("sensor", "run_id", "user_id", F.round("value", 6).alias("value"))


@query("""WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM l)
SELECT event_id AS run_id, event_type AS sensor FROM k WHERE n = 1 ORDER BY ts DESC, event_id DESC LIMIT 12""")
def sensor_health(spark, sf_dir):
    """W04."""
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("sensor"), F.col("ts").alias("finished_at"))
    return ranking.recent_health(runs).select("run_id", "sensor")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(substr(props, 1, 80))) ORDER BY event_type, n) AS seen FROM f WHERE n <= 24),
q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n) AS q FROM o WHERE seen = 1)
SELECT event_id AS post_id, event_type AS source FROM q WHERE q <= 12 ORDER BY ts DESC, event_id LIMIT 60""")
def social_quota_mix(spark, sf_dir):
    """W05."""
    posts = table(spark, sf_dir, "events").select(F.col("event_id").alias("post_id"), F.col("event_type").alias("source"), F.col("props").alias("content"), F.col("ts").alias("published_at"))
    return ranking.source_quota(posts, 60).select("post_id", "source")


@query("""SELECT user_id AS paper_id, arg_max(event_type = 'purchase', event_id) AS interesting FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id""")
def last_vote_wins(spark, sf_dir):
    """W07."""
    votes = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    return incremental.latest_votes(votes.select(F.col("user_id").alias("paper_id"), (F.col("event_type") == "purchase").alias("interesting"), F.col("event_id").alias("seq")))


@query("""WITH v AS (SELECT user_id, list(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY event_id) AS l FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id)
SELECT user_id::VARCHAR AS code, list_reduce(l, lambda w, up: round_even(CASE WHEN up > 0.5 THEN w + 0.1::DOUBLE * (1.0::DOUBLE - w) ELSE w - 0.05::DOUBLE * w END * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE, 0.1::DOUBLE) AS weight FROM v""")
def ema_fold(spark, sf_dir):
    """An ordered fold per code, rounded at each step."""
    votes = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    rows = votes.select(F.col("user_id").cast("string").alias("code"), (F.col("event_type") == "purchase").alias("interesting"), F.col("event_id").alias("seq"))
    none = spark.sql("SELECT CAST(NULL AS STRING) AS code, CAST(NULL AS DOUBLE) AS weight WHERE false")
    return incremental.folded_weights(rows, none)


@query("""WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT n.event_id, n.user_id, n.event_type FROM n LEFT JOIN s ON s.user_id = n.user_id AND s.event_type = n.event_type WHERE s.user_id IS NULL""")
def idempotent_append(spark, sf_dir):
    """New keys only, their first row."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return store.new_rows(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"), ["user_id", "event_type"], "event_id")


@query("""WITH m AS (SELECT event_type, max(event_id) AS mark FROM events WHERE event_id % 7 = 0 AND event_type <> 'error' GROUP BY event_type)
SELECT event_type, count(*)::BIGINT AS n, max(event_id) AS mark FROM events LEFT JOIN m USING (event_type) WHERE m.mark IS NULL OR event_id > m.mark GROUP BY event_type""")
def watermark_increment(spark, sf_dir):
    """Rows beyond each key's mark, and the marks that follow from them."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    marks = rows.where("event_id % 7 = 0 AND event_type <> 'error'").groupBy("event_type").agg(F.max("event_id").alias("mark"))
    new = incremental.after_watermark(rows, marks, "event_type", "event_id")
    return new.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("mark"))


@query("""SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def json_path(spark, sf_dir):
    """A field of stored JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT user_id AS paper_id, CASE WHEN count(*) >= 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS social, round(ln(1 + count(*)), 4) AS engagement FROM events WHERE event_type = 'click' GROUP BY user_id""")
def social_attention(spark, sf_dir):
    """A05, D20."""
    posts = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("paper_id"))
    counts = posts.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    return features.social_scores(posts).join(counts, "paper_id").select("paper_id", "social", dates.engagement(F.col("n")).alias("engagement"))


@query("""WITH e AS (SELECT event_id, ts::DATE AS due, CASE WHEN event_id % 2 = 0 THEN [30, 14] ELSE [] END AS seen FROM events WHERE event_type = 'signup'),
d AS (SELECT event_id, date_diff('day', DATE '2024-01-10', due) AS days, seen FROM e), a AS (SELECT *, list_min(list_filter([60, 30, 14, 7, 3, 1], lambda t: t >= days)) AS threshold FROM d WHERE days >= 0)
SELECT event_id AS deadline_id, days::BIGINT AS days, threshold::BIGINT AS threshold FROM a WHERE threshold IS NOT NULL AND NOT list_contains(seen, threshold)""")
def alert_suppression(spark, sf_dir):
    """Thresholds newly reached."""
    seen = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(30), F.lit(14))).otherwise(F.array().cast("array<int>"))
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("deadline_id"), F.lit("").alias("name"), F.col("ts").cast("date").alias("deadline_date"), seen.alias("notified_days"))
    found = incremental.due_alerts(rows, F.lit("2024-01-10").cast("date"))
    return found.select("deadline_id", F.col("days").cast("long").alias("days"), F.col("threshold").cast("long").alias("threshold"))


@query("""SELECT count(*)::BIGINT AS papers, count(DISTINCT user_id)::BIGINT AS users, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM events""")
def snapshot_stats(spark, sf_dir):
    """A13, A16."""
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("papers"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("""SELECT user_id::VARCHAR AS key, ts, CASE WHEN last.ts > ts - INTERVAL 12 HOURS THEN last.value END AS answer FROM (
 SELECT user_id, ts, event_type, last_value(CASE WHEN event_type = 'purchase' THEN {'ts': ts, 'value': event_id::VARCHAR} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'purchase', event_id ROWS UNBOUNDED PRECEDING) AS last FROM events
) WHERE event_type <> 'purchase'""")
def cache_log(spark, sf_dir):
    """Questions of a log and the answers that a cache of twelve hours has for them; purchases stand for answers."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("value"))
    return incremental.answered(log)


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'answered' WHEN 1 THEN 'empty' WHEN 2 THEN 'failed' END AS old, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'reply ' || doc_id END AS reply FROM documents),
s AS (SELECT doc_id, CASE WHEN old IN ('answered', 'empty') THEN old WHEN reply IS NULL THEN 'failed' WHEN trim(reply) = '' THEN 'empty' ELSE 'answered' END AS state, CASE WHEN old = 'answered' THEN 'held ' || doc_id WHEN old = 'empty' THEN NULL ELSE nullif(trim(reply), '') END AS answer FROM d)
SELECT 'id:' || doc_id AS key, state, answer FROM s""")
def answer_memo(spark, sf_dir):
    """A memo of external answers with three states; only what it lacks, and what failed, is asked again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("id:"), "doc_id").alias("key"))
    k = F.col("doc_id")
    state = F.when(k % 5 == 0, "answered").when(k % 5 == 1, "empty").when(k % 5 == 2, "failed")
    memo = docs.select("key", state.alias("state"), F.when(k % 5 == 0, F.concat(F.lit("held "), k)).alias("answer")).where("state is not null")
    reply = F.when(k % 4 == 1, " ").when(k % 4 > 1, F.concat(F.lit("reply "), k))
    return incremental.asked_once(docs, memo, lambda rows: rows.select("key", reply.alias("reply")))[1].select("key", "state", "answer")
