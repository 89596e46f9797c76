"""All named queries of the package, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalrank.plans import form_queries, graph_queries, job_queries, payload_queries, record_queries, stream_queries, text_queries, work_queries
from signalrank.plans.text_queries import first_line
from signalrank.session import table

#: Interest terms of the flagship query and the prestige of its sources.
TERMS = ["the", "that", "with"]
PRESTIGE = {"src0": 1.0, "src1": 0.8, "src2": 0.6}


def ranked_feed(spark, sf_dir):
    """Documents as papers: keyword and source scores, a weighted sum, the best twenty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", first_line().alias("title"))
    low = F.concat(F.lit(" "), F.lower("title"), F.lit(" "))
    keyword = F.least(F.lit(1.0), sum((F.when(F.instr(low, f" {t} ") > 0, 0.25).otherwise(0.0) for t in TERMS), F.lit(0.0)))
    prestige = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in PRESTIGE.items()], F.lit(0.3))
    score = F.round(0.4 * keyword + 0.5 * prestige + 0.1 * F.least(F.lit(1.0), F.col("n_chars") / F.lit(10000.0)), 6)
    return docs.select("doc_id", "title", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


RANKED_FEED_SQL = """
WITH d AS (SELECT doc_id, source, n_chars, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS title FROM documents),
s AS (SELECT doc_id, title, round(0.4 * least(1.0,
        CASE WHEN contains(' ' || lower(title) || ' ', ' the ') THEN 0.25 ELSE 0.0 END
      + CASE WHEN contains(' ' || lower(title) || ' ', ' that ') THEN 0.25 ELSE 0.0 END
      + CASE WHEN contains(' ' || lower(title) || ' ', ' with ') THEN 0.25 ELSE 0.0 END)
    + 0.5 * CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.8 WHEN 'src2' THEN 0.6 ELSE 0.3 END
    + 0.1 * least(1.0, n_chars::DOUBLE / 10000.0), 6)::DOUBLE AS score FROM d)
SELECT doc_id, title, score FROM s ORDER BY score DESC, doc_id LIMIT 20
"""


def queries():
    return {"ranked_feed": ranked_feed} | text_queries.QUERIES | graph_queries.QUERIES | record_queries.QUERIES | stream_queries.QUERIES | work_queries.QUERIES | form_queries.QUERIES | payload_queries.QUERIES | job_queries.QUERIES


def oracle_sql():
    return {"ranked_feed": RANKED_FEED_SQL} | text_queries.SQL | graph_queries.SQL | record_queries.SQL | stream_queries.SQL | work_queries.SQL | form_queries.SQL | payload_queries.SQL | job_queries.SQL
