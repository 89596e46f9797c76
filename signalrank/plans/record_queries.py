"""Queries over forms that are made of the rows of the tables, and over details, calls and library profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalrank.functions import dates, text
from signalrank.operators import library
from signalrank.plans import lenses
from signalrank.plans.graph_queries import _EDGES, _SIGHTINGS, authors, pairs, sightings
from signalrank.session import table
from signalrank.sources.records import openalex_works

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Forms of DOIs by row, in words that both engines read.
_DOI = """CASE o_orderkey % 8 WHEN 0 THEN 'https://doi.org/10.' WHEN 1 THEN 'http://dx.doi.org/10.' WHEN 2 THEN 'doi:10.' WHEN 3 THEN '  10.' WHEN 4 THEN 'DOI.org/10.' WHEN 5 THEN 'doi:doi:10.' WHEN 6 THEN 'HTTPS://DX.DOI.ORG/10.' END
 || (o_custkey + 1000) || '/' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '.A' END"""


@query(f"""SELECT o_orderkey AS id, coalesce(regexp_replace(lower(trim({_DOI})), '^(https?://(dx\\.)?doi\\.org/|doi\\.org/|doi:)', ''), '') AS doi FROM orders""")
def doi_normalize(spark, sf_dir):
    """F10."""
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_DOI).alias("raw"))
    return raw.select("id", F.coalesce(text.normalize_doi(F.col("raw")), F.lit("")).alias("doi"))


_POST = """CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority || ' at https://doi.org/10.' WHEN 1 THEN 'doi: 10.' WHEN 2 THEN 'none 10' WHEN 3 THEN 'bare 10.' WHEN 4 THEN 'two 10.9999/first and doi:10.' ELSE '(10.' END
 || (o_custkey + 1000) || CASE WHEN o_orderkey % 7 = 0 THEN '/ab' ELSE '/abc.' || o_orderkey END || CASE o_orderkey % 5 WHEN 0 THEN ').' WHEN 1 THEN ', new' WHEN 2 THEN ' end' WHEN 3 THEN '>x' ELSE '' END"""


@query(f"""WITH v AS (SELECT o_orderkey AS id, {_POST} AS raw FROM orders), m AS (SELECT id, regexp_extract(raw, '(?i)(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)(10\\.\\d{{4,9}}/[^\\s"''<>]+)', 1) AS a, regexp_extract(raw, '(?:^|[^/\\p{{L}}\\p{{N}}_])(10\\.\\d{{4,9}}/[^\\s"''<>]{{4,}})', 1) AS b FROM v)
SELECT id, regexp_replace(CASE WHEN a <> '' THEN a ELSE b END, '[.,;)]+$', '') AS doi FROM m""")
def doi_extract(spark, sf_dir):
    """F12."""
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_POST).alias("raw"))
    return raw.select("id", F.coalesce(text.doi_in_text(F.col("raw")), F.lit("")).alias("doi"))


_ABSTRACT = """p_name || CASE p_partkey % 5 WHEN 0 THEN '. JEL: O' WHEN 1 THEN '. JEL codes: J' WHEN 2 THEN ', O1, R' WHEN 3 THEN '; JEL Classification: Q' ELSE '. jel code : A' END
 || (p_partkey % 100) || CASE p_partkey % 4 WHEN 0 THEN ', R31' WHEN 1 THEN '; J31. Other A1' WHEN 2 THEN '' ELSE ' and more' END"""


@query(f"""SELECT p_partkey AS id, array_to_string(regexp_extract_all(regexp_extract({_ABSTRACT}, '(?i)JEL(?:\\s+(?:codes?|classification))?\\s*:\\s*((?:[A-Z]\\d{{1,2}}[\\s,;]*)+)', 1), '[A-Z]\\d{{1,2}}'), ',') AS codes FROM part""")
def jel_extract(spark, sf_dir):
    """F31."""
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_ABSTRACT).alias("raw"))
    return raw.select("id", F.array_join(text.jel_codes(F.col("raw")), ",").alias("codes"))


_LIST = """c_name || CASE c_custkey % 6 WHEN 0 THEN ', ' WHEN 1 THEN ' and ' WHEN 2 THEN '; ' WHEN 3 THEN ' & ' WHEN 4 THEN ' AND ' ELSE ',' END || CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 7 = 1 THEN 'X' ELSE 'Bo Chan' END || CASE WHEN c_custkey % 4 = 0 THEN ', Cy Dunn and Bo Chan' ELSE '' END"""


@query(f"""WITH s AS (SELECT c_custkey AS id, list_filter(list_transform(string_split(regexp_replace({_LIST}, '(?i)\\s+and\\s+|\\s*&\\s*|;', ',', 'g'), ','), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 80) AS l FROM customer)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS names FROM s""")
def author_split(spark, sf_dir):
    """F30."""
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_LIST).alias("raw"))
    return raw.select("id", F.array_join(text.split_authors(F.col("raw")), "|").alias("names"))


_STAMP = """CASE o_orderkey % 8 WHEN 0 THEN d || 'T10:20:' || (10 + o_orderkey % 50) || 'Z' WHEN 1 THEN d || 'T0' || o_orderkey % 10 || ':00:59' WHEN 2 THEN d WHEN 3 THEN substr(d, 1, 7) WHEN 4 THEN substr(d, 1, 4)
 WHEN 5 THEN o_orderpriority WHEN 6 THEN substr(d, 1, 5) || '13-01' ELSE ' ' || d || ' ' END"""


@query(f"""WITH v AS (SELECT o_orderkey AS id, trim({_STAMP}) AS raw FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))
SELECT id, coalesce(strftime(coalesce(try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(raw, '%Y-%m-%dT%H:%M:%S'), try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y-%m'), try_strptime(raw, '%Y')), '%Y-%m-%d %H:%M:%S'), '') AS stamp FROM v""")
def iso_dates(spark, sf_dir):
    """D01."""
    rows = table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rows.select(F.col("o_orderkey").alias("id"), F.coalesce(F.date_format(dates.parse_iso(F.expr(_STAMP)), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("stamp"))


@query(f"""WITH {_EDGES}, {_SIGHTINGS}, a AS (SELECT paper_id, string_agg(s_name, '|' ORDER BY position, author_id) AS authors FROM e JOIN supplier ON s_suppkey = author_id GROUP BY paper_id),
c AS (SELECT paper_id, count(*) AS n FROM s GROUP BY paper_id)
SELECT o_orderkey AS paper_id, o_orderpriority, coalesce(authors, '') AS authors, coalesce(g.source, '') AS first_source, coalesce(n, 0)::BIGINT AS sightings FROM orders LEFT JOIN a ON a.paper_id = o_orderkey LEFT JOIN g ON g.paper_id = o_orderkey LEFT JOIN c ON c.paper_id = o_orderkey""")
def paper_details(spark, sf_dir):
    """Papers with all their authors and sightings; papers without any stay."""
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderpriority")
    rows = lenses.detail(papers, sightings(spark, sf_dir), pairs(spark, sf_dir), authors(spark, sf_dir))
    first = F.coalesce(F.get("sightings", 0)["source"], F.lit(""))
    return rows.select("paper_id", "o_orderpriority", F.array_join("authors", "|").alias("authors"), first.alias("first_source"), F.coalesce(F.size("sightings"), F.lit(0)).cast("long").alias("sightings"))


@query("""SELECT o_orderpriority || ' ' || o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due,
 CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE date_diff('day', DATE '1998-07-01', o_orderdate::DATE) END::BIGINT AS days_left,
 CASE WHEN o_orderkey % 5 = 0 THEN 'rolling' WHEN date_diff('day', DATE '1998-07-01', o_orderdate::DATE) <= 3 THEN 'final' WHEN date_diff('day', DATE '1998-07-01', o_orderdate::DATE) <= 14 THEN 'urgent' ELSE 'soon' END AS urgency
FROM orders WHERE o_orderkey % 5 = 0 AND o_totalprice > 250000 OR o_orderkey % 5 <> 0 AND o_orderdate::DATE BETWEEN DATE '1998-07-01' AND DATE '1998-07-31'""")
def upcoming_deadlines(spark, sf_dir):
    """Clean calls of the coming thirty days, and curated rolling ones."""
    rolling = F.col("o_orderkey") % 5 == 0
    rows = table(spark, sf_dir, "orders").select(
        F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("name"), F.when(~rolling, F.col("o_orderdate").cast("date")).alias("deadline_date"), (F.col("o_totalprice") > 250000).alias("curated"), F.col("o_totalprice").alias("relevance"),
    )
    found = lenses.deadlines(rows, F.lit("1998-07-01").cast("date"), 30)
    return found.select("name", F.coalesce(F.date_format("deadline_date", "yyyy-MM-dd"), F.lit("")).alias("due"), F.coalesce("days_left", F.lit(-1)).cast("long").alias("days_left"), "urgency")


STOP = ["the", "and"]
_TERMS = """t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{2,}')) AS term FROM benchmark),
c AS (SELECT term, count(*) AS tf, count(DISTINCT item_id) AS df FROM t WHERE term NOT IN ('the', 'and') GROUP BY term), n AS (SELECT greatest(count(*), 1) AS n FROM benchmark),
r AS (SELECT term, tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS raw FROM c, n WHERE tf >= 3 AND df::DOUBLE / n <= 0.25),
k AS (SELECT term, raw / max(raw) OVER () AS weight FROM (SELECT * FROM r ORDER BY raw DESC, term LIMIT 4000))"""


def _profile(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lit("").alias("title"), F.col("text").alias("abstract"))
    return library.term_weights(items, STOP)


@query(f"WITH {_TERMS} SELECT term, round(weight, 6) AS weight FROM k")
def library_profile(spark, sf_dir):
    """Weighted terms of a library."""
    return _profile(spark, sf_dir).select("term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_TERMS}, d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}')) AS term FROM documents),
h AS (SELECT doc_id, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC) AS p FROM d JOIN k USING (term))
SELECT doc_id, round(least(1.0, sum(weight) / 4.0), 6) AS content FROM h WHERE p <= 12 GROUP BY doc_id""")
def library_affinity(spark, sf_dir):
    """The twelve heaviest library terms of each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    found = library.content_scores(docs, _profile(spark, sf_dir), STOP)
    return found.select(F.col("paper_id").alias("doc_id"), F.round("content", 6).alias("content"))


@query("""SELECT 'W' || doc_id AS source_id, 'Work ' || doc_id || ' of ' || coalesce(source, 'none') AS title, CASE WHEN doc_id % 3 = 0 THEN '10.1/A' || doc_id ELSE '' END AS doi, CASE WHEN doc_id % 7 <> 0 THEN '2024-0' || (1 + doc_id % 9) || '-15' END AS published_at,
 array_to_string(list_filter([lang, CASE WHEN doc_id % 5 <> 0 THEN 'Bo ' || doc_id END], lambda x: x IS NOT NULL), '|') AS authors FROM documents WHERE doc_id % 11 <> 0""")
def parse_works(spark, sf_dir):
    """JSON works to papers; works without a title go, and authors without a name."""
    k, named = F.col("doc_id"), lambda name: F.struct(F.struct(name.alias("display_name")).alias("author"))
    works = table(spark, sf_dir, "documents").select(F.to_json(F.struct(
        F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.when(k % 11 != 0, F.concat(F.lit("Work "), k, F.lit(" of "), F.coalesce("source", F.lit("none")))).otherwise("").alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1/A"), k)).alias("doi"), F.when(k % 7 != 0, F.concat(F.lit("2024-0"), 1 + k % 9, F.lit("-15"))).alias("publication_date"),
        F.array(named(F.col("lang")), named(F.when(k % 5 != 0, F.concat(F.lit("Bo "), k)))).alias("authorships"),
    )).alias("value"))
    found = openalex_works(works)
    return found.select("source_id", "title", F.coalesce("doi", F.lit("")).alias("doi"), "published_at", F.array_join("authors", "|").alias("authors"))
