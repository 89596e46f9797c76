"""Queries over collector jobs: runs with a quarantine, collects of several keys with their marks, and what an ingest leaves in each table of the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signalrank.operators import ingest, jobs
from signalrank.operators.versions import Tables
from signalrank.session import checkpoint_dir, table
from signalrank.sources import records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _tables(spark) -> Tables:
    return Tables(spark, f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")


@query("""WITH d AS (SELECT doc_id AS seq, doc_id % 2 AS run, md5(text) AS title,
  CASE WHEN doc_id % 19 = 6 THEN 'empty' WHEN doc_id % 11 = 3 THEN 'malformed' WHEN doc_id % 13 = 4 OR text IS NULL THEN 'no title' WHEN doc_id % 17 = 5 THEN 'no source_id' END AS reason FROM documents),
n AS (SELECT title, min(run) AS run FROM d WHERE reason IS NULL GROUP BY title),
q AS (SELECT run, count(*) AS found, count(*) FILTER (reason = 'empty') AS n_empty, count(*) FILTER (reason = 'malformed') AS n_malformed, count(*) FILTER (reason = 'no title') AS n_no_title, count(*) FILTER (reason = 'no source_id') AS n_no_source FROM d GROUP BY run)
SELECT q.run::INT AS run, 'success' AS status, found AS items_found, (SELECT count(*) FROM n WHERE n.run = q.run) AS items_new, n_empty, n_malformed, n_no_title, n_no_source FROM q""")
def run_job(spark, sf_dir):
    """Two runs of a collector over landed items, some of them spoiled, into one store; the log and why items were put aside."""
    docs = table(spark, sf_dir, "documents")
    sound = F.to_json(F.struct(F.when(F.col("doc_id") % 13 != 4, F.md5("text")).alias("title"), F.array("lang").alias("authors"), F.when(F.col("doc_id") % 17 != 5, F.col("doc_id").cast("string")).alias("source_id")))
    value = F.when(F.col("doc_id") % 19 == 6, " ").when(F.col("doc_id") % 11 == 3, F.substring(sound, 1, 12)).otherwise(sound)
    landed, tables = docs.select(F.col("doc_id").alias("seq"), value.alias("value")), _tables(spark)
    for k in (0, 1):
        jobs.run(tables, landed.where(F.col("seq") % 2 == k), f"sensor{k}", "papers", f"2024-01-0{k + 1} 06:00:00", f"2024-01-0{k + 1} 06:05:00")
    held = tables.manifest()
    reason = lambda r, name: F.count_if(F.col("reason") == r).alias(name)
    bad = tables.read("quarantine", jobs.SCHEMAS["quarantine"], held).groupBy("sensor").agg(reason("empty", "n_empty"), reason("malformed", "n_malformed"), reason("no title", "n_no_title"), reason("no source_id", "n_no_source"))
    runs = tables.read("runs", jobs.SCHEMAS["runs"], held).join(bad, "sensor", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_empty", "n_malformed", "n_no_title", "n_no_source")]
    return runs.select(F.substring("sensor", -1, 1).cast("int").alias("run"), "status", "items_found", "items_new", *counts)


@query("""WITH r AS (SELECT user_id % 500 AS k, event_type <> 'signup' AS ok, event_id % 4 AS n FROM events),
a AS (SELECT k, bool_and(ok) AS s, bool_or(ok) AS p, bool_or(ok AND n > 0) AS w FROM r GROUP BY k), u AS (SELECT unnest(['success', 'page', 'rows']) AS rule)
SELECT rule, k::VARCHAR AS key, CASE WHEN (rule = 'success' AND s OR rule = 'page' AND p OR rule = 'rows' AND w) AND NOT k % 10 = 0 THEN '2024-06-01' WHEN k % 10 = 0 THEN '2024-07-01' ELSE '2024-05-01' END AS mark
FROM a, u WHERE k % 3 <> 1 OR k % 10 = 0 OR rule = 'success' AND s OR rule = 'page' AND p OR rule = 'rows' AND w""")
def mark_rules(spark, sf_dir):
    """Events as answers to requests; which keys' marks move under each rule. Some keys have no mark yet, some a later one."""
    answers = table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("k"), (F.col("event_type") != "signup").alias("ok"), (F.col("event_id") % 4).alias("rows"))
    keys = answers.select("k").distinct()
    marks = keys.where("k % 3 <> 1 OR k % 10 = 0").select(F.col("k").cast("string").alias("key"), F.when(F.col("k") % 10 == 0, "2024-07-01").otherwise("2024-05-01").alias("mark"))
    answers = answers.select(F.col("k").cast("string").alias("key"), "ok", "rows")
    moved = [jobs.moved(marks, answers, rule, F.lit("2024-06-01")).withColumn("rule", F.lit(rule)) for rule in jobs.RULES]
    return moved[0].unionByName(moved[1]).unionByName(moved[2])


_JOURNALS = """d AS (SELECT doc_id, 'j' || doc_id % 40 AS key, doc_id % 40 AS turn, doc_id // 40 % 3 AS page, doc_id % 100 AS number, doc_id % 21 = 3 AS junk, doc_id % 40 % 7 <> 2 OR doc_id // 40 % 3 > 0 AS ok FROM documents),
g AS (SELECT * FROM d WHERE ok AND NOT junk)"""


@query(f"""WITH {_JOURNALS}, f AS (SELECT number, arg_min(doc_id, (turn, page, doc_id)) AS doc_id FROM g GROUP BY number),
m AS (SELECT key, CASE WHEN bool_and(ok) THEN '2024-06-01' ELSE '2024-01-01' END AS mark FROM d GROUP BY key)
SELECT 'paper' AS kind, '10.3/' || number AS key, 'Work ' || doc_id AS value FROM f UNION ALL SELECT 'mark', key, mark FROM m""")
def journal_collect(spark, sf_dir):
    """Pages of journals, some of which did not come; works of all of them, each once, and each journal's mark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("turn"), (F.floor(F.col("doc_id") / 40) % 3).alias("page"))
    title = F.when(F.col("doc_id") % 21 != 3, F.concat(F.lit("Work "), "doc_id"))
    work = F.struct(F.array(title).alias("title"), F.concat(F.lit("10.3/"), F.col("doc_id") % 100).alias("DOI"))
    pages = docs.groupBy("turn", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", work.alias("work")))), lambda x: x["work"]).alias("items"))
    ok = (F.col("turn") % 7 != 2) | (F.col("page") > 0)
    answers = pages.select(F.concat(F.lit("j"), "turn").alias("key"), "turn", "page", ok.alias("ok"), F.to_json(F.struct(F.struct("items").alias("message"))).alias("value"))
    carry = ("key", "turn", "page", "item")
    items, came = jobs.collected(answers, lambda rows: records.crossref_works(records.message_items(rows), F.lit("2024-06-01").cast("date"), carry), order=("turn", "page", "item"))
    marks = jobs.moved(answers.select("key", F.lit("2024-01-01").alias("mark")).distinct(), came, "success", F.lit("2024-06-01"))
    paper = F.from_json("value", jobs.ITEM)
    papers = items.select(F.lit("paper").alias("kind"), paper["source_id"].alias("key"), paper["title"].alias("value"))
    return papers.unionByName(marks.select(F.lit("mark").alias("kind"), "key", F.col("mark").alias("value")))


#: Sources whose documents are in the store already; the others arrive.
STORED = [f"src{k}" for k in range(10)]
_INGEST = f"""n AS (SELECT doc_id AS id, CASE WHEN coalesce(source IN ({", ".join(f"'{s}'" for s in STORED)}), false) THEN -1 ELSE doc_id END AS rk, md5(coalesce(text, '')) AS title,
  CASE WHEN doc_id % 3 = 0 THEN '10.5/' || doc_id % 90 END AS doi, coalesce(source, 'none') || repeat('z', (doc_id % 5)::INT) AS abstract, 'u' || doc_id AS url, CASE WHEN doc_id % 5 <> 0 THEN '2024-0' || (1 + doc_id % 9) END AS published_at,
  CASE doc_id % 4 WHEN 0 THEN 'journal_article' WHEN 1 THEN 'working_paper' WHEN 2 THEN 'report' END AS paper_type, ['L' || coalesce(lang, 'none'), 'J' || doc_id % 3] AS codes,
  [CASE WHEN doc_id % 2 = 0 THEN 'Land' ELSE 'land' END, 'k' || doc_id % 4] AS words, coalesce(source, 'none') AS source, (doc_id % 300)::VARCHAR AS source_id,
  ['Ann ' || coalesce(source, 'none'), 'Bo ' || coalesce(lang, 'none')] AS names, ['Inst' || repeat('x', (doc_id % 4)::INT), ''] AS places FROM documents),
f AS (SELECT b.id, coalesce(d.s, t.s) AS paper FROM n b LEFT JOIN (SELECT doi, min(id) AS s FROM n WHERE rk < 0 AND doi IS NOT NULL GROUP BY doi) d ON d.doi = b.doi LEFT JOIN (SELECT title, min(id) AS s FROM n WHERE rk < 0 GROUP BY title) t ON t.title = b.title WHERE b.rk >= 0),
w AS (SELECT n.* FROM n JOIN f ON f.id = n.id WHERE paper IS NULL),
z AS (SELECT id AS a, min(id) OVER (PARTITION BY title) AS b FROM w UNION SELECT id, min(id) OVER (PARTITION BY doi) FROM w WHERE doi IS NOT NULL),
e AS (SELECT a, b FROM z UNION SELECT b, a FROM z), r(id, low) AS (SELECT id, id FROM w UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b),
o AS (SELECT id, id AS paper FROM n WHERE rk < 0 UNION ALL SELECT id, paper FROM f WHERE paper IS NOT NULL UNION ALL SELECT id, min(low) FROM r GROUP BY id),
h AS (SELECT o.paper, n.* FROM n JOIN o ON o.id = n.id)"""
_EACH = "(SELECT paper, rk, id, unnest({c}) AS x, generate_subscripts({c}, 1) AS pos FROM h)"


def _ingested(spark, sf_dir) -> ingest.Changes:
    docs = table(spark, sf_dir, "documents")
    k, source, lang = F.col("doc_id"), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    every = docs.select(
        k.alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("title"), F.when(k % 3 == 0, text("10.5/", k % 90)).alias("doi"), text(source, F.repeat(F.lit("z"), (k % 5).cast("int"))).alias("abstract"), text("u", k).alias("url"),
        F.when(k % 5 != 0, text("2024-0", 1 + k % 9)).alias("published_at"), F.when(k % 4 == 0, "journal_article").when(k % 4 == 1, "working_paper").when(k % 4 == 2, "report").alias("paper_type"),
        F.array(text("L", lang), text("J", k % 3)).alias("jel_codes"), F.array(F.when(k % 2 == 0, "Land").otherwise("land"), text("k", k % 4)).alias("keywords"), F.array(text("Ann ", source), text("Bo ", lang)).alias("authors"),
        F.array(text("Inst", F.repeat(F.lit("x"), (k % 4).cast("int"))), F.lit("")).alias("affiliations"), source.alias("source"), (k % 300).cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("raw_metadata"), F.coalesce(F.col("source").isin(STORED), F.lit(False)).alias("old"),
    )
    stored = every.where("old")
    named = stored.select("id", F.posexplode("authors").alias("position", "name")).withColumn("name_normalized", F.lower("name"))
    people = named.groupBy("name_normalized").agg(F.min("name").alias("name")).select(F.xxhash64("name_normalized").alias("author_id"), "name", "name_normalized", F.lit("Ins").alias("affiliation"))
    columns = [c.split(" ")[0] for c in jobs.SCHEMAS["papers"].split(", ")]
    sources = stored.groupBy("source", "source_id").agg(F.min("id").alias("paper_id"), F.first("source_url").alias("source_url"), F.first("raw_metadata").alias("raw_metadata"))
    held = ingest.Store(stored.select(*columns), sources, people, named.select(F.col("id").alias("paper_id"), F.xxhash64("name_normalized").alias("author_id"), "position"))
    store, went = ingest.ingest(every.where("not old").drop("old"), held)
    return store


@query(f"""WITH RECURSIVE {_INGEST}, c AS (SELECT paper, x, min((rk, pos)) AS o FROM {_EACH.format(c="codes")} GROUP BY paper, x),
k AS (SELECT paper, arg_min(x, (rk, pos)) AS x, min((rk, pos)) AS o FROM {_EACH.format(c="words")} GROUP BY paper, lower(x))
SELECT h.paper AS id, arg_min(title, (rk, id)) AS title, arg_min(doi, rk) FILTER (doi IS NOT NULL) AS doi, arg_max(abstract, (length(abstract), -rk)) AS abstract, arg_min(url, (rk, id)) AS url, min(published_at) AS published_at,
 arg_max(paper_type, (CASE paper_type WHEN 'journal_article' THEN 2 WHEN 'working_paper' THEN 1 ELSE 0 END, paper_type IS NOT NULL, -rk)) AS paper_type,
 (SELECT string_agg(x, ',' ORDER BY o) FROM c WHERE c.paper = h.paper) AS codes, (SELECT string_agg(x, ',' ORDER BY o) FROM k WHERE k.paper = h.paper) AS keywords FROM h GROUP BY h.paper""")
def ingest_papers(spark, sf_dir):
    """Papers of a store after a batch that shares DOIs and titles with it and within itself."""
    return _ingested(spark, sf_dir).papers.select("id", "title", "doi", "abstract", "url", "published_at", "paper_type", F.array_join("jel_codes", ",").alias("codes"), F.array_join("keywords", ",").alias("keywords"))


@query(f"""WITH RECURSIVE {_INGEST} SELECT source, source_id, arg_min(paper, (rk, id)) AS paper_id FROM h GROUP BY source, source_id""")
def ingest_sources(spark, sf_dir):
    """Sightings, each of a source's ids once, with the paper that its first record went to."""
    return _ingested(spark, sf_dir).sources.select("source", "source_id", "paper_id")


@query(f"""WITH RECURSIVE {_INGEST}, a AS (SELECT rk, id, unnest(names) AS name, unnest(places) AS place FROM h), l AS (SELECT lower(name) AS name_normalized, min(rk) < 0 AS old, arg_min(name, (rk, id)) AS name,
 arg_max(nullif(place, ''), (length(place), -id)) FILTER (rk >= 0 AND place <> '') AS place FROM a GROUP BY lower(name))
SELECT name_normalized, name, CASE WHEN old AND length(coalesce(place, '')) <= 3 THEN 'Ins' ELSE place END AS affiliation FROM l""")
def ingest_authors(spark, sf_dir):
    """Authors of a store after a batch: the stored name stays, the longer affiliation wins."""
    return _ingested(spark, sf_dir).authors.select("name_normalized", "name", "affiliation")


@query(f"""WITH RECURSIVE {_INGEST}, a AS (SELECT paper, rk, id, unnest(names) AS name, unnest([0, 1]) AS position FROM h)
SELECT paper AS paper_id, lower(name) AS name_normalized, arg_min(position, (rk, id, position))::INT AS position FROM a GROUP BY paper, lower(name)""")
def ingest_links(spark, sf_dir):
    """Links of papers and authors after a batch, each pair once, at the place where it was first."""
    found = _ingested(spark, sf_dir)
    return found.links.join(found.authors.select("author_id", "name_normalized"), "author_id").select("paper_id", "name_normalized", "position")
