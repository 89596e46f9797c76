"""Queries over documents as papers: one work of several records, ingest into a store, feed, newsletter and brief. SQL writes the same rules out."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalrank.operators import ingest, resolve
from signalrank.plans import lenses
from signalrank.plans.text_queries import LINE, NORMAL, first_line
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


def papers(spark, sf_dir):
    """Documents as papers; two authors for each language, so that papers of one language share two family names."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), first_line().alias("title"), F.array("lang", F.concat("lang", F.lit("x"))).alias("authors"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1234/d"), "doc_id")).alias("doi"), F.when(F.col("n_chars") >= 1000, F.col("source")).alias("abstract"), none.alias("published_at"), "source",
        F.array().cast("array<string>").alias("jel"), "lang", "n_chars",
    )


#: Titles, their token sets, and pairs that are the same work: similarity of 0.85, or of 0.70 with two shared family names.
_WORK = f"""n AS (SELECT doc_id AS id, lang, source, n_chars, {NORMAL} AS title FROM documents),
k AS (SELECT *, list_distinct(list_filter(string_split(title, ' '), lambda x: x <> '')) AS k FROM n),
e AS (SELECT id, lang, unnest(k) AS t, len(k) AS n FROM k),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb, coalesce(any_value(x.lang = y.lang), false) AS same FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id),
j AS (SELECT a, b, same, c::DOUBLE / (na + nb - c) AS sim FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.85 - 1e-12 OR (same AND c::DOUBLE / (na + nb - c) >= 0.7 - 1e-12))"""
_CLUSTERS = f"""{_WORK}, g AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j),
r(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.low FROM r JOIN g ON g.a = r.id WHERE r.low < g.b), m AS (SELECT id, min(low) AS cluster FROM r GROUP BY id)"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT id AS doc_id, cluster FROM m")
def same_work_components(spark, sf_dir):
    """Papers that are, directly or by others, the same work."""
    return resolve.same_work(papers(spark, sf_dir)).select(F.col("id").alias("doc_id"), "cluster")


@query(f"""WITH RECURSIVE {_CLUSTERS}, d AS (SELECT n.id, n.title, source, cluster, CASE WHEN source = 'src0' THEN 1.0 WHEN source = 'src1' THEN 0.8 ELSE 0.3 END AS prestige,
 CASE WHEN n.id % 3 = 0 THEN '10.1234/d' || n.id END AS doi, CASE WHEN n_chars >= 1000 THEN source END AS abstract FROM n JOIN m ON m.id = n.id),
x AS (SELECT *, (doi IS NOT NULL)::INT + (abstract IS NOT NULL)::INT AS complete, coalesce(length(abstract), 0) AS size FROM d),
b AS (SELECT cluster, arg_max(id, (prestige, complete, size, -id)) AS best, min(id) AS pos, count(*)::BIGINT AS members, arg_min(doi, id) FILTER (WHERE doi IS NOT NULL) AS any_doi, max(size) AS size FROM x GROUP BY cluster),
o AS (SELECT b.cluster, string_agg(DISTINCT source, ',' ORDER BY source) AS also_in FROM b JOIN x ON x.cluster = b.cluster AND x.id <> b.best GROUP BY b.cluster)
SELECT b.cluster, b.best AS id, b.pos, members, coalesce(x.doi, any_doi, '') AS doi, b.size::BIGINT AS abstract_size, coalesce(also_in, '') AS also_in FROM b JOIN x ON x.id = b.best LEFT JOIN o ON o.cluster = b.cluster""")
def collapse_duplicates(spark, sf_dir):
    """One row for each work, its best record with what the others add."""
    prestige = F.when(F.col("source") == "src0", 1.0).when(F.col("source") == "src1", 0.8).otherwise(0.3)
    found = resolve.collapse(papers(spark, sf_dir).drop("lang", "n_chars"), prestige)
    return found.select(
        "cluster", "id", "pos", "members", F.coalesce("doi", F.lit("")).alias("doi"), F.length(F.coalesce("abstract", F.lit(""))).cast("long").alias("abstract_size"), F.array_join("also_in", ",").alias("also_in")
    )


@query(f"""WITH n AS (SELECT doc_id, lang, {NORMAL} AS title FROM documents), s AS (SELECT item_id, {NORMAL} AS title FROM benchmark)
SELECT doc_id, lang FROM n WHERE doc_id NOT IN (SELECT item_id FROM s) AND NOT (title <> '' AND title IN (SELECT title FROM s))""")
def seen_suppression(spark, sf_dir):
    """Documents whose DOI or title a library of benchmark items does not have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", first_line().alias("title"), F.concat(F.lit("https://doi.org/10.9/"), "doc_id").alias("doi"))
    seen = table(spark, sf_dir, "benchmark").select(first_line().alias("title"), F.concat(F.lit("doi:10.9/"), "item_id").alias("doi"))
    return resolve.suppress_seen(docs, seen).select("doc_id", "lang")


@query("""WITH r AS (SELECT doc_id, text, source, lang, CASE WHEN doc_id % 2 = 0 THEN '10.5/' || doc_id ELSE '' END AS doi, repeat(source, (doc_id % 3)::INT) AS abstract,
 CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'journal_article' WHEN source IN ('src3', 'src4') THEN 'working_paper' ELSE 'report' END AS kind, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS day FROM documents),
d AS (SELECT text, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY text HAVING count(*) > 1)
SELECT o.doc_id AS id, coalesce(nullif(o.doi, ''), nullif(n.doi, '')) AS doi, CASE WHEN length(n.abstract) > length(o.abstract) THEN n.abstract ELSE o.abstract END AS abstract,
 CASE WHEN (CASE n.kind WHEN 'journal_article' THEN 2 WHEN 'working_paper' THEN 1 ELSE 0 END) > (CASE o.kind WHEN 'journal_article' THEN 2 WHEN 'working_paper' THEN 1 ELSE 0 END) THEN n.kind ELSE o.kind END AS paper_type,
 CASE WHEN o.lang = n.lang THEN o.lang ELSE o.lang || ',' || n.lang END AS codes, CASE WHEN o.source = n.source THEN o.source || ',K' ELSE o.source || ',K,' || upper(n.source) END AS keywords, least(o.day, n.day) AS published_at
FROM d JOIN r o ON o.doc_id = d.a JOIN r n ON n.doc_id = d.b""")
def merge_metadata(spark, sf_dir):
    """U05 on the first and last of equal documents."""
    kind = F.when(F.col("source").isin("src0", "src1", "src2"), "journal_article").when(F.col("source").isin("src3", "src4"), "working_paper").otherwise("report")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("key"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.5/"), "doc_id")).otherwise("").alias("doi"), F.repeat("source", (F.col("doc_id") % 3).cast("int")).alias("abstract"),
        kind.alias("paper_type"), F.array("lang").alias("jel_codes"), "source", day.alias("published_at"),
    )
    pairs = rows.groupBy("key").agg(F.min_by(F.struct(*rows.columns), "doc_id").alias("o"), F.max_by(F.struct(*rows.columns), "doc_id").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # The new record writes its keywords in capitals: equal ones are known without regard to case.
    words = {"o": F.array("o.source", F.lit("K")), "n": F.array(F.upper("n.source"), F.lit("k"))}
    pairs = pairs.select(*(F.col(s).withField("keywords", words[s]).alias(s) for s in "on"))
    return pairs.select(F.col("o.doc_id").alias("id"), resolve.merged_metadata("o", "n").alias("m")).select(
        "id", "m.doi", "m.abstract", "m.paper_type", F.array_join("m.jel_codes", ",").alias("codes"), F.array_join("m.keywords", ",").alias("keywords"), "m.published_at"
    )


#: Sources whose documents are in the store already; the others arrive.
STORED = [f"src{k}" for k in range(10)]
PAPER = ["id", "title", "doi", "abstract", "url", "published_at", "paper_type", "jel_codes", "keywords"]
_OLD = ", ".join(f"'{s}'" for s in STORED)


@query(f"""WITH RECURSIVE {_WORK}, o AS (SELECT id, coalesce(source IN ({_OLD}), false) AS old FROM n),
h AS (SELECT CASE WHEN x.old THEN b ELSE a END AS id, CASE WHEN x.old THEN a ELSE b END AS stored, CASE WHEN u.title = v.title THEN 2 WHEN sim >= 0.85 - 1e-12 THEN 3 ELSE 4 END AS step
 FROM j JOIN o x ON x.id = a JOIN o y ON y.id = b JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE x.old <> y.old),
f AS (SELECT id, arg_min(stored, (step, stored)) AS stored FROM h GROUP BY id),
w AS (SELECT id FROM o WHERE NOT old AND id NOT IN (SELECT id FROM f)),
g AS (SELECT a, b FROM j WHERE a IN (SELECT id FROM w) AND b IN (SELECT id FROM w) UNION ALL SELECT b, a FROM j WHERE a IN (SELECT id FROM w) AND b IN (SELECT id FROM w)),
r(id, low) AS (SELECT id, id FROM w UNION SELECT g.b, r.low FROM r JOIN g ON g.a = r.id WHERE r.low < g.b)
SELECT id, stored AS paper_id, false AS is_new FROM f UNION ALL SELECT id, min(low), id = min(low) FROM r GROUP BY id""")
def ingest_batch(spark, sf_dir):
    """Documents of some sources arrive at a store of the others; where each record goes."""
    docs, none = table(spark, sf_dir, "documents"), F.lit(None).cast("string")
    old = F.coalesce(F.col("source").isin(STORED), F.lit(False))
    lists = F.array().cast("array<string>")
    every = docs.select(
        F.col("doc_id").alias("id"), first_line().alias("title"), F.array("lang", F.concat("lang", F.lit("x"))).alias("authors"), none.alias("doi"), none.alias("abstract"), none.alias("url"), none.alias("published_at"),
        none.alias("paper_type"), lists.alias("jel_codes"), lists.alias("keywords"), lists.alias("affiliations"), "source", F.col("doc_id").cast("string").alias("source_id"), none.alias("source_url"), none.alias("raw_metadata"), old.alias("old"),
    )
    stored = every.where("old")
    known = stored.select(F.posexplode("authors").alias("position", "name"), "id").where("name is not null")
    people = known.groupBy(F.col("name").alias("name_normalized")).agg(F.first("name").alias("name")).select(F.xxhash64("name_normalized").alias("author_id"), "name", "name_normalized", none.alias("affiliation"))
    links = known.select(F.col("id").alias("paper_id"), F.xxhash64("name").alias("author_id"), "position")
    held = ingest.Store(stored.select(*PAPER), stored.select("source", "source_id", F.col("id").alias("paper_id"), "source_url", "raw_metadata"), people, links)
    return ingest.ingest(every.where("not old").drop("old"), held)[1]



_PERCENT = "((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER ())"
_CAPTION = "regexp_matches(line, '(?i)^\\s*(the|this|an?)\\s+(image|photo|picture|graphic|graph|chart|visual($|[^\\p{L}\\p{N}_])|visualization|infographic|screenshot|tweet|post|figure|map|table|data visualization|accompanying)')"


def _collapsed(pool: str, prestige: str) -> str:
    """SQL after tables n, k, e, p, j: works of `pool` (id, pos, ...) as (id, pos, also_in), each with its best record at the place of its first."""
    return f"""g AS (SELECT a, b FROM j WHERE a IN (SELECT id FROM {pool}) AND b IN (SELECT id FROM {pool}) UNION ALL SELECT b, a FROM j WHERE a IN (SELECT id FROM {pool}) AND b IN (SELECT id FROM {pool})),
r(id, low) AS (SELECT id, id FROM {pool} UNION SELECT g.b, r.low FROM r JOIN g ON g.a = r.id WHERE r.low < g.b), m AS (SELECT id, min(low) AS cluster FROM r GROUP BY id),
x AS (SELECT y.*, cluster, {prestige} AS prestige FROM {pool} y JOIN m ON m.id = y.id),
b AS (SELECT cluster, arg_max(id, (prestige, -pos)) AS best, min(pos) AS place FROM x GROUP BY cluster),
o AS (SELECT b.cluster, string_agg(DISTINCT source, ',' ORDER BY source) AS also_in FROM b JOIN x ON x.cluster = b.cluster AND x.id <> b.best GROUP BY b.cluster)"""


@query(f"""WITH RECURSIVE {_WORK}, l AS (SELECT doc_id AS id, {LINE} AS line, source, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS relevance, (doc_id % 10) / 10.0::DOUBLE AS library FROM documents),
t AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS nr FROM l ORDER BY relevance DESC, id LIMIT 600),
f AS (SELECT *, ({_PERCENT.format(c='relevance')} + {_PERCENT.format(c='library')}) / 2.0::DOUBLE AS final FROM t),
q AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY final DESC, nr) AS pos FROM f) WHERE NOT {_CAPTION}),
{_collapsed('q', "CASE source WHEN 'nber' THEN 1.0 ELSE 0.3 END")}
SELECT b.best AS id, b.place::BIGINT AS pos, round(x.relevance, 4) AS score, coalesce(also_in, '') AS also_in, 'https://doi.org/10.7/' || b.best AS url FROM b JOIN x ON x.id = b.best LEFT JOIN o ON o.cluster = b.cluster ORDER BY place LIMIT 250""")
def feed_snapshot(spark, sf_dir):
    """The best of a pool by mean percentile of two channels, each work once, in order."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("paper_id"), first_line().alias("title"), F.array("lang", F.concat("lang", F.lit("x"))).alias("authors"), none.alias("abstract"), F.concat(F.lit("10.7/"), "doc_id").alias("doi"), none.alias("url"), "source",
        none.alias("venue"), none.alias("published_at"), F.array().cast("array<string>").alias("jel"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("relevance"), (F.col("doc_id") % 10 / 10).alias("library"),
    )
    found = lenses.feed(rows, None, ["the"], ["relevance", "library"])
    return found.select("id", "pos", "score", F.array_join("also_in", ",").alias("also_in"), "url")


@query(f"""WITH RECURSIVE {_WORK}, l AS (SELECT doc_id AS id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS relevance, (doc_id % 10) / 10.0::DOUBLE AS library, CASE WHEN doc_id % 3 = 0 THEN 'nber' ELSE 'crossref' END AS source FROM documents WHERE doc_id % 2 = 0),
t AS (SELECT *, CASE WHEN source = 'nber' THEN 0.15 ELSE 0.0 END::DOUBLE AS trust FROM l ORDER BY relevance DESC, id LIMIT 150),
f AS (SELECT *, ({_PERCENT.format(c='relevance')} + {_PERCENT.format(c='library')} + {_PERCENT.format(c='trust')}) / 3.0::DOUBLE AS final FROM t),
q AS (SELECT *, row_number() OVER (ORDER BY final DESC, id) AS pos FROM f), {_collapsed('q', "CASE source WHEN 'nber' THEN 1.0 ELSE 0.8 END")}
SELECT best AS paper_id, x.source FROM b JOIN x ON x.id = b.best ORDER BY place LIMIT 8""")
def newsletter_feed(spark, sf_dir):
    """Papers of the newsletter, blocked registrants out, each work once."""
    none = F.lit(None).cast("string")
    day = F.lit("2024-01-02").cast("date")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("paper_id"), first_line().alias("title"), none.alias("abstract"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.7/"), "doc_id")).otherwise("10.5281/zenodo").alias("doi"), none.alias("published_at"), none.alias("url"),
        F.array(F.when(F.col("doc_id") % 3 == 0, "nber").otherwise("crossref")).alias("sources"), F.array(F.lit("O1")).alias("jel_codes"), F.array("lang", F.concat("lang", F.lit("x"))).alias("authors"), day.alias("first_seen"),
        (F.col("doc_id") * 7919 % 1000 / 1000).alias("relevance"), (F.col("doc_id") % 10 / 10).alias("library"),
    )
    return lenses.newsletter_papers(rows, day).select("paper_id", F.element_at("sources", 1).alias("source"))


@query("""WITH l AS (SELECT p_partkey AS id, p_retailprice / 3000 AS relevance, p_size % 2 = 0 AS article, 2 * (p_size % 3 = 0)::INT + CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 1 END - CASE WHEN p_size % 7 = 0 THEN 5 ELSE 0 END AS quality FROM part),
t AS (SELECT * FROM (SELECT * FROM l ORDER BY relevance DESC, id LIMIT 200) WHERE quality >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY quality DESC, relevance DESC, id) AS n FROM t)
SELECT id AS paper_id, quality FROM k ORDER BY CASE WHEN n > 6 THEN 2 WHEN article THEN 0 ELSE 1 END, quality DESC, relevance DESC, id LIMIT 10""")
def daily_brief(spark, sf_dir):
    """Papers with enough evidence, the best of each track, ten in all."""
    none, day = F.lit(None).cast("string"), F.lit("2024-01-02").cast("date")
    pick = lambda *lists: F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in lists]), (F.col("p_size") % len(lists)).cast("int") + 1)
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), none.alias("abstract"), day.alias("first_seen"), none.alias("published_at"), F.when(F.col("p_size") % 2 == 0, "journal_article").otherwise("working_paper").alias("paper_type"),
        none.alias("venue"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("O1"))).otherwise(F.array().cast("array<string>")).alias("jel_codes"), pick(["nber"], ["crossref"], ["openalex"], ["openalex", "crossref"]).alias("sources"),
        F.when(F.col("p_size") % 7 == 0, "10.5281/z").alias("doi"), none.alias("url"), F.lit(False).alias("blocked_source"), (F.col("p_retailprice") / 3000).alias("relevance"),
    )
    return lenses.brief(rows, day).select("paper_id", "quality")
