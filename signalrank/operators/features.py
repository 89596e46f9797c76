"""Relevance features of papers as grouped joins over whole tables, and their weighted sum.

Each feature is a DataFrame (paper_id, value) or a Column; `composite` joins them once. Weights and word lists are
parameters; the defaults are the fixed values below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalrank.functions import dates
from signalrank.functions.predicates import names_india
from signalrank.functions.text import let, whole_phrase
from signalrank.session import cut, scratch, sized

# Weights of the composite, prestige of sources, journal tiers.
WEIGHTS = {"jel": 0.15, "keyword": 0.22, "author": 0.05, "prestige": 0.35, "recency": 0.05, "social": 0.03}
INDIA_AMPLIFIER = 0.05
CORE_CREDIT, SECONDARY_CREDIT = 1.0, 0.25
PRESTIGE_DEFAULT = 0.3
PRESTIGE = {
    "nber": 1.0, "crossref": 0.8, "worldbank": 0.6, "iza": 0.6, "bread": 0.6, "repec_nep": 0.5, "imf": 0.5, "semantic_scholar": 0.45, "arxiv": 0.45, "igc": 0.45,
    "jpal_sa": 0.45, "india_think_tanks": 0.4, "rbi": 0.4, "mospi": 0.4, "openalex": 0.3, "rss_feeds": 0.3, "bluesky": 0.15, "mastodon": 0.15, "twitter": 0.15, "twitter_bridge": 0.15,
}
TOP_FIVE = [
    "american economic review", "aer", "quarterly journal of economics", "qje", "econometrica", "journal of political economy", "jpe",
    "review of economic studies", "restud",
]
TOP_FIELD = [
    "journal of development economics", "jde", "journal of urban economics", "jue", "journal of human resources", "jhr", "journal of labor economics", "jle",
    "journal of public economics", "jpube", "review of economics and statistics", "restat", "american economic journal", "world development",
    "the economic journal", "economic journal", "journal of the european economic association", "jeea", "journal of development studies",
    "world bank economic review", "economic development and cultural change", "journal of economic geography", "regional science and urban economics",
    "journal of economic growth", "explorations in economic history", "economic and political weekly", "indian economic review",
]
def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it is measured to take at most `most` bytes."""
    return sized(df, most)


def code_scores(codes: DataFrame, weights: DataFrame, default: float = 0.1) -> DataFrame:
    """(paper_id, jel): the best of a paper's codes (paper_id, code), each with the weight of its longest known prefix. weights: (prefix, weight).

    The weights of distinct codes are a written table, so that the papers' codes meet it without a shuffle where it is small.
    """
    trimmed = codes.select("paper_id", F.trim("code").alias("code")).where("code <> ''")
    each = trimmed.select("code").distinct().select("code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substr("code", F.lit(1), n))).alias("prefix"))
    known = cut(each.join(small(weights), "prefix").groupBy("code").agg(F.max_by("weight", F.length("prefix")).alias("weight")), narrow=True)
    best = F.max(F.coalesce("weight", F.lit(default)))
    return trimmed.join(small(known), "code", "left").groupBy("paper_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), best)).alias("jel"))


def keyword_score(title: Column, abstract: Column, phrases: list[str], core: list[str]) -> Column:
    """Whole-word phrases: a core one counts 1, another a quarter, together at most 1."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    total = F.lit(0.0)
    for phrase in sorted({p.lower() for p in phrases}):
        there = F.contains(low, F.lit(phrase)) & F.rlike(low, F.lit(whole_phrase([phrase])))
        total = total + F.when(there, F.lit(CORE_CREDIT if phrase in core else SECONDARY_CREDIT)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)


def matched_topics(text: Column, topics: list[str]) -> Column:
    """Sorted topics that stand as whole phrases in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(F.rlike(low, F.lit(whole_phrase([t.lower()]))), F.lit(t)) for t in topics]
    return F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def interest_terms(title: Column, abstract: Column, phrases: list[str], most: int = 12) -> Column:
    """Sorted interest phrases that stand whole in title or abstract, the first `most`: a limit of what is shown, not of what scores."""
    return F.slice(matched_topics(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))), sorted(set(phrases))), 1, most)


def journal_score(meta: Column) -> Column:
    """Tier of the journal that stored metadata (JSON text) names: the first venue that names a listed journal decides, the top tier before the other."""
    paths = ["journal", "venue", "journal_name", "container_title", "host_venue", "primary_location"]
    plain = [F.get_json_object(meta, f"$.{p}") for p in paths]
    nested = [F.coalesce(F.nullif(F.get_json_object(meta, f"$.{p}.display_name"), F.lit("")), F.get_json_object(meta, f"$.{p}.name")) for p in paths]
    named = lambda p, n: F.when(F.startswith(p, F.lit("{")), n).when(~F.startswith(p, F.lit("[")), p)
    found = let(F.array(*plain), lambda ps: F.array(*[named(F.get(ps, F.lit(k)), n) for k, n in enumerate(nested)]))
    names = F.transform(F.array_compact(found), F.lower)
    names_one = lambda v, listed: F.exists(F.array(*map(F.lit, listed)), lambda j: F.contains(v, j))
    tiers = F.transform(names, lambda v: F.when(names_one(v, TOP_FIVE), F.lit(1.0)).when(names_one(v, TOP_FIELD), F.lit(0.8)))
    return F.when(meta.isNull(), 0.0).otherwise(F.coalesce(F.get(F.array_compact(tiers), 0), F.lit(0.0)))


def source_score(source: Column, url: Column) -> Column:
    """Prestige of a source, capped for links to repositories."""
    name, link = F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lower(F.coalesce(url, F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in PRESTIGE.items() for x in pair])
    score = F.coalesce(F.try_element_at(table, name), F.lit(PRESTIGE_DEFAULT))
    cap = F.when(F.contains(link, F.lit("zenodo.org")), 0.1).when(F.contains(link, F.lit("osf.io")) | F.contains(link, F.lit("figshare.com")), 0.2).otherwise(1.0)
    return F.least(score, cap)


def prestige_scores(sources: DataFrame) -> DataFrame:
    """(paper_id, prestige) of sightings (paper_id, source, source_url, raw_metadata)."""
    best = F.max(F.greatest(source_score(F.col("source"), F.col("source_url")), journal_score(F.col("raw_metadata"))))
    return sources.groupBy("paper_id").agg(F.least(F.lit(1.0), best).alias("prestige"))


def author_scores(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """(paper_id, author): 1 with a tracked author, .5 with a co-author of one, .3 with a discovered one, else 0; all 0 when nobody is tracked.

    edges (paper_id, author_id), which may repeat, authors (author_id, is_tracked, auto_discovered). Starts from the tracked authors' papers, so the join
    never goes through the papers of everyone. The tier of discovered authors keeps looking for a co-author first. Tiers are
    given to authors, in a written table that all edges meet once.
    """
    tracked = authors.where("is_tracked").select("author_id")
    with scratch(edges.sparkSession) as kept:
        tracked_papers = cut(edges.join(tracked, "author_id", "left_semi").select("paper_id").distinct(), narrow=True)
        near = edges.join(small(tracked_papers), "paper_id", "left_semi").select("author_id").distinct().withColumn("near", F.lit(True))
        some = tracked.limit(1).withColumn("some", F.lit(True)).select("some")
        tier = F.when(F.col("some").isNull(), 0.0).when(F.col("is_tracked"), 1.0).when(F.col("near"), 0.5).when(F.col("auto_discovered"), 0.3).otherwise(0.0)
        tiers = kept(authors.join(near, "author_id", "left").join(F.broadcast(some), F.lit(True), "left").select("author_id", tier.alias("tier")), narrow=True)
    return edges.join(small(tiers), "author_id").groupBy("paper_id").agg(F.max("tier").alias("author"))


def social_scores(posts: DataFrame) -> DataFrame:
    """(paper_id, social): 1 from three linked posts, .5 from one."""
    return posts.where("paper_id is not null").groupBy("paper_id").agg(F.when(F.count(F.lit(1)) >= 3, 1.0).otherwise(0.5).alias("social"))


def india_scores(papers: DataFrame, edges: DataFrame, authors: DataFrame) -> DataFrame:
    """(paper_id, india): 1 when the text, an author's country or an affiliation says so, else 0."""
    home = (F.upper(F.trim(F.coalesce("country", F.lit("")))) == "IN") | names_india(F.col("affiliation"))
    by_author = edges.join(authors.where(home).select("author_id"), "author_id", "left_semi").select("paper_id").distinct().withColumn("home", F.lit(True))
    texts = papers.select("paper_id", names_india(F.concat_ws(" ", "title", "abstract")).alias("text"))
    return texts.join(by_author, "paper_id", "left").select("paper_id", F.when(F.col("text") | F.col("home"), 1.0).otherwise(0.0).alias("india"))


def composite(papers: DataFrame, features: list[DataFrame], phrases: list[str], core: list[str], as_of: Column) -> DataFrame:
    """papers (paper_id, title, abstract, published_at, ...) with all features and their weighted sum `relevance`.

    features: (paper_id, value) tables named jel, author, prestige, social and india. Codes that are missing are stood in for by keywords.
    What texts and dates say is found before the joins, so that they need not go through them.
    """
    rows = papers.withColumns(
        {"keyword": keyword_score(F.col("title"), F.col("abstract"), phrases, core), "recency": dates.recency(F.col("published_at"), as_of)}
    )
    for feature in features:
        rows = rows.join(feature, "paper_id", "left")
    codes = F.coalesce("jel", "keyword")
    values = {"jel": codes, "prestige": F.coalesce("prestige", F.lit(PRESTIGE_DEFAULT))} | {c: F.coalesce(c, F.lit(0.0)) for c in ("keyword", "author", "recency", "social")}
    total = sum((F.lit(WEIGHTS[c]) * v for c, v in values.items()), F.lit(0.0))
    amplified = F.when(F.coalesce("india", F.lit(0.0)) > 0, F.lit(INDIA_AMPLIFIER) * F.greatest(codes, F.col("keyword"))).otherwise(F.lit(0.0))
    return rows.withColumns({c: v for c, v in values.items() if c not in ("keyword", "recency")} | {"relevance": F.least(F.lit(1.0), total + amplified)})


def relevance_batch(papers: DataFrame, features: list[DataFrame], phrases: list[str], core: list[str], as_of: Column, days: int = 7, most: int = 10_000) -> DataFrame:
    """(paper_id, relevance) of the papers first seen in the last `days` days, the newest `most` of them. papers also have first_seen."""
    recent = papers.where(F.col("first_seen") >= F.date_sub(as_of.cast("date"), days)).orderBy(F.desc("first_seen"), "paper_id").limit(most)
    return composite(recent, features, phrases, core, as_of).select("paper_id", "relevance")


# Base scores of funding tiers, who may apply as a student, and terms that move a score.
TIERS = {"core": 0.88, "relevant": 0.62, "peripheral": 0.42}
UNTIERED, GATE = 0.50, 0.50
STUDENT = ["phd_student", "both"]
PROFILE_TERMS = [
    "develop", "developing countr", "low-income", "low income", "lmic", "poverty", "global south", "urban", "cities", "slum", "india", "south asia",
    "agricultur", "smallholder", "rural", "land use", "tenure", "labor market", "labour market", "employment", "jobs", "informal", "microfinance",
    "micro-enterprise", "enterprise", "firms", "randomi", "impact evaluation", "field experiment", "structural transformation", "economic growth",
    "human capital", "migration", "housing", "governance", "public economic", "political economy", "social protection", "cash transfer",
    "financial inclusion", "gender", "sanitation", "energy access", "fieldwork",
]
OFFTOPIC_TERMS = [
    "instrumentation", "cyberinfrastructure", "infrastructure improvement", "equipment", "telescope", "spectromet", "materials science", "chemistry",
    "physics", "astronom", "quantum", "semiconductor", "genom", "biomedical", "clinical", "cancer", "nursing", "occupational safety", "fishing",
    "fishery", "marine", "vaccine", "molecular", "workforce development", "manufacturing", "mentored", "career development award", "k-12",
    "stem education", "defense", "aerospace", "seismic",
]


def funding_score(text: Column, tier: Column, eligibility: Column, eligible: Column, good: list[str] = PROFILE_TERMS, bad: list[str] = OFFTOPIC_TERMS) -> Column:
    """Score of a call by its text (name, scope, organization): its tier's base, a little for each good term and for students, a lot off for bad terms and where India is not eligible; between 0 and 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda terms: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)))
    base = F.coalesce(*[F.when(tier.cast("string") == k, F.lit(v)) for k, v in TIERS.items()], F.lit(UNTIERED))
    score = (
        base + F.least(F.lit(0.12), F.lit(0.03) * count(good)) - F.lit(0.35) * F.least(count(bad), F.lit(2))
        + F.when(eligibility.isin(STUDENT), 0.03).otherwise(0.0) - F.when(F.coalesce(eligible, F.lit(True)), 0.0).otherwise(0.12)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(score, 3)))


def funding_relevant(text: Column, tier: Column, score: Column, terms: str) -> Column:
    """Tiered calls stand; others need a topic and a score at the gate."""
    return tier.isNotNull() | (F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.lit(terms)) & (score >= GATE))
