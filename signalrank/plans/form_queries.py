"""Queries that put rows of the tables into the forms that sources write, and read them back: text, links, dates and filters. SQL states what must come out."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from signalrank.functions import dates, predicates, text
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


def join(*parts):
    """Texts and columns one after another; a text in brackets is a column's name."""
    named = lambda p: isinstance(p, str) and re.fullmatch(r"\[\w+\]", p)
    return F.concat(*[F.col(p[1:-1]).cast("string") if named(p) else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""SELECT p_partkey, round(len(list_intersect(string_split(p_name, ' '), ['small', 'steel', 'widget', 'gadget']))::DOUBLE / len(list_distinct(list_concat(string_split(p_name, ' '), ['small', 'steel', 'widget', 'gadget']))), 6) AS similarity,
 CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS shared, p_name || ' &lt; "' || p_type || '" ''x' AS decoded, p_name || ' < "' || p_type || '" ''x' AS decoded_twice, p_name || 'text next ' || p_type AS inline,
 substr(p_name || ' ' || p_type || '&amp;', 1, 12) AS capped, p_name || ' x' AS markup, p_name || ' & co' AS anchor, p_name || ' ' || p_type || ' ' || p_name AS inverted, p_name || ' A longer title here' AS chrome,
 substr(md5(p_name), 1, 8) AS md5_8, substr(sha1(p_name), 1, 12) AS sha1_12, substr(sha256('{"b":"' || p_brand || '","n":' || p_size || '}'), 1, 16) AS request, lower(p_name) || ' o''neil-' AS library_name, 'o''neil-' AS library_last,
 repeat('#', (p_size % 11)::INT) || repeat('-', (10 - p_size % 11)::INT) AS bar, p_name || ', ' || p_type || ', c +2' AS authors, CASE WHEN p_size % 2 = 0 THEN 'Journal Article' ELSE '' END AS label,
 '&lt;' || p_name || ' &amp; &quot;' || p_brand || '&#x27;' AS escaped, '@' || p_brand AS handle,
 trim(substr(p_name || ' Deadline: May 1 ' || p_type, greatest(1, length(p_name) - 1)::INT, (length(p_name) + 12 - greatest(1, length(p_name) - 1))::INT)) AS around,
 'This paragraph of more than sixty characters names research on ' || p_name || ' and more.' AS paragraph FROM part""")
def text_forms(spark, sf_dir):
    """F08, F09, F15, F18 to F21, F24, F32 to F34, F37 to F40, F42, F43, F45, F47."""
    words = F.split("p_name", " ")
    last = F.element_at(words, -1)
    names = F.array("p_name"), F.array(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("X "), last)).otherwise("Other Person"))
    encoded = join("[p_name]", " &amp;lt; &quot;", "[p_type]", "&quot;&nbsp;&#39;x")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(text.jaccard(words, F.array(*map(F.lit, ["small", "steel", "widget", "gadget"]))), 6).alias("similarity"), text.shared_last_names(*names).alias("shared"),
        text.decode_entities(encoded).alias("decoded"), text.decode_twice(encoded).alias("decoded_twice"), text.strip_html_inline(join("<b>", "[p_name]", "</b>text<br/>next<p class=x>", "[p_type]", "</p>")).alias("inline"),
        text.strip_html_capped(join("<p>", "[p_name]", "</p>&nbsp;", "[p_type]", "&amp;"), 12).alias("capped"), text.strip_markup(join("<jats:p>", "[p_name]", "</jats:p> <i>x</i>")).alias("markup"),
        text.anchor_text(join("<a href=x> ", "[p_name]", " &amp; co</a>")).alias("anchor"), text.from_inverted(F.create_map("p_name", F.array(F.lit(0), F.lit(2)), "p_type", F.array(F.lit(1)))).alias("inverted"),
        text.strip_title_chrome(join("[p_name]", " A longer title here | NBER"), r"\s*\|\s*NBER$").alias("chrome"), text.short_hash(F.col("p_name"), 8).alias("md5_8"), text.short_hash(F.col("p_name"), 12, "sha1").alias("sha1_12"),
        text.request_key(F.struct(F.col("p_brand").alias("b"), F.col("p_size").alias("n"))).alias("request"), text.library_name(join("[p_name]", " O'Neil-3")).alias("library_name"), text.library_last_name(join("[p_name]", " O'Neil-3")).alias("library_last"),
        text.score_bar((F.col("p_size") % 11) / 10).alias("bar"), text.author_line(F.array(F.col("p_name"), F.col("p_type"), *map(F.lit, "cde"))).alias("authors"),
        text.type_label(F.when(F.col("p_size") % 2 == 0, "journal_article")).alias("label"), text.escape_html(join("<", "[p_name]", ' & "', "[p_brand]", "'")).alias("escaped"), text.handle_label(join("@@", "[p_brand]")).alias("handle"),
        text.window_around(join("[p_name]", " Deadline: May 1 ", "[p_type]"), "Deadline", 3, 10).alias("around"),
        text.first_paragraph(join("<p>short research</p><p>This paragraph of more than sixty characters names research on ", "[p_name]", " and more.</p>"), ["research"]).alias("paragraph"),
    )


@query("""SELECT p_partkey, '10.1/' || p_brand AS bare, '10.3386/w' || p_partkey AS nber, '10.1257/x.' || p_partkey AS doi, lower('10.1/' || p_brand) AS normal, 'W' || p_partkey AS segment, '2401.' || lpad(p_partkey::VARCHAR, 7, '0') || 'v2' AS arxiv,
 '2401.' || lpad(p_partkey::VARCHAR, 7, '0') AS arxiv_base, 'RePEc:nbr:' || p_partkey AS repec, p_name AS title, 'Ann Lee|Bo Chan|' || p_brand AS byline, 'w' || p_partkey AS number,
 CASE p_size % 3 WHEN 0 THEN 'https://h.org/' || p_partkey WHEN 1 THEN 'https://doi.org/10.1/' || p_partkey ELSE '' END AS link, CASE p_size % 3 WHEN 0 THEN 'doi:10.1/' || p_partkey WHEN 1 THEN 'id:' || p_partkey ELSE 'title:' || sha1(lower(p_name)) END AS cache,
 'https://h.org/x/' || p_partkey AS from_root, 'https://H.org/a/y.html' AS from_page, 'O12,J' || (p_size % 10) AS codes, 'Ann Lee|Bo Chan|' || p_name AS names,
 substr(sha256(lower(p_name) || '|brand,lee'), 1, 16) AS canonical FROM part""")
def link_forms(spark, sf_dir):
    """F06, F10 to F14, F25, F27 to F31, F41, F44, F46."""
    arxiv = text.arxiv_id(join("https://arxiv.org/pdf/2401.", F.lpad(F.col("p_partkey").cast("string"), 7, "0"), "v2.pdf"))
    byline = text.split_byline(join("[p_name]", " -- by Ann Lee, Bo Chan and ", "[p_brand]"))
    by = lambda k, value: F.when(F.col("p_size") % 3 == k, value)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.bare_doi(join("http://dx.doi.org/10.1/", "[p_brand]")).alias("bare"), text.nber_doi(join("see nber.org/papers/W", "[p_partkey]", " now")).alias("nber"),
        text.doi_in_text(join("Out now: https://doi.org/10.1257/x.", "[p_partkey]", ").")).alias("doi"), text.normalize_doi(join(" DOI:10.1/", "[p_brand]", " ")).alias("normal"),
        text.last_segment(join("https://openalex.org/W", "[p_partkey]", "/")).alias("segment"), arxiv.alias("arxiv"), text.strip_version(arxiv).alias("arxiv_base"),
        text.repec_handle(join("https://ideas.repec.org/x?u=RePEc%3Anbr%3A", "[p_partkey]")).alias("repec"), byline["title"].alias("title"), F.array_join(byline["authors"], "|").alias("byline"),
        text.working_paper_number(join("https://www.nber.org/papers/W", "[p_partkey]", "#fromrss")).alias("number"),
        text.paper_link(by(0, join("https://h.org/", "[p_partkey]")), by(1, join("10.1/", "[p_partkey]"))).alias("link"),
        text.cache_key(by(0, join("doi:10.1/", "[p_partkey]")), by(1, F.col("p_partkey")), F.col("p_name")).alias("cache"),
        text.absolute_link(join("/x/", "[p_partkey]"), F.lit("https://H.org/a/b")).alias("from_root"), text.absolute_link(F.lit("y.html"), F.lit("https://H.org/a/b")).alias("from_page"),
        F.array_join(text.jel_codes(join("Text. JEL codes: O12, J", F.col("p_size") % 10, "; O12")), ",").alias("codes"), F.array_join(text.split_authors(join("Ann Lee; Bo Chan & ", "[p_name]", " and Ann Lee")), "|").alias("names"),
        text.canonical_id(F.col("p_name"), F.array(F.lit("Ann Lee"), F.lit("Brand, Cy"))).alias("canonical"),
    )


_DAY = "make_date(2020 + (o_orderkey % 10)::INT, month(o_orderdate)::INT, least(day(o_orderdate), 28)::INT)"


@query(f"""WITH d AS (SELECT o_orderkey, {_DAY} AS d, o_totalprice FROM orders), f AS (SELECT *, strftime(d, '%Y-%m-%d') AS iso FROM d)
SELECT o_orderkey, iso AS long, iso AS day_first, iso AS slash, iso AS iso_any, iso || ' 10:20:30' AS mail, strftime(d, '%Y-%m') || '-01' AS parts, strftime(d, '%Y') || '-01-01' AS year_start,
 CASE WHEN d <= DATE '2024-06-16' THEN iso ELSE '2024-01-05' END AS published, iso || ',' || strftime(d + 40, '%Y-%m-%d') AS dates, iso AS first, iso AS deadline,
 CASE WHEN d >= DATE '2024-06-15' THEN iso WHEN o_orderkey % 2 = 0 THEN '2024-11-15,2025-05-15' ELSE '2025-05-15' END AS curated,
 strftime(make_date(CASE WHEN month(d) < 6 THEN 2025 ELSE 2024 END, month(d)::INT, 1), '%Y-%m-%d') AS month_start, CASE o_orderkey % 3 WHEN 0 THEN '2021-10-01' WHEN 1 THEN '2022-03-01' ELSE '2023-01-01' END AS season,
 CASE WHEN date_diff('day', DATE '2024-06-15', d) <= 3 THEN 'final' WHEN date_diff('day', DATE '2024-06-15', d) <= 7 THEN 'urgent' WHEN date_diff('day', DATE '2024-06-15', d) <= 14 THEN 'soon' ELSE 'upcoming' END AS urgency,
 round(ln(1 + o_orderkey % 50), 4) AS engagement, CASE WHEN o_totalprice / 400000 >= 0.75 THEN 'high' WHEN o_totalprice / 400000 >= 0.4 THEN 'mid' ELSE 'low' END AS class FROM f""")
def date_forms(spark, sf_dir):
    """D03 to D06, D08 to D16, D18, D20, D21."""
    today = F.lit("2024-06-15").cast("date")
    day = F.make_date((F.lit(2020) + F.col("o_orderkey") % 10).cast("int"), F.month("o_orderdate"), F.least(F.day("o_orderdate"), F.lit(28)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", day.alias("d"))
    written = lambda pattern: F.date_format("d", pattern)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    listed = lambda c: F.array_join(F.transform(c, iso), ",")
    even = F.col("o_orderkey") % 2 == 0
    season = F.when(F.col("o_orderkey") % 3 == 0, "Fall 2021").when(F.col("o_orderkey") % 3 == 1, "March, 2022").otherwise("2023")
    return rows.select(
        "o_orderkey", iso(dates.parse_long(written("MMMM d, yyyy"))).alias("long"), iso(dates.parse_long(written("d MMM yyyy"))).alias("day_first"), iso(dates.parse_slash(written("MM/dd/yyyy"))).alias("slash"),
        iso(dates.parse_any(written("yyyy-MM-dd"))).alias("iso_any"), F.date_format(dates.parse_mail_date(F.concat(written("EEE, dd MMM yyyy"), F.lit(" 10:20:30 GMT"))), "yyyy-MM-dd HH:mm:ss").alias("mail"),
        iso(dates.from_parts(F.array(F.array(F.year("d"), F.month("d"))))).alias("parts"), iso(dates.year_start(F.year("d"))).alias("year_start"),
        iso(dates.published_on(F.col("d"), F.lit(None).cast("date"), [], today)).alias("_p1"), F.lit("2024-01-05").alias("_p2"),
        listed(dates.dates_in(F.concat(F.lit("Due "), written("MMMM d, yyyy"), F.lit(" or later, "), F.date_format(F.date_add("d", 40), "yyyy-MM-dd")))).alias("dates"),
        iso(dates.first_date(F.concat(F.lit("Held "), written("MMM d, yyyy"), F.lit(" in town")))).alias("first"), listed(dates.deadline_dates(F.concat(F.lit("The deadline is "), written("d MMMM yyyy"), F.lit(".")), ["deadline"])).alias("deadline"),
        listed(dates.curated_dates(written("yyyy-MM-dd"), F.lit(5), F.lit(11), F.when(even, "biannual").otherwise("annual"), today)).alias("curated"), iso(dates.month_start_from(F.month("d"), today)).alias("month_start"),
        iso(dates.season_or_month(season)).alias("season"), dates.newsletter_urgency(dates.days_left(F.col("d"), today)).alias("urgency"), dates.engagement(F.col("o_orderkey") % 50).alias("engagement"),
        dates.score_class(F.col("o_totalprice") / 400000).alias("class"),
    ).withColumn("published", F.coalesce("_p1", "_p2")).drop("_p1", "_p2")


@query("""SELECT p_partkey, p_size % 3 <> 2 AS known, p_size % 4 <> 3 AS econ_post, p_size % 5 <> 4 AS gate, p_size % 4 IN (0, 1) AS clean_call, p_size % 3 = 0 AS econ_paper, p_size % 3 = 1 AS blocked_doi, p_size % 4 IN (0, 1) AS blocked_link,
 p_size % 4 IN (0, 1) AS editorial, p_size % 2 = 0 AS india, p_size % 3 = 0 AS announced, p_size % 2 = 0 AS relevant FROM part""")
def predicate_forms(spark, sf_dir):
    """Each choice of text has a known answer."""
    from signalrank.operators.features import funding_relevant

    pick = lambda *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("p_size") % len(values)).cast("int") + 1)
    none = F.lit(None).cast("string")
    handle = pick("@Ann@econ.social", "@bo@x.y", None)
    return table(spark, sf_dir, "part").select(
        "p_partkey", predicates.is_known_handle(handle, ["econ.social"], ["bo"]).alias("known"),
        predicates.is_econ_post(pick("New on doi.org/10.1257/aer.1", "On minimum wages", "by the way", "The chart shows wages"), pick(None, None, "@bo@x.y", "@bo@x.y"), none, [], ["bo"], ["minimum wages"]).alias("econ_post"),
        predicates.passes_gate(pick("doi:10.1257/aer.1", "#Econ talk", "x", "x", "x"), pick(None, None, "ANN", "zoe", "zoe"), ["Ann"], ["econ"], F.when(F.col("p_size") % 5 == 3, 0.25).otherwise(0.0)).alias("gate"),
        predicates.is_clean_deadline(pick("Call", "Rolling call", "Rolling", "This photo of a call"), pick("2024-01-01", None, None, "2024-01-01").cast("date"), pick("true", "true", None, "true").cast("boolean")).alias("clean_call"),
        predicates.is_econ_paper(pick(None, "10.5281/zenodo.1", None), F.array().cast("array<string>"), pick("Inflation and wages", "Inflation", "A poem")).alias("econ_paper"),
        predicates.is_blocked_doi(pick("10.1257/aer.1", "https://doi.org/10.6084/m9", None)).alias("blocked_doi"), predicates.is_blocked_link(pick("https://zenodo.org/1", "http://a.hal.science:80/x", "https://nothal.science/", None)).alias("blocked_link"),
        predicates.is_editorial(pick(" Front Matter", "Correction to: Wages", "On corrections", None)).alias("editorial"), predicates.names_india(pick("Firms in Delhi", "Firms in Rome")).alias("india"),
        predicates.is_announcement(pick("My new working paper is out", "A paper", "Lunch")).alias("announced"),
        funding_relevant(pick("Urban poverty call", "Poverty"), pick("core", None), F.lit(0.4), "poverty").alias("relevant"),
    )
