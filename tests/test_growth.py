"""What a query does to each row, and holds at a time, does not grow with the table."""

import numpy as np
from pyspark.sql import functions as F

from signalrank.operators import features, resolve, vectors
from signalrank.plans import catalog, lenses, text_queries
from signalrank.sources import records
from tests.oracle import compare


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"documents": {"D1": {"id": "D1", "display_title": "A title"}, "facets": {}}}',), ("no json",), (None,)], "value string").localCheckpoint()
    found = records.worldbank_documents(rows)
    assert [(r["source_id"], r["title"]) for r in found.collect()] == [("D1", "A title")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # the answer, and each document in it


def test_posts_are_parsed_before_they_are_merged(spark, sf):
    plan = catalog.queries()["posts_payload"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json(" not in plan


def test_a_score_is_made_once(spark, sf):
    plan = catalog.queries()["top_papers"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") == 5 + 3  # texts with a T, and others
    assert plan.count("RLIKE(") == 3 + 2  # a keyword each, and the country in a paper's text and in an affiliation
    assert plan.count("get_json_object(") == 6 + 18  # each path, and, where it holds an object, two names below it, one of which stands twice


def test_tiers_of_edges_that_repeat(spark):
    edges = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2), (2, 2), (3, 3), (4, 9), (5, None)], "paper_id int, author_id int")
    people = spark.createDataFrame([(1, True, False), (2, None, True), (3, None, True), (4, False, False)], "author_id int, is_tracked boolean, auto_discovered boolean")
    found = features.author_scores(edges, people)
    assert {r["paper_id"]: r["author"] for r in found.collect()} == {1: 1.0, 2: 0.5, 3: 0.3} and found.count() == 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # edges meet the tiers of authors once


def test_edges_are_dealt_out_once_by_their_number(spark, monkeypatch):
    edges = spark.createDataFrame([(p, a, n) for p in range(20) for a, n in ((2, 5), (1, 5), (3, 1), (1, 2), (4, 9), (2, 0), (9, 0))] + [(30, 1, None), (None, 1, 1)], "paper_id int, author_id int, position int")
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo Chan"), (3, "ANN LEE"), (4, None)], "author_id int, name string")
    papers = spark.createDataFrame([(p,) for p in [*range(20), 30, 31]], "paper_id int")
    monkeypatch.setattr(lenses, "EDGES_PER_TASK", 10)
    found = lenses.attach_authors(papers, edges, people)
    got = {r["paper_id"]: r["authors"] for r in found.collect()}
    assert got == {p: ["Bo Chan", "ANN LEE", None] for p in range(20)} | {30: ["Ann Lee"], 31: []}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(paper_id" in plan and ", 15), REPARTITION_BY_NUM" in plan and "hashpartitioning(paper_id, key" not in plan


def test_an_empty_store_is_not_searched(spark, monkeypatch):
    paper = "id long, title string, doi string, authors array<string>"
    new = spark.createDataFrame([(1, "Wages in towns", "10.1/a", ["Ann Lee"]), (2, "Wages in towns", None, None)], paper)
    full = resolve.match_existing(new, new.where("id = 1").withColumn("id", F.lit(9).cast("long")))
    assert sorted((r["id"], r["existing_id"], r["step"]) for r in full.collect()) == [(1, 9, 1), (2, 9, 2)]
    monkeypatch.setattr(resolve, "matches", lambda *_: 1 / 0)
    none = resolve.match_existing(new, spark.createDataFrame([], paper))
    assert none.collect() == [] and none.dtypes == full.dtypes


def test_terms_of_ids_that_repeat(spark, tmp_path):
    rows = [(1, "one two two six", "en"), (1, "two one", "en"), (2, "two six", "en"), (None, "six six", "en"), (3, "one", "de"), (3, "one", None), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["lang"], r["term"]): (r["tf"], r["df"]) for r in text_queries._term_counts(docs).collect()}
    assert got == {("en", "one"): (2, 1), ("en", "two"): (4, 2), ("en", "six"): (4, 2), ("de", "one"): (1, 1), (None, "one"): (1, 1)}


def test_words_are_shuffled_as_counts(spark, sf):
    """Only ids that several rows have take part in counts by id."""
    compare(catalog.queries()["word_freq_tfidf"](spark, sf), catalog.oracle_sql()["word_freq_tfidf"], sf)


def test_similarities_are_held_in_parts(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, draw.normal(size=8).tolist()) for k in range(90)], "id long, vector array<double>")
    asked, library = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    whole = {r["id"]: r["similarity"] for r in vectors.library_affinity(asked, library).collect()}
    monkeypatch.setattr(vectors, "SIM_BYTES", 8 * 30 * 7)  # seven candidates at a time
    parts = {r["id"]: r["similarity"] for r in vectors.library_affinity(asked, library).collect()}
    assert len(whole) == 60 and {k: round(v, 12) for k, v in parts.items()} == {k: round(v, 12) for k, v in whole.items()}
