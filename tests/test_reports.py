import datetime
import json

import pytest
from pyspark.sql import functions as F

from signalrank.operators.versions import Tables
from signalrank.plans import lenses
from signalrank.streaming import posts as stream

D = datetime.date
AS_OF = "2026-01-10"


def as_of():
    return F.lit(AS_OF).cast("date")


def test_feed(spark):
    schema = "paper_id long, title string, authors array<string>, abstract string, doi string, url string, source string, venue string, published_at string, jel array<string>, relevance double, library double, learned double"
    row = lambda i, t, rel, lib=0.0, src="iza", doi=None, a=("Ann Lee",): (i, t, list(a), f"On land {i}", doi, None, src, None, "2025-01-01", [], rel, lib, 0.0)
    papers = spark.createDataFrame([
        row(1, "Land reform in Delhi villages", 0.9, 0.1), row(2, "The image shows a chart", 0.8, 0.9), row(3, "Tax &amp;amp; growth", 0.5, 0.8), row(4, "Land Reform in Delhi Villages", 0.4, 0.15, "nber", "10.1/x"),
        row(5, "Seen work", 0.3, 0.3), row(6, "Low", 0.01, 0.1),
    ], schema)
    seen = spark.createDataFrame([(None, "seen work")], "doi string, title string")
    got = lenses.feed(papers, seen, ["land", "tax"], ["relevance", "library", "learned"], least=0.05).orderBy("pos").collect()
    assert [r["title"] for r in got] == ["Tax & growth", "Land Reform in Delhi Villages"]
    assert got[1]["also_in"] == ["iza"] and got[1]["url"] == "https://doi.org/10.1/x" and got[1]["topics"] == ["land"] and got[1]["india"]
    empty = spark.createDataFrame([], "x int")
    value = json.loads(lenses.snapshot_json(lenses.feed(papers, seen, [], ["relevance"]), empty, empty, empty).first()["value"])
    assert value["stats"]["papers"] == len(value["papers"]) and value["deadlines"] == []


def test_deadlines_and_alerts(spark):
    rows = spark.createDataFrame([
        (1, "A", "o", D(2026, 1, 12), False, 0.5, None), (2, "B", "o", None, True, 0.9, None), (3, "C", "o", None, False, 0.9, None), (4, "The image of x", "o", D(2026, 1, 20), False, 0.1, None), (5, "D", "o", D(2026, 2, 1), False, 0.1, [30]),
        (6, "E", "o", D(2025, 1, 1), False, 0.1, None),
    ], "deadline_id int, name string, organization string, deadline_date date, curated boolean, relevance double, notified_days array<int>")
    assert [(r["name"], r["urgency"]) for r in lenses.deadlines(rows, as_of()).collect()] == [("A", "final"), ("D", "soon"), ("B", "rolling")]
    assert [r["name"] for r in lenses.newsletter_deadlines(rows, as_of()).collect()] == ["A", "The image of x", "D"]
    found = lenses.alerts(rows, as_of())
    assert [(r["name"], r["threshold"], r["action"]) for r in found.collect()] == [("A", 3, "submit now"), ("The image of x", 14, "finalise")]
    assert "## Within 3 days" in lenses.render_alerts(found)


def test_brief_and_newsletter(spark):
    schema = "paper_id long, title string, abstract string, first_seen date, published_at string, paper_type string, venue string, jel_codes array<string>, sources array<string>, doi string, url string, blocked_source boolean, relevance double, library double"
    row = lambda i, kind="working_paper", jel=("O1",), src=("nber",), doi=None, day=D(2026, 1, 10), title=None: (i, title or f"Wages of town{i} near river{i}", "x", day, "2026-01-01", kind, None, list(jel), list(src), doi, None, False, i / 20, 0.0)
    rows = spark.createDataFrame([row(i, "journal_article" if i < 3 else "working_paper") for i in range(14)] + [row(20, doi="10.5281/z"), row(21, jel=(), src=("openalex",), title="Fish"), row(22, day=D(2025, 1, 1))], schema)
    got = lenses.brief(rows, as_of())
    ids = [r["paper_id"] for r in got.collect()]
    assert ids[:3] == [2, 1, 0] and ids[3:9] == [13, 12, 11, 10, 9, 8] and len(ids) == 10 and 20 in ids or 20 not in ids
    assert {20, 21, 22} & set(ids) <= {20}
    text = lenses.render_brief(got, "Brief")
    assert text.startswith("# Brief") and "JEL O1" in text
    assert lenses.source_mix(got).first()["source"] == "nber"
    papers = lenses.newsletter_papers(rows, as_of(), 4)
    assert [r["paper_id"] for r in papers.collect()][0] == 13 or papers.count() == 4
    assert lenses.render_html(papers, "News").count("<li>") == 4
    twice = spark.createDataFrame([row(1, title="Wages and towns"), row(2, title="Wages and Towns.", kind="journal_article"), row(3, title="Fish of the north sea")], schema)
    assert [r["paper_id"] for r in lenses.newsletter_papers(twice, as_of(), 4).collect()] == [3, 2]


def test_attachments(spark):
    papers = spark.createDataFrame([(1,), (2,)], "paper_id long")
    edges = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 12, 3)], "paper_id long, author_id long, position int")
    people = spark.createDataFrame([(10, "Bo Chan"), (11, "Ann Lee"), (12, "ANN LEE")], "author_id long, name string")
    got = {r["paper_id"]: r["authors"] for r in lenses.attach_authors(papers, edges, people).collect()}
    assert got == {1: ["Ann Lee", "Bo Chan"], 2: []}
    seen = spark.createDataFrame([(1, 1, "openalex", "https://zenodo.org/1", '{"v": null}'), (2, 1, "crossref", None, '{"v": "J"}'), (3, 1, "nber", None, '{"v": "K"}')], "sighting_id long, paper_id long, source string, source_url string, raw_metadata string")
    r = {x["paper_id"]: x for x in lenses.attach_sources(papers, seen, F.get_json_object("raw_metadata", "$.v")).collect()}[1]
    assert r["source"] == "openalex" and r["venue"] == "J" and r["sources"] == ["nber", "crossref", "openalex"] and r["blocked_source"]


def test_stream_replay_equals_batch(spark, tmp_path):
    schema = "source string, source_id string, ts timestamp, value double"
    at = datetime.datetime(2026, 1, 1, 12)
    for k in range(3):
        spark.createDataFrame([("m", f"p{k}", at, 1.0), ("m", "p0", at, 1.0), ("b", f"q{k}", at, 2.0)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    for _ in range(2):
        query = stream.append_new(stream.read_posts(spark, f"file://{tmp_path}/in/*", schema, 1), f"file://{tmp_path}/out", f"file://{tmp_path}/check", ["source", "source_id"]).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6
    query = stream.attention(stream.read_posts(spark, f"file://{tmp_path}/in/*", schema)).writeStream.format("memory").queryName("att").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["source"], r["posts"]) for r in spark.table("att").collect()} == {("m", 6), ("b", 3)}


def test_vote_stream(spark, tmp_path):
    from signalrank.operators.incremental import folded_weights

    rows = [("O1", 1, True), ("O1", 2, False), ("R3", 1, True)]
    schema = "code string, seq int, interesting boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/votes")
    votes = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/votes")
    query = stream.vote_weights(votes).writeStream.format("memory").queryName("votes").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    none = spark.createDataFrame([], "code string, weight double")
    assert {r["code"]: r["weight"] for r in spark.table("votes").collect()} == {r["code"]: r["weight"] for r in folded_weights(spark.createDataFrame(rows, schema), none).collect()}


def test_sorts_and_details(spark):
    rows = spark.createDataFrame([(1, "beta", 0.1, "2024"), (2, "Éclair", 0.9, None), (3, "alpha", None, "2025")], "id int, title string, score double, published_at string")
    order = lambda by: [r["id"] for r in lenses.sorted_feed(rows, by).collect()]
    assert order("relevance") == [2, 1, 3] and order("newest") == [3, 1, 2] and order("title") == [3, 1, 2]
    papers = spark.createDataFrame([(1,), (2,)], "paper_id long")
    seen = spark.createDataFrame([(2, 1, "b", "u2"), (1, 1, "a", "u1")], "sighting_id long, paper_id long, source string, source_url string")
    none = spark.createDataFrame([], "paper_id long, author_id long, position int"), spark.createDataFrame([], "author_id long, name string")
    got = {r["paper_id"]: r for r in lenses.detail(papers, seen, *none).collect()}
    assert [s["source"] for s in got[1]["sightings"]] == ["a", "b"] and got[2]["sightings"] is None and got[1]["authors"] == []


def test_reports_change_together(spark, tmp_path, monkeypatch):
    tables = Tables(spark, f"file://{tmp_path}/reports")
    feed = spark.createDataFrame([('{"papers":[]}',)], "value string")
    assert lenses.report(tables, "brief") is None
    assert lenses.publish_reports(tables, {"feed": feed, "brief": "# Brief\n\n1. Ünï\n", "alerts": "# Deadlines\n"}, done=("reports", 1))
    held = tables.manifest()
    assert not lenses.publish_reports(tables, {"brief": "again"}, done=("reports", 1))
    with monkeypatch.context() as m:
        m.setattr(Tables, "_point", lambda *_: 1 / 0)  # dies after writing, before readers are told
        with pytest.raises(ZeroDivisionError):
            lenses.publish_reports(tables, {"brief": "half", "alerts": "half"}, done=("reports", 2))
    assert lenses.report(tables, "brief") == "# Brief\n\n1. Ünï\n" and lenses.report(tables, "feed") == '{"papers":[]}'
    assert lenses.publish_reports(tables, {"brief": "new"}, done=("reports", 2))
    assert (lenses.report(tables, "brief"), lenses.report(tables, "alerts")) == ("new", "# Deadlines\n")
    assert lenses.report(tables, "brief", held) == "# Brief\n\n1. Ünï\n"  # a reader that began before
    with pytest.raises(ValueError):
        lenses.publish_reports(tables, {"letter": "x"})
