import json

import pytest
from pyspark.sql import functions as F

from signalrank.operators import jobs
from signalrank.operators.versions import Tables
from signalrank.sources import records

TIMES = ("2024-01-01 06:00:00", "2024-01-01 06:05:00")


def landed(spark, values, first=0):
    return spark.createDataFrame([(first + k, v) for k, v in enumerate(values)], "seq long, value string")


def item(title, source_id, **more):
    return json.dumps({"title": title, "source_id": source_id} | more)


def rows(tables, name):
    return tables.read(name, jobs.SCHEMAS[name]).collect()


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/store")


def test_run_counts_and_puts_bad_items_aside(spark, tables):
    good = [item("Wages in towns", "a", authors=["Ann Lee"], affiliations=["ISI"]), item("Rents of rivers", "b"), item("Wages in towns", "c")]
    bad = ["", None, "{not json", '"text"', item(" ", "d"), json.dumps({"title": "No key"}), '{"title": "T", "authors": 5, "source_id": "e"}']
    found = jobs.run(tables, landed(spark, good + bad), "nber", "papers", *TIMES)
    assert found == {"sensor": "nber", "watch": "papers", "status": "success", "found": 10, "new": 2, "errors": 7}
    assert [(r["sensor"], r["status"], r["items_found"], r["items_new"], r["error"]) for r in rows(tables, "runs")] == [("nber", "success", 10, 2, None)]
    assert sorted((r["seq"], r["reason"]) for r in rows(tables, "quarantine")) == [(3, "empty"), (4, "empty"), (5, "malformed"), (6, "malformed"), (7, "no title"), (8, "no source_id"), (9, "malformed")]
    assert {r["title"] for r in rows(tables, "papers")} == {"Wages in towns", "Rents of rivers"} and len(rows(tables, "sources")) == 3
    assert {json.loads(r["raw_metadata"])["source_id"] for r in rows(tables, "sources")} == {"a", "b", "c"}
    again = jobs.run(tables, landed(spark, good), "nber", "papers", *TIMES)
    assert (again["found"], again["new"], again["errors"]) == (3, 0, 0)
    assert [len(rows(tables, n)) for n in ("papers", "sources", "authors", "links", "runs")] == [2, 3, 1, 1, 2]
    none = jobs.run(tables, landed(spark, []), "iza", "papers", *TIMES, failed=2)
    assert none["status"] == "partial_success" and (none["found"], none["errors"]) == (0, 2)


def test_a_run_that_fails_changes_only_the_log(spark, tables, monkeypatch):
    jobs.run(tables, landed(spark, [item("Wages in towns", "a")]), "nber", "papers", *TIMES)
    monkeypatch.setattr(jobs, "batch_of", lambda *a: 1 / 0)
    marks = spark.createDataFrame([("nber", "2024-02-01")], "key string, mark string")
    found = jobs.run(tables, landed(spark, [item("Other work", "b")]), "nber", "papers", *TIMES, marks=marks, done=("nber", 0))
    assert found["status"] == "error" and "division" in found["error_message"]
    assert [(r["status"], r["items_found"]) for r in sorted(rows(tables, "runs"), key=lambda r: r["status"])] == [("error", 0), ("success", 1)]
    assert len(rows(tables, "papers")) == 1 and rows(tables, "marks") == [] and not tables.is_done("nber", 0)


def test_a_run_that_dies_leaves_nothing_and_a_repeated_one_adds_nothing(spark, tables, monkeypatch):
    batch = landed(spark, [item("Wages in towns", "a"), item("Rents of rivers", "b"), "{"])
    marks = spark.createDataFrame([("nber", "2024-02-01")], "key string, mark string")
    jobs.run(tables, landed(spark, [item("Before", "z")]), "nber", "papers", *TIMES)
    names = [n for n in jobs.SCHEMAS]
    before = {n: sorted(map(repr, rows(tables, n))) for n in names}

    def dies(*_):
        raise KeyboardInterrupt  # as when the driver is killed: no handler runs

    with monkeypatch.context() as m:
        m.setattr(Tables, "_point", dies)
        with pytest.raises(KeyboardInterrupt):
            jobs.run(tables, batch, "nber", "papers", *TIMES, marks=marks, done=("nber", 4))
    assert {n: sorted(map(repr, rows(tables, n))) for n in names} == before
    first = jobs.run(tables, batch, "nber", "papers", *TIMES, marks=marks, done=("nber", 4))
    after = {n: sorted(map(repr, rows(tables, n))) for n in names}
    assert (first["new"], first["errors"]) == (2, 1) and rows(tables, "marks")[0]["mark"] == "2024-02-01"
    later = spark.createDataFrame([("nber", "2024-03-01")], "key string, mark string")
    for number in (4, 3):
        assert jobs.run(tables, batch, "nber", "papers", *TIMES, marks=later, done=("nber", number))["status"] == "repeated"
    assert {n: sorted(map(repr, rows(tables, n))) for n in names} == after


def test_readers_see_whole_versions(spark, tables):
    schema = "k long, v string"
    frame = lambda *ks: spark.createDataFrame([(k, "x") for k in ks], schema)
    assert tables.read("a", schema).count() == 0 and tables.numbers() == []
    tables.publish(replace={"a": frame(1)}, append={"b": frame(1)})
    held = tables.manifest()
    tables.publish(replace={"a": tables.read("a", schema).union(frame(2))}, append={"b": frame(2)})
    ks = lambda name, m=None: sorted(r["k"] for r in tables.read(name, schema, m).collect())
    assert ks("a") == ks("b") == [1, 2] and ks("a", held) == ks("b", held) == [1]
    frame(9).write.parquet(f"{tables.place}/000000000003-lost/a")  # what a writer that died has left
    assert ks("a") == [1, 2]
    tables.compact(["b"], {"b": schema}, 1)
    assert ks("b") == [1, 2] and len(tables.manifest()["tables"]["b"]) == 1
    tables.vacuum(keep=1)
    assert ks("a") == ks("b") == [1, 2] and tables.numbers() == [3]
    assert not tables._fs.exists(tables._at("000000000003-lost"))
    with pytest.raises(RuntimeError):
        tables._point(3, {})
    assert tables.publish(append={"b": frame(3)}, done=("s", 7)) and not tables.publish(append={"b": frame(4)}, done=("s", 7))
    assert ks("b") == [1, 2, 3] and tables.is_done("s", 6) and not tables.is_done("s", 8)


@pytest.mark.parametrize("rule,through", [("success", "ae"), ("page", "abe"), ("rows", "ab")])
def test_marks_move_by_their_rule(spark, rule, through):
    answers = [("a", True, 2), ("b", True, 3), ("b", False, 0), ("c", False, 0), ("d", None, 5), ("e", True, 0)]
    old = {"a": "2024-01-01", "b": "2024-01-02", "c": "2024-01-03", "x": "2023-01-01", "e": "2025-01-01"}
    marks = spark.createDataFrame(list(old.items()), "key string, mark string")
    moved = jobs.moved(marks, spark.createDataFrame(answers, "key string, ok boolean, rows long"), rule, F.lit("2024-06-01"))
    want = old | {k: max(old[k], "2024-06-01") for k in through}
    assert {r["key"]: r["mark"] for r in moved.collect()} == want
    assert jobs.moved(marks, moved.sparkSession.createDataFrame([], "key string, ok boolean, rows long"), rule, F.lit("2024-06-01")).count() == len(old)


def page(*works):
    return json.dumps({"message": {"items": [{"title": [t], "DOI": d} for t, d in works]}})


def test_collect_of_several_keys(spark, tables):
    answers = [
        ("j2", 1, 0, True, page(("Second of one", "10.1/a"), ("Own of two", "10.1/c"))), ("j1", 0, 1, True, page(("First on page two", "10.1/b"))),
        ("j1", 0, 0, True, page(("First of one", "10.1/a"), ("Front matter", "10.1/x"), ("Later on a page", "10.1/d"), ("Again on a page", "10.1/d"))), ("j3", 2, 0, False, None), ("j4", 3, 0, True, "{broken"), ("j5", 4, 0, True, page()),
    ]
    responses = spark.createDataFrame(answers, "key string, turn int, page int, ok boolean, value string")
    as_of = F.lit("2024-06-01").cast("date")
    items, came = jobs.collected(responses, lambda r: records.crossref_works(records.message_items(r), as_of, ("key", "turn", "page", "item")), ("turn", "page", "item"))
    found = [json.loads(r["value"]) for r in items.orderBy("seq").collect()]
    assert [(x["source_id"], x["title"]) for x in found] == [("10.1/a", "First of one"), ("10.1/d", "Later on a page"), ("10.1/b", "First on page two"), ("10.1/c", "Own of two")]
    assert sorted(map(tuple, came.collect())) == [("j1", True, 1), ("j1", True, 3), ("j2", True, 2), ("j3", False, 0), ("j4", True, 0), ("j5", True, 0)]
    marks = jobs.moved(spark.createDataFrame([], jobs.SCHEMAS["marks"]), came, "success", F.lit("2024-06-01"))
    result = jobs.run(tables, items, "crossref", "papers", *TIMES, marks=marks, done=("crossref", 0), failed=1)
    assert (result["found"], result["new"], result["status"]) == (4, 4, "partial_success")
    assert {r["key"] for r in rows(tables, "marks")} == {"j1", "j2", "j4", "j5"}
