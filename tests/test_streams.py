import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalrank.operators import incremental, jobs, store
from signalrank.operators.versions import Tables
from signalrank.sources import records
from signalrank.streaming import jobs as stream_jobs
from signalrank.streaming import timers

CLOCK = lambda: "2024-06-01 06:00:00"


@pytest.fixture
def store_type(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield timers.uses_timers(spark)
    spark.conf.set(key, before)


def land(spark, place, rows, schema, number):
    """One file, which the stream reads as one batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/{number:04d}")


def read(spark, place, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(place)


def finish(writer, spark, table):
    writer.trigger(availableNow=True).format("memory").queryName(table).outputMode("append").start().awaitTermination(240)
    return spark.table(table).collect()


def test_cache_with_expiry_is_what_the_log_says(store_type, tmp_path):
    spark, rng, place, schema = store_type, random.Random(1), str(tmp_path / "log"), "key string, ts timestamp, value string"
    at, every = datetime(2024, 1, 1), []
    for number in range(5):
        rows = []
        for _ in range(40):
            at += timedelta(minutes=rng.choice([0, 7, 40, 200]))
            rows.append((rng.choice("abcdef"), at, rng.choice([None, None, f"v{at:%d%H%M}"])))
        # of one key and moment, one answer at most
        seen = set()
        rows = [r for r in rows if r[2] is None or not ((r[0], r[1]) in seen or seen.add((r[0], r[1])))]
        at += timedelta(minutes=1)
        every += rows
        land(spark, place, rows, schema, number)
    got = finish(timers.cached_answers(read(spark, place, schema)).writeStream.option("checkpointLocation", str(tmp_path / "c1")), spark, "answers")
    want = incremental.answered(spark.createDataFrame(every, schema)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert {r["answer"] is None for r in got} == {True, False}
    fresh = lambda r: max(((t, v) for k, t, v in every if k == r["key"] and v is not None and r["ts"] - timedelta(hours=12) < t <= r["ts"]), default=(None, None))[1]
    assert all(r["answer"] == fresh(r) for r in want)


def test_alerts_fire_once_as_they_fall_due(store_type, tmp_path):
    spark, rng, place = store_type, random.Random(2), str(tmp_path / "deadlines")
    schema = "deadline_id string, deadline_date date, notified_days array<int>, ts timestamp"
    start, days = date(2024, 1, 1), 80
    arrivals = {}
    for k in range(25):
        arrivals.setdefault(rng.choice([0, 0, 3, 10, 41]), []).append((f"d{k:02d}", rng.choice([None, start + timedelta(days=rng.randrange(-5, 120))]), rng.choice([None, [], [30], [60, 7]])))
    moved = ("d03", start + timedelta(days=75), [])
    arrivals.setdefault(20, []).append(moved)
    for number in range(days):
        if number % 4 == 0 or number in arrivals or number == days - 1:  # the stream need not bring a row every day
            day = datetime(2024, 1, 1) + timedelta(days=number)
            land(spark, place, [(*r, day + timedelta(hours=6)) for r in arrivals.get(number, [])] + [("tick", None, None, day + timedelta(hours=6))], schema, number)
    got = finish(timers.alerts(read(spark, place, schema)).writeStream.option("checkpointLocation", str(tmp_path / "c2")), spark, "alerts")
    held, want = {}, []
    for number in range(days):
        day = start + timedelta(days=number)
        for name, due, told in arrivals.get(number, []):
            held[name] = (due, set(told or []) | held.get(name, (None, set()))[1])
        for name, (due, told) in held.items():
            want += timers._told(name, due, day, told)
    last = start + timedelta(days=days - 1)
    assert sorted(r for r in map(tuple, got) if r[3] < last) == sorted(r for r in want if r[3] < last)
    assert len({(r[0], r[1]) for r in got}) == len(got) > 30


def test_alerts_of_a_day_are_those_of_the_batch(spark):
    start, rng = date(2024, 1, 1), random.Random(3)
    rows = [(k, "n", start + timedelta(days=rng.randrange(-5, 80)), rng.choice([None, [30], [60, 7]])) for k in range(40)]
    table, found = spark.createDataFrame(rows, "deadline_id long, name string, deadline_date date, notified_days array<int>"), []
    told = {r[0]: set(r[3] or []) for r in rows}
    for number in (0, 1, 9):
        day = start + timedelta(days=number)
        due = incremental.due_alerts(table, F.lit(day))
        found = sorted((r["deadline_id"], r["threshold"], r["days"]) for r in due.collect())
        assert found == sorted(x[:3] for r in rows for x in timers._told(r[0], r[2], day, told[r[0]]))
        table = spark.createDataFrame(store.mark_notified(table, due).collect(), table.schema)


def pages(number):
    work = lambda k: {"title": [f"Work about matter number{k} of kind{k}"], "DOI": f"10.1/{k}"}
    page = lambda *ks: json.dumps({"message": {"items": [work(k) for k in ks]}})
    return [
        ("j1", 0, 0, True, page(3 * number, 3 * number + 1), f"2024-0{number + 1}-01"), ("j2", 1, 0, True, page(3 * number + 1, 3 * number + 2), f"2024-0{number + 1}-02"),
        ("j3", 2, 0, number != 1, page(3 * number) if number != 1 else None, f"2024-0{number + 1}-03"),
    ]


RESPONSES = "key string, turn int, page int, ok boolean, value string, mark string"


def state(tables):
    held = tables.manifest()
    key = {"papers": ["title", "doi"], "sources": ["source", "source_id"], "marks": ["key", "mark"]}
    return {n: sorted(map(tuple, tables.read(n, jobs.SCHEMAS[n], held).select(*c).collect())) for n, c in key.items()}


def test_a_collect_that_streams_ends_as_its_batches_do_and_survives_a_crash(spark, tmp_path, monkeypatch):
    place, parse = str(tmp_path / "pages"), lambda r: records.crossref_works(records.message_items(r), F.lit("2024-06-01").cast("date"), ("key", "turn", "page", "item"))
    for number in range(2):
        land(spark, place, pages(number), RESPONSES, number)
    tables = Tables(spark, f"file://{tmp_path}/store")
    start = lambda: stream_jobs.collect_stream(read(spark, place, RESPONSES), parse, tables, "crossref", "papers", "success", str(tmp_path / "c"), ("turn", "page", "item"), CLOCK).trigger(availableNow=True).start()

    real, runs = stream_jobs._stop_on_error, []

    def dies_after_second(result):
        runs.append(result)
        if len(runs) == 2:
            raise RuntimeError("lost after the tables were written, before the stream knew")
        real(result)

    monkeypatch.setattr(stream_jobs, "_stop_on_error", dies_after_second)
    with pytest.raises(Exception):
        start().awaitTermination(240)
    between = state(tables)
    start().awaitTermination(240)
    assert [r["status"] for r in runs] == ["success", "partial_success", "repeated"]
    assert [r["new"] for r in runs] == [3, 3, 0] and between["marks"] == [("j1", "2024-02-01"), ("j2", "2024-02-02"), ("j3", "2024-01-03")]
    assert state(tables) == between and len(between["papers"]) == 6
    plain = Tables(spark, f"file://{tmp_path}/plain")
    for number in range(2):
        items, _ = jobs.collected(spark.createDataFrame(pages(number), RESPONSES), parse, ("turn", "page", "item"))
        jobs.run(plain, items, "crossref", "papers", CLOCK(), CLOCK())
    assert {n: state(plain)[n] for n in ("papers", "sources")} == {n: state(tables)[n] for n in ("papers", "sources")}


def test_items_that_stream_count_once(spark, tmp_path):
    place, tables = str(tmp_path / "items"), Tables(spark, f"file://{tmp_path}/store")
    for number in range(2):
        land(spark, place, [(json.dumps({"title": f"Title alpha{number}", "source_id": f"s{number}"}),), ("{",)], "value string", number)
    for again in ("c1", "c2"):  # with a new checkpoint the same batches come again
        stream_jobs.ingest_stream(read(spark, place, "value string"), tables, "nep", "papers", str(tmp_path / again), CLOCK).trigger(availableNow=True).start().awaitTermination(240)
        assert len(state(tables)["papers"]) == 2 and tables.read("quarantine", jobs.SCHEMAS["quarantine"]).count() == 2
