import hashlib

from signalrank.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, kept string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def test_largest_id_stays_and_null_is_empty(spark):
    rows = [(1, "a"), (5, "a"), (2, None), (3, ""), (None, "a"), (7, "b" * 200_000)]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.report(docs(spark, rows)).collect()}
    assert got == {(1, 5, 3, False), (5, 5, 3, True), (None, 5, 3, False), (2, 3, 2, False), (3, 3, 2, True), (7, 7, 1, True)}


def test_digest_is_of_the_text(spark):
    got = exact_dedup.report(docs(spark, [(1, "é")])).first()
    assert got["text_sha256"] == hashlib.sha256("é".encode()).hexdigest()


def test_repeated_rows_keep_one(spark):
    got = exact_dedup.report(docs(spark, [(4, "q"), (4, "q"), (3, "q")])).collect()
    assert len(got) == 3 and sum(r["kept"] for r in got) == 1 and all(r["group_size"] == 3 for r in got)
    kept = exact_dedup.keep_one(docs(spark, [(4, "q"), (4, "q"), (3, "q")]))
    assert [r["doc_id"] for r in kept.collect()] == [4] and kept.columns == ["doc_id", "text", "digest", "kept", "row"]


def test_only_null_ids(spark):
    got = exact_dedup.report(docs(spark, [(None, "n"), (None, "n")])).collect()
    assert [r["keep_id"] for r in got] == [None, None] and sum(r["kept"] for r in got) == 1


def test_empty_table(spark):
    assert exact_dedup.report(docs(spark, [])).count() == 0
    assert exact_dedup.keep_one(docs(spark, [])).count() == 0


def test_index_persists_and_grows(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    exact_dedup.report(docs(spark, [(1, "a"), (2, "b")]), index).collect()
    again = {r["doc_id"]: r for r in exact_dedup.report(docs(spark, [(9, "a"), (8, "c")]), index).collect()}
    assert not again[9]["kept"] and again[9]["keep_id"] == 1 and again[8]["kept"]
    assert index.rows().count() == 3


def test_index_is_found_by_path_in_a_later_session(spark, tmp_path):
    place = f"file://{tmp_path}/digests"
    first = exact_dedup.DigestIndex(spark, "digests_of_a_test", buckets=3, path=place)
    exact_dedup.report(docs(spark, [(1, "a"), (2, "b")]), first).collect()
    spark.sql("DROP TABLE digests_of_a_test")  # the catalogue of a later session knows nothing; the files stay
    later = spark.newSession()
    index = exact_dedup.DigestIndex(later, "digests_of_a_test", buckets=5, path=place)
    got = {r["doc_id"]: r for r in exact_dedup.report(docs(later, [(9, "a"), (8, "c")]), index).collect()}
    assert index.buckets == 3 and got[9]["keep_id"] == 1 and not got[9]["kept"] and got[9]["group_size"] == 2 and got[8]["kept"]
    assert {(r["keep_id"], r["group_size"]) for r in index.rows().collect()} == {(1, 2), (2, 1), (8, 1)}
    plan = index.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_increments_give_the_whole_result(spark):
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(None, "t1"), (None, None), (3, "t3")]
    whole, parts = (sorted(map(repr, exact_dedup.report(docs(spark, rows), increments=k).collect())) for k in (1, 3))
    assert whole == parts
    assert exact_dedup.report(docs(spark, []), increments=3).count() == 0


def test_hot_groups_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 3)
    rows = [(i, "same") for i in range(10)] + [(100 + i, f"t{i}") for i in range(5)]
    got = exact_dedup.report(docs(spark, rows)).collect()
    assert len(got) == 15 and sum(r["kept"] for r in got) == 6
