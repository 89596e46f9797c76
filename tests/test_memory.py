"""What is remembered between runs: content hashes, vectors of a library, external answers."""

import itertools

import pytest
from pyspark.sql import functions as F

from signalrank.operators import incremental, library
from signalrank.operators.versions import Tables
from signalrank.plans import lenses

ITEMS = "title string, abstract string"
MEMO = "key string, state string, answer string"


def digest(spark, rows):
    return library.corpus_hash(spark.createDataFrame(rows, ITEMS)).first()["hash"]


@pytest.mark.parametrize("leaf", [4096, 1])
def test_every_multiset_of_items_has_its_own_hash(spark, leaf, monkeypatch):
    monkeypatch.setattr(library, "LEAF_ITEMS", leaf)
    a, b, c = ("t0", "x"), ("t10", "x"), ("t2", None)
    sets = [[], [a], [b], [a, a], [b, b], [a, b], [a, a, a], [a, a, b], [a, b, b], [a, b, c], [("t0x", "")], [("t0x", None)], [(None, "t0x")], [("", "t0x")], [("t", "0x")], [("2:t0", "x")]]
    sets = sets if leaf == 1 else sets[3:8]
    found = [digest(spark, rows) for rows in sets]
    assert len(set(found)) == len(sets)
    assert {digest(spark, rows) for rows in set(itertools.permutations([a, a, b]))} == {found[sets.index([a, a, b])]}


def test_hash_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(library, "LEAF_ITEMS", 4)
    rows = [(f"title {k}", "text") for k in range(300)]
    whole = digest(spark, rows)
    assert whole == digest(spark, rows[::-1]) != digest(spark, rows[:-1]) != digest(spark, [*rows[:-1], ("title 299", "other")])


def test_vectors_are_made_once_for_a_text(spark, tmp_path):
    asked = []

    def embed(rows):
        asked.append(sorted(r["title"] for r in rows.collect()))
        return rows.where("title <> 'bad'").select("item", F.array(F.length("title").cast("double"), F.lit(1.0)).alias("vector"))

    cache = library.VectorCache(Tables(spark, f"file://{tmp_path}/vectors"))
    items = lambda *titles: spark.createDataFrame([(t, None) for t in titles], ITEMS)
    get = lambda model, *titles: sorted(r["vector"][0] for r in cache.vectors(items(*titles), model, embed).collect())
    assert get("m", "a", "bb", "bb") == [1.0, 2.0] and asked == [["a", "bb"]]
    assert get("m", "bb", "a", "bb") == [1.0, 2.0] and len(asked) == 1  # the same library in another order
    assert get("m", "bb", "ccc") == [2.0, 3.0] and asked[1:] == [["ccc"]]
    assert get("other", "bb") == [2.0] and asked[2:] == [["bb"]]  # another model's vectors are its own
    assert get("m", "a", "bad") == [1.0] and get("m", "a", "bad") == [1.0] and asked[3:] == [["bad"], ["bad"]]
    assert get("m") == []


def test_memo_has_three_states(spark):
    memo = spark.createDataFrame([("a", "answered", "yes"), ("e", "empty", None), ("f", "failed", None), ("z", "answered", "old")], MEMO)
    rows = spark.createDataFrame([("a", 1), ("e", 2), ("f", 3), ("n", 4), ("n", 5), ("m", 6), (None, 7)], "key string, k int")
    calls = []

    def ask(open_):
        calls.append(sorted(r["key"] for r in open_.collect()))
        return open_.select("key", F.when(F.col("key") == "n", " new ").when(F.col("key") == "f", "").alias("reply"))

    found, after = incremental.asked_once(rows, memo, ask)
    assert calls == [["f", "m", "n"]]
    assert sorted((r["k"], r["answer"]) for r in found.collect()) == [(1, "yes"), (2, None), (3, None), (4, "new"), (5, "new"), (6, None), (7, None)]
    assert sorted(map(tuple, after.collect())) == [("a", "answered", "yes"), ("e", "empty", None), ("f", "empty", None), ("m", "failed", None), ("n", "answered", "new"), ("z", "answered", "old")]
    found, after = incremental.asked_once(rows, after, ask)
    assert calls[1:] == [["m"]] and incremental.asked_once(rows, memo, None)[1] is memo


def test_reasons_in_the_feed(spark):
    feed = [(k, f"Title {k}", None, f"10.1/{k}" if k % 2 else None, ["t"], k) for k in range(1, 6)]
    rows = spark.createDataFrame(feed, "id long, title string, abstract string, doi string, topics array<string>, pos long")
    memo = spark.createDataFrame([("doi:10.1/1", "answered", "held"), ("id:2", "empty", None), ("doi:10.1/5", "answered", "beyond the top")], MEMO)
    found, after = lenses.with_reasons(rows, memo, lambda r: r.select("key", F.concat(F.lit("why "), "title").alias("reply")), top=4)
    assert {r["id"]: r["why_it_matters"] for r in found.collect()} == {1: "held", 2: None, 3: "why Title 3", 4: "why Title 4", 5: None}
    assert after.count() == 5 and found.columns == [*rows.columns, "why_it_matters"]
    off, same = lenses.with_reasons(rows, memo)
    assert {r["id"]: r["why_it_matters"] for r in off.collect()} == {1: "held", 2: None, 3: None, 4: None, 5: "beyond the top"} and same is memo
    assert lenses.with_reasons(rows.limit(0), memo)[0].count() == 0
