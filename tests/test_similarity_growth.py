import random

import pytest
from pyspark.sql import functions as F

from signalrank.operators import similarity
from signalrank.plans import catalog, text_queries


def jaccard(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("least", [0.4, 0.7])
def test_links_under_frequent_tokens(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "RARE", 3)
    draw = random.Random(5)
    sets = {k: set(draw.sample("abcdefghijklmnop", draw.randint(1, 9))) for k in range(120)} | {500: set()}
    rows = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "id long, tokens array<string>")
    got = {r["id"]: (r["representative"], r["links"]) for r in similarity.linked(rows, least).collect()}
    near = lambda k: [j for j in sets if j != k and sets[j] and sets[k] and jaccard(sets[j], sets[k]) >= least - 1e-12]
    assert got == {k: (min(j for j in sets if sets[j] == sets[k]), len(near(k))) for k in sets}


def test_what_meets_grows_with_the_input(spark, monkeypatch):
    """Words of a language repeat in every table, so each set's rarest token is in many others; two of them are in few."""
    monkeypatch.setattr(similarity, "RARE", 8)

    def met(n):
        draw = random.Random(3)
        words = [f"w{k}" for k in range(120)]
        rows = spark.createDataFrame([(k, sorted(set(draw.choices(words, k=8)))) for k in range(n)], "id long, tokens array<string>")
        signed = similarity.signed(similarity.representatives(rows)).persist()
        found = similarity.met(signed, signed, 0.7).where("a < b").count(), signed.select(F.explode(similarity.keys_of(0.7))).groupBy("col.key").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
        signed.unpersist()
        return found

    passed, under_keys = met(1600)
    single = 1600 * (3 * 1600 * 8 / 120)  # what would meet under single tokens, about
    assert under_keys < single / 10 and passed < 1600


def test_the_query_gives_every_pair_with_its_similarity(spark, sf):
    sets = {r["id"]: set(r["tokens"]) for r in text_queries.line_sets(spark, sf).collect()}
    want = {(a, b): round(jaccard(x, y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and jaccard(x, y) >= 0.7 - 1e-12}
    rows = catalog.queries()["set_similarity_pairs"](spark, sf).collect()
    assert len(rows) == len(want) > 149 and {(r["a"], r["b"]): r["jaccard"] for r in rows} == want


def test_pairs_of_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "PAIRS_PER_TASK", 100)
    sets = {k: set("abcdefg") for k in range(60)} | {k: set("abcdefgh") for k in range(60, 90)} | {90: set("xy"), 91: set()}
    rows = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "id long, tokens array<string>")
    found = similarity.similar_pairs(rows, 0.7, 3)
    parts = found.select("*", F.spark_partition_id().alias("part")).collect()
    assert {(r["a"], r["b"]): r["jaccard"] for r in parts} == {(a, b): 1.0 if (a < 60) == (b < 60) else 0.875 for b in range(90) for a in range(b)} and len(parts) == 90 * 89 / 2
    most = max(sum(r["part"] == k for r in parts) for k in {r["part"] for r in parts})
    assert most < len(parts) / 8
