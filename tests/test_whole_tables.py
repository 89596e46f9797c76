import random
import re

import pytest
from pyspark.sql import functions as F

from signalrank.functions import predicates, text
from signalrank.operators import features, resolve, similarity
from signalrank.plans import catalog
from signalrank.session import table
from tests.test_operators import PAPER, paper


@pytest.mark.parametrize("name, source, keys", [("keyword_score", "documents", 1), ("matched_topics", "documents", 1), ("post_gate", "conversations", 2), ("snippets", "conversations", 2)])
def test_no_row_is_left_out(spark, sf, name, source, keys):
    got = catalog.queries()[name](spark, sf)
    assert sorted(tuple(r)[:keys] for r in got.collect()) == sorted(tuple(r) for r in table(spark, sf, source).select(*got.columns[:keys]).collect())


def test_phrases_end_at_letters_of_any_script(spark):
    texts = ["für das Land", "thé", "the élan", "éthe", "Ωthe", "the٣", "the_", "«the»", "the", "the—end", "", "visualé the", "A visualé", "A visual é"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    got = rows.select("text", features.keyword_score(F.lit(""), F.col("text"), ["the"], []).alias("s"), F.size(features.matched_topics(F.col("text"), ["the"])).alias("n"), predicates.names_topic(F.col("text"), ["the"]).alias("t"), predicates.is_caption(F.col("text")).alias("c"))
    for r in got.collect():
        hit = re.search(r"\bthe\b", r["text"]) is not None
        assert (r["s"] == 0.25, r["n"] == 1, r["t"]) == (hit, hit, hit), r
        assert r["c"] == (re.match(r"a visual\b", r["text"], re.IGNORECASE) is not None), r


def test_snippet_cut_at_a_space(spark):
    rows = spark.createDataFrame([("ab cd",), ("abc",), ("é  ü ö",), (None,)], "text string")
    assert [r["x"] for r in rows.select(text.snippet(F.col("text"), 3).alias("x")).collect()] == ["ab…", "abc", "é ü…", ""]


def most_rows(df):
    """Greatest number of rows that a join of the finished plan gave."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan().toString(), 0
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        stack += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert "Join" in plan
    return most


def most_rows_of(spark, run):
    """Greatest number of rows that a join of any query that `run` starts gave, as Spark's own record of them says."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: [e.executionId() for e in map(store.executionsList().apply, range(store.executionsList().size()))]
    before = max(ids(), default=-1)
    result = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    counts = []
    for number in (n for n in ids() if n > before):
        values = store.executionMetrics(number)
        nodes = store.planGraph(number).allNodes()
        for node in (nodes.apply(n) for n in range(nodes.size())):
            for metric in (node.metrics().apply(m) for m in range(node.metrics().size()) if "Join" in node.name()):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    counts.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    assert counts
    return result, max(counts)


def test_equal_sets_make_no_square(spark):
    n = 400
    rows = spark.createDataFrame([(k, ["land", "reform", "growth"]) for k in range(n)] + [(n, ["land", "reform", "growth", "villages"]), (n + 1, ["growth", "reform", "land"]), (n + 2, [])], "id long, tokens array<string>")
    near = similarity.representative_pairs(rows, 0.7)
    assert [tuple(r) for r in near.collect()] == [(0, n, 0.75)] and most_rows(near) < 2 * n
    assert {r["id"]: r["representative"] for r in similarity.represented(rows).collect()} == {**dict.fromkeys(range(n), 0), n: n, n + 1: 0}
    pairs = similarity.similar_pairs(rows.where(f"id >= {n - 3}"), 0.7).collect()
    ids = [n - 3, n - 2, n - 1, n, n + 1]
    assert sorted((r["a"], r["b"], r["jaccard"]) for r in pairs) == [(a, b, 0.75 if n in (a, b) else 1.0) for a in ids for b in ids if a < b]


def test_match_of_many_equal_titles_makes_no_square(spark):
    n = 300
    stored = spark.createDataFrame([paper(k, "Land Reform and Growth in Villages", ["Ann Lee", "Bo Chan"], "10.1/a") for k in range(n, 0, -1)], PAPER)
    new = spark.createDataFrame([paper(1000 + k, "Land reform and growth in villages: evidence" if k % 2 else "Land reform and growth in villages", ["Ann Lee"]) for k in range(n)], PAPER)
    found, most = most_rows_of(spark, lambda: resolve.match_existing(new, stored))
    assert {r["id"]: (r["existing_id"], r["step"]) for r in found.collect()} == {1000 + k: (1, 3 if k % 2 else 2) for k in range(n)}
    assert most <= 2 * n
    same = resolve.same_work_edges(new.unionByName(spark.createDataFrame([paper(k, "Land reform and growth in villages", [f"Family{k}"]) for k in range(n)], PAPER)))
    assert same.count() < 10 * n


def test_whole_groups_merge_as_pairs_do(spark):
    rng = random.Random(5)
    some = lambda *words: [rng.choice(words) for _ in range(rng.randrange(4))]
    record = lambda: (
        rng.choice([None, "", "10.1/a", "10.1/b"]), rng.choice(["", "ab", "cd", "efg", "hij"]), rng.choice(["journal_article", "working_paper", "other", "report"]),
        some("O1", "R3", "J2"), some("Land", "land", "LAND", "Cities", "cities", "x"), rng.choice([None, "", "2024-01-01", "2023-09", "2023"]),
    )
    fields = "doi string, abstract string, paper_type string, jel_codes array<string>, keywords array<string>, published_at string"
    groups = {g: [record() for _ in range(5)] for g in range(40)}
    rows = [(g, k, *r) for g, found in groups.items() for k, r in enumerate(found)]
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in resolve.merged_all(spark.createDataFrame(rows, f"key int, at int, {fields}"), "key", "at").collect()}
    kind = "struct<" + fields.replace(" ", ":").replace(",:", ",") + ">"
    folded = spark.createDataFrame([(g, *found) for g, found in groups.items()], "key int, old " + kind + "".join(f", r{k} {kind}" for k in range(1, 5)))
    for k in range(1, 5):
        folded = folded.withColumn("old", resolve.merged_metadata("old", f"r{k}"))
    plain = lambda r: (r[0] or None, *r[1:])
    assert {g: plain(r) for g, r in got.items()} == {r["key"]: plain(tuple(r["old"])) for r in folded.collect()}


def test_middle_copies_count(spark, tmp_path):
    rows = [(1, "t", "a", 1), (2, "t", "z", 1), (3, "t", "b", 1), (4, "u", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["merge_metadata_all"](spark, str(tmp_path)).collect()] == [(1, "z", "a,z,b", 1)]
