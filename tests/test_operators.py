import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalrank.operators import components, features, incremental, library, ranking, resolve, similarity, store, vectors

D = datetime.date


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    low = {}

    def root(k):
        low.setdefault(k, k)
        while low[k] != k:
            k = low[k]
        return k

    for a, b in edges:
        x, y = root(a), root(b)
        low[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for e in edges if e[0] != e[1] for k in e}


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 1.0])
def test_similar_pairs_against_brute_force(spark, least):
    rng = random.Random(int(least * 100))
    sets = [(i, sorted({f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(9))})) for i in range(80)]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= least - 1e-12}
    rows = spark.createDataFrame(sets, "id long, tokens array<string>")
    got = similarity.similar_pairs(rows, least).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    new = spark.createDataFrame(sets[:20], rows.schema)
    both = {(a, b) for a, b in ((x, y) for x in range(20) for y in range(80)) if sets[a][1] and sets[b][1] and len({*sets[a][1]} & {*sets[b][1]}) / len({*sets[a][1]} | {*sets[b][1]}) >= least - 1e-12}
    assert {(r["a"], r["b"]) for r in similarity.matches(new, rows, least).collect()} == both


PAPER = "id long, pos int, title string, authors array<string>, doi string, abstract string, published_at string, source string, jel array<string>"


def paper(i, title, authors, doi="", abstract="", day="", source="openalex", jel=()):
    return (i, i, title, list(authors), doi, abstract, day, source, list(jel))


def test_cascade_steps(spark):
    stored = spark.createDataFrame([
        paper(1, "Land Titles and Housing Markets in Growing Cities", ["Ann Lee", "Bo Chan"], "10.1/A"), paper(2, "Wages in the Informal Sector", ["Cy Dunn"]), paper(3, "", ["X Y"]),
        paper(4, "Roads and the Spatial Growth of Towns in Kenya", ["Di Egan", "Flo Gray"]),
    ], PAPER)
    new = spark.createDataFrame([
        paper(11, "Other", ["Q"], "10.1/A"), paper(12, "NBER Working Paper 7: Wages in the informal sector!", ["Z Z"]), paper(13, "Land titles and housing markets in growing cities: evidence", ["N N"]),
        paper(14, "Roads and the spatial growth of towns in Kenya and Uganda: evidence", ["Egan, Di", "Gray, Flo"]), paper(15, "Roads and the spatial growth of towns in Kenya and Uganda: evidence", ["H I", "J K"]),
        paper(16, "", []), paper(17, "Quite another topic", ["Ann Lee", "Bo Chan"]),
    ], PAPER)
    got = {r["id"]: (r["existing_id"], r["step"]) for r in resolve.match_existing(new, stored).collect()}
    assert got == {11: (1, 1), 12: (2, 2), 13: (1, 3), 14: (4, 4)}


def test_collapse(spark):
    rows = spark.createDataFrame([
        paper(1, "Land Reform and Growth: Evidence from Villages", ["Ann Lee", "Bo Chan"], "", "short", "2024-05-01", "nber"),
        paper(2, "Unrelated Work on Taxes", ["Cy"], "", "", "", "iza"),
        paper(3, "Land reform and growth evidence from villages", ["A Lee"], "https://doi.org/10.1/x", "a longer abstract", "2023-09", "crossref"),
        paper(4, "A different title entirely", ["D"], "10.1/X", "", "2024-01-01", "openalex"),
        paper(5, "", [], "", "", "", "iza"), paper(6, "", [], "", "", "", "iza"),
    ], PAPER)
    prestige = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in features.PRESTIGE.items() for x in p]), F.col("source")), F.lit(0.3))
    got = {r["id"]: r for r in resolve.collapse(rows, prestige).collect()}
    assert set(got) == {1, 2, 5, 6}
    one = got[1]
    assert one["doi"] == "https://doi.org/10.1/x" and one["abstract"] == "a longer abstract" and one["published_at"] == "2023-09" and one["also_in"] == ["crossref", "openalex"] and one["pos"] == 1 and one["members"] == 3
    seen = spark.createDataFrame([("doi:10.1/X", ""), (None, "Unrelated work on TAXES"), ("", "")], "doi string, title string")
    assert {r["id"] for r in resolve.suppress_seen(resolve.collapse(rows, prestige), seen).collect()} == {5, 6}


def test_merge_rules(spark):
    schema = "doi string, abstract string, paper_type string, jel_codes array<string>, keywords array<string>, published_at string"
    row = lambda *a: a
    old = row(None, "long abstract", "journal_article", ["O1"], ["Land"], "2024-01-01")
    new = row("10.1/x", "short", "working_paper", ["R3", "O1"], ["land", "Cities"], "2023-09")
    df = spark.createDataFrame([(old, new), (new, old)], f"old struct<{schema.replace(' ', ':').replace(',:', ',')}>, new struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    a, b = (r["x"] for r in df.select(resolve.merged_metadata().alias("x")).collect())
    assert tuple(a) == ("10.1/x", "long abstract", "journal_article", ["O1", "R3"], ["Land", "Cities"], "2023-09")
    assert b["paper_type"] == "journal_article" and b["abstract"] == "long abstract" and b["jel_codes"] == ["R3", "O1"] and b["keywords"] == ["land", "Cities"]


def test_percentiles(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.0, 2.0, 3.0])], "id int, v double")
    want = {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0}
    assert {r["id"]: r["p"] for r in rows.select("id", ranking.percentile("v").alias("p")).collect()} == want
    assert {r["id"]: r["p"] for r in ranking.percentiles(rows, "v", "p").collect()} == want
    assert ranking.percentiles(rows.limit(1), "v", "p").first()["p"] == 1.0
    with pytest.raises(ValueError):
        ranking.combined([])
    scored = spark.createDataFrame([(1, 0.9, 0.0, 0.0), (2, 0.1, 0.0, 0.0), (3, 0.5, 0.0, 0.0)], "pos int, relevance double, library double, learned double")
    assert [r["pos"] for r in ranking.personalized(scored, ["relevance", "library", "learned"]).collect()] == [1, 3, 2]


def test_features(spark):
    weights = spark.createDataFrame([("O12", 1.0), ("O1", 0.6), ("R", 0.3)], "prefix string, weight double")
    codes = spark.createDataFrame([(1, "O12"), (1, "Z9"), (2, "O15"), (3, "Z9"), (4, " ")], "paper_id int, code string")
    assert {r["paper_id"]: r["jel"] for r in features.code_scores(codes, weights).collect()} == {1: 1.0, 2: 0.6, 3: 0.1}
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    key = lambda t: one(features.keyword_score(F.lit(t), F.lit(None).cast("string"), ["housing", "land use", "health"], ["housing", "land use"]))
    assert key("Housing and land use") == 1.0 and key("health of islands") == 0.25 and key("warehousing") == 0.0
    assert one(features.journal_score(F.lit('{"journal": "American Economic Review: Insights"}'))) == 1.0 and one(features.journal_score(F.lit('{"host_venue": {"display_name": "World Development"}}'))) == 0.8
    assert one(features.journal_score(F.lit("broken"))) == 0.0 and one(features.source_score(F.lit("crossref"), F.lit("https://zenodo.org/1"))) == 0.1 and one(features.source_score(F.lit("other"), F.lit(None).cast("string"))) == 0.3
    edges = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2), (4, 3), (5, 4)], "paper_id int, author_id int")
    people = lambda tracked: spark.createDataFrame([(1, tracked, False), (2, False, False), (3, False, True), (4, False, False)], "author_id int, is_tracked boolean, auto_discovered boolean")
    assert {r["paper_id"]: r["author"] for r in features.author_scores(edges, people(True)).collect()} == {1: 1.0, 2: 1.0, 3: 0.5, 4: 0.3, 5: 0.0}
    assert {r["author"] for r in features.author_scores(edges, people(False)).collect()} == {0.0}
    fund = lambda t, tier, ok=True: one(features.funding_score(F.lit(t), F.lit(tier).cast("string"), F.lit("phd_student" if "phd" in t else None).cast("string"), F.lit(ok), ["urban", "housing"], ["biomedical"]))
    assert fund("urban housing", "core") == 0.94 and fund("x", "core") > fund("x", "relevant") > fund("x", "peripheral") and fund("x", None) == 0.5 and fund("biomedical", "peripheral") == 0.07 and fund("phd", "relevant", False) == 0.53
    assert one(features.funding_score(F.lit("Instrumentation"), F.lit(None).cast("string"), F.lit("both"), F.lit(None).cast("boolean"))) == 0.18
    assert one(features.funding_score(F.lit("Poverty and urban housing in India"), F.lit("core"), F.lit("faculty"), F.lit(True))) == 1.0


def test_composite(spark):
    papers = spark.createDataFrame([(1, "Housing in India", "", "2024-03-10"), (2, "Other", None, None)], "paper_id int, title string, abstract string, published_at string")
    frame = lambda name, rows: spark.createDataFrame(rows, f"paper_id int, {name} double")
    found = features.composite(papers, [frame("jel", []), frame("author", [(1, 0.5)]), frame("prestige", [(1, 1.0)]), frame("social", [(1, 0.5)]), frame("india", [(1, 1.0)])], ["housing"], ["housing"], F.lit("2024-03-12").cast("date"))
    got = {r["paper_id"]: r["relevance"] for r in found.collect()}
    assert abs(got[1] - (0.15 + 0.22 + 0.05 * 0.5 + 0.35 + 0.05 + 0.03 * 0.5 + 0.05)) < 1e-9 and abs(got[2] - (0.35 * 0.3 + 0.05 * 0.5)) < 1e-9


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = lambda x: [float(a) for a in x]
    one = lambda a, b: spark.createDataFrame([(v(a), v(b))], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert abs(one([1, 2], [2, 4]) - 1) < 1e-9 and one([1, 0], [0, 1]) == 0 and one([1], [1, 2]) == 0 and one([0, 0], [1, 1]) == 0
    lib, cand = rng.normal(size=(50, 8)), rng.normal(size=(30, 8))
    library_rows = spark.createDataFrame([(v(x),) for x in lib], "vector array<double>")
    rows = spark.createDataFrame([(k, v(x)) for k, x in enumerate(cand)], "id long, vector array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sort(unit(cand) @ unit(lib).T, axis=1)[:, -5:].mean(1)
    monkeypatch.setattr(vectors, "BLOCK", 9)
    for most in (1000, 10):
        got = {r["id"]: r["similarity"] for r in vectors.library_affinity(rows, library_rows, most_broadcast=most).collect()}
        assert np.allclose([got[k] for k in range(30)], want)
    good, bad = rng.normal(2, 1, (20, 6)), rng.normal(-2, 1, (20, 6))
    frame = lambda x, first=0: spark.createDataFrame([(first + k, v(r)) for k, r in enumerate(x)], "id long, vector array<double>")
    for kind in ("logistic", "centroid"):
        model = vectors.train_ranker(frame(good), frame(bad), kind=kind)
        score = {r["id"]: r["score"] for r in model.score(frame(np.vstack([good, bad])).unionByName(spark.createDataFrame([(99, [1.0])], "id long, vector array<double>"))).collect()}
        assert min(score[k] for k in range(20)) > max(score[k] for k in range(20, 40)) and score[99] == 0.0
    assert vectors.train_ranker(frame(good[:2]), frame(bad)) is None


def test_library(spark):
    items = spark.createDataFrame([(1, "Land use land use land", "tenure"), (2, "Land rights", "slums"), (3, "tenure tenure", None), (4, "other", "x")], "item_id int, title string, abstract string")
    terms = {r["term"]: r["weight"] for r in library.term_weights(items, ["use"], most_df=0.5).collect()}
    assert set(terms) == {"land", "tenure"} and max(terms.values()) == 1.0
    full, last = library.author_weights(spark.createDataFrame([(1, "Ann O'Lee"), (2, "ann o'lee"), (3, "Bo Lee")], "item_id int, name string"))
    papers = spark.createDataFrame([(1, ["Ann O'Lee"], "Land", "tenure"), (2, ["C Lee"], "none", None)], "paper_id int, authors array<string>, title string, abstract string")
    assert {r["paper_id"]: r["author"] for r in library.author_scores(papers, full, last).collect()} == {1: 1.0, 2: 0.35}
    content = {r["paper_id"]: r["content"] for r in library.content_scores(papers, library.term_weights(items, [], most_df=0.5), []).collect()}
    assert set(content) == {1} and 0 < content[1] <= 1
    assert library.corpus_hash(items).first() == library.corpus_hash(items.orderBy(F.desc("item_id")).repartition(3)).first()


def test_store(spark, tmp_path):
    stored = spark.createDataFrame([("a", None, 1)], "k string, d string, n int")
    rows = spark.createDataFrame([("a", None, 2), ("b", "x", 5), ("b", "x", 4)], "k string, d string, n int")
    once = store.insert_ignore(rows, stored, ["k", "d"], "n")
    assert sorted((r["k"], r["n"]) for r in once.collect()) == [("a", 1), ("b", 4)]
    assert store.new_rows(rows, once, ["k", "d"]).count() == 0
    old = spark.createDataFrame([("ann", "MIT", False, None), ("bo", None, True, "US")], "name string, affiliation string, is_tracked boolean, country string")
    new = spark.createDataFrame([("ann", "M.I.T. Dept", True, "US"), ("cy", "LSE", False, None)], old.schema)
    got = {r["name"]: tuple(r)[1:] for r in store.upsert(new, old, ["name"], store.AUTHOR_RULES).collect()}
    assert got == {"ann": ("M.I.T. Dept", True, "US"), "bo": (None, True, "US"), "cy": ("LSE", False, None)}
    people = spark.createDataFrame([(1, "ann", "x"), (2, "ann", "longest"), (3, "bo", None)], "author_id int, key string, affiliation string")
    kept, edges = store.collapse_duplicates(people, spark.createDataFrame([(9, 1, 2), (9, 2, 1), (8, 3, 1)], "paper_id int, author_id int, position int"), "key", "author_id")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "ann", "longest"), (3, "bo", None)] and sorted(tuple(r) for r in edges.collect()) == [(8, 3, 1), (9, 1, 1)]
    path = f"file://{tmp_path}/t"
    store.swap(stored, path)
    store.swap(spark.read.parquet(path).unionByName(rows.limit(1)), path)
    assert spark.read.parquet(path).count() == 2
    assert store.run_log(spark, "s", "w", "2024-01-01 00:00:00", "2024-01-01 00:01:00", "success", 3, 1).first()["items_new"] == 1


def test_incremental(spark):
    calls = spark.createDataFrame([(1, "a", D(2026, 1, 11), [14]), (2, "b", D(2026, 1, 3), None), (3, "c", None, None), (4, "d", D(2025, 1, 1), None)], "deadline_id int, name string, deadline_date date, notified_days array<int>")
    due = incremental.due_alerts(calls, F.lit("2026-01-01").cast("date"))
    assert [(r["deadline_id"], r["threshold"]) for r in due.collect()] == [(2, 3)]
    marked = {r["deadline_id"]: r["notified_days"] for r in store.mark_notified(calls, due.select("deadline_id", "threshold")).collect()}
    assert marked[2] == [3] and marked[1] == [14]
    votes = spark.createDataFrame([(1, "O1", True), (2, "O1", True), (3, "O1", False)], "seq int, code string, interesting boolean")
    start = spark.createDataFrame([("O1", 0.5), ("R3", 0.2)], "code string, weight double")
    assert {r["code"]: r["weight"] for r in incremental.folded_weights(votes, start).collect()} == {"O1": 0.56525, "R3": 0.2}
    exports = spark.createDataFrame([('{"7": {"vote": "up", "votedAt": "t1"}, "8": {"vote": null}, "x": {"vote": "down", "votedAt": "t"}, "9": {"vote": "down", "votedAt": "t2"}}',), ("broken",)], "value string")
    assert sorted(tuple(r) for r in incremental.votes_of_export(exports).collect()) == [(7, True, "t1"), (9, False, "t2")]
    from signalrank.sources.profiles import imported

    log = spark.createDataFrame([(7, True, "t1")], "paper_id long, interesting boolean, at string")
    assert [tuple(r) for r in imported(exports, log).collect()] == [(9, False, "t2")]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert abs(one(incremental.nudged(F.lit(0.5), F.lit(0.4))) - 0.52) < 1e-9 and one(incremental.nudged(F.lit(0.5), F.lit(0.01))) == 0.5
    cache = spark.createDataFrame([("k", "", datetime.datetime(2026, 1, 1, 0)), ("old", "v", datetime.datetime(2025, 12, 31, 0))], "key string, value string, stored_at timestamp")
    live = incremental.fresh(cache, F.lit("2026-01-01 06:00:00").cast("timestamp"))
    hit, miss = incremental.memoized(spark.createDataFrame([("k",), ("old",)], "key string"), live)
    assert [r["value"] for r in hit.collect()] == [""] and [r["key"] for r in miss.collect()] == ["old"]
