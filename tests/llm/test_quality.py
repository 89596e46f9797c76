import numpy as np
from pyspark.sql import functions as F

from signalrank import session
from signalrank.llm import quality as q

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, host string, posterior string"
GOOD = "A plain sentence with several different words, and then another one that says a little more about it."
BAD = "BUY!! BUY!! NOW!! BUY!! BUY!! NOW!! ### $$$ %%% BUY!! NOW!! ### $$$ %%%"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "h", "p") for i, t, s in rows], COLUMNS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    rng = np.random.default_rng(0)
    rows = [(i, (GOOD if i % 3 else BAD) + f" {rng.integers(1000)} w{rng.integers(99)}", f"s{i % 4}") for i in range(120)]
    return rows, [(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)]


def test_rejects_bad_and_keeps_all_columns(spark):
    rows, marks = corpus()
    rows += [(500, None, None), (501, "", "s0"), (None, GOOD, "new"), (3, BAD * 20_000, "s1")]
    kept = q.keep_good(docs(spark, rows), labels(spark, [*marks, (2, 0, 0), (None, 1, 0), (7, None, 0)]))
    assert kept.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    got = [r["doc_id"] for r in kept.collect()]
    assert {i for i in range(120) if i % 3} <= set(got) and None in got and not {i for i in range(0, 120, 3)} & set(got)


def test_sites_shrink_to_their_priors(spark):
    rows = [(i, GOOD, "big" if i < 300 else "poor" if i < 600 else "one" if i == 600 else "none") for i in range(602)]
    marks = [(i, int(i % 10 > 0), 0) for i in range(300)] + [(i, int(i % 10 > 6), 0) for i in range(300, 600)] + [(600, 0, 0)]
    found = q.judged(docs(spark, rows), labels(spark, marks), F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    by_host = {r["host"]: r for r in found if r["doc_id"] in (5, 305, 600, 601)}
    assert abs(by_host["big"]["host_rate"] - 0.9) < 0.05 and abs(by_host["poor"]["host_rate"] - 0.3) < 0.05
    assert by_host["none"]["host_rate"] is None and by_host["one"]["host_rate"] is None  # its only label is its own
    even = 1 / (1 + np.exp(-by_host["none"]["log_odds"]))
    assert by_host["poor"]["posterior"] < even < by_host["big"]["posterior"] and abs(by_host["one"]["posterior"] - even) < 1e-9


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (GOOD if rng.random() < 0.7 else BAD) + f" {i}", None if i % 11 == 0 else f"s{int(rng.integers(5))}") for i in range(300)]
    marks = [(i, int(rng.random() < (0.9 if rows[i][1].startswith("A") else 0.2)), 0) for i in range(0, 300, 2)]
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    got = {r["doc_id"]: r for r in q.judged(docs(spark, rows), labels(spark, marks), host, path).collect()}
    good = dict((i, y) for i, y, _ in marks)
    x = np.array([q.features(rows[i][1]) for i in good])
    y = np.array([float(good[i]) for i in good])
    odds = {i: float(np.array(q.features(t)) @ q.fit(x, y, np.ones(len(y)))) for i, t, _ in rows}
    chance = {i: 1 / (1 + np.exp(-odds[i])) for i in odds}
    logit = lambda p: np.log(p / (1 - p))

    def strength(groups):
        s, v, nv = (sum(f(n, k, m) for n, k, m in groups) for f in (lambda n, k, m: n * (k / n - m) ** 2, lambda n, k, m: m * (1 - m), lambda n, k, m: n * m * (1 - m)))
        between = max(0.0, (s - v) / (nv - v))
        return min(1000.0, max(2.0, (1 - between) / between if between > 0 else 1000.0))

    site = {i: s for i, _, s in rows}
    def counts(s, without=None):
        ids = [i for i in good if site[i] == s and i != without]
        return len(ids), sum(good[i] for i in ids), sum(chance[i] for i in ids)

    def shift(n, k, e, mass, above=0.0):
        if not n:
            return above
        prior = 1 / (1 + np.exp(-(logit(e / n) + above)))
        return logit((k + mass * prior) / (n + mass)) - logit(e / n)

    every = [counts(s) for s in set(site.values())]
    host_mass = strength([(n, k, e / n) for n, k, e in every if n])
    path_mass = strength([(n, k, 1 / (1 + np.exp(-(logit(e / n) + shift(n, k, e, host_mass))))) for n, k, e in every if n])
    for i in got:
        own = counts(site[i], i)
        total = odds[i] + shift(*own, path_mass, shift(*own, host_mass))
        assert abs(got[i]["posterior"] - 1 / (1 + np.exp(-total))) < 1e-6


def test_shuffle_join_of_sites_agrees(spark, monkeypatch):
    rows, marks = corpus()
    found = lambda: sorted(q.judged(docs(spark, rows), labels(spark, marks), F.col("source"), F.col("lang")).select("doc_id", F.round("posterior", 9)).collect())
    small = found()
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    assert found() == small


def test_without_labels_and_rows(spark):
    rows, _ = corpus()
    none = labels(spark, [])
    assert q.keep_good(docs(spark, rows), none).count() == len(rows)
    assert q.keep_good(docs(spark, []), none).count() == 0


def test_held_out_accuracy(spark):
    from signalrank.session import table

    sf = "/root/testdata/sf0.01"
    marks = table(spark, sf, "labels")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = q.judged(table(spark, sf, "documents"), marks.where(half), F.col("source"), F.concat_ws("/", "source", "lang"))
    rows = found.select("doc_id", "posterior").join(marks.where(~half), "doc_id").collect()
    good = [r for r in rows if r["quality"]]
    assert sum(r["posterior"] >= 0.5 for r in good) >= 0.98 * len(good) and sum((r["posterior"] >= 0.5) == r["quality"] for r in rows) >= 0.94 * len(rows)
