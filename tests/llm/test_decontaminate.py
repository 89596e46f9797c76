import random

import pytest

from signalrank.llm import decontaminate as d

SCHEMA = "doc_id long, text string, words string, term string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, tests, window=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for item, t in tests:
            v = words(t)
            for s in range(max(1, len(v) - window + 1)) if v else ():
                win = v[s : s + window]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        ids.add(item)
        found.append((doc_id, len(w), len(hit), len(ids), bool(hit)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("most", [d.MAX_BROADCAST_BYTES, -1])
def test_against_brute_force(spark, most):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "a", "Émile", "x9"]) if rng.random() < 0.6 else f"w{rng.randrange(60)}"
    tests = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 10, 14, 25, 1])] + [(10, None), (11, " .. "), (12, "")]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            w[5:5] = (tests[rng.randrange(4)][1] or "").upper().split()
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, tests[3][1] + "-" + tests[3][1]), (None, tests[1][1])]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in d.report(docs(spark, rows), items(spark, tests), max_broadcast=most).collect()), key=repr)
    assert got == brute(rows, tests)


def test_repeated_rows_and_empty_tables(spark):
    tests = items(spark, [(1, "one two three")])
    got = d.report(docs(spark, [(1, "one two three"), (1, "one two three"), (1, "other")]), tests).collect()
    assert sorted(r["n_hit"] for r in got) == [0, 3, 3]
    assert d.report(docs(spark, []), tests).count() == 0
    assert [r["n_hit"] for r in d.report(docs(spark, [(1, "one two three")]), items(spark, [])).collect()] == [0]


def test_clean_keeps_columns(spark):
    kept = d.clean(docs(spark, [(1, "a b c d"), (2, "e f"), (None, "a b c d"), (3, None)]), items(spark, [(1, "b c")]))
    assert kept.columns == ["doc_id", "text", "words", "term"] and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_proximity(spark):
    rows = docs(spark, [(1, "alpha x beta"), (2, "beta y y y alpha"), (3, "alpha")])
    asked = spark.createDataFrame([(7, "alpha beta")], "query_id long, text string")
    assert {(r["doc_id"], r["start"]) for r in d.proximity(rows, asked, 3).collect()} == {(1, 0)}
    assert {r["doc_id"] for r in d.proximity(rows, asked, 5).collect()} == {1, 2}
