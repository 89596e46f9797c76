import pytest

import corpus_pipeline as c
from signalrank.session import table
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = table(spark, SF, "documents"), []
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        rows = [r.asDict() for r in out.collect()]
        found.append((name, out.columns, rows))
        if name != "packing":
            docs = spark.createDataFrame([tuple(r.values()) for r in rows], out.schema)
    return found


def test_columns_and_order(spark, stages):
    assert [s[0] for s in stages] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    assert all(columns == table(spark, SF, "documents").columns for _, columns, _ in stages[:-1])


def test_quality_keeps_good_ones(spark, stages):
    kept = {r["doc_id"] for r in stages[0][2]}
    marks = table(spark, SF, "labels").collect()
    good = [r["doc_id"] for r in marks if r["quality"]]
    bad = [r["doc_id"] for r in marks if not r["quality"]]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_exact_dedup_keeps_the_largest(stages):
    last = {}
    for r in stages[0][2]:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[1][2]) == sorted(last.values())


def test_near_dedup_keeps_the_least(stages):
    groups = brute([(r["doc_id"], r["text"]) for r in stages[1][2]])
    assert sorted(r["doc_id"] for r in stages[2][2]) == sorted(i for i, (_, low) in groups.items() if i == low)


def test_decontamination(spark, stages):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in t))
    windows = {tuple(w[i : i + 10]) for r in table(spark, SF, "benchmark").collect() for w in [words(r["text"])] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert sorted(r["doc_id"] for r in stages[3][2]) == sorted(r["doc_id"] for r in stages[2][2] if not hit(words(r["text"])))


def test_packing_takes_all(stages):
    assert check([(r["doc_id"], r["text"]) for r in stages[3][2]], stages[4][2]) < 0.01


def test_stages_take_nulls_repeats_long_texts_and_nothing(spark):
    schema = table(spark, SF, "documents").schema
    plain = "A plain sentence with several different words, and then another one that says a little more about it all."
    rows = [(None, plain, "en", "src0", 1), (None, None, None, None, None), (1, plain, "en", "src1", 1), (1, plain, "en", "src1", 1), (2, "", "en", "src1", 0), (3, plain + " Indeed so.", "de", None, 1)]
    rows.append((4, " ".join(f"word{k} and more of it," for k in range(60_000)), "en", "src2", 1))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in c.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert bool(got) == bool(given), name
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame([tuple(r) for r in got], schema)
        if given:
            assert sum(r["length"] for r in got if r["doc_id"] == 4) > 100_000
