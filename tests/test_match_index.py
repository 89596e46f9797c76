import json
import random

import pytest

from signalrank.operators import jobs, resolve
from signalrank.operators.match_index import ENTRY, TitleIndex
from signalrank.operators.versions import Tables

PAPER = "id long, title string, authors array<string>, doi string"
WORDS = "land wages town river growth trade school health credit market city village reform water rain crop".split()
NAMES = ["Ann Lee", "Bo Chan", "Cy Dunn", "Di Ek", "Ed Fo"]


BASES = [random.Random(k).sample(WORDS, 8) for k in range(25)]


def a_title(rng):
    words = list(rng.choice(BASES))
    change = rng.randrange(4)
    if change:
        words.pop(rng.randrange(8))
    if change > 1:
        words.append(f"word{rng.randrange(40)}")
    return rng.choice([None, "", "The the of", *[" ".join(words)] * 20])


def papers(rng, ids):
    return [(k, a_title(rng), rng.choice([None, [], *[rng.sample(NAMES, rng.randrange(1, 5)) for _ in range(4)]]), rng.choice([None, "", None, f"10.1/{rng.randrange(400)}"])) for k in ids]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1])
def test_finds_what_going_through_the_store_finds(spark, tmp_path, seed):
    rng = random.Random(seed)
    frame = lambda ids: spark.createDataFrame(papers(rng, ids), PAPER)
    first, later, new = frame(range(150)), frame(range(150, 260)), frame(range(1000, 1120))
    index = TitleIndex(Tables(spark, f"file://{tmp_path}/index"), buckets=16)
    index.build(first)
    assert rows(index.match(new)) == rows(resolve.match_existing(new, first))
    index.add(later)
    want = rows(resolve.match_existing(new, first.unionByName(later)))
    assert rows(index.match(new)) == want and {r[2] for r in want} == {1, 2, 3, 4}
    assert index.match(new.limit(0)).count() == 0


def test_a_batch_reads_the_folders_of_its_keys(spark, tmp_path):
    index = TitleIndex(Tables(spark, f"file://{tmp_path}/index"), buckets=64)
    index.build(spark.createDataFrame(papers(random.Random(3), range(200)), PAPER))
    asked = index._entries(*(lambda r: (r, index._order_of(r)))(index._keyed(spark.createDataFrame([(999, "Unheard words", [], None)], PAPER))))
    held = index.tables.read_some("entries", ENTRY, "bucket", index._buckets_of(asked))
    every = index.tables.read("entries", ENTRY)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert held.count() < every.count() / 5


def test_runs_with_an_index_end_as_runs_without(spark, tmp_path):
    rng, times = random.Random(4), ("2024-01-01 06:00:00", "2024-01-01 06:05:00")
    batches = []
    for number in range(2):
        items = [{"title": t, "authors": a, "doi": d or None, "source_id": str(k)} for k, t, a, d in papers(rng, range(100 * number, 100 * number + 60)) if t]
        batches.append(spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(items)], "seq long, value string"))
    ends = []
    for name in ("plain", "indexed"):
        tables = Tables(spark, f"file://{tmp_path}/{name}")
        index = TitleIndex(tables, buckets=8) if name == "indexed" else None
        if index is not None:
            index.build(spark.createDataFrame([], PAPER))
        found = [jobs.run(tables, b, "nber", "papers", *times, index=index) for b in batches]
        assert index is None or tables.read("entries", ENTRY).count() > 100
        ends.append((found, *(sorted(map(repr, tables.read(n, jobs.SCHEMAS[n]).collect())) for n in ("papers", "sources", "authors", "links"))))
    assert ends[0] == ends[1] and all(r["status"] == "success" for r in ends[0][0])
