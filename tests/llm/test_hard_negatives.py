import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalrank.llm import hard_negatives as h
from signalrank.session import table
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<double>, label int, row string, q string, anchor string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain(rows, every=50, positives=5, negatives=3, least=50, most=95, scale=256):
    """All pairs, one after the other, in whole numbers."""
    q = [(k, i, y, [int(np.floor(scale * x)) for x in v]) for k, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, i, y, v in q:
        if i % every:
            continue
        scores = [(-max(-h.LONG, min(h.LONG, sum(a * b for a, b in zip(v, w)))), j, m, z) for m, j, z, w in q if m != k and len(w) == len(v)]
        for s, j, m, _ in sorted(x for x in scores if x[3] == y)[:positives]:
            fit = sorted(x for x in scores if x[3] != y and least * -s <= 100 * -x[0] <= most * -s)[:negatives]
            out += [(i, j, rank, n[1], -s, -n[0]) for rank, n in enumerate(fit, 1)]
    return sorted(out)


def mined(df, every=50, **settings):
    return sorted(map(tuple, h.mine(df, F.col("vec_id") % every == 0, F.col("label"), **settings).collect()))


def random_rows(seed, n, length=6, labels=3):
    rng = random.Random(seed)
    center = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(5)]
    rows = []
    for k in range(n):
        v = [x + rng.gauss(0, 0.4) for x in rng.choice(center)] if rng.random() < 0.7 else rng.choice([[1.0] * length, [0.5] * length])  # many ties
        rows.append((k, v, rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("block_bytes", [h.BLOCK_BYTES, 300])
def test_as_all_pairs_say(spark, block_bytes, monkeypatch):
    rows = random_rows(1, 400)
    df = vectors(spark, rows).repartition(5)
    assert mined(df, every=20, block_bytes=block_bytes) == plain(rows, every=20)
    monkeypatch.setattr(h, "TILE", 7)
    assert mined(df, every=20, block_bytes=block_bytes, positives=2, negatives=4, least=10, most=100) == plain(rows, 20, 2, 4, 10, 100)


def test_tiles_of_any_size_agree(monkeypatch):
    rng = np.random.default_rng(2)
    q, label = rng.integers(-3, 4, (200, 3)), rng.integers(0, 3, 200)
    block = {3: h.Block(np.arange(200)[:40], np.arange(200)[:40], label[:40], q[:40])}
    batch = h.pa.record_batch({"row": np.arange(200), "vec_id": np.arange(200), "label": label, "q": h.pa.array(q.tolist())})
    found = []
    for tile in (1, 9, 1000):
        monkeypatch.setattr(h, "TILE", tile)
        best = h.positives_of(block, iter([batch]), 5)
        block[3].open_windows(best[3], 50, 95)
        found.append([x.tolist() for b in (best, h.negatives_of(block, iter([batch]), 3)) for x in b[3].found()])
    assert found[0] == found[1] == found[2]


def test_rows_that_take_no_part_and_odd_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 1.5], 2), (2, [0.9, 1.5], 2), (50, [1.0], 1), (51, [3.0], 1), (52, [2.0], 2), (100, [], 1), (101, [], 1), (102, [], 2)]
    rows += [(None, [1.0, 2.0], 1), (3, None, 2), (4, [1.0, 2.0], None), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (150, [1.0, 2.0], 1), (150, [1.0, 2.0], 1), (-50, [-1.0, -2.0], 1)]
    got = mined(vectors(spark, rows))
    assert got == plain(rows) and {r[0] for r in got} == {0, 50, 100, 150}


def test_sums_beyond_float64_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, [float(rng.randrange(1 << 22)) + 0.25 * rng.randrange(4) for _ in range(9)], rng.randrange(2)) for k in range(60)]
    rows += [(60, [1e30] * 9, 0), (61, [1e30] * 9, 1), (62, [2.0**40, -(2.0**40), 1.0] * 3, 0), (63, [2.0**40, -(2.0**40), 1.0] * 3, 1)]
    sure = [r for r in rows if r[0] < 60]
    assert max(r[5] for r in plain(sure, every=10)) > 1 << 53
    assert mined(vectors(spark, sure), every=10) == plain(sure, every=10)
    got = mined(vectors(spark, rows), every=10)  # scores beyond a long stand at its ends
    assert got and max(r[4] for r in got) == h.LONG


def test_one_vector_a_third_of_all_rows(spark):
    rows = random_rows(4, 300) + [(1000 + k, [1.0] * 6, k % 2) for k in range(1500)]
    assert mined(vectors(spark, rows).repartition(7)) == plain(rows)


def test_no_anchor_no_row(spark):
    assert mined(vectors(spark, [])) == [] and mined(vectors(spark, [(1, [1.0], 1)])) == [] and mined(vectors(spark, [(0, [1.0], 1)])) == []


def test_blocks_are_bounded(spark):
    df = h.cut(h.rounded(vectors(spark, random_rows(5, 500)), F.lit(True), "vec_id", "embedding", F.col("label")))
    blocks = h._blocks(df, 2000)
    sizes = [r["n"] * (6 * 8 + 64) for r in df.groupBy(h._block(blocks)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 4000 and len(sizes) > 20


def test_query_on_whole_table(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        compare(h.op11_hard_negatives(spark, sf), h.SQL, sf)
    label = lambda r: (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
    rows = [(r["vec_id"], r["embedding"], label(r)) for r in table(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, h.op11_hard_negatives(spark, sf).collect())) == plain(rows)
