import numpy as np
import pytest
from pyspark.sql import functions as F

from signalrank.operators import vectors

ROW = "id long, vector array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], ROW)


def clustered(seed, n, dim=24, groups=40, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


def scores(df):
    return {r["id"]: r["similarity"] for r in df.collect()}


def test_all_lists_are_the_exact_way(spark, monkeypatch):
    library, asked = frame(spark, clustered(1, 600)), frame(spark, clustered(2, 50), 10_000)
    exact = scores(vectors.library_affinity(asked, library))
    for block in (4096, 16):  # long lists in blocks
        monkeypatch.setattr(vectors, "BLOCK", block)
        found = scores(vectors.InvertedLists(library, lists=12).affinity(asked, probes=12))
        assert found == pytest.approx(exact)


def test_few_probes_find_nine_of_ten_neighbours(spark):
    x, y = clustered(3, 3000), clustered(4, 200)
    lists = vectors.InvertedLists(frame(spark, x))
    assert len(lists.centres) == 55
    exact, found = scores(vectors.library_affinity(frame(spark, y), frame(spark, x))), scores(lists.affinity(frame(spark, y)))
    assert set(found) == set(exact) and all(found[k] <= exact[k] + 1e-9 for k in exact)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(y) @ unit(x).T), axis=1)[:, :5]
    listed = {r["id"]: r["list"] for r in lists._near(frame(spark, x), 1).collect()}
    probed = {}
    for r in lists._near(frame(spark, y), vectors.PROBES).collect():
        probed.setdefault(r["id"], set()).add(r["list"])
    recall = np.mean([listed[int(j)] in probed[k] for k, row in enumerate(best) for j in row])
    assert recall >= 0.9, recall


def test_edges(spark):
    one = vectors.InvertedLists(frame(spark, [[1.0, 0.0]]))
    assert scores(one.affinity(frame(spark, [[1.0, 0.0], [0.0, 2.0]]))) == pytest.approx({0: 1.0, 1: 0.0})
    equal = vectors.InvertedLists(frame(spark, [[1.0, 1.0]] * 50), lists=4)
    assert scores(equal.affinity(frame(spark, [[2.0, 2.0]]))) == pytest.approx({0: 1.0})
    assert one.affinity(frame(spark, [[1.0, 0.0]]).where(F.lit(False))).count() == 0
