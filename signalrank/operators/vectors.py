"""Vector operators: cosine affinity to a library, centroids and a small learned ranker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import checkpoint_dir, cut, remove

# Neighbours pooled, floor and width of the similarity band, its cap and scale; steepness of the centroid rule; examples of a class.
TOP_K, FLOOR, WIDTH, CAP, SCALE = 5, 0.45, 0.35, 0.7, 10.0
STEEPNESS, LEAST_EXAMPLES, MOST_NEGATIVES, SEED = 8.0, 3, 200, 13
#: Library vectors compared at a time in a task; a library beyond MOST_BROADCAST vectors is dealt out in blocks instead of broadcast.
MOST_BROADCAST, BLOCK = 20_000, 4096
#: Bytes of the similarities that a task holds at a time where the library is broadcast; sorting them takes as much again.
SIM_BYTES = 16 << 20
#: Lists of an inverted index at most, vectors of a list that its centre is fitted on at most, about, and lists that a candidate meets.
MOST_LISTS, SAMPLE_A_LIST, PROBES = 4096, 64, 8
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for vectors of no length or of different sizes."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b) + F.lit(TINY))).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def pooled(sims: Column, k: int = TOP_K) -> Column:
    """Mean of the k greatest of an array."""
    best = F.slice(F.sort_array(sims, asc=False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)


def affinity_of(mean: Column) -> Column:
    """Library score of a pooled similarity: shifted by the floor, cut to [0, cap], scaled."""
    return F.greatest(F.lit(0.0), F.least(F.lit(CAP), (mean - FLOOR) / WIDTH)) * SCALE


def _unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)


def _best_means(vectors, library: np.ndarray, k: int) -> np.ndarray:
    """Mean of the k greatest cosines of each vector with the library's unit rows."""
    sims = _unit_rows(vectors) @ library.T
    m = min(k, sims.shape[1])
    sims.partition(sims.shape[1] - m, axis=1)
    return np.sort(sims[:, -m:], axis=1).mean(1)


def _best_of(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """(id, sim): the k best cosines of each row of one block of candidates with those of one block of a library."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        sims = _unit_rows(left["vector"]) @ _unit_rows(right["vector"]).T
        m = min(k, sims.shape[1])
        sims.partition(sims.shape[1] - m, axis=1)  # in place: a copy would be as large again
        top = sims[:, -m:]
        return pd.DataFrame({"id": np.repeat(left["id"].to_numpy(), m), "sim": top.ravel()})

    return best


class InvertedLists:
    """A library in lists under trained centres, of which a candidate meets only those nearest to it.

    The centres are fitted on a hash-chosen sample of at most SAMPLE_A_LIST vectors a list; all vectors are dealt into
    lists. Long lists are split into blocks, so no list is gathered in one task. Similarities are those of the vectors met,
    so the mean of the k best is never above the exact one; more probes make it equal more often, all lists always.
    """

    def __init__(self, library: DataFrame, lists: int | None = None, seed: int = SEED):
        """library: (vector), and id where there is one; vectors of one length, none null."""
        rows = library.select(F.xxhash64("id" if "id" in library.columns else "vector").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
        rows = cut(rows.where(F.size("vector") > 0))
        wanted = lists or min(MOST_LISTS, max(1, round(rows.count() ** 0.5)))
        sample = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(wanted * SAMPLE_A_LIST).select(array_to_vector(unit(F.col("vector"))).alias("features"))
        model = KMeans(k=wanted, seed=seed, maxIter=10).fit(sample) if wanted > 1 else None
        self.centres = _unit_rows(model.clusterCenters()) if model else np.ones((1, 1))
        self.rows = cut(self._near(rows.select(F.col("key").alias("id"), "vector"), 1))
        counts = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        self.sizes = cut(counts.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), narrow=True)  # one row a list

    def _near(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows (id, vector) once for each of their `probes` nearest lists."""
        held, wide = rows.sparkSession.sparkContext.broadcast(self.centres), min(probes, len(self.centres))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(held.value) == 1:
                    yield frame.assign(list=0)
                    continue
                sims = _unit_rows(frame["vector"]) @ held.value.T if len(frame) else np.zeros((0, len(held.value)))
                near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
                yield frame.loc[frame.index.repeat(wide)].assign(list=near.ravel().astype("int32"))

        return rows.mapInPandas(run, "id long, vector array<double>, list int")

    def affinity(self, candidates: DataFrame, probes: int = PROBES, k: int = TOP_K) -> DataFrame:
        """(id, similarity, affinity) of candidates (id, vector), as `library_affinity` gives them but for what the lists not probed hold."""
        asked = cut(self._near(candidates.select("id", F.col("vector").cast("array<double>").alias("vector")), probes))
        part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-candidates.count() // BLOCK)))).cast("int").alias("part")
        blocks = F.broadcast(self.sizes)
        asked = asked.join(blocks, "list").select("id", "vector", "list", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        wanted = asked.select(F.col("list").alias("l"), F.col("block").alias("b"), F.col("part").alias("p")).distinct()
        dealt = self.rows.join(blocks, "list").select("vector", "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        dealt = dealt.join(wanted, (F.col("list") == F.col("l")) & (F.col("block") == F.col("b"))).select("vector", F.col("l").alias("list"), F.col("b").alias("block"), F.col("p").alias("part"))
        keys = ["list", "block", "part"]
        met = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_best_of(k), "id long, sim double")
        found = met.groupBy("id").agg(pooled(F.collect_list("sim"), k).alias("similarity"))
        return found.select("id", "similarity", affinity_of(F.col("similarity")).alias("affinity"))


def library_affinity(candidates: DataFrame, library: DataFrame, k: int = TOP_K, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, similarity, affinity) of candidates (id, vector) to a library (vector): mean of the k greatest cosines.

    A library of bounded size is broadcast as one matrix. A larger one stays in blocks; every candidate block meets each of
    them, keeps its k best there, and the best of all blocks are pooled.
    """
    spark = candidates.sparkSession
    size = library.limit(most_broadcast + 1).count()
    if size == 0:
        return candidates.select("id", F.lit(0.0).alias("similarity"), F.lit(0.0).alias("affinity"))
    if size <= most_broadcast:
        held = spark.sparkContext.broadcast(_unit_rows([r[0] for r in library.select("vector").collect()]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, SIM_BYTES // (8 * len(held.value)))
            for frame in frames:
                for start in range(0, len(frame), step):
                    some = frame.iloc[start : start + step]
                    yield pd.DataFrame({"id": some["id"], "similarity": _best_means(some["vector"], held.value, k)})

        found = candidates.select("id", "vector").mapInPandas(run, "id long, similarity double")
    else:
        # Every block of candidates meets every block of the library; a group holds one of each.
        blocks, asking = -(-library.count() // BLOCK), max(1, -(-candidates.count() // BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # By a hash, so that a stage that runs again deals the same; of the id where there is one, as equal vectors share a block otherwise.
        key = F.xxhash64("id") if "id" in library.columns else F.xxhash64("vector")
        dealt = library.select("vector", F.pmod(key, F.lit(blocks)).cast("int").alias("block")).select("vector", "block", every(asking).alias("part"))
        asked = candidates.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(asking)).cast("int").alias("part")).select("id", "vector", "part", every(blocks).alias("block"))

        parts = asked.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInPandas(_best_of(k), "id long, sim double")
        found = parts.groupBy("id").agg(pooled(F.collect_list("sim"), k).alias("similarity"))
    return found.select("id", "similarity", affinity_of(F.col("similarity")).alias("affinity"))


def centroids(rows: DataFrame) -> DataFrame:
    """(label, vector): mean of the unit vectors of each class of rows (label, vector)."""
    each = rows.select("label", F.posexplode(unit(F.col("vector"))).alias("pos", "x"))
    means = each.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def centroid_probability(vector: Column, good: Column, bad: Column, steepness: float = STEEPNESS) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(steepness) * (cosine(vector, good) - cosine(vector, bad))))


def score_by_centroids(candidates: DataFrame, model: DataFrame) -> DataFrame:
    """(id, score) of candidates (id, vector); model: centroids of labels 1 and 0. Vectors of another size score 0."""
    sides = model.groupBy().agg(F.max_by("vector", F.col("label") == 1).alias("good"), F.min_by("vector", F.col("label") == 1).alias("bad"))
    joined = candidates.join(F.broadcast(sides), F.lit(True), "left")  # one row
    fits = F.size("vector") == F.size("good")
    return joined.select("id", F.when(fits, centroid_probability(F.col("vector"), F.col("good"), F.col("bad"))).otherwise(F.lit(0.0)).alias("score"))


class Ranker:
    """A trained ranker: logistic over unit vectors, or centroids where a class cannot be separated."""

    def __init__(self, kind: str, model, dim: int):
        self.kind, self.model, self.dim = kind, model, dim

    def score(self, candidates: DataFrame) -> DataFrame:
        """(id, score); candidates of another size score 0."""
        if self.kind == "centroid":
            return score_by_centroids(candidates, self.model)
        fits = candidates.where(F.size("vector") == self.dim).select("id", array_to_vector(unit(F.col("vector"))).alias("features"))
        found = self.model.transform(fits).select("id", vector_to_array("probability")[1].alias("score"))
        return candidates.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the ranker under `path`, for `load`."""
        if self.kind == "centroid":
            self.model.write.mode("overwrite").parquet(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        spark.range(1).select(F.lit(self.kind).alias("kind"), F.lit(self.dim).alias("dim")).coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Ranker":
        row = spark.read.parquet(f"{path}/kind").first()
        model = spark.read.parquet(f"{path}/model") if row["kind"] == "centroid" else LogisticRegressionModel.load(f"{path}/model")
        return Ranker(row["kind"], model, row["dim"])


def examples(votes: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) vectors (id, vector) of the papers with a last vote (paper_id, interesting); papers without a vector are in neither."""
    voted = vectors.join(votes.select(F.col("paper_id").alias("id"), "interesting"), "id")
    return voted.where("interesting").select("id", "vector"), voted.where("not interesting").select("id", "vector")


def ranked_by_votes(votes: DataFrame, vectors: DataFrame, candidates: DataFrame, path: str | None = None) -> DataFrame:
    """(id, score) of candidates (id, vector) by a ranker trained on the votes, which is written to `path`; all 0 where the votes are too few."""
    model = train_ranker(*examples(votes, vectors), candidates=candidates)
    if model is None:
        return candidates.select("id", F.lit(0.0).alias("score"))
    if path is not None:
        model.save(candidates.sparkSession, path)
    return model.score(candidates)


def train_ranker(good: DataFrame, bad: DataFrame, candidates: DataFrame | None = None, kind: str = "logistic", least: int = LEAST_EXAMPLES) -> Ranker | None:
    """good, bad, candidates: (id, vector). A hash-chosen sample of candidates counts as bad. None with too few of either class."""
    negatives = bad.select("vector")
    if candidates is not None:
        negatives = negatives.unionByName(candidates.orderBy(F.xxhash64(F.col("id"), F.lit(SEED)), "id").limit(MOST_NEGATIVES).select("vector"))
    rows = good.select("vector", F.lit(1).alias("label")).unionByName(negatives.withColumn("label", F.lit(0))).where(F.size("vector") > 0)
    sizes = {r["label"]: (r["n"], r["low"], r["high"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).collect()}
    if any(sizes.get(k, (0,))[0] < least for k in (0, 1)) or len({d for x in sizes.values() for d in x[1:]}) != 1:
        return None
    dim = sizes[1][1]
    if kind == "centroid":
        return Ranker("centroid", centroids(rows), dim)
    total = sum(x[0] for x in sizes.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * sizes[1][0])).otherwise(total / (2.0 * sizes[0][0]))
    data = rows.select(array_to_vector(unit(F.col("vector"))).alias("features"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
    return Ranker("logistic", _bare(LogisticRegression(weightCol="weight", regParam=1.0 / total, maxIter=200).fit(data)), dim)


def _bare(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model without its training summary, which holds the session and can't be sent to tasks once the session has observed a query."""
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    found = LogisticRegressionModel.load(path)
    remove(spark, path)
    return found
