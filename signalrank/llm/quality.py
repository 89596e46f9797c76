"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path-level posteriors.

The classifier is logistic over counts of a text's characters and words, fitted on a bounded sample of labelled rows. All
labelled documents of each path (here: source and language) and host (source) are then counted by grouped aggregation:
how many are good, and how many the classifier expects to be. A host's rate is drawn towards what its texts let expect, a
path's towards that with the host's shift, each by a prior strength estimated from how much the rates differ from the
expected ones beyond chance, so sparse sites stay near the prior. What the path's rate then differs from the expected
one, in log-odds, is added to the evidence of the text. A labelled document's own label is left out of its sites' counts.

Null and empty texts, of any length, have the features of their words, which may be none. Null hosts and paths are groups
of their own; sites without labels have the prior of the level above. Labels that repeat a doc_id count once, as good if
one of them is; rows that repeat a doc_id each carry its label. Without labels every document has an even chance and is
kept; an empty table gives none. All texts are read whole. All columns of a document are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.llm.toxicity import training_rows
from signalrank.session import cut, scratch, sized, small_batches, table

#: Labelled rows that the classifier is fitted on at most, chosen by hash.
TRAIN_ROWS = 20_000
#: Documents with a lower posterior of being good are rejected.
THRESHOLD = 0.5
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'-()\"?")
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
FEATURES = 14


def features(text: str | None) -> list[float]:
    """Shares of capitals, digits, odd marks and letters; how varied words, word pairs and lines are; word lengths; size."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    letters = max(1, size - len(data.translate(None, LETTERS)))
    words = data.split()
    n = max(1, len(words))
    upper = len(data) - len(data.translate(None, UPPER))
    marks = len(data) - len(data.translate(None, MARKS))
    digits = len(data) - len(data.translate(None, DIGITS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    runs = sum(map(bytes.__eq__, words, words[1:]))
    log_n = np.log1p(len(words))
    return [
        1.0, upper / letters, min(1.0, 5 * marks / size), min(1.0, 5 * digits / size), (size - letters) / size, len(set(words)) / n, float(np.log1p(len(set(words)))) / max(log_n, 1e-9) if words else 0.0,
        runs / n, len(set(lines)) / max(1, len(lines)), min(20.0, len(data) / n) / 20, float(log_n) / 10, float(len(words) < 20), float(upper > 0.5 * letters), float(marks > 0.08 * size),
    ]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic weights by damped Newton steps; the intercept is not drawn to 0."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    hold[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (weight * (p - y)) + hold * w)
        size = np.abs(step).max()
        w -= step * min(1.0, 3.0 / size if size else 1.0)
        if size < 1e-7:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray | None:
    """Weights of the classifier, or None without labels of both kinds. docs (doc_id, text), labels (doc_id, quality)."""
    rows = training_rows(docs, labels, most, "quality")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [features(t) for t in frame["text"]], "y": (frame["label"] > 0).astype(float)})

    found = rows.mapInPandas(run, "x array<double>, y double").collect()  # at most `most` rows
    x, y = np.array([r["x"] for r in found]).reshape(-1, FEATURES), np.array([r["y"] for r in found])
    return fit(x, y, np.ones(len(y))) if 0 < y.sum() < len(y) else None


def evidence(weights: np.ndarray | None, text: Column) -> Column:
    """Log-odds that a text is good, from the text alone."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if weights is None:
            return pd.Series(np.zeros(len(texts)))
        return pd.Series(np.array([features(t) for t in texts]).reshape(-1, FEATURES) @ weights)

    return run(text)


def prior_strength(groups: DataFrame, least: float = 2.0, most: float = 1000.0) -> float:
    """Documents that a prior counts for, by the method of moments over groups (n, k, mean): the less the rates differ from the mean expected of them beyond chance, the more."""
    n, mean, rate = F.col("n"), F.col("mean"), F.col("k") / F.col("n")
    row = groups.agg(F.sum(n * (rate - mean) * (rate - mean)).alias("s"), F.sum(mean * (1 - mean)).alias("v"), F.sum(n * mean * (1 - mean)).alias("nv")).first()
    if not row["v"] or row["nv"] <= row["v"]:
        return most
    between = max(0.0, (row["s"] - row["v"]) / (row["nv"] - row["v"]))  # share of the variance that is between sites
    return float(min(most, max(least, (1 - between) / between if between > 0 else most)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrunk(n: Column, k: Column, prior: Column, mass: float) -> Column:
    return (k + mass * prior) / (n + mass)  # a mass is never 0


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text_hash, host, path, log_odds, n, k, e) for every row: log_odds of its text; n, k, e: whether it is labelled, is good, and the classifier's chance for that."""
    weights = train(docs.select("doc_id", "text"), labels, most)
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"))
    rows = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), host.cast("string").alias("host"), path.cast("string").alias("path"), evidence(weights, F.col("text")).alias("log_odds")
    )
    chance = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 / (1 + F.exp(-F.col("log_odds")))))
    labelled = F.col("good").isNotNull()
    return rows.join(sized(cut(one, narrow=True)), "doc_id", "left").select(
        *rows.columns, labelled.cast("int").alias("n"), F.coalesce("good", F.lit(0)).alias("k"), F.when(labelled, chance).otherwise(0.0).alias("e")
    )


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """Rows (doc_id, text_hash, host, path, log_odds, host_rate, path_rate, posterior). The rates are those of the row's sites without its own label; null without labels."""
    with scratch(small_batches(docs.sparkSession)) as kept:
        rows = cut(scored(docs, labels, host, path, most))
        total = lambda p: [F.sum(c).alias(f"{p}_{c}") for c in "nke"]
        paths = cut(rows.groupBy("host", "path").agg(*total("path")), narrow=True)
        hosts = cut(paths.groupBy("host").agg(*(F.sum(f"path_{c}").alias(f"host_{c}") for c in "nke")), narrow=True)
        host_mass = prior_strength(hosts.where("host_n > 0").select(F.col("host_n").alias("n"), F.col("host_k").alias("k"), F.try_divide("host_e", "host_n").alias("mean")))
        same_host = F.col("p.host").eqNullSafe(F.col("h.host"))
        places = paths.alias("p").join(sized(hosts).alias("h"), same_host).select("p.*", *(f"h.host_{c}" for c in "nke"))
        places = cut(places, narrow=True)
        expected = _logit(F.try_divide("path_e", "path_n")) + _shift("host", host_mass, F.lit(0), F.lit(0), F.lit(0.0))
        path_mass = prior_strength(places.where("path_n > 0").select(F.col("path_n").alias("n"), F.col("path_k").alias("k"), (1 / (1 + F.exp(-expected))).alias("mean")))
        at = F.col("r.host").eqNullSafe(F.col("s.host")) & F.col("r.path").eqNullSafe(F.col("s.path"))
        found = rows.alias("r").join(sized(places).alias("s"), at).select("r.*", *(f"s.{p}_{c}" for p in ("host", "path") for c in "nke"))
        own = [F.col(c) for c in "nke"]
        host_shift = _shift("host", host_mass, *own)
        path_shift = _shift("path", path_mass, *own, above=host_shift)
        found = found.withColumns({"host_rate": _rate("host", host_mass, *own), "path_rate": _rate("path", path_mass, *own, above=host_shift)})
        return kept(found.select(
            "doc_id", "text_hash", "host", "path", "log_odds", "host_rate", "path_rate", (1 / (1 + F.exp(-(F.col("log_odds") + path_shift)))).alias("posterior")
        ), narrow=True)


def _rate(level: str, mass: float, n: Column, k: Column, e: Column, above: Column | None = None) -> Column:
    """A site's rate of good documents without one labelled row (n, k, e), drawn towards the expected rate; null where no other row is labelled."""
    rest = F.col(f"{level}_n") - n
    mean = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.try_divide(F.col(f"{level}_e") - e, rest)))
    prior = mean if above is None else 1 / (1 + F.exp(-(_logit(mean) + above)))
    return F.when(rest > 0, _shrunk(rest, F.col(f"{level}_k") - k, prior, mass))


def _shift(level: str, mass: float, n: Column, k: Column, e: Column, above: Column | None = None) -> Column:
    """Log-odds by which a site's rate differs from what its texts let expect; that of the level above where no other row is labelled."""
    mean = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.try_divide(F.col(f"{level}_e") - e, F.col(f"{level}_n") - n)))
    return F.coalesce(_logit(_rate(level, mass, n, k, e, above)) - _logit(mean), F.lit(0.0) if above is None else above)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that the posterior rejects; all columns kept."""
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    key = ["doc_id", "text_hash", "host", "path"]
    gone = sized(cut(judged(docs, labels, host, path).where(F.col("posterior") < THRESHOLD).select(*key).distinct(), narrow=True)).alias("g")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), host.cast("string").alias("host"), path.cast("string").alias("path")).alias("r")
    same = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in key])
    return rows.join(gone, same, "left_anti").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, host, path, text_score, host_rate, path_rate, score (posterior of being good) and predicted for every document."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
    return found.select(
        "doc_id", "host", "path", (1 / (1 + F.exp(-F.col("log_odds")))).alias("text_score"), "host_rate", "path_rate",
        F.col("posterior").alias("score"), (F.col("posterior") >= THRESHOLD).cast("int").alias("predicted"),
    )
