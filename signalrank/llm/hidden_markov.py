"""Hidden Markov language model over words: Baum-Welch counts summed across partitions, exact scores by scaled forward recursion.

Tokens are words, A-Z lower-cased, and one end for each text. A text becomes a sequence of symbols: each of the SYMBOLS
most frequent training words, the end, or one of CLASSES classes of the other words by their last letters. The model
gives a symbol sequence its probability under STATES latent states; a word of a class then has the share (c + 1) /
(N + V + 1) of its class, with c, N and V counted over all training texts, and unseen words share one such part. So the
score counts exact word frequencies of the whole corpus, however many words it has.

Word counts stay distributed. The DICTIONARY most frequent words of at most 64 bytes, a bounded number, are known to
every task; all others meet their counts in a join. Expectations are taken over texts cut into runs of RUN tokens; each
partition adds up its counts, Spark sums those of all partitions. All of the WARM_ROUNDS and FULL_ROUNDS rounds take all
training texts.

Null and empty texts are the end alone. A null doc_id is never held out. doc_id may be null or repeated; each row has
its score. Without any training text all probabilities are those of the add-one rule on nothing, and finite. Texts of any
length are scored whole. An empty table gives no rows. Only id and text are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import cut, small_batches, table

STATES, SYMBOLS, CLASSES, DICTIONARY = 8, 8192, 64, 200_000
WARM_ROUNDS, FULL_ROUNDS, RUN = 12, 2, 128
#: None: the first rounds take all training texts, as the last do. A user with little time may set how many texts a share of them has at least.
WARM_TEXTS: int | None = None
#: Runs that are counted at once, and tokens after which their probabilities are scaled, far before they leave the range of doubles.
RUNS_AT_ONCE, SCALED = 1024, 8
#: Different words that a task counts before it hands their counts on.
COUNTED = 500_000
#: Expected symbols added to each state in proportion to the corpus, so that no symbol is impossible.
PSEUDO = 50.0
LONGEST_KEY = 64
RARE = pa.map_(pa.string(), pa.int64())
#: Bytes of symbols that the forward recursion takes at once, beyond one batch.
FORWARD_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % CLASSES


def class_column(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2))) % CLASSES).cast("int")


class Model:
    """What every task needs: the dictionary with counts, the class totals and the HMM."""

    def __init__(self, words: list[str], counts: np.ndarray, classes: np.ndarray, total: int, distinct: int, ends: int):
        """classes: (CLASSES, 2) training tokens and distinct words of the classes."""
        self.rank = {w.encode(): k for k, w in enumerate(words)}
        self.logs = np.log10(counts + 1.0)
        self.total, self.distinct, self.ends = total, distinct, ends
        self.first_class = min(SYMBOLS, len(words))
        self.end = self.first_class + CLASSES
        self.size = self.end + 1
        later = [self.first_class + word_class(w) for w in words[self.first_class :]]
        self.symbol = np.concatenate([np.arange(self.first_class), np.array(later, np.int64)]).astype(np.uint16)
        self.class_logs = np.log10(classes.sum(1) + 1.0)
        self.corpus = np.concatenate([counts[: self.first_class], classes[:, 0], [ends]]).astype(float)
        share = (self.corpus + 1) / (self.corpus.sum() + self.size)
        draw = np.random.default_rng(7)
        self.start = np.full(STATES, 1 / STATES)
        self.middle = self.start.copy()
        self.move = 0.8 * np.eye(STATES) + 0.2 / STATES
        emit = share * np.exp(draw.normal(0, 0.5, (STATES, self.size)))
        self.emit = emit / emit.sum(1, keepdims=True)
        self.share = share

    def updated(self, sums: np.ndarray) -> None:
        """Takes the expected counts of `expect` as the new parameters."""
        start, middle, move, emit = self._parts(sums)
        unit = lambda x: x / x.sum(-1, keepdims=True)
        self.start, self.middle = unit(start + 0.1), unit(middle + 0.1)
        self.move = unit(move + 0.1)
        self.emit = unit(emit + PSEUDO * self.share)

    def _parts(self, flat: np.ndarray):
        a, b, c = STATES, 2 * STATES, 2 * STATES + STATES * STATES
        return flat[:a], flat[a:b], flat[b:c].reshape(STATES, STATES), flat[c:].reshape(STATES, self.size)

    def sums_size(self) -> int:
        return 2 * STATES + STATES * STATES + STATES * self.size

    def encode(self, text: str | None) -> tuple[np.ndarray, int, float, float, list[str]]:
        """Symbols; then of the dictionary words in the text: their number, the sum of log10(c + 1), the part of it from class words; and all other words."""
        words = words_of(text)
        ranks = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))
        known = ranks >= 0
        symbols = np.empty(len(words) + 1, np.uint16)
        symbols[-1] = self.end
        symbols[:-1][known] = self.symbol[ranks[known]]
        rare = []
        for k in np.nonzero(~known)[0]:
            word = words[k].decode("utf-8", "surrogatepass")
            rare.append(word)
            symbols[k] = self.first_class + word_class(word)
        logs = self.logs[ranks[known]]
        return symbols, int(known.sum()), float(logs.sum()), float(logs[ranks[known] >= self.first_class].sum()), rare

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each symbol sequence, by the scaled forward recursion over all sequences at once."""
        sizes = np.array([len(s) for s in sequences])
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([sequences[k] for k in order]).astype(np.int64)
        sorted_sizes = sizes[order]
        at = np.concatenate([[0], np.cumsum(sorted_sizes)[:-1]])
        logs = np.zeros(len(sequences))
        lives = np.searchsorted(-sorted_sizes, -np.arange(sorted_sizes[0] + 1), "left")
        onward = np.ascontiguousarray(self.move.T)
        for t in range(int(sorted_sizes[0])):
            k, stay = lives[t], lives[t + 1]
            now = onward @ alpha[:, :k] if t else self.start[:, None]
            alpha = np.take(self.emit, flat[at[:k] + t], axis=1) * now
            scaled = stay if (t + 1) % SCALED else 0
            if scaled < k:
                scale = alpha[:, scaled:].sum(0)
                logs[scaled:k] += np.log10(scale)
                alpha[:, scaled:] /= scale
        found = np.empty(len(sequences))
        found[order] = logs
        return found

    def expect(self, runs: np.ndarray, first: np.ndarray, sums: np.ndarray, sizes: np.ndarray | None = None) -> None:
        """Adds the expected counts of runs (run, token); `first` marks runs that begin a text. sizes: tokens of each run, the longest first, where they are not of equal length."""
        n, length = runs.shape
        live = np.append(np.full(length, n) if sizes is None else np.searchsorted(-sizes, -np.arange(length), "left"), 0)
        start, middle, move, emit_sums = self._parts(sums)
        symbols = np.ascontiguousarray(runs.T)
        if getattr(self, "room", np.empty((0, 0))).shape[1] != length * STATES * n:
            self.room = np.empty((2, length * STATES * n))
        seen, gamma = self.room.reshape(2, length, STATES, n)
        for s in range(STATES):
            seen[:, s] = self.emit[s][symbols]
        onward = np.ascontiguousarray(self.move.T)
        for t in range(length):
            k, stay = live[t], live[t + 1]
            now = onward @ gamma[t - 1, :, :k] if t else np.where(first, self.start[:, None], self.middle[:, None])
            np.multiply(now, seen[t, :, :k], out=gamma[t, :, :k])
            gamma[t, :, k:] = 0
            # Runs are scaled where they end, so that the products of both directions add up to one.
            at = stay if (t + 1) % SCALED else 0
            if at < k:
                by = 1 / gamma[t, :, at:k].sum(0)
                gamma[t, :, at:k] *= by
                seen[t, :, at:k] *= by
        beta = np.ones((STATES, n))
        moved = np.zeros((STATES, STATES))
        for t in range(length - 2, -1, -1):
            k = live[t + 1]
            ahead = seen[t + 1, :, :k]
            ahead *= beta[:, :k]
            moved += gamma[t, :, :k] @ ahead.T
            beta[:, :k] = self.move @ ahead
            gamma[t, :, :k] *= beta[:, :k]
        move += moved * self.move
        start += gamma[0][:, first].sum(1)
        middle += gamma[0][:, ~first].sum(1)
        for s in range(STATES):
            emit_sums[s] += np.bincount(symbols.ravel(), gamma[:, s].ravel(), self.size)


def _train_sums(rows: DataFrame, model: Model) -> np.ndarray:
    """Expected counts over all texts of rows (symbols), added up within partitions, then by Spark."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sums = np.zeros(model.sums_size())
        parts: list[np.ndarray] = []
        first: list[bool] = []

        def add() -> None:
            sizes = np.array([len(p) for p in parts])
            order = np.argsort(-sizes, kind="stable")
            sizes = sizes[order]
            runs = np.zeros((len(parts), sizes[0]), np.int64)
            runs[np.arange(sizes[0]) < sizes[:, None]] = np.concatenate([parts[k] for k in order])
            model.expect(runs, np.array(first)[order], sums, sizes)
            parts.clear()
            first.clear()

        for batch in batches:
            for value in batch.column("symbols"):
                symbols = np.frombuffer(value.as_py(), np.uint16)
                for at in range(0, len(symbols), RUN):
                    parts.append(symbols[at : at + RUN])
                    first.append(at == 0)
                    if len(parts) == RUNS_AT_ONCE:
                        add()
        if parts:
            add()
        place = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[place])], ["place", "value"])

    total = np.zeros(model.sums_size())
    # One row for each parameter of the model at most, whatever the input.
    for row in rows.select("symbols").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        total[row[0]] = row[1]
    return total


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts, ends not among them. Tasks count COUNTED different words at a time, Spark adds their counts up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            words, counts = pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())
            found.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words[at : at + 50_000], counts[at : at + 50_000]], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                if len(found) > COUNTED:
                    yield from counted()
        yield from counted()

    return docs.select(text_col).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame) -> list:
    """Rows of the most frequent words, at most DICTIONARY, in order. How many words have each count tells where to cut, so no task sends more than what is kept."""
    short = counts.where(F.octet_length("word") <= LONGEST_KEY)
    sizes = short.groupBy("c").agg(F.count(F.lit(1)).alias("words"))
    kept, least = 0, None
    for row in sizes.orderBy(F.desc("c")).limit(DICTIONARY).collect():
        kept += row["words"]
        if kept > DICTIONARY:
            break
        least = row["c"]
    return [] if least is None else sorted(short.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], r["word"]))


def _share(learned: DataFrame, texts: int, k: int) -> DataFrame:
    """The rows of `learned` (row, ...), of so many texts, that warm round k learns from: all, or where WARM_TEXTS is set a share, of which the rounds together take all."""
    if WARM_TEXTS is None:
        return learned
    shares = min(WARM_ROUNDS, max(1, texts // WARM_TEXTS))
    return learned.where(F.pmod(F.xxhash64("row"), F.lit(shares)) == k % shares)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. training: which rows to learn from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), training.alias("training"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    learn = rows.where("training")
    counts = cut(word_counts(learn))
    ends = learn.count()
    top = _frequent(counts)
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    by_class = {r[0]: (r[1], r[2]) for r in counts.groupBy(class_column(F.col("word"))).agg(F.sum("c"), F.count(F.lit(1))).collect()}
    classes = np.array([by_class.get(k, (0, 0)) for k in range(CLASSES)], float)
    for r in top[:SYMBOLS]:
        classes[word_class(r["word"])] -= (r["c"], 1)
    model = Model([r["word"] for r in top], np.array([r["c"] for r in top], float), classes, totals[0] + ends, totals[1] + (ends > 0), ends)
    del top
    held = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [model.encode(t.as_py()) for t in batch.column("text")]
            symbols, known, logs, class_logs, rare = zip(*found) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + len(found)), pa.int64()), batch.column("doc_id"), batch.column("training"), pa.array([x.tobytes() for x in symbols], pa.binary()),
                    pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(class_logs, pa.float64()), pa.array([list(Counter(x).items()) for x in rare], RARE),
                ],
                ["row", "doc_id", "training", "symbols", "known", "logs", "class_logs", "rare"],
            )
            number += len(found)

    coded = cut(rows.mapInArrow(encode, "row long, doc_id long, training boolean, symbols binary, known long, logs double, class_logs double, rare map<string, long>"))
    learned = coded.where("training")
    if ends:
        for k in range(WARM_ROUNDS + FULL_ROUNDS):
            model.updated(_train_sums(_share(learned, ends, k) if k < WARM_ROUNDS else learned, model))
    trained = docs.sparkSession.sparkContext.broadcast(model)

    def scored_batch(model: Model, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sequences = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("symbols")]
        logs = model.forward(sequences)
        shares = [model.class_logs[s[(s >= model.first_class) & (s < model.end)].astype(np.int64) - model.first_class].sum() for s in sequences]
        columns = [batch.column(c) for c in ("row", "doc_id", "training")] + [pa.array([len(s) for s in sequences], pa.int64()), batch.column("known"), batch.column("logs")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(logs - np.array(shares) + batch.column("class_logs").to_numpy())], ["row", "doc_id", "training", "n_tokens", "known", "logs", "partial"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The recursion steps through all texts at once, so several batches together take no more steps than the longest of their texts.
        model, waiting, size = trained.value, [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.column("symbols").nbytes
            if size > FORWARD_BYTES:
                yield scored_batch(model, waiting)
                waiting, size = [], 0
        if waiting:
            yield scored_batch(model, waiting)

    scored = coded.drop("rare").mapInArrow(forward, "row long, doc_id long, training boolean, n_tokens long, known long, logs double, partial double")
    rare = coded.select("row", F.explode("rare").alias("word", "times"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    nothing = F.log10(F.lit(float(model.total + model.distinct + 1)))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    end_log = F.log10(F.lit(float(ends + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs + end_log - F.col("n_tokens") * nothing).alias("base_score"),
        (F.col("partial") + rare_logs).alias("score"),
    )


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    return score(table(spark, sf_dir, "documents"), training)
