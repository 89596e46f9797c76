"""Language identification by language-bitmask n-gram filters.

Letter trigrams are counted per language over a bounded, hash-chosen sample of labelled documents. A trigram belongs to
every language in which it is at least 1 / SPREAD as frequent as where it is most frequent. One bit-sliced Bloom filter
holds all languages: each slot is a row of language bits, and the AND of a trigram's slots gives all languages that
contain it. A text's bits are counted per language and corrected for each language's false-positive rate; the largest
corrected share decides, ties go to the first name.

A text that is null or has no letter is `und` with score 0. A text of letters that no language knows gets the most
frequent learned language with score 0. Without any labelled document every text is `und`. Texts of any length are read
whole, in slices. doc_id may be null or repeated; an empty table gives no rows. Other columns, whatever their names, do
no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import small_batches, table

#: Documents of each language to learn from, in expectation: they are chosen by hash, and bound the trigrams that are collected.
TRAIN_DOCS = 3000
LEAST_COUNT, SPREAD = 3, 4.0
#: The filter has 2**k slots, at least twice as many as it has entries for each language, within these bounds on k.
LEAST_BITS, MOST_BITS, HASHES = 16, 22, 3
SLICE = 400_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case code point for letters, else 0."""
    if not _LETTERS:
        known = np.zeros(0x110000, np.uint32)
        for code in range(0x33480):  # letters end here
            char = chr(code)
            if char.isalpha():
                known[code] = ord(char.lower()[0])
        _LETTERS.append(known)
    return _LETTERS[0]


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def trigrams(text: str) -> np.ndarray:
    """Hashes of the trigrams around each letter; anything else than a letter is one and the same mark."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[codes].astype(np.uint64)
    here = np.nonzero(letters[1:-1])[0] + 1
    return _hash((letters[here - 1] << np.uint64(42)) | (letters[here] << np.uint64(21)) | letters[here + 1])


def _slices(text: str) -> Iterator[str]:
    for at in range(0, len(text), SLICE):
        yield text[at : at + SLICE]


class Filter:
    """The bit-sliced Bloom filter: `slots` has a row of 64-bit words of language bits for each slot."""

    def __init__(self, languages: list[str], grams: np.ndarray, masks: np.ndarray):
        """masks: (gram, word) language bits."""
        self.languages = languages
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(2 * HASHES * len(grams)).bit_length()))
        self.slots = np.zeros((1 << self.bits, max(1, masks.shape[1])), np.uint64)
        for at in self._places(grams):
            for w in range(masks.shape[1]):
                np.bitwise_or.at(self.slots[:, w], at, masks[:, w])
        full = np.array([((self.slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        self.false = full**HASHES

    def _places(self, grams: np.ndarray) -> list[np.ndarray]:
        again = _hash(grams + np.uint64(0x2545F4914F6CDD1D))
        return [((x >> np.uint64(s)) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for x, s in ((grams, 0), (grams, 42), (again, 21))][:HASHES]

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of `grams` each language contains, false positives included."""
        a, *rest = self._places(grams)
        bits = self.slots[a]
        for at in rest:
            bits &= self.slots[at]
        return np.array([np.count_nonzero(bits[:, k // 64] & np.uint64(1 << (k % 64))) for k in range(len(self.languages))], float)

    def judge(self, text: str | None) -> tuple[str, float]:
        found, n = np.zeros(len(self.languages)), 0
        for part in _slices(text or ""):
            grams = trigrams(part)
            n += len(grams)
            if len(grams) and self.languages:
                found += self.counts(grams)
        if not n or not self.languages:
            return "und", 0.0
        share = np.clip((found / n - self.false) / (1 - self.false), 0, None)
        if not share.any():
            return self.languages[0], 0.0
        order = sorted(range(len(share)), key=lambda k: (-share[k], self.languages[k]))
        best = share[order[0]]
        return self.languages[order[0]], float(best / share.sum())


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Filter:
    """docs: rows to learn from; those without a language are left out. Languages stand in order of their documents, most first."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filter([], np.empty(0, np.uint64), np.empty((0, 1), np.uint64))
    limit = F.coalesce(*[F.when(F.col("lang") == x, F.lit((2**63 - 1) * min(train_docs, n) // n)) for x, n in sizes.items()])
    place = {x: k for k, x in enumerate(languages)}
    chosen = rows.where(F.col("draw").bitwiseAND(F.lit(2**63 - 1)) <= limit).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            for k, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for part in _slices(text.as_py() or ""):
                    grams = trigrams(part)
                    if len(grams):
                        held.setdefault(place[lang], []).append(grams)
                        size += len(grams)
                if size > 2_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = chosen.mapInArrow(run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = dict(counts.groupBy("lang").agg(F.sum("n")).collect())
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.col("n") / F.lit(float(t))) for k, t in totals.items()], F.lit(0.0))
    kept = (
        counts.groupBy("gram").agg(F.sum("n").alias("n"), F.collect_list(F.struct(rate.alias("p"), "lang")).alias("each"), F.max(rate).alias("top"))
        .where(F.col("n") >= LEAST_COUNT)
        .select("gram", F.expr(f"transform(filter(each, x -> x.p * {SPREAD} >= top), x -> x.lang)").alias("langs"))
    )
    found = kept.collect()
    masks = np.zeros((len(found), (len(languages) + 63) // 64), np.uint64)
    for k, row in enumerate(found):
        for lang in row["langs"]:
            masks[k, lang // 64] |= np.uint64(1 << (lang % 64))
    return Filter(languages, np.array([r["gram"] for r in found], np.int64).view(np.uint64), masks)


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    held = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.judge(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
