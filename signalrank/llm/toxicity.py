"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon holds words, and stems that begin several such words, whose contexts (the words before and after) are mostly
in toxic training documents; contexts rather than documents are counted, so that many copies of one document count
once. A text's distinct words are run
through the trie with a Levenshtein automaton (one edit from five letters on, two from nine), so misspelt terms are
found too; words that clean training documents use more than toxic ones are no misspellings, and terms whose misspelt
hits are often in clean documents are only met exactly. Each hit has a window of words: quotation marks
or reporting words in it make it a quoted hit. A logistic model over the counts of hits gives the score.

Null and empty texts, and texts without a hit, get the score of no hits. Without toxic training rows the lexicon is
empty and all scores are equal. Labels that repeat a doc_id count as toxic if one of them is. Texts of any length are
read whole. doc_id may be null or repeated; an empty table gives no rows. Other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import cut, small_batches, table

#: Labelled rows to learn from at most, chosen by hash. They bound the lexicon and all that is collected with it.
TRAIN_ROWS = 20_000
LEAST_CONTEXTS, LEAST_PRECISION, LEAST_LETTERS = 4, 0.8, 3
#: Letters of a stem, contexts and different words that it needs, and the least share of them in toxic documents.
STEM_LETTERS, STEM_CONTEXTS, STEM_WORDS, STEM_PRECISION = (4, 7), 12, 4, 0.97
#: A term is only met exactly if less than this share of its misspelt hits is in toxic documents, where VAGUE_PRIOR such hits are taken for granted.
LEAST_CLEAR, VAGUE_PRIOR = 0.8, 8
#: Words on either side of a hit that are looked at.
WINDOW = 5
THRESHOLD = 0.7
WORD_MEMO = 200_000
WORDS = re.compile(r"[^\W_]+")
# Quotation marks, words that report what others say, and characters written for letters.
QUOTES = "\"“”„«»‹›"
REPORTING = {
    "said", "says", "quote", "quoted", "quotes", "called", "word", "words", "term", "slur", "insult", "insults", "wrote", "writes",
    "sagte", "sagt", "zitat", "wort", "nannte", "dit", "mot", "citation", "traité", "dijo", "palabra", "cita", "llamó",
}
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"})


def letters_of(word: str) -> int:
    """Bit set of a word's letters, folded to 64 bits: one edit changes two of them at most."""
    bits = 0
    for char in word:
        bits |= 1 << (ord(char) & 63)
    return bits


class Trie:
    """Terms as a trie of dicts, walked with the states of a word's Levenshtein automaton.

    A state is, for each number of edits, the bit set of the word's prefixes that the path may spell with so many edits;
    a path is given up once no prefix is left. Words that share neither end nor middle with a term need no walk.
    """

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        self.terms = terms
        self.heads: dict[int, dict[str, list]] = {}
        self.tails: dict[int, dict[str, list]] = {}
        self.middles: dict[str, list] = {}
        self.sizes: set[int] = set()
        for term in sorted(terms):
            node = self.root
            for char in term:
                node = node.setdefault(char, {})
            node[""] = term
            k = self.edits(term)
            if k:
                size, entry = len(term) // (k + 1), (len(term), letters_of(term))
                self.heads.setdefault(size, {}).setdefault(term[:size], []).append(entry)
                self.tails.setdefault(size, {}).setdefault(term[-size:], []).append(entry)
                self.sizes |= set(range(len(term) - k, len(term) + k + 1))
                if k == 2:
                    for i in range(size, len(term) - size - 2):
                        self.middles.setdefault(term[i : i + 3], []).append(entry)

    @staticmethod
    def edits(word: str) -> int:
        return 2 if len(word) >= 9 else 1 if len(word) >= 5 else 0

    def may_be_near(self, word: str, k: int) -> bool:
        """With one edit the first or the last half of a term is whole in the word, with two one third of it; and few letters differ."""
        found: list = []
        for size, heads in self.heads.items():
            if (entries := heads.get(word[:size])) is not None:
                found += entries
            if (entries := self.tails[size].get(word[-size:])) is not None:
                found += entries
        if self.middles and len(word) >= 7:
            for i in range(1, len(word) - 3):
                if (entries := self.middles.get(word[i : i + 3])) is not None:
                    found += entries
        if not found:
            return False
        letters, n = letters_of(word), len(word)
        return any(abs(n - size) <= k and (bits ^ letters).bit_count() <= 2 * k for size, bits in found)

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term within the word's edits and their number; the first by name on ties."""
        if word in self.terms:
            return word, 0
        k = self.edits(word)
        if not k or len(word) not in self.sizes or not self.may_be_near(word, k):
            return None
        whole, end = (1 << (len(word) + 1)) - 1, 1 << len(word)
        places: dict[str, int] = {}
        for i, char in enumerate(word, 1):
            places[char] = places.get(char, 0) | 1 << i
        found: list[tuple[int, str]] = []
        todo = [(self.root, tuple((1 << (d + 1)) - 1 for d in range(k + 1)))]
        while todo:
            node, state = todo.pop()
            for char, child in node.items():
                if char == "":
                    for d in range(min(k, self.edits(child)) + 1):
                        if state[d] & end:
                            found.append((d, child))
                            break
                    continue
                here = places.get(char, 0)
                last = (state[0] << 1) & here
                new = [last]
                for d in range(1, k + 1):
                    last = (((state[d] << 1) & here) | state[d - 1] | (state[d - 1] << 1) | (last << 1)) & whole
                    new.append(last)
                if last:
                    todo.append((child, tuple(new)))
        return (min(found)[1], min(found)[0]) if found else None


class Scorer:
    """Counts hits of a text; with weights, scores it."""

    FEATURES = 8

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: set[str], weights: np.ndarray | None = None, vague: frozenset[str] = frozenset()):
        self.terms, self.stems, self.clean, self.weights, self.vague = terms, stems, clean, weights, vague
        self._ready()

    def _ready(self) -> None:
        self.trie = Trie({t: w for t, w in self.terms.items() if t not in self.vague})
        self.heads = {s[: STEM_LETTERS[0]] for s in self.stems}
        self.known: dict[str, tuple[str, int]] = {}
        self.harmless: set[str] = set()

    def __getstate__(self):
        return self.terms, self.stems, self.clean, self.weights, self.vague

    def __setstate__(self, state):
        self.terms, self.stems, self.clean, self.weights, self.vague = state
        self._ready()

    def _meet(self, word: str) -> tuple[str, int] | None:
        if word in self.terms:
            return word, 0
        if word[: STEM_LETTERS[0]] in self.heads:
            for n in range(STEM_LETTERS[0], STEM_LETTERS[1] + 1):
                if word[:n] in self.stems and word not in self.clean:
                    return word[:n], 0
        plain = word if word.isalpha() else word.translate(LEET)
        found = self.trie.near(plain)
        if found is None or word in self.clean:
            return None
        return found if plain == word else (found[0], max(1, found[1]))

    def hits(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """Word -> (term, edits) for the words that meet the lexicon. Words are judged once while they are remembered."""
        found = {}
        for word in words - self.harmless:
            hit = self.known.get(word) or self._meet(word)
            if hit is None:
                self.harmless.add(word)
            else:
                found[word] = self.known[word] = hit
        if len(self.harmless) + len(self.known) > WORD_MEMO:
            self.harmless.clear()
            self.known.clear()
        return found

    @staticmethod
    def words(text: str | None) -> tuple[str, list[str]]:
        low = (text or "").lower().replace("@", "a").replace("$", "s")
        return low, WORDS.findall(low)

    def features(self, text: str | None) -> list[float]:
        """Hits by kind (exact, misspelt) and place (open, quoted), as whether and how many, and by their weights."""
        low, words = self.words(text)
        hits = self.hits(set(words))
        counts, most = [0, 0, 0, 0], 0.0
        if hits:
            places = [(m.start(), m.end(), m.group()) for m in WORDS.finditer(low)]
            for i, (_, _, word) in enumerate(places):
                if word not in hits:
                    continue
                term, edits = hits[word]
                first, last = max(0, i - WINDOW), min(len(places) - 1, i + WINDOW)
                before, after = low[places[first][0] : places[i][0]], low[places[i][1] : places[last][1]]
                quoted = (any(q in before for q in QUOTES) and any(q in after for q in QUOTES)) or any(p[2] in REPORTING for p in places[first : last + 1] if p[2] != word)
                counts[(edits > 0) + 2 * quoted] += 1
                if not quoted:
                    most = max(most, self.terms.get(term, self.stems.get(term, 0.0)) / (1 + edits))
        exact, misspelt, exact_quoted, misspelt_quoted = counts
        return [1.0, float(exact > 0), np.log1p(exact), float(misspelt > 0), np.log1p(misspelt), np.log1p(exact_quoted), np.log1p(misspelt_quoted), most]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights), -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, penalty: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights by Newton steps, drawn towards `prior`; all but the first stay at 0 or above, since a hit is no sign of a clean text."""
    w = prior.astype(float).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * (w - prior)
        free = (w > 0) | (slope < 0)
        free[0] = True
        bend = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + penalty * np.eye(int(free.sum()))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(bend, slope[free])
        size = np.abs(step).max()
        new = w - step * min(1.0, 1.0 / size if size else 1.0)
        new[1:] = np.maximum(new[1:], 0)
        done, w = np.abs(new - w).max() < 1e-6, new
        if done:
            break
    return w


#: What the model holds before it sees rows: no hit is clean, an open hit is abuse, a quoted one is not, a misspelt one is likely abuse.
PRIOR = np.array([-4.0, 4.0, 1.5, 3.5, 1.5, 0.0, 0.0, 0.3])


def training_rows(docs: DataFrame, labels: DataFrame, most: int, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most `most` labelled ids, chosen by hash; the chosen labels are bounded by that number and broadcast. Of an id's rows one is taken, by hash."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    found = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id")
    return found.groupBy("label_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("text", "label")


def longest_stems(rows: list) -> dict[str, float]:
    """Weights of stems (stem, bad, weight) without those that a longer one stands for, as it has nearly all of their contexts."""
    counts = {r["stem"]: r["bad"] for r in rows}
    spoken = {s[:n] for s, bad in counts.items() for n in range(STEM_LETTERS[0], len(s)) if bad >= 0.9 * counts.get(s[:n], bad + bad)}
    return {r["stem"]: r["weight"] for r in rows if r["stem"] not in spoken}


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Scorer:
    """docs (doc_id, text), labels (doc_id, toxic): rows to learn from."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, most, "toxic")
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    near = rows.select("label", words.alias("w")).where(F.size("w") > 0).select("label", "w", F.posexplode("w").alias("i", "word"))
    contexts = near.select("label", "word", F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1)).alias("context")).distinct()
    counts = cut(contexts.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") != 1).alias("good")))
    listed = (
        counts.where((F.col("bad") >= LEAST_CONTEXTS) & (F.col("bad") >= LEAST_PRECISION * (F.col("bad") + F.col("good"))) & F.length("word").between(LEAST_LETTERS, 40))
        .select("word", F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)).alias("weight"))
    )
    terms = {r["word"]: r["weight"] for r in listed.collect()}
    first, last = STEM_LETTERS
    stems = (
        counts.where(F.length("word") > first).select(F.explode(F.expr(f"transform(sequence({first}, least({last}, length(word) - 1)), n -> left(word, n))")).alias("stem"), "bad", "good")
        .groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > F.col("good")).alias("words"))
        .where((F.col("bad") >= STEM_CONTEXTS) & (F.col("words") >= STEM_WORDS) & (F.col("bad") >= STEM_PRECISION * (F.col("bad") + F.col("good"))))
        .select("stem", "bad", F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)).alias("weight"))
    )
    first_scorer = Scorer(terms, longest_stems(stems.collect()), set())

    def harmful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column("word").to_pylist() if w not in terms and first_scorer.hits({w})], pa.string())], ["word"])

    # Words of clean documents matter only where they would be taken for a term.
    clean = counts.where((F.col("good") >= 2) & (F.col("good") > F.col("bad")) & F.length("word").between(5, 40)).select("word").mapInArrow(harmful, "word string")
    scorer = Scorer(terms, first_scorer.stems, {r["word"] for r in clean.collect()})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [(h[0], label) for t, label in zip(batch.column("text"), batch.column("label").to_pylist()) for h in scorer.hits(set(scorer.words(t.as_py())[1])).values() if h[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in near], pa.string()), pa.array([int(x[1] == 1) for x in near], pa.int32())], ["term", "toxic"])

    near = rows.select("text", "label").mapInArrow(met, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    vague = near.where(F.col("bad") + VAGUE_PRIOR < LEAST_CLEAR * (F.col("n") + VAGUE_PRIOR)).select("term")
    scorer = Scorer(scorer.terms, scorer.stems, scorer.clean, None, frozenset(r["term"] for r in vague.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [scorer.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label")], ["x", "y"])

    grouped = rows.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()
    x, y, n = np.array([r["x"] for r in grouped]).reshape(-1, Scorer.FEATURES), np.array([float(r["y"] == 1) for r in grouped]), np.array([r["count"] for r in grouped], int)
    scorer.weights = fit_logistic(np.repeat(x, n, 0), np.repeat(y, n), PRIOR) if len(x) else PRIOR
    return scorer


def score(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    held = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([held.value.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels").where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
