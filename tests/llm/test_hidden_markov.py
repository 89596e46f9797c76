import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from signalrank.llm import hidden_markov as h


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def model():
    m = h.Model(["a", "b", "c"], np.array([5.0, 3.0, 2.0]), np.ones((h.CLASSES, 2)), 20, 10, 4)
    draw = np.random.default_rng(2)
    m.emit = draw.dirichlet(np.ones(m.size), h.STATES)
    m.move = draw.dirichlet(np.ones(h.STATES), h.STATES)
    m.start = draw.dirichlet(np.ones(h.STATES))
    return m


def test_forward_is_the_sum_over_all_paths():
    m = model()
    found = m.forward([np.array(s, np.uint16) for s in ([0, 1, 2], [2], [1, 1])])
    for value, sequence in zip(found, ([0, 1, 2], [2], [1, 1])):
        total = 0.0
        for path in itertools.product(range(h.STATES), repeat=len(sequence)):
            p = m.start[path[0]] * m.emit[path[0], sequence[0]]
            for t in range(1, len(sequence)):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], sequence[t]]
            total += p
        assert abs(value - math.log10(total)) < 1e-9


def test_baum_welch_never_lowers_the_likelihood(monkeypatch):
    monkeypatch.setattr(h, "PSEUDO", 0.0)
    m = model()
    draw = np.random.default_rng(5)
    runs = draw.integers(0, 3, (40, 12))
    runs[:, ::2] = 0
    values = []
    for _ in range(6):
        values.append(m.forward([r.astype(np.uint16) for r in runs]).sum())
        sums = np.zeros(m.sums_size())
        m.expect(runs, np.ones(40, bool), sums)
        assert abs(m._parts(sums)[3].sum() - runs.size) < 1e-6
        start, _, move, emit = m._parts(sums)
        m.start, m.move, m.emit = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:])) and values[-1] > values[0] + 1


def test_contract(spark, monkeypatch):
    monkeypatch.setattr(h, "DICTIONARY", 6)
    monkeypatch.setattr(h, "SYMBOLS", 3)
    monkeypatch.setattr(h, "WARM_ROUNDS", 2)
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 9 + i % 5))) for i in range(1, 30)] + [(100, None), (101, ""), (None, "W1 É unseen"), (5, "ÉÉ w1\x0bw2"), (200, "w1 " * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, word string, score double")
    from pyspark.sql import functions as F

    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    got = sorted(((r["doc_id"] or -1, r["n_tokens"]), r) for r in h.score(docs, training).collect())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learn = [words(t) for i, t in rows if not held(i)]
    counts = Counter(w for t in learn for w in t)
    total, distinct, ends = sum(counts.values()) + len(learn), len(counts) + 1, len(learn)
    want = sorted(((i or -1, len(words(t)) + 1), (i, words(t))) for i, t in rows)
    for (key, r), (other, (i, tokens)) in zip(got, want):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens) + math.log10((ends + 1) / (total + distinct + 1))
        assert key == other and r["held_out"] == held(i) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens) + 1
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and math.isfinite(r["score"]) and r["score"] < 0


def test_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert h.score(docs, F.lit(True)).count() == 0
    one = h.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert one["n_known"] == 0 and one["train_tokens"] == 0 and one["base_score"] == 0.0 and math.isfinite(one["score"])


def test_beats_the_base_on_held_out_texts(spark, sf):
    rows = h.op5_hidden_markov(spark, sf).where("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)


def test_first_rounds_together_learn_from_every_text(spark, monkeypatch):
    monkeypatch.setattr(h, "WARM_TEXTS", 20)
    taken = []

    def sums(rows, model):
        taken.append(sorted(r["doc_id"] for r in rows.collect()))
        return np.ones(model.sums_size())

    monkeypatch.setattr(h, "_train_sums", sums)
    docs = spark.createDataFrame([(k, f"a b{k % 7} c") for k in range(100)], "doc_id long, text string")
    h.score(docs, docs["doc_id"] % 10 != 0)
    learned = [k for k in range(100) if k % 10]
    assert len(taken) == h.WARM_ROUNDS + h.FULL_ROUNDS and taken[-h.FULL_ROUNDS :] == [learned] * h.FULL_ROUNDS
    assert sorted(sum(taken[:4], [])) == learned and all(x != learned for x in taken[:4])


def test_every_round_learns_from_every_text(spark, monkeypatch):
    taken = []

    def sums(rows, model):
        taken.append(rows.agg({"doc_id": "sum"}).first()[0])
        return np.ones(model.sums_size())

    monkeypatch.setattr(h, "_train_sums", sums)
    docs = spark.range(8000).selectExpr("id as doc_id", "'a b c' as text")
    h.score(docs, docs["doc_id"] % 10 != 0)
    assert taken == [sum(k for k in range(8000) if k % 10)] * (h.WARM_ROUNDS + h.FULL_ROUNDS)


def test_expected_counts_of_runs_of_any_length():
    m = model()
    draw = np.random.default_rng(3)
    sizes = np.array(sorted(draw.integers(1, 40, 30), reverse=True))
    runs = np.zeros((30, sizes[0]), np.int64)
    first = draw.random(30) < 0.5
    start, middle, move, emit = m._parts(np.zeros(m.sums_size()))
    for r, n in enumerate(sizes):
        runs[r, :n] = draw.integers(0, m.size, n)
        alpha, beta = [(m.start if first[r] else m.middle) * m.emit[:, runs[r, 0]]], [np.ones(h.STATES)]
        for t in range(1, n):
            alpha.append(alpha[-1] @ m.move * m.emit[:, runs[r, t]])
            beta.insert(0, m.move @ (m.emit[:, runs[r, n - t]] * beta[0]))
        total = alpha[-1].sum()
        for t in range(n):
            emit[:, runs[r, t]] += alpha[t] * beta[t] / total
            if t:
                move += np.outer(alpha[t - 1], m.emit[:, runs[r, t]] * beta[t]) * m.move / total
        (start if first[r] else middle)[:] += alpha[0] * beta[0] / total
    got = np.zeros(m.sums_size())
    m.expect(runs, first, got, sizes)
    assert np.allclose(got, np.concatenate([start, middle, move.ravel(), emit.ravel()]), rtol=1e-9, atol=1e-12)


def test_words_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(h, "COUNTED", 2)
    texts = ["A a b\x0bÉ", None, "", "c\u00a0d b \t a e f", "É é a"]
    got = {r["word"]: r["c"] for r in h.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == Counter(w for t in texts for w in words(t))
