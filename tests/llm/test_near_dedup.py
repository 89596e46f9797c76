import random

import numpy as np

from signalrank import session
from signalrank.llm import near_dedup as n

SCHEMA = "doc_id long, text string, node string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def brute(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    low = list(range(len(rows)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def corpus(seed, families=12, copies=14):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(300)}"
    rows, i = [], 0
    for f in range(families):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 9, 20, 60, 150, 400]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 8])):
                if text:
                    text[rng.randrange(len(text))] = word()
            rows.append((i, " ".join(text).title() if rng.random() < 0.3 else "\n ".join(text)))
            i += 1
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "one two")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.report(docs(spark, rows)).collect()}
        assert got == brute(rows)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_SETS", 7)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.report(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_families_and_rare_pairs_together(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_SETS", 7)
    monkeypatch.setattr(n, "RARE", 3)
    for seed in (1, 4):
        rows = corpus(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.report(docs(spark, rows)).collect()}
        assert got == brute(rows)


def test_a_chain_of_sets_is_no_cluster(spark, monkeypatch):
    """Sets that share with their neighbours only meet those, however long the chain is."""
    joined = []
    real = n.components

    def seen(edges, *rest):
        joined.append(edges.count())
        return real(edges, *rest)

    monkeypatch.setattr(n, "components", seen)
    rows = [(i, " ".join(f"w{k}" for k in range(2 * i, 2 * i + 12))) for i in range(200)]  # 6 of 10 shingles in common
    got = {r["doc_id"]: r["component_id"] for r in n.report(docs(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows}
    assert joined == [0, 0]


def test_nothing_is_broadcast_when_tables_are_large(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    rows = corpus(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.report(docs(spark, rows)).collect()} == brute(rows)


def test_copies_of_one_set(spark):
    rows = [(i, "a b c d e f g") for i in range(9, 0, -1)] + [(20, "z")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in n.report(docs(spark, rows)).collect()}
    assert got == {i: (1, i == 1) for i in range(1, 10)} | {20: (20, True)}


def test_null_and_repeated_ids_and_empty_table(spark):
    got = n.report(docs(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, None)])).collect()
    assert len(got) == 4 and {r["component_id"] for r in got if r["n_shingles"]} == {2}
    assert n.report(docs(spark, [])).count() == 0


def test_keep_one(spark):
    kept = n.keep_one(docs(spark, [(3, "a b c d e f"), (1, "A b c d e f"), (2, None), (5, "q")]))
    assert kept.columns == ["doc_id", "text", "node", "key"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]


def test_keep_one_with_null_and_shared_ids(spark):
    same = "a b c d e f"
    rows = [(1, same), (None, same), (None, "quite another text"), (2, same), (2, "a third text by itself")]
    kept = sorted(((r["doc_id"], r["text"]) for r in n.keep_one(docs(spark, rows)).collect()), key=repr)
    assert kept == sorted([(1, same), (None, "quite another text"), (2, "a third text by itself")], key=repr)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    for share in (0.9, 0.6, 0.2):
        b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 2**63, len(a) - int(share * len(a))).astype(np.uint64) * np.uint64(2)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found, k = n.estimate(n.sketch(a).tobytes(), n.sketch(b).tobytes(), len(a), len(b))
        assert k == n.REGISTERS and abs(found - true) < 0.16


def test_registers_hold_zeros_and_mantissa():
    for value in (1, 3, 0x00FF_FFFF_FFFF_FFFF, 0x01FF_0000_0000_0001):
        got = int(n.sketch(np.array([value], np.uint64))[0])
        bits = f"{(value << 7) & (2**64 - 1):064b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert got >> 10 == min(zeros, 53) or zeros > 52
        if zeros <= 50:
            assert got & 1023 == int(bits[zeros + 1 : zeros + 11].ljust(10, "0"), 2)
