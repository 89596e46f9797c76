import numpy as np

from signalrank.llm import toxicity as t


def scorer(**more):
    return t.Scorer({"idiot": 5.0, "disgusting": 5.0, "scum": 5.0}, {"vexl": 4.0}, {"idiom"}, t.PRIOR, **more)


def test_automaton_against_edit_distance():
    from functools import lru_cache
    import itertools

    @lru_cache(None)
    def distance(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))

    terms = {"abcab": 1.0, "bcaab": 1.0, "aaabbbccc": 1.0, "cabcabcab": 1.0}
    trie = t.Trie(terms)
    words = {"".join(w) for w in itertools.product("abc", repeat=5)} | {"".join(w) for w in itertools.product("abc", repeat=6)}
    words |= {w[:i] + x + w[i + 1 :] for w in ("aaabbbccc", "cabcabcab") for i in range(9) for x in ("", "a", "c", "ab")}
    for word in sorted(words):
        k = trie.edits(word)
        want = min(((distance(word, term), term) for term in terms if distance(word, term) <= min(k, trie.edits(term))), default=None)
        assert trie.near(word) == ((want[1], want[0]) if want else None), word


def test_misspellings_stems_and_quotes():
    s = scorer()
    assert s.hits({"idi0t", "disgustng", "vexling", "idiom", "scun", "plain"}) == {"idi0t": ("idiot", 1), "disgustng": ("disgusting", 1), "vexling": ("vexl", 0)}
    assert s.score("you idiot") >= 0.7 and s.score("you idi0t") > 0.3
    assert s.score('they wrote "idiot" there') < 0.3 and s.score("he said the word idiot") < 0.3
    assert scorer(vague=frozenset({"idiot"})).hits({"idi0t", "idiot"}) == {"idiot": ("idiot", 0)}
    assert s.score(None) == s.score("") == s.score("a clean text") < 0.1


def table(spark, rows):
    return spark.createDataFrame([(i, x, "w") for i, x in rows], "doc_id long, text string, score string")


def test_longest_stems():
    rows = [{"stem": s, "bad": b, "weight": 1.0} for s, b in (("lost", 20), ("lostr", 20), ("lostra", 19), ("lostrax", 4), ("vequ", 30))]
    assert set(t.longest_stems(rows)) == {"lostra", "lostrax", "vequ"}


def test_learns_from_labels(spark):
    rng = np.random.default_rng(1)
    word = lambda: f"{rng.choice(['ab', 'cd', 'ef'])}{'xyzuvw'[rng.integers(6)]}{'klmn'[rng.integers(4)]}"
    rows, labels = [], []
    for i in range(120):
        text = [word() for _ in range(30)]
        if i % 3 == 0:
            for _ in range(3):
                text.insert(int(rng.integers(30)), "blorgh")
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0) if i % 10 else None))
    marks = spark.createDataFrame([*labels, (5, 0), (None, 1)], "doc_id long, toxic int")
    model = t.train(table(spark, rows), marks)
    assert "blorgh" in model.terms
    asked = table(spark, [(1, "ab blorgh cd blorgh"), (2, "abxk cdyl"), (3, None), (4, ""), (None, "BLORGH blorgh blorgh " * 50_000), (1, "blorghh blorrgh")])
    got = [r["score"] for r in t.score(asked, model).collect()]
    assert got[0] >= 0.7 and got[4] >= 0.7 and got[5] > got[1] and max(got[1:4]) < 0.2
    assert t.score(table(spark, []), model).count() == 0


def test_scores_against_brute_force(spark):
    """Every document of a table by the learned lexicon with plain edit distances instead of trie, automaton and memories."""
    import math
    import re

    from signalrank.session import table as read

    sf = "/root/testdata/sf0.01"
    every = read(spark, sf, "documents")
    model = t.train(every, read(spark, sf, "labels").where(~t.held_out()))
    assert model.terms

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    fuzzy = [w for w in model.terms if w not in model.vague and t.Trie.edits(w)]

    def meet(word):
        if word in model.terms:
            return word, 0
        stem = next((word[:n] for n in range(4, 8) if word[:n] in model.stems), None)
        if word in model.clean:
            return None
        if stem is not None:
            return stem, 0
        plain = word if word.isalpha() else word.translate(t.LEET)
        if plain in model.terms and plain not in model.vague:
            return plain, 1
        near = [(d, w) for w in fuzzy if abs(len(w) - len(plain)) <= 2 for d in [distance(plain, w)] if d <= min(t.Trie.edits(plain), t.Trie.edits(w))]
        return (min(near)[1], max(min(near)[0], 1)) if near else None

    memory = {}

    def score(text):
        low = (text or "").lower().replace("@", "a").replace("$", "s")
        words = list(re.finditer(r"[^\W_]+", low))
        counts, most = {}, 0.0
        for i, m in enumerate(words):
            hit = memory[m.group()] = memory[m.group()] if m.group() in memory else meet(m.group())
            if hit is None:
                continue
            first, last = max(0, i - t.WINDOW), min(len(words) - 1, i + t.WINDOW)
            quotes = all(any(q in part for q in t.QUOTES) for part in (low[words[first].start() : m.start()], low[m.end() : words[last].end()]))
            quoted = quotes or any(w.group() in t.REPORTING and w.group() != m.group() for w in words[first : last + 1])
            counts[hit[1] > 0, quoted] = counts.get((hit[1] > 0, quoted), 0) + 1
            if not quoted:
                most = max(most, model.terms.get(hit[0], model.stems.get(hit[0], 0.0)) / (1 + hit[1]))
        n = lambda *k: math.log1p(counts.get(k, 0))
        x = [1.0, float((False, False) in counts), n(False, False), float((True, False) in counts), n(True, False), n(False, True), n(True, True), most]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))

    rows = every.select("doc_id", "text").limit(400).collect()
    got = {r["doc_id"]: r["score"] for r in t.score(every, model).collect()}
    for r in rows:
        assert abs(got[r["doc_id"]] - score(r["text"])) < 1e-9, r["doc_id"]


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.train(table(spark, [(1, "a b c")]), none)
    assert len({r["score"] for r in t.score(table(spark, [(1, "a"), (2, "b")]), model).collect()}) == 1


def test_held_out(spark):
    from signalrank.session import table as read

    sf = "/root/testdata/sf0.01"
    found = t.op1_toxicity(spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out and quality = 1").collect()
    bad = [r for r in found if r["toxic"]]
    assert sum(r["predicted"] for r in bad) >= 0.6 * len(bad) and sum(r["predicted"] for r in found if not r["toxic"]) <= 0.05 * len(found)
