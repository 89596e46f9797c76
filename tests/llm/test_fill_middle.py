import hashlib
import random
import re

import pytest

from signalrank.llm import fill_middle as f
from signalrank.session import table
from tests.oracle import compare

UNITS = {"word": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), "char": re.compile(r"(?s).")}
SCHEMA = "doc_id long, text string, n string, output string, h0 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def plain(doc_id, text, unit="word"):
    """The contract with lists of units."""
    text = text or ""
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS[unit].findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "Wört", " ", "  ", "\t", "\n", "\x0b", "\x1c", " ", "　", "日本", "🙂", "<", "<P", "P>", "<S", "x"]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("unit", ["word", "char"])
def test_cuts_are_those_of_the_list_of_units(unit):
    for text in [*texts(1, 300), "", " ", "a", " a", "a ", "\n\n"]:
        runs, units = f.ClassRuns(text, unit), UNITS[unit].findall(text)
        assert runs.units == len(units)
        for k in range(len(units) + 1):
            assert runs.offset(k) == len("".join(units[:k]))


@pytest.mark.parametrize("unit", ["word", "char"])
def test_whole_rows_and_round_trip(spark, unit):
    rows = list(enumerate(texts(2, 400))) + [(1000, None), (1001, ""), (1002, "a <M> b"), (1003, " "), (None, "no id at all here"), (7, "twice twice"), (7, "twice twice"), (-5, "below nought it is")]
    got = f.transform(docs(spark, rows), unit=unit).withColumn("back", f.restored(f.F.col("output"), f.F.col("form"))).collect()
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=order) == sorted([plain(i, t, unit) for i, t in rows], key=order)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    rows = [(k, t) for k in range(6) for t in ("x" * 3_000_000, " " * 3_000_000, "ab " * 500_000)]
    got = f.transform(docs(spark, rows)).selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(output, 256)").collect()
    want = [(*p[:5], hashlib.sha256(p[5].encode()).hexdigest()) for p in (plain(i, t) for i, t in rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table_and_unknown_unit(spark):
    assert f.transform(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        f.transform(docs(spark, []), unit="line")


def test_sentinels_stay_apart():
    for text in ("a<", "<S", "<P x<M", "><P"):
        for h in ((1, 2, 0, 0), (0, 1, 0, 99), (2, 0, 0, 99)):
            _, form, *_, output = f.rewrite(text, h)
            parts = re.split("<[PSM]>", output)
            assert text == {"plain": lambda: output, "psm": lambda: parts[1] + parts[3] + parts[2], "spm": lambda: parts[2] + parts[3] + parts[1]}[form]()


def test_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = f.op13_fill_middle(spark, sf)
    compare(got, f.SQL, sf)
    want = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert {(r["doc_id"], r["restored_sha256"]) for r in got.select("doc_id", "restored_sha256").collect()} == want
