import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalrank.llm import packing as p

SCHEMA = "doc_id long, text string, ids string, part string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def check(rows, got, length=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return sum(length - sum(r["length"] for r in x) for x in by_sequence.values()) / (length * len(by_sequence))


def test_every_id_in_one_piece(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "Ünï", "\n\n", "12", "日本"]) for _ in range(rng.choice([0, 5, 300, 1500, 9000])))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|> in a text"), (1003, "x" * 60_000)]
    got = p.pack(docs(spark, rows).repartition(3), *p.public_files()).collect()
    assert check(rows, got) < 0.03


def test_ranks_give_the_tokenizers_ids():
    path, ranks, pattern = p.public_files()
    fast, slow = p.encoder(path, ranks, pattern), p.encoder(path)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "The ", "'s", " 'll", "é", "ß", "9", "  ", "\t", "\n", " ", "​", "日", "🙂", "<|endoftext|>", "_", "%%", "İ"]) for _ in range(40))
        assert list(fast(text)) == list(slow(text))


def test_ids_of_whole_documents_are_the_tokenizers(spark):
    path, ranks, pattern = p.public_files()
    fast, slow = p.encoder(path, ranks, pattern), p.encoder(path)
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert list(fast(row["text"] or "")) == list(slow(row["text"] or ""))


@pytest.mark.parametrize("blank,n", [(" ", 5_000_000), ("\t", 5_000_000), ("\n", 5_000_000), ("\u3000", 500_000)])
def test_long_white_space(spark, blank, n):
    rows = [(1, blank * n), (2, f"a{blank * 300_000}b")]
    assert check(rows, p.pack(docs(spark, rows), *p.public_files()).collect()) < 1


@pytest.mark.parametrize("most_open", [1, 4])
def test_packer_is_bounded_and_best_fit(most_open):
    packer = p.Packer(0, 16, most_open, 2)
    rng = random.Random(2)
    total = 0
    for k in range(200):
        n = rng.randrange(1, 40)
        total += n
        packer.add(k, np.arange(n, dtype=np.uint32))
        assert len(packer.windows) <= most_open
    done = packer.done + [x for w in packer.windows.values() for x in w]
    assert sum(len(x[2]) for x in done) == total
    first = p.Packer(0, 16, 4, 2)
    for n in (10, 12, 4):
        first.add(n, np.zeros(n, np.uint32))
    assert {x[0] for x in first.done} == {12, 4}  # 4 fits exactly where 12 is


def test_null_and_repeated_ids_and_empty_table(spark):
    got = p.pack(docs(spark, [(None, "a"), (1, "b"), (1, "b")]), *p.public_files()).collect()
    assert len(got) == 3 and sum(r["doc_tokens"] for r in got) == sum(r["length"] for r in got)
    assert p.pack(docs(spark, []), *p.public_files()).count() == 0
