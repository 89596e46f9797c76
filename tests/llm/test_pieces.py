import hashlib
import random

import pytest
import sentencepiece

from signalrank.llm import pieces as p

SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=p.public_model())


@pytest.fixture(scope="module")
def vocabulary():
    return p.Vocabulary(p.public_model())


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return p.Encoder(vocabulary)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def same(encoder, library, text):
    assert list(encoder.encode(text)) == library.encode(text), repr(text)


PARTS = [" ", "  ", "   ", "a", "b", "e", "t", "th", "er", "ing", "▁", "\n", "\t", "é", "日", "本", "ข", "🙂", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "A", "9", "0", "-", "ß", "ﬁ", "́", " ", "�"]


def test_ids_of_random_strings_are_the_librarys(encoder, library):
    rng = random.Random(1)
    for _ in range(4000):
        same(encoder, library, "".join(rng.choice(PARTS) for _ in range(rng.randrange(40))))


def test_ids_of_joined_pieces_are_the_librarys(vocabulary, encoder, library):
    rng, every = random.Random(2), list(vocabulary.pieces.values())
    for _ in range(8000):
        same(encoder, library, "".join(rng.choice(every) for _ in range(rng.randrange(10))).replace("▁", " " if rng.random() < 0.5 else ""))


def test_every_piece_and_runs(vocabulary, encoder, library):
    for piece in vocabulary.pieces.values():
        same(encoder, library, piece)
    for n in range(70):
        for text in (" " * n, f"a{' ' * n}b", "x" * n, "=" * n, "ab" * n, "0" * n, "日" * n, "\n" * n, "ab" + "é" * n):
            same(encoder, library, text)


def test_steps_back_and_marks_places(vocabulary, library):
    """Texts without spaces, on which longest pieces often fail; each place is left at most once."""
    encoder, rng = p.Encoder(vocabulary), random.Random(3)
    tried = []
    encoder.shorter = Counting(encoder.shorter, tried)
    for n in (50, 3000):
        text = "".join(rng.choice("abcdeinorst") for _ in range(n))
        tried.clear()
        same(encoder, library, text)
        assert len(tried) <= 16 * n


class Counting(list):
    def __init__(self, rows, tried):
        super().__init__(rows)
        self.tried = tried

    def __getitem__(self, key):
        self.tried.append(key)
        return super().__getitem__(key)


def test_tables_of_seen_parts_are_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(p, "PARTS", 20)
    monkeypatch.setattr(p, "PAIRS", 10)
    encoder, rng = p.Encoder(vocabulary), random.Random(4)
    for _ in range(200):
        same(encoder, library, " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 50))) for _ in range(9)))
        assert len(encoder) <= 20 and len(encoder.older) <= 20 and len(encoder.pairs) <= 10
        assert all(len(part) <= p.PART_CHARS for part in encoder)


def test_decoded_as_the_library_does(vocabulary, library):
    decoder, rng = p.Decoder(vocabulary), random.Random(5)
    for _ in range(6000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randrange(12))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_ids_of_whole_documents_are_the_librarys(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for doc_id, text in texts.items():
        ids = library.encode(text, add_eos=True)
        want[doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    got = p.op12_sentencepiece(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_null_empty_repeated_and_long_texts(spark, library):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, " " * 300_000), (5, "x" * 1_000_000), (6, "日本ข" * 100_000), (7, "▁"), (8, "ab cd " * 200_000)]
    got = p.decode(p.encode(docs(spark, rows), p.public_model()), p.public_model()).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [(i, library.encode(t or "", add_eos=True)) for i, t in sorted(rows, key=key)]
    got = sorted(got, key=key)
    assert [(r["doc_id"], r["ids"]) for r in got] == want
    assert [r["decoded"] for r in got] == [(t or "").replace("▁", " ") for _, t in sorted(rows, key=key)]
    assert p.encode(docs(spark, [(1, "a")]), p.public_model(), end=False).first()["ids"] == library.encode("a")


def test_empty_table_and_null_ids(spark):
    assert p.decode(p.encode(docs(spark, []), p.public_model()), p.public_model()).count() == 0
    assert p.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), p.public_model()).first()["decoded"] is None
