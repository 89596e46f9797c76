"""SentencePiece ids of texts by backtracking, and texts of ids.

A merge-type model joins the two neighbouring symbols whose union has the best score until none is left. A list of
pieces is that result exactly when no merge joins any piece with the next one, so the encoder never merges a whole text: it takes
the longest piece that an Aho-Corasick automaton finds at a place, checks it against the piece before by re-merging
just these two, tries shorter prefixes when they do not go together, and steps back when none does. A bit for each place
keeps from which of them nothing leads on, so each is left at most once and long texts cost their length.

No piece of such a vocabulary goes on over a space after something else (checked when the model is read), so texts fall
apart at the first space after each word; the ids of short parts are kept for the next time, in a table of bounded size.
Characters that the vocabulary lacks become the pieces of their bytes.

The model must be of the merge type with scores, byte pieces, one space put before a text, and no other normalisation:
anything else raises. Null and empty texts have the end id alone and decode to the empty text. A lower one eighth block
stands for a space, as in the library, and decodes to one. Texts of any length are encoded whole, repeated rows each, an
empty table gives none; doc_id may be null. Only id and text are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import small_batches, table

SPACE = "▁"
#: A text's parts: spaces and what follows up to the next space.
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Parts of up to this many characters are kept with their ids: so many new ones a worker, and those that were new before; and as many verdicts on two pieces.
PART_CHARS, PARTS, PAIRS = 32, 1 << 19, 1 << 19
#: Characters that the automaton reads at once.
WINDOW = 64
NEVER = float("-inf")


class Vocabulary:
    """Pieces and scores of a model file, read with the library; everything else here works on these tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.end_id = model.eos_id()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = {i for i in ids if model.is_unknown(i)}
        self.silent = {i for i in ids if model.is_control(i)}
        self.pieces = {i: model.id_to_piece(i) for i in ids if not (model.is_byte(i) or i in self.unknown or i in self.silent)}
        self.scores = {p: model.get_score(i) for i, p in self.pieces.items()}
        if len(self.byte_ids) != 256 or model.normalize("  ﬁ A ") != "▁▁▁ﬁ▁A▁" or any(SPACE in p.lstrip(SPACE) for p in self.pieces.values()):
            raise ValueError(f"not a merge-type model with byte pieces and plain spaces: {path}")

    def merge(self, left: str, right: str) -> bool:
        """Whether re-merging the characters of both leaves them apart."""
        symbols, border, scores = list(left + right), len(left), self.scores
        joined = [scores.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while joined and (best := max(joined)) > NEVER:
            at = joined.index(best)  # of equal ones the leftmost
            if at + 1 == border:
                return False
            border -= at < border
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = scores.get(symbols[at - 1] + symbols[at], NEVER)
            if at < len(joined):
                joined[at] = scores.get(symbols[at] + symbols[at + 1], NEVER)
        return True

    def whole(self, piece: str) -> bool:
        """Whether merging the characters of a piece gives that piece: others never come out of a text."""
        symbols, scores = list(piece), self.scores
        while len(symbols) > 1:
            found = [(-scores[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
            if not found:
                return False
            at = min(found)[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return True


class Encoder(dict):
    """text -> ids. As a dict it holds the ids of short parts seen before, as bytes, by the part without its first space."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = {i: p for i, p in vocabulary.pieces.items() if vocabulary.whole(p)}
        by_text = {p: i for i, p in self.pieces.items()}
        self.known = {p for p in by_text if len(p) == 1}
        self.total = max(self.pieces) + 1
        self.size = [len(self.pieces.get(i, "")) for i in range(self.total)]
        self.longest = max(self.size)
        self.shorter: list[int | None] = [None] * self.total
        for i, p in self.pieces.items():
            self.shorter[i] = next((by_text[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in by_text), None)
        self.automaton = ahocorasick.Automaton()
        for p, i in by_text.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, int] = {}
        self.older: dict[str, bytes] = {}

    def follow(self, key: int) -> int:
        """Of `token` and its shorter prefixes, with key = last * total + token, the longest that goes with `last`; -1 if none does."""
        last, token = divmod(key, self.total)
        while token is not None and not self.vocabulary.merge(self.pieces[last], self.pieces[token]):
            token = self.shorter[token]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[key] = -1 if token is None else token
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        match, size, shorter, pairs, follow, total, n = self.automaton.iter_long, self.size, self.shorter, self.pairs, self.follow, self.total, len(text)
        ids: list[int] = []
        failed = None  # a bit for each place, made when the first one fails
        at, last = 0, -1
        while at < n:
            base = at
            sure = n if at + WINDOW >= n else at + WINDOW - self.longest  # a piece found after that may be cut short
            for end, longest in match(text[at : at + WINDOW]):  # longest pieces, one after the other, as long as they go together
                if at > sure:
                    break
                token: int | None = longest
                while True:
                    if token is not None and last >= 0:
                        key = last * total + token
                        token = pairs[key] if key in pairs else follow(key)
                    if token is None or token < 0:
                        if failed is None:
                            failed = bytearray((n >> 3) + 1)
                        failed[at >> 3] |= 1 << (at & 7)
                        token = ids.pop()
                        at -= size[token]
                        last = ids[-1] if ids else -1
                    else:
                        here = at + size[token]
                        if failed is None or not failed[here >> 3] >> (here & 7) & 1:
                            break
                    token = shorter[token]
                ids.append(token)
                at, last = here, token
                if at != base + end + 1:
                    break
        return ids

    def spelled(self, text: str) -> list[int]:
        """Ids of a text some of whose characters may be unknown: these are written as bytes."""
        ids: list[int] = []
        start, bytes_of = 0, self.vocabulary.byte_ids
        for k, c in enumerate(text):
            if c not in self.known:
                ids += self.backtrack(text[start:k])
                ids += [bytes_of[b] for b in c.encode("utf-8", "surrogatepass")]
                start = k + 1
        return ids + self.backtrack(text[start:])

    def __missing__(self, part: str) -> bytes:
        found = self.older.pop(part, None)
        if found is None:
            text = SPACE + part
            found = array("i", self.backtrack(text) if self.known.issuperset(text) else self.spelled(text)).tobytes()
        if len(part) <= PART_CHARS:
            if len(self) >= PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids without an end id."""
        if not text:
            return np.empty(0, np.int32)
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            parts = [part[1:] for part in PART.findall(SPACE + text.replace(" ", SPACE))]
        else:
            parts = text.split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), np.int32)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


class Decoder:
    """ids -> text: pieces and bytes in order, the space before the text taken off, each byte of no character as U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        known = {i: p.replace(SPACE, " ").encode() for i, p in vocabulary.pieces.items()} | dict.fromkeys(vocabulary.silent, b"") | dict.fromkeys(vocabulary.unknown, " ⁇ ".encode())
        known |= {i: bytes([b]) for b, i in vocabulary.byte_ids.items()}
        self.bytes = [known[i] for i in range(len(known))]
        self.silent, self.pieces = vocabulary.silent, vocabulary.pieces

    def decode(self, ids: list[int]) -> str:
        silent, bytes_of = self.silent, self.bytes.__getitem__
        while ids and ids[-1] in silent:
            ids = ids[:-1]
        if not silent.isdisjoint(ids):  # the bytes on both sides of a silent id are no character together
            runs = [b"".join(map(bytes_of, run)) for quiet, run in groupby(ids, silent.__contains__) if not quiet]
        else:
            runs = [b"".join(map(bytes_of, ids))]
        first = next((i for i in ids if i not in silent), None)
        if first is not None and self.pieces.get(first, "").startswith(SPACE):
            runs[0] = runs[0][1:]
        return "".join(run.decode("utf-8", "each_byte") for run in runs)


_LOADED: dict[tuple[type, str], object] = {}


def _loaded(kind: type, path: str):
    """An encoder or decoder, made once a worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(Vocabulary(path))
    return _LOADED[kind, path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids) for each row, with the model's end id where `end`. model_path must be readable at that place on every executor."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(Encoder, model_path)
        last = np.array([encoder.vocabulary.end_id] if end else [], np.int32)
        for batch in batches:
            found = [x for text in batch.column("text") for x in (encoder.encode(text.as_py() or ""), last)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])[1::2])).astype(np.int32)
            values = np.concatenate(found) if found else last[:0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(values))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) for rows (doc_id, ids). Null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _loaded(Decoder, model_path)
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = [decoder.decode(values[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends)]
            texts = pc.if_else(ids.is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_model()
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
