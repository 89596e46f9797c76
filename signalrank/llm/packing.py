"""Bounded-space online packing of tokenised documents into sequences of at most 2048 ids.

A document is its text's ids and one end id. Each partition keeps OPEN windows: full-length parts of a long document
fill sequences of their own, the rest goes to the open window that it fits best. When none fits, the fullest window is
topped up with the head of the document if at least LEAST_PIECE ids go in, and emitted. What is open at the end of the
partitions is merged, SPAN partitions at a time, by laying the pieces end to end: one padded sequence a merge remains.

Null and empty texts are the end id alone. doc_id may be null or repeated; every row is packed. Nothing is dropped.
Very long texts, also of one character or of white space alone, are encoded whole. An empty table gives no piece. Only
the id and the text are read, so other columns of any name do no harm.
Windows hold at most OPEN * 2048 ids in a partition and SPAN times as many in a merge, whatever the size of the input.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import cut, small_batches, table

LENGTH, END_ID = 2048, 1
OPEN, LEAST_PIECE, SPAN = 64, 8, 32
#: Runs of white space of this length, on which the faster encoder's pattern may exhaust its stack, go to the tokenizer file's own encoder.
LONG_BLANK = re.compile(r"\s{10000}")
_LOADED: dict[tuple, Callable[[str], np.ndarray]] = {}


def encoder(tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> ids as the tokenizer file gives them, loaded once a worker.

    ranks_path, where given, holds the ranks of the same vocabulary; they give the same ids, faster. Texts that name an
    added token or hold a very long run of white space, and any text on which the ranks fail, go to the file's encoder.
    """
    key = (tokenizer_path, ranks_path, pattern)
    if key not in _LOADED:
        from tokenizers import Tokenizer

        file = Tokenizer.from_file(tokenizer_path)
        by_file = lambda text: np.array(file.encode(text, add_special_tokens=False).ids, np.uint32)
        _LOADED[key] = by_file if ranks_path is None else _by_ranks(by_file, tokenizer_path, ranks_path, pattern)
    return _LOADED[key]


def _by_ranks(by_file: Callable[[str], np.ndarray], tokenizer_path: str, ranks_path: str, pattern: str | None) -> Callable[[str], np.ndarray]:
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as file:
        added = [t["content"] for t in json.load(file).get("added_tokens", [])]
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if LONG_BLANK.search(text) is None and not any(a in text for a in added):
            try:
                return np.array(fast.encode_ordinary(text), np.uint32)
            except BaseException as error:  # a panic of the encoder is no Exception
                if not isinstance(error, Exception) and type(error).__name__ != "PanicException":
                    raise
        return by_file(text)

    return encode


class Packer:
    """Windows of one partition. Emits (doc_id, start, ids, doc_tokens, sequence_id, offset) pieces of finished sequences."""

    def __init__(self, first_id: int, length: int = LENGTH, most_open: int = OPEN, least_piece: int = LEAST_PIECE):
        self.next_id, self.length, self.most_open, self.least_piece = first_id, length, most_open, least_piece
        self.windows: dict[int, list] = {}
        self.free: list[tuple[int, int]] = []  # (free ids, window), sorted
        self.done: list[tuple] = []

    def _put(self, window: int, free: int, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        self.windows[window].append((doc_id, start, ids, total, window, self.length - free))
        if free == len(ids):
            self.done += self.windows.pop(window)
        else:
            insort(self.free, (free - len(ids), window))

    def _open(self) -> tuple[int, int]:
        self.windows[self.next_id] = []
        self.next_id += 1
        return self.length, self.next_id - 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.length:
            free, window = self._open()
            self._put(window, free, (doc_id, start, ids[start : start + self.length], total))
            start += self.length
        while start < total:
            rest = total - start
            at = bisect_left(self.free, (rest, -1))
            if at < len(self.free):
                free, window = self.free.pop(at)
            elif len(self.free) < self.most_open:
                free, window = self._open()
            else:
                free, window = self.free.pop(0)
                if free < self.least_piece:
                    self.done += self.windows.pop(window)
                    free, window = self._open()
            size = min(free, rest)
            self._put(window, free, (doc_id, start, ids[start : start + size], total))
            start += size


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = [pa.int64()] * 7


def _rows(pieces: list[tuple], group: int | None) -> pa.RecordBatch:
    """With a group, the pieces are left over and carry their ids."""
    doc_id, start, ids, total, sequence, offset = zip(*pieces) if pieces else [()] * 6
    columns = [doc_id, start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], total, sequence, offset]
    arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES)]
    arrays += [pa.array([group] * len(ids), pa.int64()), pa.array([None if group is None else x.astype("<u4").tobytes() for x in ids], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, [*(c.split()[0] for c in PIECES.split(", ")), "part", "ids"])


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_path (and ranks_path, the same vocabulary as ranks with its pattern) must be readable at that place on every executor.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern)
        partition = TaskContext.get().partitionId()
        packer = Packer(partition << 32, length, most_open)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(END_ID)))
            yield _rows(packer.done, None)
            packer.done = []
        yield _rows([p for w in packer.windows.values() for p in w], partition // SPAN)

    packed = cut(rows.mapInArrow(run, f"{PIECES}, part long, ids binary"))

    def merge(part: pa.Table) -> pa.Table:
        part = part.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        merged, sequence, used = [], (1 << 62) | (part.column("part")[0].as_py() << 32), 0
        for doc_id, start, total, ids in zip(*(part.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            ids, at = np.frombuffer(ids, "<u4"), 0
            while at < len(ids):
                size = min(length - used, len(ids) - at)
                merged.append((doc_id, start + at, ids[at : at + size], total, sequence, used))
                at, used = at + size, used + size
                if used == length:
                    sequence, used = sequence + 1, 0
        return pa.Table.from_batches([_rows(merged, None)]).select([c.split()[0] for c in PIECES.split(", ")])

    left = packed.where("ids is not null").groupBy("part").applyInArrow(merge, PIECES)
    return packed.where("ids is null").drop("part", "ids").unionByName(left)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *public_files())


def public_files() -> tuple[str, str, str]:
    """Tokenizer file, ranks of the same vocabulary, and their pattern, as installed on this cluster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
