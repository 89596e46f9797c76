"""Hard negatives by blocked dense products: anchors against all rows, with their best rows of the same and of other labels.

Components are rounded down to integers after scaling, so inner products are integers. Anchors are dealt into blocks of
a measured size. Each block is broadcast; tasks multiply it with blocks of candidate rows and keep, for each anchor, the
best few of the same label; what tasks kept is merged by score and id. A second pass over the candidates keeps, for each
anchor and positive, the best few rows of other labels whose score lies in the positive's window. Products are taken in
float64 where no sum can reach 2^53, so they are exact, and in whole numbers of any size where one can; scores beyond a
long stand at its ends.

A task keeps a few rows for each anchor of the block, whatever it reads, so hot vectors, labels and long runs of equal
scores cost no memory. Equal scores go by the smaller id. Rows with a null id, label or vector, or with a component that is null or not
finite, take no part. A repeated row is a row of its own, and other than the first. Vectors of different lengths are not
compared; those of no component have the product 0. Without anchors, positives or negatives no row is returned. Only
the named columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalrank.session import checkpoint_dir, cut, scratch, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 50, 95
#: Bytes of anchors in a block, as 64-bit components: what is broadcast at once is at most twice that, or one vector.
BLOCK_BYTES = 32 << 20
#: Anchors and candidates whose products a task holds at once.
TILE = 1024
EXACT, LONG = 1 << 53, (1 << 63) - 1


def rounded(vectors: DataFrame, anchor: Column, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, anchor, q) for rows that take part; `row` numbers them."""
    own_id, vector = F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & (x - x == 0))
    rows = vectors.select(own_id.alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(F.when(finite, vector), lambda x: F.floor(x * scale)).alias("q"))
    return rows.where("vec_id is not null and label is not null and q is not null").select(F.monotonically_increasing_id().alias("row"), "*")


def _size(q: np.ndarray) -> int:
    return max(abs(int(q.min())), abs(int(q.max()))) if q.size else 0


def products(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Inner products of the rows of two integer matrices, no product of two components being over `size`."""
    if size * a.shape[1] < EXACT:
        return a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)


class Best:
    """The k best (score, vec_id, row) of each group: higher scores, then smaller ids, then smaller rows."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score = np.full((groups, k), -LONG)
        self.vec_id, self.row = np.full((groups, k), LONG), np.full((groups, k), LONG)

    def offer(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        last = self.score[group, -1]
        good = (score > last) | ((score == last) & (vec_id <= self.vec_id[group, -1]))
        group, score, vec_id, row = group[good], score[good], vec_id[good], row[good]
        if not len(group):
            return
        touched, at = np.unique(group, return_inverse=True)
        at = np.concatenate((at, np.repeat(np.arange(len(touched)), self.k)))
        score, vec_id, row = (np.concatenate((x, y[touched].ravel())) for x, y in ((score, self.score), (vec_id, self.vec_id), (row, self.row)))
        order = np.lexsort((row, vec_id, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        cells = touched[at[keep]], place[keep]
        for held, new in ((self.score, score), (self.vec_id, vec_id), (self.row, row)):
            held[cells] = new[order][keep]

    def found(self) -> tuple[np.ndarray, ...]:
        """(group, score, vec_id, row) of all that is held."""
        group, place = np.nonzero(self.row < LONG)
        return group, self.score[group, place], self.vec_id[group, place], self.row[group, place]


class Block:
    """Anchors of one vector length. With positives, `low` and `high` are the windows of their scores, one a positive."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, q: np.ndarray):
        self.row, self.vec_id, self.label, self.size = row, vec_id, label, _size(q)
        self.q = q.astype(np.float64) if self.size < EXACT else q

    def open_windows(self, positives: Best, least: int, most: int) -> None:
        score, there = positives.score.astype(object), positives.row < LONG
        self.positive_id, self.positive_score = positives.vec_id, positives.score
        bound = lambda x, other: np.where(there, np.clip(x, -LONG, LONG), other).astype(np.int64)
        self.low, self.high = bound(-(-score * least // 100), LONG), bound(score * most // 100, -LONG)


def _matrices(batch) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, vec_id, label, q) of a batch, one for each length of vectors."""
    row, vec_id, label = (np.asarray(batch.column(c)) for c in ("row", "vec_id", "label"))
    lists = batch.column("q").combine_chunks() if isinstance(batch, pa.Table) else batch.column("q")
    values, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths(), np.int64))
    lengths = np.diff(ends, prepend=0)
    if len(lengths) and (lengths == lengths[0]).all():
        yield row, vec_id, label, values.astype(np.int64, copy=False).reshape(len(lengths), lengths[0])
        return
    for length in np.unique(lengths):
        here = np.flatnonzero(lengths == length)
        yield row[here], vec_id[here], label[here], values[(ends[here] - length)[:, None] + np.arange(length)].astype(np.int64).reshape(len(here), length)


def _meet(blocks: dict[int, Block], batches: Iterator[pa.RecordBatch], same: bool, offer: Callable) -> None:
    """Hands each tile of anchors and candidates to `offer`: length, block, first anchor, scores, where labels agree or not, the candidates' row and vec_id."""
    for batch in batches:
        for row, vec_id, label, q in _matrices(batch):
            block = blocks.get(q.shape[1])
            if block is None:
                continue
            for c in (slice(k, k + TILE) for k in range(0, len(row), TILE)):
                size = block.size * _size(q[c])
                other = q[c].astype(np.float64) if block.size < EXACT and size * q.shape[1] < EXACT else q[c]
                for start in range(0, len(block.row), TILE):
                    anchors = slice(start, start + TILE)
                    offer(q.shape[1], block, start, products(block.q[anchors], other, size), (block.label[anchors, None] == label[c]) == same, row[c], vec_id[c])


def positives_of(blocks: dict[int, Block], batches: Iterator[pa.RecordBatch], k: int) -> dict[int, Best]:
    best = {length: Best(len(b.row), k) for length, b in blocks.items()}

    def offer(length, block, start, score, mask, row, vec_id):
        held = best[length]
        mask &= score >= held.score[start : start + len(score), -1:]
        a, c = np.nonzero(mask)
        other = block.row[start + a] != row[c]
        a, c = a[other], c[other]
        held.offer(start + a, score[a, c].astype(np.int64), vec_id[c], row[c])

    _meet(blocks, batches, True, offer)
    return best


def negatives_of(blocks: dict[int, Block], batches: Iterator[pa.RecordBatch], k: int) -> dict[int, Best]:
    """Groups are anchor times positives plus positive."""
    best = {length: Best(b.low.size, k) for length, b in blocks.items()}

    def offer(length, block, start, score, mask, row, vec_id):
        held, anchors, wide = best[length], slice(start, start + len(score)), block.low.shape[1]
        last = held.score[:, -1].reshape(-1, wide)
        floor = np.maximum(block.low[anchors], last[anchors])
        mask &= (score >= floor.min(axis=1, keepdims=True)) & (score <= block.high[anchors].max(axis=1, keepdims=True))
        a, c = np.nonzero(mask)
        value = score[a, c].astype(np.int64)
        pair, window = np.nonzero((value[:, None] >= floor[a]) & (value[:, None] <= block.high[start + a]))
        held.offer((start + a[pair]) * wide + window, value[pair], vec_id[c[pair]], row[c[pair]])

    _meet(blocks, batches, False, offer)
    return best


def _blocks(anchors: DataFrame, block_bytes: int) -> int:
    """How many blocks the anchors are dealt into so that none is over twice block_bytes, unless it is one vector."""
    size = F.size("q").cast("long") * 8 + 64
    total = anchors.agg(F.sum(size)).first()[0]
    if not total:
        return 0
    blocks = -(-total // block_bytes)
    while True:
        fullest = anchors.groupBy(_block(blocks)).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.max("size")).first()[0]
        if (fullest or 0) <= 2 * block_bytes:
            return blocks
        blocks *= 2


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")


KEPT = "length int, at long, score long, vec_id long, row long"
_KEPT = pa.schema([("length", pa.int32()), ("at", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])


def _merged(candidates: DataFrame, held, find: Callable, k: int) -> DataFrame:
    """What the tasks found for a broadcast block, merged: (length, at, score, vec_id, row, rank), k rows for each length and group at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, best in find(held.value, batches, k).items():
            found = best.found()
            for start in range(0, len(found[0]), 10_000):
                part = [x[start : start + 10_000] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), length, np.int32)), *map(pa.array, part)], schema=_KEPT)

    order = Window.partitionBy("length", "at").orderBy(F.col("score").desc(), "vec_id", "row")
    return candidates.mapInArrow(run, KEPT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST, scale: int = SCALE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to `negatives` for each of up to `positives` of each row where `anchor` holds."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = f"{checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    with scratch(spark):
        candidates = cut(rounded(vectors, anchor, id_col, vector_col, label, scale))
        anchors = cut(candidates.where("anchor").drop("anchor"))
        candidates = candidates.drop("anchor")
        blocks = _blocks(anchors, block_bytes)
        for number in range(blocks):
            found = anchors.where(_block(blocks) == number).toArrow()  # of measured size
            block = {m[3].shape[1]: Block(*m) for m in _matrices(found)}
            if not block:
                continue
            held = context.broadcast(block)
            best = {length: Best(len(b.row), positives) for length, b in block.items()}
            merged = _merged(candidates, held, positives_of, positives).toArrow()  # `positives` rows for each anchor of the block
            length, *columns = (np.asarray(merged.column(c)) for c in ("length", "at", "score", "vec_id", "row"))
            for x in block:
                best[x].offer(*(c[length == x] for c in columns))
                block[x].open_windows(best[x], least, most)
            held.unpersist()
            held = context.broadcast(block)
            names = _names(context, spark, block)
            rows = _merged(candidates, held, negatives_of, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
            rows.join(F.broadcast(names), ["length", "at"]).selectExpr("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
            held.unpersist()
    return spark.read.schema(schema).parquet(path)


def _names(context, spark: SparkSession, block: dict[int, Block]) -> DataFrame:
    """(length, at, anchor_id, positive_id, positive_score) of a block, which has a bounded size."""
    parts = []
    for length, b in block.items():
        wide = b.low.shape[1]
        at = np.flatnonzero((b.low <= b.high).ravel())
        parts.append(pa.table({"length": np.full(len(at), length, np.int32), "at": at, "anchor_id": b.vec_id[at // wide], "positive_id": b.positive_id.ravel()[at], "positive_score": b.positive_score.ravel()[at]}))
    return spark.createDataFrame(pa.concat_tables(parts))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return mine(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label.cast("long") + 1) % 10).otherwise(label))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
"""
