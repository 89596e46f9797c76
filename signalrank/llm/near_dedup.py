"""Near-duplicate documents by HyperMinHash sketches, banded, with exact confirmation.

A document's set holds the hashes of its distinct 5-word shingles (fewer words: the whole sequence as one). One pass
sketches each set: the hash's top bits choose one of REGISTERS buckets, and each bucket keeps the leading-zero count
and MANTISSA bits of its least hash. Equal sets are one node. Bands of registers give buckets of nodes; small sets are
also entered under their least quarter of hashes, which finds all their links exactly.

Pairs are made without listing all pairs of a bucket: every node meets one centre, the node with the most company
among all that share a bucket with it. Sketches estimate the similarity, corrected for register collisions; pairs far
below the threshold go, and the rest is confirmed on the full sets. Linked nodes take their centre's name, and then
only buckets that hold several names are open. Of their nodes, those that cannot reach the threshold are left out by
an exact bound: of a set, only hashes that some other open set holds can be shared. Of what is left, linked sets share
one of their rarest quarter of hashes. Those that share one which at most RARE sets have there are compared pair by pair;
those that share a more frequent one are joined into clusters, and a cluster's full sets are compared in blocks of
bounded size: families of texts that are all alike, but below the threshold, cost the square of their number here.
Links of similarity 0.75 are missed by all bands with a chance under 1e-5. One components loop ends the work.

Null and empty texts have no shingles, are linked with nothing and are kept. doc_id may be null or repeated; equal
texts are always in one group. Very long texts are read whole; a set takes eight bytes a shingle in the task that holds
it. An empty table gives an empty report. Other columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalrank.operators.components import components
from signalrank.session import cut, fits, scratch, sized, small_batches, table

SHINGLE = 5
#: Links need SIM_NUM * union <= SIM_DEN * intersection, that is a similarity of 0.75.
SIM_NUM, SIM_DEN = 75, 100
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BUCKET_BITS, MANTISSA = 7, 10
#: Sets up to this size are also found by their least hashes: a link of 0.75 from 12 or fewer reaches at most 16.
SMALL = 16
#: Estimates this many standard deviations under the threshold are dropped.
DEVIATIONS = 5.0
WORD_MEMO = 150_000
_EMPTY = np.uint16(0xFFFF)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    """word -> 64-bit hash, remembered; emptied when it has grown to WORD_MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. bytes.lower() and bytes.split() know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - SHINGLE + 1)
    width = min(SHINGLE, len(ids))
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total += _mix(ids[k : k + n] + np.uint64(k)) * _ODD[k]
    return np.unique(_mix(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: leading zeros and mantissa of the least hash in each bucket, packed in 16 bits."""
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    at = np.searchsorted(hashes, bounds)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    some = (at < len(hashes)) & ((least >> np.uint64(64 - BUCKET_BITS)) == np.arange(REGISTERS, dtype=np.uint64))
    rest = least << np.uint64(BUCKET_BITS)
    zeros = (64 - np.frexp(np.maximum(rest >> np.uint64(11), np.uint64(1)).astype(np.float64))[1] - 11).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(some, ((zeros << np.uint64(MANTISSA)) | tail).astype(np.uint16), _EMPTY)


def band_keys(registers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One key for each band with a filled register, and for small sets one for each of their least quarter of hashes."""
    packed = np.ascontiguousarray(registers.reshape(BANDS, ROWS)).view(np.uint64).ravel()
    filled = packed != np.uint64(0xFFFFFFFFFFFFFFFF)
    keys = _mix(packed + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0])[filled]
    if len(hashes) <= SMALL:
        prefix = hashes[: len(hashes) - -(-SIM_NUM * len(hashes) // SIM_DEN) + 1]
        keys = np.concatenate([keys, _mix(prefix + _ODD[1])])
    return keys.view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SIM_DEN * common >= SIM_NUM * (len(a) + len(b) - common)


@lru_cache(maxsize=4096)
def _collision(log_a: int, log_b: int) -> float:
    """Chance that two unrelated buckets of about 2**(log/4) hashes each have equal registers."""
    edges = [0.0]
    for zeros in range(40, -1, -1):
        edges += list(2.0 ** -(zeros + 1) * (1 + np.arange(1, (1 << MANTISSA) + 1) / (1 << MANTISSA)))
    edges = np.array(edges)
    cells = [np.diff(-np.expm1(-(2.0 ** (x / 4)) * edges)) for x in (log_a, log_b)]
    return float(cells[0] @ cells[1])


def estimate(a: bytes, b: bytes, n_a: int, n_b: int) -> tuple[float, int]:
    """Collision-corrected similarity of two sketches, and the number of registers that it rests on."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    used = (x != _EMPTY) | (y != _EMPTY)
    k = int(used.sum())
    if not k:
        return 0.0, 0
    raw = float(((x == y) & used).sum()) / k
    chance = _collision(*(int(round(4 * np.log2(max(n, 1) / REGISTERS))) for n in (n_a, n_b)))
    return max(0.0, (raw - chance) / (1 - chance)), k


def _near(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    least = SIM_NUM / SIM_DEN
    found, k = estimate(a, b, n_a, n_b)
    return found >= least - DEVIATIONS * (least * (1 - least) / max(k, 1)) ** 0.5


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n, node, tag, registers, keys): one row per document; node names its set, null without shingles, tag is its first half."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    made = "n long, node binary, tag long, registers binary, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py())
                if len(hashes):
                    registers, node = sketch(hashes), set_key(hashes)
                    found.append((len(hashes), node, int.from_bytes(node[:8], "big", signed=True), registers.tobytes(), band_keys(registers, hashes)))
                else:
                    found.append((0, None, None, None, None))
            n, node, tag, registers, keys = zip(*found) if found else [()] * 5
            arrays = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(tag, pa.int64()), pa.array(registers, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *arrays], ["doc_id", "text_hash", *(c.split()[0] for c in made.split(", "))])

    return rows.mapInArrow(run, f"doc_id long, text_hash long, {made}")


def nodes_of(drawn: DataFrame) -> DataFrame:
    """(tag, doc_id, text_hash, n, node, registers, keys, lead): sets that share a bucket with another set. keys: those buckets; lead: less company counts more."""
    some = drawn.where("node is not null")
    entries = some.select("tag", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("tag").alias("low"), F.max("tag").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
    cells = entries.join(sized(cut(shared, narrow=True)), "key").groupBy("tag").agg(F.collect_set(F.struct("key", "size")).alias("cells"))
    first = some.groupBy("tag").agg(F.min(F.struct("doc_id", "text_hash", "n", "node", "registers")).alias("x"))
    company = F.aggregate("cells", F.lit(0).cast("long"), lambda total, c: total + c["size"])
    return cells.join(first, "tag").select("tag", "x.*", F.col("cells.key").alias("keys"), (-company).alias("lead"))


def _starred(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), at most one for each node: b leads all nodes that share a bucket with a."""
    cells = nodes.select("tag", "lead", F.explode("keys").alias("key"))
    centres = cells.groupBy("key").agg(F.min(F.struct("lead", "tag")).alias("b"))
    return cells.join(centres, "key").groupBy(F.col("tag").alias("a")).agg(F.min("b")["tag"].alias("b")).where("a <> b")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule a link out, with the rows that hold their texts."""
    side = lambda s: nodes.select(F.col("tag").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "registers", "doc_id", "text_hash")))
    sized_pairs = pairs.join(side("a"), "a").join(side("b"), "b").where((SIM_NUM * F.col("n_a") <= SIM_DEN * F.col("n_b")) & (SIM_NUM * F.col("n_b") <= SIM_DEN * F.col("n_a")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_near(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("registers_a", "registers_b", "n_a", "n_b")))]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "doc_id_a", "text_hash_a", "doc_id_b", "text_hash_b"])

    return sized_pairs.mapInArrow(run, "a long, b long, doc_id_a long, text_hash_a long, doc_id_b long, text_hash_b long")


def _texts(rows: DataFrame, small: bool, docs: DataFrame) -> DataFrame:
    """`rows` (doc_id, text_hash, ...) with the text of each. docs has doc_id, text and text_hash; rows that repeat both come again."""
    found = docs.alias("d").join(F.broadcast(rows) if small else rows, F.col("d.doc_id").eqNullSafe(rows["doc_id"]) & (F.col("d.text_hash") == rows["text_hash"]))
    return found.select(*(rows[c] for c in rows.columns if c not in ("doc_id", "text_hash")), "d.text")


#: Members of one centre are dealt to this many tasks, each of which gets the centre's text too.
SALTS = 64


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b; a written table) that are linked on their full sets."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    members = salted.select("b", "salt", F.lit(1).alias("member"), F.col("a").alias("tag"), F.col("doc_id_a").alias("doc_id"), F.col("text_hash_a").alias("text_hash"))
    centres = salted.select("b", "salt", F.lit(0).alias("member"), F.col("b").alias("tag"), F.col("doc_id_b").alias("doc_id"), F.col("text_hash_b").alias("text_hash"))
    texts = _texts(members.unionByName(centres.distinct()), fits(pairs), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre, done = None, None, None
        for batch in batches:
            found = []
            for b, salt, member, tag, text in zip(*(batch.column(c) for c in ("b", "salt", "member", "tag", "text"))):
                group = b.as_py(), salt.as_py()
                if group != last:  # the centre comes first
                    last, centre, done = group, shingle_set(text.as_py()), None
                elif member.as_py() and tag.as_py() != done:
                    done = tag.as_py()
                    if linked(shingle_set(text.as_py()), centre):
                        found.append((done, group[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return texts.repartition("b", "salt").sortWithinPartitions("b", "salt", "member", "tag").mapInArrow(run, "a long, b long")


def _links_within(nodes: list[int], parts: list[int], blocks: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different parts, one for each two parts. Sets of the same block are compared only where all are of one block."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    hashes, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(hashes)) > 1
    rank = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(column, (start, start + 4096))
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[lo:hi], column[lo:hi] - start] = 1
        common += grid @ grid.T
    number = {p: k for k, p in enumerate(dict.fromkeys(parts))}
    part = np.array([number[p] for p in parts])
    block = np.array(blocks)
    near = SIM_DEN * common >= SIM_NUM * (sizes[:, None] + sizes[None, :] - common)
    near &= part[:, None] < part[None, :]
    if block.min() != block.max():
        near &= block[:, None] != block[None, :]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(near)):
        found.setdefault((part[i], part[j]), (nodes[i], nodes[j]))
    return list(found.values())


def _open(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(tag, part, doc_id, text_hash, n) of the nodes in buckets that hold different names: part is the name, two steps up the links."""
    top = links.alias("x").join(links.select(F.col("a").alias("b"), F.col("b").alias("top")).alias("y"), "b", "left").select(F.col("a").alias("tag"), F.coalesce("top", "b").alias("part"))
    if fits(links):
        top = F.broadcast(top)
    named = nodes.join(top, "tag", "left").select("tag", F.coalesce("part", "tag").alias("part"), "doc_id", "text_hash", "n", "keys")
    placed = named.select("tag", "part", "doc_id", "text_hash", "n", F.explode("keys").alias("key"))
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    return placed.join(sized(cut(several, narrow=True)), "key").select("tag", "part", "doc_id", "text_hash", "n").distinct()


def _hashes(texts: DataFrame) -> DataFrame:
    """(tag, hash): the sets of texts (tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tags = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
            return pa.RecordBatch.from_arrays([pa.array(tags), pa.array(np.concatenate([x[1] for x in held]))], ["tag", "hash"])

        for batch in batches:
            for tag, text in zip(batch.column("tag").to_pylist(), batch.column("text")):
                found = shingle_set(text.as_py()).view(np.int64)
                for start in range(0, len(found), 50_000):
                    held.append((tag, found[start : start + 50_000]))
                    size += len(held[-1][1])
                    if size >= 50_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "tag long, hash long")


def _able(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The members that could reach the threshold with another of them, by the hashes that some other one holds too. texts: (tag, text)."""
    # A text that comes twice counts once.
    found = _hashes(texts).groupBy("hash").agg(F.min("tag").alias("tag"), F.max("tag").alias("high"))
    alone = found.where("tag = high").groupBy("tag").agg(F.count(F.lit(1)).alias("alone"))
    usable = F.col("n") - F.coalesce("alone", F.lit(0))
    # With needed overlap (n + m) * SIM_NUM / (SIM_NUM + SIM_DEN), a partner has at most `most` hashes, and at least SIM_NUM / SIM_DEN * n.
    most = F.floor(usable * (SIM_NUM + SIM_DEN) / SIM_NUM + 1e-9) - F.col("n")
    return members.join(alone, "tag", "left").where(SIM_DEN * most >= SIM_NUM * F.col("n")).select(*members.columns)


def _rarest(able: DataFrame, texts: DataFrame) -> DataFrame:
    """(hash, tag): each set's hashes, rarest first, as far as two linked sets must share one, but for those that no other set holds. texts: (tag, text)."""
    own = texts.join(able.select("tag"), "tag", "left_semi").dropDuplicates(["tag"])
    rows = cut(_hashes(own), narrow=True)
    often = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("often"), F.min("tag").alias("tag"))
    alone = often.where("often = 1").groupBy("tag").agg(F.count(F.lit(1)).alias("alone"))
    # A partner holds SIM_NUM / SIM_DEN of the set, so at least one of the first `ahead` hashes in any order that all sets share.
    ahead = F.col("n") - F.floor((SIM_NUM * F.col("n") + (SIM_DEN - 1)) / SIM_DEN) + 1
    ahead = able.join(alone, "tag", "left").select("tag", (ahead - F.coalesce("alone", F.lit(0))).alias("ahead")).where("ahead > 0")
    place = F.row_number().over(Window.partitionBy("tag").orderBy("often", "hash"))
    shared = rows.join(often.where("often > 1").select("hash", "often"), "hash").join(ahead, "tag")
    return shared.withColumn("place", place).where("place <= ahead").select("hash", "tag")


#: Sets that share a hash with at most this many others, among their rarest ones, are compared with each of them.
RARE = 64


def _left_over(nodes: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different names, at least one for each two names with a link."""
    members = cut(_open(nodes, links), narrow=True)
    small = fits(members)
    texts = _texts(members.select("tag", "doc_id", "text_hash"), small, docs)
    if not small:
        texts = cut(texts)
    able = cut(_able(members, texts), narrow=True)
    cells = cut(_rarest(able, texts).join(able, "tag"), narrow=True)
    held = cells.groupBy("hash").agg(F.count(F.lit(1)).alias("sets"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("tag").alias("b")).where("low <> high")
    held = cut(held.select("hash", "sets", "b"), narrow=True)
    return _confirmed(cut(_rare_pairs(cells, held.where(F.col("sets") <= RARE)), narrow=True), docs).unionByName(_in_clusters(able, cells, held.where(F.col("sets") > RARE), docs))


def _rare_pairs(cells: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of different names under the hashes `held`, of sizes that can be linked, as `_confirmed` takes them."""
    rows = cells.join(held.select("hash"), "hash")
    side = lambda s: rows.select("hash", *(F.col(c).alias(f"{c}_{s}") for c in ("tag", "part", "n", "doc_id", "text_hash")))
    fit = (F.col("tag_a") > F.col("tag_b")) & (F.col("part_a") != F.col("part_b"))
    fit = fit & (SIM_NUM * F.col("n_a") <= SIM_DEN * F.col("n_b")) & (SIM_NUM * F.col("n_b") <= SIM_DEN * F.col("n_a"))
    found = side("a").join(side("b"), "hash").where(fit)
    return found.select(F.col("tag_a").alias("a"), F.col("tag_b").alias("b"), "doc_id_a", "text_hash_a", "doc_id_b", "text_hash_b").distinct()


def _in_clusters(able: DataFrame, cells: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the sets that hashes `held` (hash, b) join into clusters."""
    # A node stands for all its centres under the least of them, so the graph has the centres' pairs, not those of all nodes.
    met = cut(cells.join(held.select("hash", "b"), "hash").groupBy("tag").agg(F.collect_set("b").alias("bs")).select("tag", F.array_min("bs").alias("a"), "bs"), narrow=True)
    clusters = components(met.select("a", F.explode("bs").alias("b")).where("a <> b").distinct())
    named = met.drop("bs").join(sized(clusters), F.col("a") == F.col("node"), "left").select("tag", F.coalesce("label", "a").alias("cluster"))
    placed = cut(able.join(F.broadcast(named) if fits(met) else named, "tag"), narrow=True)
    small = fits(placed)
    sizes = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_HASHES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(sizes) if small else sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int"))
    # Every two blocks meet once; a cluster of one block is only compared with itself.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("lo"), F.greatest(k, "block").alias("hi")))
    spread = _texts(dealt, small, docs).select("cluster", F.explode(meets).alias("pair"), "block", "tag", "part", "text")
    spread = spread.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "tag")

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def close() -> pa.RecordBatch:
            found = _links_within(*zip(*rows)) if len({r[1] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for cluster, pair, block, tag, part, text in zip(*(batch.column(c) for c in ("cluster", "pair", "block", "tag", "part", "text"))):
                own = (cluster.as_py(), *pair.as_py().values())
                if own != group and rows:
                    yield close()
                    rows = []
                group = own
                if not rows or rows[-1][0] != tag.as_py():
                    rows.append((tag.as_py(), part.as_py(), block.as_py(), shingle_set(text.as_py())))
        if rows:
            yield close()

    return spread.mapInArrow(links_of, "a long, b long")


#: Left-over sets are compared in blocks of about this many hashes, and sets, at most.
BLOCK_HASHES, BLOCK_SETS = 300_000, 500


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_hash (xxhash64 of its text)."""
    with scratch(small_batches(docs.sparkSession)) as kept:
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        drawn = cut(sketches(own))
        own = own.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
        nodes = cut(nodes_of(drawn))
        links = cut(_confirmed(cut(_estimated(_starred(nodes), nodes), narrow=True), own), narrow=True)
        labels = components(links.unionByName(_left_over(nodes, links, own)))
        named = labels.join(nodes.select(F.col("tag").alias("node"), F.col("node").alias("set")), "node").select("set", "label")
        if fits(labels):
            named = F.broadcast(named)
        # A group is a component of links, or one set.
        rows = drawn.select("doc_id", "text_hash", "n", "node").join(named, F.col("node") == F.col("set"), "left").drop("set")
        rows = rows.withColumn("node", F.when(F.col("label").isNull(), F.col("node")))
        groups = rows.where("node is not null or label is not null").groupBy("label", "node").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
        groups = sized(cut(groups.where("rows > 1").drop("rows"), narrow=True)).alias("g")
        same = F.col("r.label").eqNullSafe(F.col("g.label")) & F.col("r.node").eqNullSafe(F.col("g.node"))
        found = rows.alias("r").join(groups, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
        return kept(found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash"), narrow=True)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group, the one with the least doc_id; all columns kept. Rows that repeat that doc_id stay."""
    gone = sized(cut(report(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), narrow=True))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    return rows.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti").select("row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents")).drop("text_hash")
