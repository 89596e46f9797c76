"""Set-similarity join by prefix filtering on rare tokens, and the candidate joins of the resolution cascade.

Tokens are ordered by ascending document frequency. Two sets of similarity t share ceil(t n) tokens, so their first common
token is among the first n - ceil(t n) + 1 of both and their second among the first n - ceil(t n) + 2. Sets meet under
their first common token where at most RARE sets hold it, else under their first two common tokens, so that what meets
grows with the input and not with its square. Those that meet are compared by size, place and a bitmap of their tokens,
none of which drops a similar pair; only pairs that pass are compared on their tokens. Of equal sets only the one with the least id is compared;
`represented` ties the others to it, so that many copies of one set make no square of pairs unless all pairs are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalrank.session import cut

#: Sets meet under single tokens that at most this many sets hold, under two tokens otherwise.
RARE = 64
#: So many tokens before a key's are looked at, to let two sets meet once and not under each of their common keys.
LOOK = 3
#: A set's bitmap has this many words of 64 bits.
WORDS = 4
#: Ids of equal sets in a block at most, and pairs of ids that a task spells out, about.
BLOCK, PAIRS_PER_TASK = 1000, 8_000_000


def document_frequency(sets: DataFrame) -> DataFrame:
    """(token, df) of sets (id, tokens)."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def ordered(sets: DataFrame) -> DataFrame:
    """sets (id, tokens) with their tokens by ascending document frequency, ties by the token."""
    tokens = sets.select("id", F.explode("tokens").alias("token")).join(document_frequency(sets), "token")
    return tokens.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(token, id, tokens): each set under the tokens of its prefix."""
    n = F.size("tokens")
    keep = n - F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    return sets.where(n > 0).select(F.explode(F.slice("tokens", 1, F.greatest(keep, F.lit(1)))).alias("token"), "id", "tokens")


def represented(sets: DataFrame) -> DataFrame:
    """(id, representative) of sets (id, tokens) that are not empty: the least id of those with the same tokens."""
    rows = sets.where(F.size("tokens") > 0).select("id", F.array_sort("tokens").alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("id").alias("representative")), "key").select("id", "representative")


def representatives(sets: DataFrame) -> DataFrame:
    """One of each group of equal sets (id, tokens): the one with the least id. Empty sets are left out."""
    return sets.where(F.size("tokens") > 0).groupBy(F.array_sort("tokens").alias("tokens")).agg(F.min("id").alias("id")).select("id", "tokens")


def near(left: DataFrame, right: DataFrame, least: float, *carry: str) -> DataFrame:
    """(a, b, jaccard), and the columns to carry, of prefix rows `left` (token, a, tokens_a) and `right` (token, b, tokens_b) whose tokens have one order."""
    sized = (F.size("tokens_a") >= F.size("tokens_b") * least - 1e-9) & (F.size("tokens_b") >= F.size("tokens_a") * least - 1e-9)
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    # A pair meets at its first common prefix token only, so no distinct is needed.
    pairs = left.join(right, "token").where(sized).where(F.get(F.array_intersect("tokens_a", "tokens_b"), F.lit(0)) == F.col("token"))
    found = pairs.select("a", "b", *carry, (common / (F.size("tokens_a") + F.size("tokens_b") - common)).alias("jaccard"))
    return found.where(F.col("jaccard") >= least - 1e-12)


def signed(sets: DataFrame) -> DataFrame:
    """sets (id, tokens) with their tokens in order, `rare`, the number of those that at most RARE sets hold, and `bits`, their bitmap."""
    each = sets.select("id", F.explode("tokens").alias("token"))
    held = each.join(document_frequency(sets), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x"))
    rows = held.select("id", F.transform("x", lambda x: x["token"]).alias("tokens"), F.size(F.filter("x", lambda x: x["df"] <= RARE)).alias("rare"))
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(64 * WORDS)).cast("int")
    word = lambda k: F.aggregate(F.filter(F.transform("tokens", place), lambda p: F.floor(p / 64) == k), F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)))
    return rows.select("*", F.array(*[word(k) for k in range(WORDS)]).alias("bits"))


def keys_of(least: float) -> Column:
    """Of `signed` rows, the keys under which they meet others: the first common token, or the first two. at: place of the first; before, between: up to LOOK tokens just before each."""
    n = F.size("tokens")
    need = F.greatest(F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int"), F.lit(1))
    last = n - need + 1  # of a first common token
    token = lambda k: F.xxhash64(F.get("tokens", k - 1))
    ahead = lambda k, least_place: [F.when(k - d >= least_place, token(k - d)) for d in range(1, LOOK + 1)]
    key = lambda key, k, between: F.struct(key.alias("key"), k.alias("at"), F.array(*ahead(k, 1)).alias("before"), F.array(*between).alias("between"))
    single = lambda k: key(token(k), k, [F.lit(None).cast("long")] * LOOK)
    # A set that may share one token only stands under frequent ones too.
    to = F.when(need >= 2, F.least("rare", last)).otherwise(last)
    none = F.array().cast("array<struct<key:bigint,at:int,before:array<bigint>,between:array<bigint>>>")
    singles = F.when(to >= 1, F.transform(F.sequence(F.lit(1), F.greatest(to, F.lit(1))), single)).otherwise(none)
    second_last = F.least(n, last + 1)
    double = lambda k: lambda j: key(F.xxhash64(F.get("tokens", k - 1), F.get("tokens", j - 1)), k, ahead(j, k + 1))
    doubles = lambda k: F.when(k < second_last, F.transform(F.sequence(k + 1, F.greatest(second_last, k + 1)), double(k))).otherwise(none)
    frequent = F.when(F.col("rare") < last, F.flatten(F.transform(F.sequence(F.col("rare") + 1, F.greatest(last, F.col("rare") + 1)), doubles))).otherwise(none)
    return F.concat(singles, frequent)


def met(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b), some more than once, of those `signed` rows of both sides that meet under a key and that size, place and bitmap don't tell apart."""
    part = {**{f"w{k}": F.get("bits", F.lit(k)) for k in range(WORDS)}, **{f"{c}{k}": F.get(f"x.{c}", F.lit(k)) for c in ("before", "between") for k in range(LOOK)}}
    side = lambda df, s: df.select("id", "bits", F.size("tokens").alias("n"), F.explode(keys_of(least)).alias("x")).select("x.key", F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("x.at").alias(f"at_{s}"), *(v.alias(f"{c}_{s}") for c, v in part.items()))
    rows = side(left, "a").join(side(right, "b"), "key")
    total, apart = F.col("n_a") + F.col("n_b"), sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in range(WORDS)), F.lit(0))
    common = F.lit(least) * total / (1 + least) - 1e-9
    reach = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    # Where both have a token before the key's, they meet under that one too.
    earlier = F.lit(False)
    for c in ("before", "between"):
        for i in range(LOOK):
            for j in range(LOOK):
                earlier = earlier | (F.col(f"{c}{i}_a") == F.col(f"{c}{j}_b"))
    # A bit in which the bitmaps differ is a token of one set only.
    rows = rows.where((F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9) & (reach >= common) & (total - apart >= 2 * common))
    return rows.where(~F.coalesce(earlier, F.lit(False))).select("a", "b")


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) of at least that similarity, by the tokens of both sides (id, tokens)."""
    side = lambda df, s: df.select(F.col("id").alias(s), F.col("tokens").alias(f"tokens_{s}"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    rows = pairs.distinct().join(side(left, "a"), "a").join(side(right, "b"), "b")
    found = rows.select("a", "b", (common / (F.size("tokens_a") + F.size("tokens_b") - common)).alias("jaccard"))
    return found.where(F.col("jaccard") >= least - 1e-12)


def representative_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) with a < b of all pairs of different sets with at least that similarity, each by its representative."""
    rows = cut(signed(representatives(sets)))
    return compared(met(rows, rows, least).where("a < b"), rows, rows, least)


def linked(sets: DataFrame, least: float) -> DataFrame:
    """(id, representative, links) of all of sets (id, tokens): how many other ids have at least that similarity. An empty set is its own and has no link.

    Copies count as links, and are not spelled out: the rows are those of `sets`.
    """
    members = represented(sets)
    sizes = cut(members.groupBy("representative").agg(F.count(F.lit(1)).alias("n")), narrow=True)
    pairs = representative_pairs(sets, least)
    either = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", F.col("e.b").alias("representative"))
    others = either.join(sizes, "representative").groupBy(F.col("a").alias("representative")).agg(F.sum("n").alias("others"))
    found = members.join(sizes.join(others, "representative", "left"), "representative").select("id", "representative", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return found.unionByName(sets.where(~F.coalesce(F.size("tokens") > 0, F.lit(False))).select("id", F.col("id").alias("representative"), F.lit(0).cast("long").alias("links")))


def similar_pairs(sets: DataFrame, least: float, digits: int | None = None) -> DataFrame:
    """(a, b, jaccard) with a < b of all pairs of sets (id, tokens) with at least that similarity, rounded to `digits`; empty sets are in none.

    The rows grow with the square of a group of equal sets. `representative_pairs` and `represented` say the same without.
    Blocks of such a group's ids meet and are dealt out before their pairs are spelled out, so no task has a group to itself.
    """
    sets = cut(sets)
    place = F.row_number().over(Window.partitionBy("representative").orderBy("id"))
    blocks = represented(sets).withColumn("block", F.floor((place - 1) / BLOCK))
    blocks = cut(blocks.groupBy("representative", "block").agg(F.collect_list("id").alias("ids")), narrow=True)
    sizes = cut(blocks.groupBy("representative").agg(F.sum(F.size("ids")).alias("n")), narrow=True)
    own = sizes.where("n > 1").select(F.col("representative").alias("a"), F.col("representative").alias("b"), F.lit(1.0).alias("jaccard"))
    found = cut(representative_pairs(sets, least).unionByName(own), narrow=True)
    if digits is not None:
        found = found.withColumn("jaccard", F.round("jaccard", digits))
    side = lambda df, s: df.select(*(F.col(c).alias(s if c == "representative" else f"{c}_{s}") for c in df.columns))
    total = found.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism, -(-total // PAIRS_PER_TASK))
    met = found.join(side(blocks, "a"), "a").join(side(blocks, "b"), "b").where("a <> b or block_a <= block_b").repartition(tasks, "a", "b", "block_a", "block_b")
    each = met.select("a", "b", "jaccard", "ids_b", F.explode("ids_a").alias("id_a")).select("a", "b", "jaccard", "id_a", F.explode("ids_b").alias("id_b"))
    every = each.where((F.col("a") != F.col("b")) | (F.col("id_a") < F.col("id_b")))
    return every.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard")


def matches(new: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) for sets a of `new` and b of `stored`, both (id, tokens). Equal sets of a side are compared once."""
    sides = [representatives(side).select(F.struct(F.lit(k).alias("side"), "id").alias("id"), "tokens") for k, side in enumerate((new, stored))]
    rows = cut(signed(sides[0].unionByName(sides[1])))
    left, right = (rows.where(f"id.side = {k}").withColumn("id", F.col("id.id")) for k in (0, 1))
    found = compared(met(left, right, least), left, right, least)
    ours, theirs = (represented(side).select(F.col("representative").alias(s), F.col("id").alias(f"id_{s}")) for s, side in zip("ab", (new, stored)))
    return found.join(ours, "a").join(theirs, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "jaccard")
