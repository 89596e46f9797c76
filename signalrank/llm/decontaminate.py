"""Benchmark decontamination over a distributed positional inverted index.

Every window of ten consecutive item words (a shorter item is one window) is looked up by its rarest terms, rare by their
number in all documents. The postings of those terms (term, document, positions) are stored as a table. For each window
the list of its rarest term comes first; those of its next ANCHORS - 1 terms are intersected with it, each shifted by the
term's place in the window; what is left is compared word by word. `proximity` intersects the stored lists of all terms
of a query and finds the places where they stand in any order within a span.

Null and empty texts have no words and no hits; very long texts are read whole. Items without words hold no window. A
window of several items counts for each. Rows that repeat doc_id and text each get their result; doc_id may be null. An
empty table of documents gives an empty report, one of items no hit. Only id and text columns are read, so other columns
of any name do no harm. Nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import cut, fits, scratch, sized, small_batches, table

WINDOW = 10
#: Terms of a window whose posting lists are stored and intersected.
ANCHORS = 2
#: Windows whose words take up to this many bytes are broadcast; beyond it postings meet the windows in a shuffle join.
MAX_BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, items): the distinct windows and the ids of the items that hold each."""
    n = F.size("words")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).when(n > 0, F.array(F.lit(0)))
    return (
        items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
        .select("item", "words", F.explode(starts).alias("start"))
        .groupBy(F.slice("words", F.col("start") + 1, window).alias("win")).agg(F.collect_set("item").alias("items"))
    )


def term_counts(docs: DataFrame, terms: DataFrame, small: bool, text_col: str = "text") -> DataFrame:
    """(term, n): how often each of `terms` occurs in all of `docs`."""
    every = docs.select(F.explode(words_of(F.col(text_col))).alias("term"))
    if small:
        return every.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")


def anchors(windows: DataFrame, counts: DataFrame, most: int = ANCHORS) -> DataFrame:
    """(win, items, anchors): each window with its rarest terms as (n, at, term), rarest first; windows with a term that no document has are left out."""
    each = windows.select("win", "items", F.posexplode("win").alias("at", "term")).join(counts, "term", "left")
    lists = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("lists")
    return each.groupBy("win").agg(lists, F.first("items").alias("items")).where("lists[0].n > 0").select("win", "items", F.slice("lists", 1, most).alias("anchors"))


def postings(docs: DataFrame, terms: DataFrame, small: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, text_hash, n_words, copies, places): where each of `terms` stands in each document, counted from 1.

    The empty term has a row for every document, with the number of rows that repeat it.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    every = own.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("place", "term"))
    if small:
        wanted = terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
        found = every.join(F.broadcast(wanted), "term")
    else:  # the empty term would be a key with a row of every document
        found = every.where("place > 0").join(terms.select("term"), "term").unionByName(every.where("place = 0").select("term", *(c for c in every.columns if c != "term")))
    copies = F.count_if(F.col("place") == 0)
    return found.groupBy("term", "doc_id", "text_hash", "n_words").agg(copies.alias("copies"), F.array_sort(F.collect_set("place")).alias("places"))


def candidates(stored: DataFrame, index: DataFrame, most: int = ANCHORS, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, win, items, start): the places where the lists of a window's anchors meet, shifted by their places in it."""
    lists = stored.where("term <> ''")
    first, size = F.col("anchors")[0], F.size("win")
    shifted = F.transform("places", lambda p: p - F.col("anchors")[0]["at"])
    found = lists.join(sized_index(index, max_broadcast), lists["term"] == first["term"]).select(
        "doc_id", "text_hash", "win", "items", "anchors", F.explode(F.filter(shifted, lambda s: (s >= 1) & (s + size - 1 <= F.col("n_words")))).alias("start")
    )
    for k in range(1, most):
        anchor = F.get("anchors", F.lit(k))
        other = lists.select(F.col("term").alias("term_k"), F.col("doc_id").alias("id_k"), F.col("text_hash").alias("hash_k"), F.col("places").alias("places_k"))
        at = (F.col("term_k") == anchor["term"]) & F.col("id_k").eqNullSafe(F.col("doc_id")) & (F.col("hash_k") == F.col("text_hash"))
        met = F.array_contains("places_k", F.col("start") + anchor["at"])
        found = found.join(other, at, "left").where((F.size("anchors") <= k) | F.coalesce(met, F.lit(False))).drop("term_k", "id_k", "hash_k", "places_k")
    return found.drop("anchors")


def sized_index(index: DataFrame, most: int) -> DataFrame:
    """The windows' index (a written table), marked for broadcast where its words and items are few."""
    row = index.agg(F.sum(F.length(F.concat_ws(" ", "win")) + 40 * F.size("win") + 60 * F.size("anchors") + 20 * F.size("items"))).first()[0] or 0
    return F.broadcast(index) if row <= most else index


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(stored, found): the index, and (doc_id, text_hash, hits) of documents with occurrences; hits: array of (start, length, items), start from 1."""
    most = MAX_BROADCAST_BYTES if max_broadcast is None else max_broadcast
    windows = cut(windows_of(items, window=window), narrow=True)
    terms = cut(windows.select(F.explode("win").alias("term")).distinct(), narrow=True)
    small = fits(terms, most)
    index = cut(anchors(windows, term_counts(docs, terms, small, text_col)), narrow=True)
    rare = cut(index.select(F.explode("anchors.term").alias("term")).distinct(), narrow=True)
    stored = cut(postings(docs, rare, fits(rare, most), id_col, text_col))
    asked = cut(candidates(stored, index, max_broadcast=most).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("win", "items", "start")).alias("asked")), narrow=True)
    places = asked.select(F.col("doc_id").alias("asked_id"), F.col("text_hash").alias("asked_hash"))
    places = F.broadcast(places) if fits(places, most) else places
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    texts = own.join(places, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_hash") == F.col("asked_hash")), "left_semi")
    both = texts.alias("d").join(asked.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.text_hash") == F.col("a.text_hash")))
    # Inside the lambda a text's words are made once, not for every window that is asked for.
    true = F.get(F.transform(F.array(words_of(F.col("d.text"))), lambda words: F.filter("asked", lambda x: F.slice(words, x["start"], F.size(x["win"])) == x["win"])), F.lit(0))
    rows = both.select("d.doc_id", "d.text_hash", true.alias("true"))
    hits = F.transform("true", lambda x: F.struct(x["start"].alias("start"), F.size(x["win"]).alias("length"), x["items"].alias("items")))
    return stored, rows.select("doc_id", "text_hash", hits.alias("hits")).where(F.size("hits") > 0).dropDuplicates(["doc_id", "text_hash"])


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and text_hash, xxhash64 of the text).

    Tables of more than max_broadcast bytes are not broadcast but joined by shuffles.
    """
    with scratch(small_batches(docs.sparkSession)) as kept:
        stored, found = matches(docs, items, window, max_broadcast, id_col, text_col)
        spans = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length")))))
        covered = F.aggregate(
            spans,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, s: F.struct(
                (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
                F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            ),
            lambda acc: acc["n"],
        )
        ids = F.array_sort(F.array_distinct(F.flatten("hits.items")))
        hit = sized(cut(found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), covered.alias("hit"), F.size(ids).alias("n_ids"), F.sha2(F.concat_ws(",", ids), 256).alias("sha")), narrow=True))
        at = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
        every = stored.where("term = ''").join(hit, at, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        return kept(every.select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_ids", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"), "text_hash",
        ), narrow=True)


def proximity(docs: DataFrame, queries: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, start): places, from 0, where all distinct words of a query stand, in any order, in the `span` words from there on.

    queries: (query_id, text). The lists of the rarest term come first; each other term's list is then intersected by document.
    """
    with scratch(small_batches(docs.sparkSession)) as kept:
        asked = cut(queries.select("query_id", F.array_distinct(words_of(F.col("text"))).alias("want")).where(F.size("want") > 0))
        terms = cut(asked.select(F.explode("want").alias("term")).distinct())
        small = fits(terms)
        stored = cut(postings(docs, terms, small, id_col, text_col).where("term <> ''"))
        counts = stored.groupBy("term").agg(F.sum(F.size("places")).alias("n"))
        each = asked.select("query_id", F.explode("want").alias("term"), F.size("want").alias("wanted")).join(counts, "term")
        rarest = each.groupBy("query_id", "wanted").agg(F.min(F.struct("n", "term"))["term"].alias("rare"), F.count(F.lit(1)).alias("known")).where("known = wanted")
        first = stored.select(F.col("term").alias("rare"), "doc_id", "text_hash", F.col("places").alias("rare_places")).join(rarest, "rare")
        same = F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.text_hash") == F.col("s.text_hash")) & (F.col("f.term") == F.col("s.term"))
        lists = first.join(each.select("query_id", "term"), "query_id").alias("f").join(stored.alias("s"), same).select("query_id", "wanted", "rare_places", "f.doc_id", "f.text_hash", "s.places")
        every = lists.groupBy("query_id", "doc_id", "text_hash", "wanted", "rare_places").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == F.col("wanted"))
        # Starts are at or before a place of the rarest term; every list must have a place in the span.
        near = F.array_distinct(F.flatten(F.transform("rare_places", lambda p: F.sequence(F.greatest(F.lit(1), p - (span - 1)), p))))
        starts = F.filter(near, lambda s: F.forall("lists", lambda places: F.exists(places, lambda p: (p >= s) & (p < s + span))))
        return kept(every.select("query_id", "doc_id", F.explode(starts).alias("start")).select("query_id", "doc_id", (F.col("start") - 1).alias("start")).distinct())


def clean(docs: DataFrame, items: DataFrame, most: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those of which more than the share `most` of the words is hit; all columns kept."""
    bad = report(docs, items, id_col=id_col, text_col=text_col).where(F.col("contaminated") & (F.col("n_hit") > most * F.col("n_words")))
    bad = sized(cut(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), narrow=True))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("bad_hash")), "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS k, least(len(w), {WINDOW}) AS n FROM s),
l AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.k = g.k AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
