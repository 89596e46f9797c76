"""Collector jobs: landed items are parsed, the bad ones put aside with a reason, the good ones ingested, and the run logged.

One run changes the store's tables, the quarantine, the run log and the marks in one version, so a run that dies leaves
nothing behind, and a batch that comes again is recognised. Counts come from metrics that Spark observes while it writes,
not from passes of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from signalrank.operators import ingest, resolve, store
from signalrank.operators.match_index import BY, TitleIndex
from signalrank.operators.versions import Tables
from signalrank.session import cut, scratch

#: An item as collectors hand it over, one JSON object a row.
ITEM = (
    "title string, authors array<string>, abstract string, doi string, url string, published_at string, paper_type string, jel_codes array<string>, keywords array<string>, "
    "affiliations array<string>, source_id string, source_url string"
)
SCHEMAS = {
    "papers": "id long, title string, doi string, abstract string, url string, published_at string, paper_type string, jel_codes array<string>, keywords array<string>",
    "sources": "source string, source_id string, paper_id long, source_url string, raw_metadata string",
    "authors": "author_id long, name string, name_normalized string, affiliation string",
    "links": "paper_id long, author_id long, position int",
    "runs": "sensor string, watch string, started_at timestamp, finished_at timestamp, status string, items_found long, items_new long, error string",
    "quarantine": "sensor string, run_at timestamp, seq long, reason string, value string",
    "marks": "key string, mark string",
}
_BAD = "_corrupt_record"


def judged(landed: DataFrame) -> DataFrame:
    """landed (seq, value) with `item`, the fields of ITEM, and `reason`, why it can't be ingested: null for good ones.

    Reasons are empty, malformed (no JSON object of these types), no title and no source_id.
    """
    item = F.from_json("value", f"{ITEM}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD})
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = (
        F.when(blank(F.col("value")), "empty").when(F.col("item").isNull() | F.col(f"item.{_BAD}").isNotNull(), "malformed")
        .when(blank(F.col("item.title")), "no title").when(blank(F.col("item.source_id")), "no source_id")
    )
    return landed.select("seq", "value", item.alias("item")).withColumn("reason", reason).withColumn("item", F.col("item").dropFields(_BAD))


def batch_of(good: DataFrame, sensor: str, first_id: int) -> DataFrame:
    """Records for `ingest`, numbered from first_id on in the order of seq."""
    lists = {c: F.coalesce(f"item.{c}", F.array().cast("array<string>")).alias(c) for c in ("authors", "jel_codes", "keywords", "affiliations")}
    plain = [F.col(f"item.{c}") for c in ("title", "doi", "abstract", "url", "published_at", "paper_type", "source_id", "source_url")]
    return good.select((F.col("seq") + first_id).alias("id"), *plain, *lists.values(), F.lit(sensor).alias("source"), F.col("value").alias("raw_metadata"))


def run(tables: Tables, landed: DataFrame, sensor: str, watch: str, started: str, finished: str, marks: DataFrame | None = None, done: tuple[str, int] | None = None, failed: int = 0, index: TitleIndex | None = None) -> dict:
    """Ingests landed items (seq, value), seq being numbers from 0 on, none twice, and returns sensor, watch, status, found, new and errors.

    A failure of an item puts it into `quarantine`; a failure of the run changes nothing but the log, which gets its
    message. marks, where given, replaces the stored marks in the same version. done (stream, batch) makes the run one
    that counts once. failed counts requests that brought nothing: with any, the status is partial_success. index, a
    TitleIndex over the same tables, finds the stored papers and gets the entries of those that the run adds or changes.
    """
    spark = landed.sparkSession
    if done is not None and tables.is_done(*done):
        return {"sensor": sensor, "watch": watch, "status": "repeated", "found": 0, "new": 0, "errors": 0}
    log = lambda status, found, new, error=None: store.run_log(spark, sensor, watch, started, finished, status, found, new, error)
    try:
        with scratch(spark):
            seen, placed = Observation(), Observation()
            rows = cut(judged(landed).observe(seen, F.count(F.lit(1)).alias("found"), F.count("reason").alias("errors")))
            held = tables.manifest()
            stored = ingest.Store(*(tables.read(n, SCHEMAS[n], held) for n in ingest.Store._fields))
            first_id = (stored.papers.agg(F.max("id")).first()[0] or 0) + 1
            changes = ingest.changes(batch_of(rows.where("reason is null"), sensor, first_id), stored, index and index.match)
            went = cut(changes.went.observe(placed, F.count_if("is_new").alias("new")), narrow=True)
            found, errors, new = seen.get["found"], seen.get["errors"], placed.get["new"]
            bad = rows.where("reason is not null").select(F.lit(sensor).alias("sensor"), F.lit(started).cast("timestamp").alias("run_at"), "seq", "reason", "value")
            status = "partial_success" if failed else "success"
            appended = {"sources": changes.sources, "links": changes.links, "quarantine": bad, "runs": log(status, found, new)}
            replaced = {"papers": changes.papers, "authors": changes.authors} | ({"marks": marks} if marks is not None else {})
            if index is not None:
                touched = changes.papers.join(went.select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi")
                appended["entries"] = index.entries(ingest.named(touched, changes.authors, stored.links.unionByName(changes.links)))
            tables.publish(replaced, appended, done, by=BY)
            return {"sensor": sensor, "watch": watch, "status": status, "found": found, "new": new, "errors": errors + failed}
    except Exception as error:
        message = str(error).split("\n")[0][:1000]
        tables.publish(append={"runs": log("error", 0, 0, message)})
        return {"sensor": sensor, "watch": watch, "status": "error", "found": 0, "new": 0, "errors": 0, "error_message": message}


#: When a key's mark moves: its requests all came back; any of them did; any of them brought rows.
RULES: dict[str, Callable[[], Column]] = {
    "success": lambda: F.coalesce(F.bool_and("ok"), F.lit(False)), "page": lambda: F.coalesce(F.bool_or("ok"), F.lit(False)), "rows": lambda: F.coalesce(F.bool_or(F.col("ok") & (F.col("rows") > 0)), F.lit(False)),
}


def moved(marks: DataFrame, responses: DataFrame, rule: str, mark: Column) -> DataFrame:
    """marks (key, mark) after responses (key, ok, rows): keys that the rule lets through get `mark` if it is later, all others keep what they have."""
    through = responses.groupBy("key").agg(RULES[rule]().alias("through")).where("through").select("key", mark.cast("string").alias("mark"))
    return marks.select("key", "mark").unionByName(through).groupBy("key").agg(F.max("mark").alias("mark"))


def collected(responses: DataFrame, parse: Callable[[DataFrame], DataFrame], order: tuple[str, ...] = ("turn", "page"), keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What the responses of one collect bring: items (seq, value) for `run`, and answers (key, ok, rows) for `moved`.

    responses: (key, turn, page, ok, value): turn is the key's place among the keys asked, so of items that several keys
    or pages bring the one of the earliest stays. parse takes rows (key, turn, page, value) and gives papers with the
    columns key, turn and page and what else `order` names; keep leaves out some of them before one is chosen.
    """
    papers = parse(responses.where("ok").select("key", "turn", "page", "value"))
    papers = cut(papers if keep is None else papers.where(keep))
    counts = papers.groupBy("key", "turn", "page").agg(F.count(F.lit(1)).alias("rows"))
    answers = responses.select("key", "turn", "page", "ok").join(counts, ["key", "turn", "page"], "left").select("key", "ok", F.coalesce("rows", F.lit(0)).alias("rows"))
    firsts = resolve.keep_first(papers.withColumn("_order", F.struct(*order)), "source_id", "_order")
    return numbered(firsts, "_order"), answers


def numbered(papers: DataFrame, order: str) -> DataFrame:
    """(seq, value) for papers, seq growing with `order`: a range sort, then places within partitions, so no task gets all rows."""
    names = [c.split(" ")[0] for c in ITEM.split(", ")]
    there = [F.col(c) if c in papers.columns else F.lit(None).alias(c) for c in names]
    return cut(papers.orderBy(order).select(F.monotonically_increasing_id().alias("seq"), F.to_json(F.struct(*there)).alias("value")))
