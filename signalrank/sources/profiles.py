"""Configuration and feedback sources: interest phrases, code weights, votes, the personal library."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.operators.incremental import votes_of_export
from signalrank.operators.library import pivot_items
from signalrank.sources.feeds import file_order
from signalrank.sources.schemas import FEEDBACK


def interest_phrases(markdown: str, section: str = "## Topics of Interest") -> list[str]:
    """Phrases of a profile's section, split at commas, lower case, sorted. A profile is one small text read on the driver."""
    found: set[str] = set()
    inside = False
    for line in map(str.strip, markdown.splitlines()):
        if line.startswith(section):
            inside = True
        elif inside and line.startswith("##"):
            break
        elif inside:
            found |= {p for part in re.sub(r"^[-*]\s*", "", line).split(",") if (p := re.sub(r"\s+", " ", part.strip().lower()))}
    return sorted(found)


def code_weights(spark: SparkSession, text: str | None) -> tuple[DataFrame, float]:
    """((prefix, weight), default) of a JSON object; a missing or broken one has only the default."""
    try:
        data = json.loads(text) if text else {}
    except ValueError:
        data = {}
    default = float(data.pop("_default", 0.1))
    rows = [(str(k), float(v)) for k, v in data.items()]
    return spark.createDataFrame(rows, "prefix string, weight double"), default


def weights_json(weights: DataFrame, default: float) -> str:
    """The object that code_weights reads; one row for each code of a profile."""
    return json.dumps({"_default": default} | {r["code"]: r["weight"] for r in weights.orderBy("code").collect()}, indent=2)


def votes(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, interesting, at, seq) of an append-only JSON lines log; malformed lines go. seq follows the log."""
    rows = spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)
    return rows.where("paper_id is not null and interesting is not null").select("*", file_order().alias("seq"))


def imported(exports: DataFrame, log: DataFrame) -> DataFrame:
    """Votes of exports (value) that the log lacks by paper and time: importing again adds nothing, a changed vote is added."""
    found = votes_of_export(exports).dropDuplicates(["paper_id", "at"])
    return found.join(log.select("paper_id", "at"), ["paper_id", "at"], "left_anti").select("paper_id", "interesting", "at")


def library_items(values: DataFrame, kinds: list[str], fields: list[str] = ["title", "abstractNote", "DOI", "date"]) -> DataFrame:  # noqa: B006
    """Items of chosen kinds from (item_id, kind, field, value): one row each."""
    return pivot_items(values.where(F.col("kind").isin(kinds)), fields)


def library_corpus(items: DataFrame, most: int, least_chars: int = 20) -> DataFrame:
    """(item_id, text) of the newest items (item_id, title, abstract, date_added) with enough text."""
    rows = items.withColumn("text", F.trim(F.concat_ws(". ", "title", "abstract"))).where(F.length("text") >= least_chars)
    return rows.orderBy(F.desc("date_added"), "item_id").limit(most).select("item_id", "text")
