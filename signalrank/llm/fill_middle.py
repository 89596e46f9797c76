"""Fill-in-the-middle rewriting of documents, with cuts found in run-length class encodings of their texts.

A text is stored as its maximal runs of one character class (white space or not) with, for each run, its first code
point and the units that end up to it. A cut after k units is found by binary search for the run that holds the k-th
unit; its place inside the run follows by arithmetic, so no list of units is ever built. Units are "word" (a run of other
characters with the white space before it; white space at the end is one more) or "char" (each code point).

Cuts and forms are drawn from a hash of seed and doc_id, so a retried task and a repeated row give the same output.
Texts that hold a sentinel, empty and null texts stay plain. A null doc_id is hashed as no digits. Texts of any length
are cut whole. Rows that repeat are each rewritten; an empty table gives none. Only the id and the text are read, so
other columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalrank.session import small_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents, so many are rewritten, and of 100 rewritten ones so many have their suffix first.
FIM_RATE, SPM_RATE = 50, 80


class ClassRuns:
    """Maximal runs of white space and of other characters: `starts` of the runs and the end, `ends` units that end up to each run."""

    def __init__(self, text: str, unit: str = "word"):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.starts = np.concatenate(([0], edges, [len(points)])) if len(points) else np.zeros(1, np.int64)
        lengths = np.diff(self.starts)
        if unit == "char":
            self.per_run = lengths
        else:
            self.per_run = (~blank[self.starts[:-1]]).astype(np.int64)
            self.per_run[-1:] = 1  # a run at the end ends a unit, of whatever class it is
        self.ends = np.cumsum(self.per_run)

    @property
    def units(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def offset(self, k: int) -> int:
        """Code points up to the end of the k-th unit."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.ends, k))
        size = int(self.starts[run + 1] - self.starts[run]) // int(self.per_run[run])  # code points of a unit of this run
        return int(self.starts[run + 1]) - (int(self.ends[run]) - k) * size


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 for each document: the first groups of eight digits of a hash of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def rewrite(text: str, h: tuple[int, int, int, int], unit: str = "word", fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, prefix code points, middle code points, output) of one text."""
    runs = ClassRuns(text, unit)
    n = runs.units
    if n == 0 or h[2] % 100 >= fim_rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (runs.offset(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "word", seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output."""
    if unit not in ("word", "char"):
        raise ValueError(f"unknown unit: {unit}")
    small_batches(docs.sparkSession)
    own_id = F.col(id_col).cast("long")
    rows = docs.select(own_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(own_id, seed))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = zip(*(batch.column(f"h{k}").to_pylist() for k in range(4)))
            made = [rewrite(text.as_py(), h, unit, fim_rate, spm_rate) for text, h in zip(batch.column("text"), hashes)]
            columns = [list(c) for c in zip(*made)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:]))], schema=_SCHEMA)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of `transform` was made from. Rewritten texts hold no sentinel, so the three found are its own."""
    parts = F.split(output, "<[PSM]>")  # an empty part, then the three in the order of the form
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


#: Cuts by lists of units, where the operator searches runs.
SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM docs
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
