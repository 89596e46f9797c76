"""A personal library that another program keeps in an SQLite file: a data source for its tables, and the library from them.

The file is opened read-only and as it is; it must be readable at its path on every executor. A table is read in ranges of
its row ids, one a partition, and only in the columns asked for; a view has no row ids and is one partition. Joins are
Spark's.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from signalrank.operators import library

# Item types that are no works, and fields of a work.
NO_WORKS = ["attachment", "annotation", "note"]
FIELDS = ["title", "abstractNote", "DOI", "date"]
LEAST_TEXT = 20


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteTable(DataSource):
    """Format "sqlite_table", with options path, table, columns (comma-separated; all when left out) and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with closing(_open(self.options["path"])) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        kinds = {row[1]: LongType() if "INT" in row[2].upper() else DoubleType() if row[2].upper() in ("REAL", "DOUBLE", "FLOAT") else StringType() for row in found}
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or list(kinds)
        if missing := [c for c in wanted if c not in kinds]:
            raise ValueError(f"{self.options['table']} has no column {', '.join(missing)}")
        return StructType([StructField(c, kinds[c]) for c in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(dict(self.options), schema)


class _TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "1"))
        self.columns = [f.name for f in schema.fields]
        self.casts = [{LongType: int, DoubleType: float}.get(type(f.dataType), str) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with closing(_open(self.path)) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                low = None
        if low is None:  # a view, or nothing
            return [_Range(None, None)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(start, min(start + step - 1, high)) for start in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        asked = f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)}"
        bounds: tuple = ()
        if partition.low is not None:
            asked, bounds = f"{asked} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)
        with closing(_open(self.path)) as con:
            for row in con.execute(asked, bounds):
                yield tuple(None if v is None else cast(v.decode("utf-8", "replace") if isinstance(v, bytes) else v) for v, cast in zip(row, self.casts))


def table_of(spark: SparkSession, path: str, table: str, columns: list[str], partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, columns=",".join(columns), partitions=str(partitions)).load()


def library_items(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """(item_id, type, date_added, title, abstract, doi, date) of the library's works that have a title."""
    get = lambda table, *columns: table_of(spark, path, table, list(columns), partitions)
    items = get("items", "itemID", "itemTypeID", "dateAdded").join(get("itemTypes", "itemTypeID", "typeName"), "itemTypeID").where(~F.col("typeName").isin(NO_WORKS))
    values = get("itemData", "itemID", "fieldID", "valueID").join(get("fieldsCombined", "fieldID", "fieldName").where(F.col("fieldName").isin(FIELDS)), "fieldID").join(get("itemDataValues", "valueID", "value"), "valueID")
    wide = library.pivot_items(values.select(F.col("itemID").alias("item_id"), F.col("fieldName").alias("field"), "value"), FIELDS)
    found = items.join(wide, F.col("itemID") == F.col("item_id")).where("title is not null")
    return found.select("item_id", F.col("typeName").alias("type"), F.try_to_timestamp(F.substring("dateAdded", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("date_added"), "title", F.col("abstractNote").alias("abstract"), F.col("DOI").alias("doi"), "date")


def library_creators(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """(item_id, position, name) of the library's items, names of two parts joined; nameless ones go."""
    get = lambda table, *columns: table_of(spark, path, table, list(columns), partitions)
    part = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    names = get("itemCreators", "itemID", "creatorID", "orderIndex").join(get("creators", "creatorID", "firstName", "lastName"), "creatorID")
    return names.select(F.col("itemID").alias("item_id"), F.col("orderIndex").alias("position"), F.concat_ws(" ", part(F.col("firstName")), part(F.col("lastName"))).alias("name")).where("name <> ''")


def library_corpus(items: DataFrame) -> DataFrame:
    """(item_id, title, abstract, text, date_added) of works with enough text to compare others with."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = items.select("item_id", clean(F.col("title")).alias("title"), clean(F.col("abstract")).alias("abstract"), "date_added")
    return rows.withColumn("text", F.trim(F.concat_ws(" ", "title", F.nullif("abstract", F.lit(""))))).where(F.length("text") >= LEAST_TEXT).select("item_id", "title", "abstract", "text", "date_added")
