"""Spark session defaults and small helpers shared by queries and tests."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "signalrank", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; `conf` overrides single settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. A temporary one where that is unset and Spark is local, as in tests; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


class _Scopes(threading.local):
    def __init__(self):
        self.paths: list[list[str]] = []


_scopes = _Scopes()


#: Tables of narrow rows are written in at most this many files for each core.
FILES_PER_CORE = 2


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """`df` written as a table to the shared checkpoint folder and read again, so that later steps neither run it again nor depend on executors.

    narrow: its rows are ids, counts or the like, so that a file for each partition would be a small one.
    """
    if narrow:
        df = df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if _scopes.paths:
        _scopes.paths[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Removes the tables that `cut` writes inside, when it ends. It yields a `cut` whose table stays, for the result."""
    paths: list[str] = []
    _scopes.paths.append(paths)

    def kept(df: DataFrame, narrow: bool = False) -> DataFrame:
        held = _scopes.paths.pop()
        try:
            return cut(df, narrow)
        finally:
            _scopes.paths.append(held)

    try:
        yield kept
    finally:
        _scopes.paths.remove(paths)
        for path in paths:
            remove(spark, path)


#: Tables of up to this many bytes in memory are broadcast; a row counts ROW_BYTES and its fields.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 40


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether the measured size of `df` is at most `most` bytes. It should be a written table, as it is read for that."""
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    many = [c for c, kind in df.dtypes if kind == "array<bigint>"]
    fixed = ROW_BYTES + 8 * (len(df.columns) - len(wide) - len(many)) + 16 * (len(wide) + len(many))
    sizes = [F.sum(F.octet_length(c)) for c in wide] + [F.sum(8 * F.size(c).cast("long")) for c in many]
    found = df.agg(F.count(F.lit(1)), *sizes).first()
    return found[0] * fixed + sum(x or 0 for x in found[1:]) <= (BROADCAST_BYTES if most is None else most)


def sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df`, a written table, marked for broadcast where it `fits`."""
    return F.broadcast(df) if fits(df, most) else df


#: Rows and bytes of an Arrow batch, and rows of a Parquet batch, at most, so that memory does not follow the length of texts.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 1000, "8m", 512
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", BATCH_BYTES),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", str(READ_ROWS)),
}


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds batches for operators over long texts, for the session: Spark has no such setting for one read. Settings that the user changed from Spark's own stay."""
    for key, (default, wanted) in _BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, wanted)
    return spark
