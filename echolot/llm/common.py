"""What the operators of this subpackage share: tables, durable intermediate results, batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and the session is of one machine, as in tests, is a folder
    of our own made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="echolot-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage, survives the loss of any executor, is compressed, and
    lets later readers take single columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if urlparse(path).scheme in ("", "file"):
        atexit.register(shutil.rmtree, urlparse(path).path, True)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, on whatever file system, once nothing is to read it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``limit``; a larger row comes alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_batches(batches, key: str, text: str, limit: int = 1 << 20):
    """From Arrow batches, (keys, texts) in pieces of about ``limit`` bytes; a null text is empty."""
    for batch in batches:
        column = batch.column(text)
        for a, b in slices(byte_sizes(column), limit):
            yield batch.column(key).slice(a, b - a), ["" if t is None else t for t in column.slice(a, b - a).to_pylist()]
        del column, batch
        tidy()


def byte_sizes(column) -> list[int]:
    return pc.add(pc.fill_null(pc.binary_length(column), 0), 1).to_pylist()


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library, which has no such call

    def _trim(_: int) -> None:
        pass


def tidy() -> None:
    """Gives freed memory back to the system: workers live on, and the next ones need it."""
    pa.default_memory_pool().release_unused()
    _trim(0)


_kept: dict[str, tuple] = {}


def cached(kind: str, name, build):
    """What ``build`` makes, kept by a worker process for its next tasks until another name of that kind is asked for."""
    if kind not in _kept or _kept[kind][0] != name:
        _kept[kind] = name, build()
    return _kept[kind][1]


def fresh(name: str, columns) -> str:
    """``name``, with underscores before it until it clashes with no column, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the names that an operator works with; all others are left out."""
    return df.select(*(F.col(f"`{source}`").alias(alias) for alias, source in columns.items()))
