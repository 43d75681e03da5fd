"""What the operators share: shared scratch tables, bounded Arrow batches, null-safe input frames, joins with hot keys.

``bound_batches`` sets the session's two Arrow batch settings and leaves them so: plans are lazy, and the settings
must hold when they run.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch hands to a Python worker.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
#: Short rows of a scratch file, and the fewest files.
FILE_ROWS, FILES = 250_000, 12
#: A key with more than one in ``HOT`` of all rows is hot, so there are ``HOT`` hot keys at most; and fewer rows than that aren't.
HOT, HOT_LEAST = 1_000, 100

_OWN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A temporary one only where that is unset and
    driver and executors are one process; elsewhere it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='textward-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str = "part", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and losing an executor
    loses nothing. The files go by ``discard`` or when the driver's Python ends. With ``rows``, about how many short
    rows it has, it is written in no more files than these need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(FILES + rows // FILE_ROWS)
    path = f"{shared_dir(spark)}/textward/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _OWN:
        atexit.register(_sweep)
    _OWN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no plan reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path in _OWN:
            _delete(path, _OWN.pop(path))


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The scratch tables that the block makes go at its end, but those it puts into the list."""
    before, kept = set(_OWN), []
    yield kept
    for path in set(_OWN) - before - {getattr(df, "_scratch", None) for df in kept}:
        _delete(path, _OWN.pop(path))


def _sweep() -> None:
    for path, spark in _OWN.items():
        try:
            _delete(path, spark)
        except Exception:  # the session has ended: its cluster clears the shared folder
            return


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """At the end of a task: give memory that Arrow's pool and the allocator hold back to the system, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and ``trim`` behind the last."""
    yield from batches
    trim()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` never null, and ``more`` columns; other columns go, so clashing names can't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that none of ``taken`` has, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def join_keys(rows: DataFrame, per_key: DataFrame, keys: list[str], counts: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` joined with ``per_key``, a written table with one row a key and as ``n`` how many rows the key has
    (``counts``: their sum and the greatest, if at hand); without ``n``.

    Rows of hot keys, which are ``HOT`` at most, meet a broadcast and stay where they are; the others are shuffled.
    """
    total, most = counts or per_key.agg(F.sum("n"), F.max("n")).first()
    least = max(HOT_LEAST, (total or 0) // HOT)
    if (most or 0) <= least:
        return rows.join(per_key.drop("n"), keys)
    hot, cold = per_key.where(F.col("n") > least).drop("n"), per_key.where(F.col("n") <= least).drop("n")
    met = rows.join(F.broadcast(hot), keys)
    return met.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
