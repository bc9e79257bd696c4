"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ship

#: Records per Arrow batch for text columns: a batch of long documents must fit a small worker.
TEXT_BATCH = "256"
_own = ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set (tests)."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own = _own or tempfile.mkdtemp(prefix="graphloom-")
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    The table survives lost executors. It stays until ``spark.checkpoint.dir`` is emptied.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Before Python functions over texts: send the package, bound what one Arrow batch can hold."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH)


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers are reused for many blocks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(made: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``made``, a function over the batches of a task, and ``trim`` when its own tables are gone."""

    @functools.wraps(made)
    def run(batches: Iterator) -> Iterator:
        yield from made(batches)
        trim()

    return run


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; False for a null id."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.pmod(crc, F.lit(4)) == 2) & doc_id.isNotNull()
