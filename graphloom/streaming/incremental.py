"""Structured Streaming: event-time windows, and chapter by chapter upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.writers import recover, upsert, write_table


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None, at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """start, by, n, total of batch or streaming events; ``late`` is the watermark of a stream."""
    rows = events.withWatermark(at, late) if late else events
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counted = rows.groupBy(window.alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", at: str = "ts", key: str = "user_id", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    counted = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None, then: Callable[[DataFrame, int], None] | None = None):
    """Each micro-batch replaces the rows of its keys in the table at ``path``; idempotent on replay."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        recover(spark, path)
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        there = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
        new = batch.dropDuplicates(keys) if order is None else batch
        write_table(upsert(spark.read.parquet(path), new, keys, order) if there else upsert(new.limit(0), new, keys, order), path)
        if then:
            then(batch, epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
