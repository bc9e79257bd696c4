"""Upserts by merge-on-read: a table of a base and of small deltas, merged when it is read.

A batch writes its own rows only, one folder a batch, so what an upsert costs does not grow with the table.
``read`` takes the base without the keys of newer deltas, and of these the newest row a key; ``compact`` writes a new
base. Nothing is renamed or replaced: a folder counts once Spark has marked it as complete, so a reader
meets the table before or after a write, and a run that was cut off leaves nothing that counts. A batch that comes
again (same source, same number) writes the same folder again, or nothing if a base holds it already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources.scratch import file_state
from graphloom.sources.writers import upsert


@dataclass(frozen=True)
class MergedTable:
    """The table at ``path`` with rows of ``schema``, one for each value of ``keys``; of rows of one key in one batch
    the last by ``order`` counts, or any one."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: str | None = None

    def _folders(self, kind: str) -> list[tuple[int, str, int, str]]:
        """(number, source, batch, path) of the complete folders of a kind, in order."""
        out = []
        for name, _, _ in file_state(self.spark, self.path):
            parts = name.split("-")
            if parts[0] == kind and any(x[0] == "_SUCCESS" for x in file_state(self.spark, f"{self.path}/{name}")):
                out.append((int(parts[1]), parts[2], int(parts[3]), f"{self.path}/{name}"))
        return sorted(out)

    def _base(self) -> tuple[int, dict[str, int], str | None]:
        """The number up to which the newest base holds deltas, its last batch of each source, its folder."""
        done = self._folders("done")  # written after the rows it speaks of
        if not done:
            return -1, {}, None
        number, _, _, path = done[-1]
        rows = self.spark.read.schema("source string, batch long").parquet(path).collect()  # a row for each source
        return number, {r["source"]: r["batch"] for r in rows}, f"{self.path}/base-{number}-all-0"

    def write(self, batch: DataFrame, source: str = "", number: int | None = None) -> None:
        """Upsert a batch; ``source`` and ``number`` tell a batch that comes again."""
        name = hashlib.sha256(source.encode()).hexdigest()[:16]
        held, done, _ = self._base()
        deltas = self._folders("delta")
        if number is None:
            number = max([b for _, s, b, _ in deltas if s == name] + [done.get(name, -1)], default=-1) + 1
        if number <= done.get(name, -1):
            return
        again = [p for _, s, b, p in deltas if (s, b) == (name, number)]
        to = again[0] if again else f"{self.path}/delta-{max([n for n, *_ in deltas] + [held], default=-1) + 1}-{name}-{number}"
        upsert(batch.limit(0), batch.select(*self.schema.names), list(self.keys), self.order).write.mode("overwrite").parquet(to)

    def read(self) -> DataFrame:
        held, _, base = self._base()
        out = self.spark.read.schema(self.schema).parquet(base) if base else self.spark.createDataFrame([], self.schema)
        newer = [(n, p) for n, _, _, p in self._folders("delta") if n > held]
        if not newer:
            return out
        parts = [self.spark.read.schema(self.schema).parquet(p).withColumn("_n", F.lit(n)) for n, p in newer]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "_n").alias("r")).select("r.*")
        return upsert(out, newest, list(self.keys)).select(*self.schema.names)

    def compact(self) -> None:
        """Merge all deltas into a new base; readers of the old one are not disturbed, ``clean`` removes what is out of use."""
        held, done, _ = self._base()
        deltas = [d for d in self._folders("delta") if d[0] > held]
        if not deltas:
            return
        number = deltas[-1][0]
        for _, source, batch, _ in deltas:
            done[source] = max(batch, done.get(source, -1))
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{number}-all-0")
        self.spark.createDataFrame(sorted(done.items()), "source string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done-{number}-all-0")

    def clean(self) -> None:
        """Delete bases and deltas that the newest base has replaced; for when no reader is at work on them."""
        held, _, base = self._base()
        jvm = self.spark._jvm
        for kind in ("delta", "base", "done"):
            for number, _, _, path in self._folders(kind):
                if base and (number <= held if kind == "delta" else number < held):
                    at = jvm.org.apache.hadoop.fs.Path(path)
                    at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def stream(self, rows: DataFrame, checkpoint: str, compact_every: int = 50, then: Callable[[DataFrame, int], None] | None = None):
        """A stream of upserts, a delta for each micro-batch, compacted after so many."""

        def write(batch: DataFrame, number: int) -> None:
            self.write(batch, checkpoint, number)
            if (number + 1) % compact_every == 0:
                self.compact()
            if then:
                then(batch, number)

        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
