"""A data source for one's own document loaders: ``spark.read.format("documents")``.

A loader is a function of this process's modules, named ``module:function``, that yields
(path, text) for one of the option ``paths`` (separated by ``;``); each path is a partition.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Path(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.loader, self.paths = options["loader"], [p for p in options["paths"].split(";") if p]

    def partitions(self) -> list[_Path]:
        return [_Path(p) for p in self.paths]

    def read(self, partition: _Path) -> Iterator[tuple[str, str, str]]:
        module, _, name = self.loader.partition(":")
        for path, text in getattr(importlib.import_module(module), name)(partition.path):
            yield path, text, "custom"


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, text string, document_type string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
