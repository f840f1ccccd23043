"""A Python data source that pages through recorded answers: options path, pattern, cursor and limit.

``spark.read.format("recorded_pages")`` gives one row per page (page, cursor, body); partitions are files, so pages are
read by executors. Register it with ``register(spark)``.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAX_PAGES = 10


class _Page(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        super().__init__(number)
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.pattern = options["path"], options.get("pattern", "*.json")
        self.cursor, self.limit = options.get("cursor", ""), int(options.get("limit", MAX_PAGES))

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.root, self.pattern)))
        after = [f for f in files if os.path.basename(f) > self.cursor]
        return [_Page(i, f) for i, f in enumerate(after[: self.limit])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            body = f.read()
        json.loads(body)  # a page that is no JSON fails its source, not silently its rows
        yield partition.number, os.path.basename(partition.path), body


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "page int, cursor string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPages)
