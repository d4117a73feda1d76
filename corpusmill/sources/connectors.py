"""Services that answer page by page, as a Spark data source.

A client is any picklable object with ``page(selector, cursor)`` that returns
(rows, next cursor or None). Each selector is one input partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedClient(Protocol):
    def page(self, selector: str, cursor: Any) -> tuple[list[dict], Any]: ...


def all_pages(client: PagedClient, selector: str) -> Iterator[dict]:
    """Rows of every page; a cursor that comes back ends the walk."""
    cursor, seen = None, set()
    while True:
        rows, cursor = client.page(selector, cursor)
        yield from rows
        if cursor is None or cursor in seen:
            return
        seen.add(cursor)


def paged_source(name: str, client: PagedClient, columns: list[str]) -> type[DataSource]:
    """A data source over ``client``; register it with ``spark.dataSource.register``. Columns are strings."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.selectors = json.loads(options.get("selectors", '[""]'))

        def partitions(self):
            return [InputPartition(s) for s in self.selectors]

        def read(self, partition):
            for row in all_pages(client, partition.value):
                yield tuple(None if row.get(c) is None else str(row[c]) for c in columns)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ", ".join(f"`{c}` string" for c in columns)

        def reader(self, schema):
            return Reader(self.options)

    return Source


def read_paged(spark: SparkSession, name: str, client: PagedClient, columns: list[str], selectors: list[str]) -> DataFrame:
    spark.dataSource.register(paged_source(name, client, columns))
    return spark.read.format(name).option("selectors", json.dumps(selectors)).load()


class PrivateMode:
    """While private, only services on this machine or the local network may be named."""

    def __init__(self, spark: SparkSession, private: bool):
        self.spark, self.private = spark, private

    def check(self, endpoint: str) -> None:
        if not self.private:
            return
        from pyspark.sql import functions as F

        from corpusmill.functions.text import is_local_host

        local = self.spark.range(1).select(is_local_host(F.lit(endpoint))).first()[0]
        if not local:
            raise PermissionError(f"private mode refuses {endpoint!r}")
