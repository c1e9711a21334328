"""Remote services as Spark data sources: a paged listing as a scan, finished batches as a stream.

Both take a client as a parameter: what is read is split by pages or batches, so tasks fetch them side by side and
one that is lost fetches its own again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Drift(RuntimeError):
    """A listing has changed while it was read."""


class _Page(InputPartition):
    def __init__(self, number: int, total: int, size: int):
        self.number, self.total, self.size = number, total, size


def read_pages(spark: SparkSession, fetch: Callable[[int], dict], schema: str) -> DataFrame:
    """The rows of a paged listing.

    fetch(page), from 1, gives page, page_size, total (of rows) and rows (dicts or tuples). The first page tells how many
    there are; a page that announces another total, size or number, or holds another number of rows than it should, is an
    error (Drift): rows would be missing or twice."""

    def checked(said: dict, number: int, total: int, size: int) -> list:
        due = max(0, min(size, total - (number - 1) * size))
        facts = {"page": (said["page"], number), "total": (said["total"], total), "page_size": (said["page_size"], size), "rows": (len(said["rows"]), due)}
        wrong = {k: v for k, v in facts.items() if v[0] != v[1]}
        if wrong:
            raise Drift(f"page {number}: " + ", ".join(f"{k} {a} instead of {b}" for k, (a, b) in wrong.items()))
        return said["rows"]

    class Reader(DataSourceReader):
        def __init__(self, names: list[str]):
            self.names = names

        def partitions(self) -> list[_Page]:
            first = fetch(1)
            total, size = first["total"], first["page_size"]
            if total < 0 or size < 1:
                raise Drift(f"page 1 announces {total} rows, {size} a page")
            checked(first, 1, total, size)
            return [_Page(k, total, size) for k in range(1, max(1, -(-total // size)) + 1)]

        def read(self, partition: _Page) -> Iterator[tuple]:
            for row in checked(fetch(partition.number), partition.number, partition.total, partition.size):
                yield tuple(row.get(n) for n in self.names) if isinstance(row, dict) else tuple(row)

    name = f"pages_{uuid.uuid4().hex}"

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema.names)

    spark.dataSource.register(Pages)
    return spark.read.format(name).load()


class _Batch(InputPartition):
    def __init__(self, batch: str):
        self.batch = batch


def stream_batches(spark: SparkSession, listed: Callable[[], list[tuple[str, str]]], fetch: Callable[[str], list[tuple]], schema: str, done: tuple[str, ...] = ("completed",), ended: tuple[str, ...] = ("failed", "cancelled", "expired")) -> DataFrame:
    """The rows of batches as they finish, as a stream.

    listed() gives (batch, state) of all batches in the order of their making; fetch(batch) a finished one's rows, always the
    same. An offset says which batches have been read: up to which place all have ended, and which later ones. So a
    query that restarts from its checkpoint neither loses nor repeats a batch, in whatever order they finish. Batches
    that end without a result are passed over."""

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"upto": 0, "later": "[]"}

        def latestOffset(self) -> dict:
            states = listed()
            over = [s in done or s in ended for _, s in states]
            upto = over.index(False) if False in over else len(over)
            return {"upto": upto, "later": json.dumps([b for k, (b, _) in enumerate(states) if k >= upto and over[k]])}

        def partitions(self, start: dict, end: dict) -> list[_Batch]:
            states = listed()

            def within(offset: dict) -> set[str]:
                return {b for b, _ in states[: offset["upto"]]} | set(json.loads(offset["later"]))

            new = within(end) - within(start)
            return [_Batch(b) for b, s in states if b in new and s in done]

        def read(self, partition: _Batch) -> Iterator[tuple]:
            yield from map(tuple, fetch(partition.batch))

    name = f"batches_{uuid.uuid4().hex}"

    class Batches(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return Reader()

    spark.dataSource.register(Batches)
    return spark.readStream.format(name).load()
