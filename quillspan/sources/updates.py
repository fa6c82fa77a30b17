"""A feed of numbered updates as a streaming source: whoever joins late gets everything from the start, or from any number.

What fetches the updates is injected; the source keeps the number it has read up to as the stream's offset, so that a
restarted query goes on where its checkpoint ends. Such feeds are thin (messages of a room), and are read by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: (after this serial) -> (serial, payload) of later updates, ascending.
Fetch = Callable[[int], list[tuple[int, str]]]


def update_source(label: str, fetch: Fetch) -> type[DataSource]:
    """A data source of that name; option ``after``: the serial to start behind, 0 for all."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, after: int) -> None:
            self.after = after

        def initialOffset(self) -> dict:
            return {"serial": self.after}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows = fetch(start["serial"])
            return iter(rows), {"serial": max([start["serial"], *(r[0] for r in rows)])}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter([r for r in fetch(start["serial"]) if r[0] <= end["serial"]])

    class Updates(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return "serial long, payload string"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader(int(self.options.get("after", 0)))

    return Updates


def updates(spark: SparkSession, label: str, fetch: Fetch, after: int = 0):
    """The feed as a stream of (serial, payload)."""
    spark.dataSource.register(update_source(label, fetch))
    return spark.readStream.format(label).option("after", after).load()
