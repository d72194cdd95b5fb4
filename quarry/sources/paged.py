"""Sources that give their rows page by page, with continuation keys, as Spark data sources.

A client is a function fetch(low, high, after, limit) that gives up to limit rows with low <= key < high in the order of their keys, the
key being the first column, behind the key after, and whether there are more. Each partition reads a range of keys, page by page, so
a source is read in parallel and a lost task reads its range again. Conditions on the key narrow the ranges. As a stream, the
offset is a key: a batch reads what lies behind the last one, in ranges too, and a restart goes on from there.

Defined cases: null bounds are open; a limit counts rows in all, and is kept by each range for itself, so that Spark takes the rest
away; a page without rows and without more ends a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Rows of a page.
PAGE = 1_000


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None

    def __init__(self, low, high):
        super().__init__((low, high))
        self.low, self.high = low, high


def pages(fetch: Callable, span: Range, page: int, limit: int | None) -> Iterator[tuple]:
    """Rows of a range, page by page."""
    after, seen, more = None, 0, True
    while more and (limit is None or seen < limit):
        rows, more = fetch(span.low, span.high, after, page if limit is None else min(page, limit - seen))
        yield from rows
        seen += len(rows)
        more = more and bool(rows)
        after = rows[-1][0] if rows else after


def cut(low: int | None, high: int | None, bounds: list[int]) -> list[Range]:
    """Ranges between low and high, cut at the bounds that lie between."""
    if low is not None and high is not None and low >= high:
        return []
    inside = [b for b in sorted(set(bounds)) if (low is None or b > low) and (high is None or b < high)]
    return [Range(a, b) for a, b in zip([low, *inside], [*inside, high], strict=True)]


def paged_source(name: str, schema: str, fetch: Callable, bounds: list[int] = (), last: Callable | None = None) -> type[DataSource]:
    """A data source of this name over a client with whole-number keys. bounds cut the keys into ranges; last() gives the highest key so far, for streams."""
    key = schema.split()[0]

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.page, self.limit = int(options.get("page", PAGE)), int(options["limit"]) if "limit" in options else None
            self.low, self.high = None, None

        def pushFilters(self, filters):
            for f in filters:
                at = f.value if getattr(f, "attribute", None) == (key,) and isinstance(getattr(f, "value", None), int) else None
                low, high = {EqualTo: (at, (at or 0) + 1), GreaterThanOrEqual: (at, None), GreaterThan: ((at or 0) + 1, None), LessThan: (None, at), LessThanOrEqual: (None, (at or 0) + 1)}.get(type(f), (None, None)) if at is not None else (None, None)
                if low is None and high is None:
                    yield f  # for Spark
                if low is not None:
                    self.low = low if self.low is None else max(low, self.low)
                if high is not None:
                    self.high = high if self.high is None else min(high, self.high)

        def partitions(self):
            return cut(self.low, self.high, list(bounds)) or [Range(0, 0)]

        def read(self, partition):
            if partition.low is None or partition.high is None or partition.low < partition.high:
                yield from pages(fetch, partition, self.page, self.limit)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options):
            self.page = int(options.get("page", PAGE))

        def initialOffset(self):
            return {"key": -1}

        def latestOffset(self):
            return {"key": last()}

        def partitions(self, start, end):
            return cut(start["key"] + 1, end["key"] + 1, list(bounds)) or [Range(0, 0)]

        def read(self, partition):
            if partition.low < partition.high:
                yield from pages(fetch, partition, self.page, None)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):
            return StreamReader(self.options)

    return Source


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes a source known by its name, with conditions pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
