"""A paged source: offset pages of JSON records, read by planned ranges of pages.

Each page is an answer like ``{"total": 950, "items": [{...}, ...]}`` at ``<path>/page-<offset>.json``.
The first page says how many records there are; ranges of offsets become partitions. A range is
read page by page, up to its end, an empty page or one that can't be read: then what was read before
stays, and a last row says what went wrong.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .scratch import file_system

#: Columns that a schema may name beside those of the records: the record's place, and a fault.
OFFSET, ERROR = "offset", "error"


@dataclass
class PageRange(InputPartition):
    """The offsets from ``first`` to before ``end``."""

    first: int
    end: int


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"]
        self.limit, self.span = int(options.get("limit", 100)), int(options.get("pagespertask", 10))
        self.first, self.end = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the offset are taken over by choosing pages; Spark checks them again on rows, with all other filters."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", ()) == (OFFSET,) and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.end = end if self.end is None else min(self.end, end)
            yield f

    def page(self, offset: int) -> dict:
        store, at = file_system(self.path)
        with store.open_input_stream(f"{at}/page-{offset}.json", compression=None) as f:
            return json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        try:
            total = int(self.page(0)["total"])
        except (OSError, ValueError, KeyError, TypeError):
            # Without a total there is one range, which ends by itself, as a first page that can't be read does.
            return [PageRange(self.first // self.limit * self.limit, 1 << 62 if self.end is None else self.end)]
        end = total if self.end is None else min(total, self.end)
        step, start = self.limit * self.span, self.first // self.limit * self.limit
        return [PageRange(k, min(k + step, end)) for k in range(start, max(end, start), step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for offset in range(partition.first, partition.end, self.limit):
            try:
                items = self.page(offset)["items"]
                rows = [tuple({OFFSET: offset + k, ERROR: None, **item}.get(n) for n in self.names) for k, item in enumerate(items)]
            except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
                if ERROR in self.names:
                    yield tuple({OFFSET: offset, ERROR: type(e).__name__}.get(n) for n in self.names)
                return
            if not rows:
                return
            yield from rows


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("limit", ...).load(path)``.

    Options: ``limit``, records of a page; ``pagespertask``, pages of a range. The schema names columns of
    the records and, if wanted, ``offset`` and ``error``; what a record lacks is null.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


def register(spark) -> None:
    """Make the source known to a session, and let its filters be pushed down."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
