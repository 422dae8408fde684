"""A Spark data source for listings that come in pages, such as those of search servers.

``spark.read.format("paged")`` plans one task for each run of pages; ``readStream`` goes on from the offset that the checkpoint holds. Options: ``url`` with ``{start}`` and ``{rows}``, ``docs`` and
``total`` (dotted paths of the rows and of their number in the JSON answer), ``rows`` (a page's size), ``pages`` (pages of a task), ``tries`` and ``timeout`` in seconds. Missing fields are null; a field that isn't of
its column's plain type comes as JSON text in string columns and fails in others. The order of the listing must not change while it is read, new rows come last.

Filters ``column >= x`` and ``column = x`` on the column named in ``filtered`` are sent along in ``{low}`` and checked by Spark again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StringType, StructType

DEFAULTS = {"docs": "response.docs", "total": "response.numFound", "rows": "100", "pages": "10", "tries": "4", "timeout": "30", "filtered": ""}


class Pages(InputPartition):
    """Rows ``start`` to ``end`` of a listing."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Listing:
    """Pages of one listing, fetched with repeated tries."""

    def __init__(self, options: dict, schema: StructType, low: str = ""):
        self.options = DEFAULTS | {k.lower(): v for k, v in options.items()}
        if "url" not in self.options:
            raise ValueError("the option url is missing")
        self.schema, self.low, self.rows = schema, low, int(self.options["rows"])

    def fetch(self, start: int, rows: int) -> dict:
        url = self.options["url"].replace("{start}", str(start)).replace("{rows}", str(rows)).replace("{low}", quote(self.low))
        for left in range(int(self.options["tries"]) - 1, -1, -1):
            try:
                with urlopen(url, timeout=float(self.options["timeout"])) as answer:
                    return json.load(answer)
            except (OSError, ValueError):
                if not left:
                    raise
                time.sleep(0.1 * 2 ** (int(self.options["tries"]) - left))

    def at(self, answer: dict, name: str):
        for key in self.options[name].split("."):
            answer = answer[key]
        return answer

    def total(self) -> int:
        return int(self.at(self.fetch(0, 0), "total"))

    def parts(self, start: int, end: int) -> list[Pages]:
        step = self.rows * int(self.options["pages"])
        return [Pages(a, min(a + step, end)) for a in range(start, end, step)]

    def read(self, part: Pages) -> Iterator[tuple]:
        texts = [isinstance(f.dataType, StringType) for f in self.schema]
        for start in range(part.start, part.end, self.rows):
            wanted = min(self.rows, part.end - start)
            docs = self.at(self.fetch(start, wanted), "docs")
            if len(docs) != wanted:
                raise ValueError(f"the page at {start} has {len(docs)} of {wanted} rows")
            for doc in docs:
                yield tuple(json.dumps(v) if text and v is not None and not isinstance(v, str) else v for v, text in zip((doc.get(f.name) for f in self.schema), texts))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.listing = Listing(options, schema)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, EqualTo)) and f.attribute == (self.listing.options["filtered"],):
                self.listing.low = max(self.listing.low, str(f.value)) if isinstance(f.value, str) or not self.listing.low else str(max(f.value, type(f.value)(self.listing.low)))
            yield f

    def partitions(self) -> list[InputPartition]:
        return self.listing.parts(0, self.listing.total())

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.listing.read(partition)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.listing = Listing(options, schema)

    def initialOffset(self) -> dict:
        return {"start": 0}

    def latestOffset(self) -> dict:
        return {"start": self.listing.total()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.listing.parts(start["start"], end["start"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.listing.read(partition)

    def commit(self, end: dict) -> None: ...


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format ``paged`` known; filters are pushed down where Spark lets Python sources take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
