"""A source that is read page by page, as a Spark Python data source.

Every page is one partition, fetched by the task that reads it; simple
comparisons are pushed to the page, so rows that a filter rejects never reach
Spark.  ``JsonPages`` reads pages that lie as JSON Lines files in a folder of
any file system pyarrow knows; a connector for a service overrides ``pages``
(what to fetch) and ``fetch`` (one page) of ``PagedReader``.

Register with ``spark.dataSource.register(JsonPages)``.  Spark asks for
``spark.sql.python.filterPushdown.enabled`` where a reader takes filters.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

COMPARISONS = {
    ds.EqualTo: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
}


class Page(ds.InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class PagedReader(ds.DataSourceReader):
    """Reads the pages of ``options["path"]``; a row lacks what its record lacks (null)."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options, self.tests = schema.names, dict(options), []

    def pages(self) -> list[str]:
        system, folder = fs.FileSystem.from_uri(self.options["path"])
        found = system.get_file_info(fs.FileSelector(folder))
        names = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json"))
        if not names:
            raise FileNotFoundError(f"no pages in {self.options['path']}")
        return names

    def fetch(self, page: str) -> Iterable[dict]:
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        with system.open_input_stream(page) as lines:
            for line in lines.readall().decode().splitlines():
                if line.strip():
                    yield json.loads(line)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes comparisons of a top-level column with a value, In and null tests; gives the others back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column is not None and type(f) in COMPARISONS:
                self.tests.append((column, "compare", COMPARISONS[type(f)], f.value))
            elif column is not None and isinstance(f, ds.In):
                self.tests.append((column, "in", None, tuple(f.value)))
            elif column is not None and isinstance(f, ds.IsNotNull):
                self.tests.append((column, "known", None, None))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        return [Page(p) for p in self.pages()]

    def passes(self, record: dict) -> bool:
        for column, kind, compare, value in self.tests:
            have = record.get(column)
            if have is None or (kind == "compare" and not compare(have, value)) or (kind == "in" and have not in value):
                return False
        return True

    def read(self, partition: Page) -> Iterator[tuple]:
        for record in self.fetch(partition.name):
            if self.passes(record):
                yield tuple(record.get(n) for n in self.names)


class JsonPages(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        raise ValueError("json_pages needs a schema: spark.read.schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)
