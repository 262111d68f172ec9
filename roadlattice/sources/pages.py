"""Paged records as a Spark data source: page ranges are partitions, comparisons are pushed down, and a lost record is an error.

A folder of pages holds ``page=<k>`` folders of JSON lines ``{"features": [{"attributes": ..., "geometry": {"paths": ...}}, ...]}``
and a folder ``_total`` with the number of records that the service states.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PATHS = "paths array<array<array<double>>>"
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class Pages(InputPartition):
    """The pages first .. stop - 1."""

    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class Folder:
    """Reads and checks pages; what tasks get of it is a path, two numbers and the schema."""

    def __init__(self, path: str, page_rows: int, schema: StructType):
        self.path, self.page_rows, self.schema = path.rstrip("/"), page_rows, schema

    def lines(self, folder: str) -> Iterator[str]:
        files, root = fs.FileSystem.from_uri(f"{self.path}/{folder}")
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for f in sorted(x.path for x in found if x.is_file and not x.base_name.startswith((".", "_"))):
            with files.open_input_stream(f) as s:
                yield from filter(None, s.read().decode().split("\n"))

    def total(self) -> int:
        stated = list(self.lines("_total"))
        if not stated:
            raise ValueError(f"{self.path} does not state its number of records")
        return int(stated[0])

    def present(self, page: int) -> bool:
        files, root = fs.FileSystem.from_uri(f"{self.path}/page={page}")
        return files.get_file_info(root).type == fs.FileType.Directory

    def batches(self, pages: Pages, total: int, filters: list) -> Iterator[pa.RecordBatch]:
        """One Arrow batch a page. A page that does not hold the records that its place in the whole requires is an error."""
        names = [f.name for f in self.schema.fields if f.name != "paths"]
        types = to_arrow_schema(self.schema)
        for k in range(pages.first, pages.stop):
            features = [f for line in self.lines(f"page={k}") for f in json.loads(line)["features"]]
            due = min(self.page_rows, total - k * self.page_rows)
            if len(features) != due:
                raise ValueError(f"page {k} of {self.path} holds {len(features)} records instead of {due}")
            rows = []
            for f in features:
                at = f.get("attributes") or {}
                if all(keeps(at.get(name)) for name, keeps in filters):
                    rows.append({**{n: at.get(n) for n in names}, "paths": (f.get("geometry") or {}).get("paths")})
            yield pa.RecordBatch.from_pylist(rows, schema=types)


def test_of(f: Filter):
    """(attribute, test) of a filter that the source applies itself, or None. A null never passes."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] == "paths":
        return None
    if isinstance(f, IsNotNull):
        return f.attribute[0], lambda x: x is not None
    if isinstance(f, In):
        return f.attribute[0], lambda x, among=frozenset(f.value): x is not None and x in among
    compare = _COMPARE.get(type(f))
    return compare and (f.attribute[0], lambda x, v=f.value: x is not None and v is not None and compare(x, v))


class PagedReader(DataSourceReader):
    def __init__(self, folder: Folder, pages_per_task: int):
        self.folder, self.pages_per_task, self.filters = folder, pages_per_task, []
        self.total = folder.total()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if test := test_of(f):
                self.filters.append(test)
            else:
                yield f

    def partitions(self):
        pages = -(-self.total // self.folder.page_rows)
        return [Pages(k, min(pages, k + self.pages_per_task)) for k in range(0, pages, self.pages_per_task)] or [Pages(0, 0)]

    def read(self, partition: Pages):
        return self.folder.batches(partition, self.total, self.filters)


class PagedStream(DataSourceStreamReader):
    """Each trigger takes the pages that have come since, up to the first that is not there yet."""

    def __init__(self, folder: Folder):
        self.folder, self.next = folder, 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        while self.folder.present(self.next):
            self.next += 1
        return {"page": self.next}

    def partitions(self, start: dict, end: dict):
        self.next = max(self.next, end["page"])
        return [Pages(k, k + 1) for k in range(start["page"], end["page"])]

    def read(self, partition: Pages):
        return self.folder.batches(partition, self.folder.total(), [])

    def commit(self, end: dict) -> None:
        pass


class PagedRecords(DataSource):
    """Options: path, fields (a DDL string), page_rows, pages_per_task."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return f"{self.options['fields']}, {PATHS}"

    def _folder(self, schema: StructType) -> Folder:
        return Folder(self.options["path"], int(self.options["page_rows"]), schema)

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self._folder(schema), int(self.options.get("pages_per_task", "8")))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self._folder(schema))


def _options(reader, path: str, fields: str, page_rows: int, pages_per_task: int):
    return reader.format("paged_records").option("fields", fields).option("page_rows", page_rows).option("pages_per_task", pages_per_task).load(path)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRecords)


def paged(spark: SparkSession, path: str, fields: str, *, page_rows: int, pages_per_task: int = 8) -> DataFrame:
    """Records of a folder of pages: ``fields`` and paths. Every page but the last must hold page_rows records and all together the stated
    number; a page that does not makes the query fail. Comparisons with constants, IN and IS NOT NULL reach the source.
    Attributes that a record lacks are null. Without records there are no rows."""
    register(spark)
    return _options(spark.read, path, fields, page_rows, pages_per_task)


def paged_stream(spark: SparkSession, path: str, fields: str, *, page_rows: int) -> DataFrame:
    """The same as a stream: pages are read as they come, each once."""
    register(spark)
    return _options(spark.readStream, path, fields, page_rows, 1)


def write_pages(records: DataFrame, path: str, page: Column) -> None:
    """Records (attributes, geometry) as a folder of pages, with their number stated. A page is bounded by the service's page size."""
    pages = records.groupBy(page.alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct("attributes", "geometry")).alias("features"))).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(path)
    records.agg(F.count("*").cast("string").alias("value")).write.text(f"{path}/_total")
