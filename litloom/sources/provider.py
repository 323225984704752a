"""A literature service as a Spark data source that says which filters it applies itself, and evidence as a table function."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.functions import udtf

from litloom.functions.documents import pack_paragraphs
from litloom.sources.search import PUSHED

SCHEMA = "record_id bigint, provider string, title string, year int, doi string, venue string, citation_count bigint, is_open_access boolean"

#: Columns that a capability of PUSHED is about.
ABILITY = {"year": ("after", "before"), "is_open_access": ("open_access",), "citation_count": ("min_citations",)}


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    """Reads the landed answers of one service, one task a file, with the filters that the service understands."""

    def __init__(self, options):
        self.path, self.service = options["path"], options["service"]
        self.applied: list[tuple[str, str, object]] = [("provider", "==", self.service)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        signs = {EqualTo: "==", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            able = any(a in PUSHED[self.service] for a in ABILITY.get(column, ()))
            if able and type(f) in signs:
                self.applied.append((column, signs[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        import pyarrow.dataset as ds

        return [_File(path) for path in ds.dataset(self.path, format="parquet").files]

    def read(self, partition: _File) -> Iterator:
        import operator

        import pyarrow.dataset as ds

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        compare = {"==": operator.eq, ">=": operator.ge, "<=": operator.le}
        condition = None
        for column, sign, value in self.applied:
            one = compare[sign](ds.field(column), value)
            condition = one if condition is None else condition & one
        yield from ds.dataset(partition.value, format="parquet").to_batches(columns=names, filter=condition)


class LandedService(DataSource):
    """``spark.read.format("landed_service").option("service", ...).option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "landed_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        if self.options.get("service") not in PUSHED:
            raise ValueError(f"no service is named {self.options.get('service')!r}")
        return _Reader(self.options)


@udtf(returnType="chunk_no int, chunk string")
class PackedChunks:
    """``packed_chunks(text, size)``: the chunks of a text, in order."""

    def eval(self, text: str, size: int):
        yield from enumerate(pack_paragraphs(text, size or 1800), 1)


def register_extensions(spark: SparkSession) -> None:
    """Make the data source and the table function known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedService)
    spark.udtf.register("packed_chunks", PackedChunks)
