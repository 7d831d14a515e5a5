"""Catalog rows straight from files or from Spark's own catalog (metadata only)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SNAPSHOT = (
    "schema string, `table` string, ordinal int, `column` string, data_type string, nullable boolean, error string"
)


def render_type(kind: T.DataType) -> str:
    """A type as catalog text: nested records spelled out, arrays marked as repeated."""
    if isinstance(kind, T.ArrayType):
        return f"{render_type(kind.elementType)} REPEATED"
    if isinstance(kind, T.StructType):
        return "RECORD<" + ", ".join(f"{f.name} {render_type(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.MapType):
        return f"RECORD<key {render_type(kind.keyType)}, value {render_type(kind.valueType)}> REPEATED"
    return kind.simpleString()


def schema_rows(schema: str, table: str, fields: T.StructType) -> list[tuple]:
    return [(schema, table, i, f.name, render_type(f.dataType), f.nullable, None)
            for i, f in enumerate(fields.fields, start=1)]


def _described(found: Iterable[tuple[str, str, Callable[[], T.StructType]]], workers: int) -> list[tuple]:
    """Column rows of (schema, table, its schema's reader); a failure becomes one error row."""
    def one(item: tuple[str, str, Callable[[], T.StructType]]) -> list[tuple]:
        schema, table, read = item
        try:
            return schema_rows(schema, table, read())
        except (PySparkException, Py4JJavaError) as exc:
            return [(schema, table, None, None, None, None, str(exc))]

    with ThreadPoolExecutor(workers) as pool:
        return [row for rows in pool.map(one, found) for row in rows]


def snapshot(spark: SparkSession, paths: Mapping[tuple[str, str], str], fmt: str = "parquet",
             options: Mapping[str, str] | None = None, workers: int = 5) -> DataFrame:
    """Column rows of datasets {(schema, table): path}; an unreadable one becomes an error row.

    Only schemas are read (footers), never data, of ``workers`` datasets at a time.
    """
    reader = lambda path: lambda: spark.read.format(fmt).options(**dict(options or {})).load(path).schema
    return spark.createDataFrame(_described([(*key, reader(path)) for key, path in paths.items()], workers), SNAPSHOT)


def snapshot_catalog(spark: SparkSession, database: str | None = None, workers: int = 5) -> DataFrame:
    """Column rows of the tables of a Spark catalog database, failures isolated per table."""
    found = []
    for table in spark.catalog.listTables(database):
        schema = ".".join(table.namespace or []) or "temp"
        name = table.name if not table.namespace else f"{'.'.join(table.namespace)}.{table.name}"
        found.append((schema, table.name, lambda name=name: spark.table(name).schema))
    return spark.createDataFrame(_described(found, workers), SNAPSHOT)
