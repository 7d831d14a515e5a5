"""The persisted catalog: five datasets under one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake import schema as S
from cartolake.schema import BUNDLE_VERSION, TABLE_KEY

PARTS = {
    "tables": S.TABLES, "columns": S.COLUMNS, "table_descriptions": S.TABLE_DESCRIPTIONS,
    "column_descriptions": S.COLUMN_DESCRIPTIONS, "relationships": S.RELATIONSHIPS,
}


class BundleVersionError(Exception):
    """The stored catalog has a version this code does not read."""


class BundleIntegrityError(Exception):
    """The stored catalog contradicts itself or is incomplete."""


@dataclass(frozen=True)
class Bundle:
    tables: DataFrame
    columns: DataFrame
    table_descriptions: DataFrame
    column_descriptions: DataFrame
    relationships: DataFrame
    meta: DataFrame


def make_meta(spark: SparkSession, connector: str, database: str) -> DataFrame:
    """The one-row meta table, stamped with UTC seconds."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(1).select(
        F.lit(BUNDLE_VERSION).alias("schema_version"), now.alias("generated_at"),
        F.lit(connector).alias("connector"), F.lit(database).alias("database"))


def write_bundle(bundle: Bundle, path: str, fmt: str = "parquet") -> None:
    """Overwrite the datasets; meta is emptied first and written last, so a half-written catalog does not open."""
    options = {"ignoreNullFields": "false"} if fmt == "json" else {}
    bundle.meta.limit(0).write.mode("overwrite").format(fmt).options(**options).save(f"{path}/meta")
    for name in [*PARTS, "meta"]:
        getattr(bundle, name).write.mode("overwrite").format(fmt).options(**options).save(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, fmt: str = "parquet") -> Bundle | None:
    """The stored catalog, or None when there is none; version and integrity are checked."""
    try:
        meta = spark.read.schema(S.META).format(fmt).load(f"{path}/meta")
        first = meta.take(2)
    except AnalysisException:
        return None
    if len(first) != 1:
        raise BundleIntegrityError(f"meta must hold one row, found {len(first)}")
    if first[0]["schema_version"] != BUNDLE_VERSION:
        raise BundleVersionError(f"expected version {BUNDLE_VERSION}, found {first[0]['schema_version']}")
    try:
        parts = {name: spark.read.schema(ddl).format(fmt).load(f"{path}/{name}") for name, ddl in PARTS.items()}
    except AnalysisException as exc:
        raise BundleIntegrityError(str(exc)) from exc
    problems = check_integrity(parts["tables"], parts["table_descriptions"])
    examples = problems.orderBy("problem", *TABLE_KEY).take(10)
    if examples:
        counts = ", ".join(f"{r['problem']} x {r['count']}" for r in problems.groupBy("problem").count().orderBy("problem").collect())
        error = BundleIntegrityError(
            f"{counts}; for example " + ", ".join(f"{r['problem']}: {r['schema']}.{r['table']}" for r in examples))
        error.problems = problems  # all of them
        raise error
    return Bundle(meta=meta, **parts)


def check_integrity(tables: DataFrame, table_descriptions: DataFrame) -> DataFrame:
    """Description slots without a table, and tables without a slot: (problem, schema, table).

    Stack and group: one shuffle for both directions.
    """
    sides = tables.select(*TABLE_KEY, F.lit(1).alias("t"), F.lit(0).alias("d")).unionByName(
        table_descriptions.select(*TABLE_KEY, F.lit(0).alias("t"), F.lit(1).alias("d")))
    both = sides.groupBy(*TABLE_KEY).agg(F.max("t").alias("t"), F.max("d").alias("d")).filter("t != d")
    return both.select(
        F.when(F.col("t") == 0, "orphan_description").otherwise("missing_description").alias("problem"), *TABLE_KEY)


def encode_keys(df: DataFrame) -> DataFrame:
    """Add ``key``: schema and table joined by a dot."""
    return df.withColumn("key", F.concat_ws(".", *TABLE_KEY))


def decode_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """Split ``schema.table`` at its dot: adds schema, table and status (ok or what is wrong)."""
    text = F.col(key)
    left, rest = F.substring_index(text, ".", 1), F.expr(f"substr(`{key}`, instr(`{key}`, '.') + 1)")
    status = (
        F.when(~text.contains(".") | (left == "") | (rest == ""), "malformed")
        .when(rest.contains("."), "dotted_table").otherwise("ok"))
    return df.withColumn("status", status).withColumn(
        "schema", F.when(F.col("status") == "ok", left)).withColumn("table", F.when(F.col("status") == "ok", rest))


def bundle_counts(tables: DataFrame, table_descriptions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Tables, filled and failed descriptions, relationships: (what, n)."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    filled = F.col("description").isNotNull()
    slots = table_descriptions.agg(F.count_if(filled).alias("present"), F.count_if(~filled).alias("missing")).select(
        F.expr("inline(array(struct('descriptions_present' as what, present as n),"
               " struct('descriptions_null' as what, missing as n)))"))
    return count(tables, "tables").unionByName(slots).unionByName(count(relationships, "relationships"))
