"""Catalog discovery from information-schema snapshots.

Inputs are plain DataFrames, so a snapshot may come from files, from JDBC reads
of ``information_schema`` views, or from any connector Spark has:

* ``columns``      schema, table, column, ordinal, data_type, is_nullable, default [, udt_name]
* ``tables``       schema, table, table_type
* ``key_usage``    constraint_schema, constraint_name, schema, table, column, ordinal,
                   position_in_unique_constraint
* ``constraints``  constraint_schema, constraint_name, constraint_type
* ``referential``  constraint_schema, constraint_name, unique_constraint_schema,
                   unique_constraint_name [, unique_constraint_catalog]
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.operators.skew import lookup_join
from cartolake.schema import COLUMN_KEY, EDGE, TABLE_KEY

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
SYSTEM_PREFIX = "pg_"


def _is_user_schema(system: Sequence[str], prefix: str | None) -> Column:
    named = ~F.col("schema").isin(*system)
    return named & ~F.col("schema").startswith(prefix) if prefix else named


def user_schemas(schemata: DataFrame, system: Sequence[str] = SYSTEM_SCHEMAS, prefix: str | None = SYSTEM_PREFIX) -> DataFrame:
    """Distinct schema names without the system ones: exact names, and those with ``prefix`` unless it is None."""
    return schemata.select("schema").filter(_is_user_schema(system, prefix)).distinct()


def scope(df: DataFrame, schemas: Sequence[str] | None = None, default: str | None = None,
          schemata: DataFrame | None = None, prefix: str | None = SYSTEM_PREFIX) -> DataFrame:
    """Restrict rows to a schema scope.

    An explicit list wins (an empty list selects nothing), then the bound default
    schema, then every user schema.  Rows of a schema that owns very many are spread over tasks.
    """
    if schemas is not None:
        return df.filter(F.col("schema").isin(*schemas)) if schemas else df.filter(F.lit(False))
    if default is not None:
        return df.filter(F.col("schema") == default)
    if schemata is None:
        return df.filter(_is_user_schema(SYSTEM_SCHEMAS, prefix))
    return lookup_join(df, user_schemas(schemata, prefix=prefix), ["schema"]).select(*df.columns)


def known_count(raw: Column) -> Column:
    """A planner's row count: negative or missing means unknown, zero stays zero."""
    return F.when(raw >= 0, raw.cast("bigint"))


def primary_key_columns(key_usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Distinct (schema, table, column) that take part in a PRIMARY KEY constraint."""
    primary = constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
    return (
        key_usage.join(primary, ["constraint_schema", "constraint_name"], "left_semi")
        .select(*COLUMN_KEY)
        .distinct()
    )


def discover_columns(
    columns: DataFrame,
    tables: DataFrame,
    key_usage: DataFrame | None = None,
    constraints: DataFrame | None = None,
    stats: DataFrame | None = None,
    schemas: Sequence[str] | None = None,
) -> DataFrame:
    """One row per column of every base table, with key flag and row count.

    ``key_usage``/``constraints`` may be missing (shared databases hide them): then
    no column is a key.  ``stats`` (schema, table, row_count) may be missing: then
    every row count is NULL.
    """
    columns, tables = scope(columns, schemas), scope(tables, schemas)
    base = tables.filter(F.col("table_type") == "BASE TABLE").select(*TABLE_KEY)
    if stats is None:
        base = base.withColumn("row_count", F.lit(None).cast("bigint"))
    else:
        known = stats.select(*TABLE_KEY, known_count(F.col("row_count")).alias("row_count"))
        base = base.join(known, TABLE_KEY, "left")
    if "udt_name" in columns.columns:
        underlying = F.col("data_type").isin("ARRAY", "USER-DEFINED")
        columns = columns.withColumn(
            "data_type", F.when(underlying, F.col("udt_name")).otherwise(F.col("data_type"))
        )
    found = columns.join(base, TABLE_KEY)
    if key_usage is None or constraints is None:
        found = found.withColumn("is_primary_key", F.lit(False))
    else:
        keys = primary_key_columns(key_usage, constraints).withColumn("__pk", F.lit(True))
        found = found.join(keys, COLUMN_KEY, "left").withColumn(
            "is_primary_key", F.coalesce("__pk", F.lit(False))
        )
    return found.select(
        "schema", "table", "ordinal", "column", "data_type",
        (F.col("is_nullable") == "YES").alias("nullable"),
        "is_primary_key", "default", "row_count",
    )


def fold_tables(discovered: DataFrame, page_size: int = (1 << 31) - 1) -> DataFrame:
    """Nest column rows into table rows: (schema, table, page, n_columns, row_count, columns).

    One row per table, however wide.  A caller who gives a ``page_size`` in
    ordinals gets wider tables on further pages, each with its own ``n_columns``;
    reading pages in order gives the whole table.
    """
    entry = F.struct("ordinal", "column", "data_type", "nullable", "is_primary_key", "default")
    page = F.floor((F.col("ordinal") - 1) / page_size).cast("int")
    return (
        discovered.withColumn("page", page)
        .groupBy("schema", "table", "page")
        .agg(
            F.count("*").alias("n_columns"),
            F.max("row_count").alias("row_count"),
            F.sort_array(F.collect_list(entry)).alias("columns"),
        )
    )


def foreign_key_targets(referential: DataFrame, key_usage: DataFrame, how: str = "inner") -> DataFrame:
    """Foreign-key column pairs; composite keys align on position_in_unique_constraint."""
    source = key_usage.select(
        "constraint_schema", "constraint_name",
        F.col("schema").alias("source_schema"),
        F.col("table").alias("source_table"),
        F.col("column").alias("source_column"),
        F.col("ordinal").alias("source_ordinal"),
        F.col("position_in_unique_constraint").alias("target_ordinal"),
    )
    target = key_usage.select(
        F.col("constraint_schema").alias("unique_constraint_schema"),
        F.col("constraint_name").alias("unique_constraint_name"),
        F.col("ordinal").alias("target_ordinal"),
        F.col("schema").alias("target_schema"),
        F.col("table").alias("target_table"),
        F.col("column").alias("target_column"),
    )
    # A popular table is the target of very many constraints: spread that key.
    popular = referential.groupBy("unique_constraint_schema", "unique_constraint_name").agg(
        F.count("*").alias("n")
    )
    return lookup_join(
        referential.join(source, ["constraint_schema", "constraint_name"]),
        target,
        ["unique_constraint_schema", "unique_constraint_name", "target_ordinal"],
        how,
        freq=popular,
        spread=["constraint_schema", "constraint_name", "source_ordinal"],
    )


def foreign_key_pairs(referential: DataFrame, key_usage: DataFrame) -> DataFrame:
    """The six edge columns plus constraint name and ordinal, which carry the source order."""
    return foreign_key_targets(referential, key_usage).select(
        *EDGE, "constraint_name", F.col("source_ordinal").alias("ordinal")
    )


def split_cross_database(referential: DataFrame, key_usage: DataFrame, bound: str) -> DataFrame:
    """Foreign-key pairs with a ``dropped`` flag.

    Dropped: the target lies in another database (compared without case) or any
    part of the target is unknown.  Filter on the flag for either side, count it
    for the report; both come from one pass.
    """
    pairs = foreign_key_targets(referential, key_usage, "left")
    elsewhere = F.coalesce(F.upper("unique_constraint_catalog") != bound.upper(), F.lit(False))
    unknown = (
        F.col("target_schema").isNull() | F.col("target_table").isNull() | F.col("target_column").isNull()
    )
    return pairs.select(
        *EDGE, F.col("unique_constraint_catalog").alias("target_database"),
        (elsewhere | unknown).alias("dropped"),
    )


def split_cross_dataset(feed: DataFrame) -> DataFrame:
    """Foreign keys of a constraint feed with a ``status``: kept, dropped or skipped.

    A target in another schema is dropped (and counted); an unresolved target is
    skipped without counting.
    """
    unresolved = (
        F.col("target_schema").isNull() | F.col("target_table").isNull() | F.col("target_column").isNull()
    )
    status = (
        F.when(unresolved, "skipped")
        .when(F.col("target_schema") != F.col("source_schema"), "dropped")
        .otherwise("kept")
    )
    return feed.filter(F.col("constraint_type") == "FOREIGN KEY").select(*EDGE, status.alias("status"))


def constraint_feed(constraints: DataFrame, key_usage: DataFrame, referential: DataFrame) -> DataFrame:
    """Primary and foreign keys in one result; target columns are NULL for primary keys."""
    kinds = constraints.filter(F.col("constraint_type").isin("PRIMARY KEY", "FOREIGN KEY"))
    primary = key_usage.join(
        kinds.filter(F.col("constraint_type") == "PRIMARY KEY"),
        ["constraint_schema", "constraint_name"], "left_semi",
    ).select(
        F.lit("PRIMARY KEY").alias("constraint_type"),
        F.col("schema").alias("source_schema"),
        F.col("table").alias("source_table"),
        F.col("column").alias("source_column"),
        *[F.lit(None).cast("string").alias(c) for c in EDGE[3:]],
        "constraint_name", "ordinal",
    )
    foreign_names = kinds.filter(F.col("constraint_type") == "FOREIGN KEY")
    foreign = foreign_key_targets(
        referential.join(foreign_names, ["constraint_schema", "constraint_name"], "left_semi"),
        key_usage, "left",
    ).select(
        F.lit("FOREIGN KEY").alias("constraint_type"), *EDGE,
        "constraint_name", F.col("source_ordinal").alias("ordinal"),
    )
    return primary.unionByName(foreign)


def dotted(df: DataFrame, names: Sequence[str]) -> Column:
    """True when any of the named identifier columns contains a dot."""
    hit = F.lit(False)
    for name in names:
        hit = hit | F.coalesce(F.col(name).contains("."), F.lit(False))
    return hit


def quarantine_dotted(df: DataFrame, names: Sequence[str] = ("schema", "table")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the no-dots rule; ``schema.table`` is the on-disk key."""
    bad = dotted(df, names)
    return df.filter(~bad), df.filter(bad)


def reject_dotted(df: DataFrame, names: Sequence[str] = ("schema", "table")) -> DataFrame:
    """Strict form: the job fails on the first identifier with a dot."""
    message = F.concat(F.lit("identifier contains '.': "), F.concat_ws(" / ", *names))
    return df.filter(F.when(dotted(df, names), F.raise_error(message).cast("boolean")).otherwise(True))
