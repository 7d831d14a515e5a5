"""Reading the catalog: listing, description, incident relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.operators.skew import lookup_join
from cartolake.schema import COLUMN_KEY, EDGE, TABLE_KEY

DIRECTIONS = ("outgoing", "incoming", "both")


def discover(tables: DataFrame, schema: str | None = None) -> DataFrame:
    """Tables with their row counts, optionally of one schema."""
    listed = tables.select("schema", "table", "row_count")
    return listed if schema is None else listed.filter(F.col("schema") == schema)


def describe(
    columns: DataFrame,
    tables: DataFrame,
    table_descriptions: DataFrame,
    column_descriptions: DataFrame,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Tables and columns joined with their descriptions, one row per column.

    Table fields repeat on each row.  A failed or missing description leaves
    NULLs.  ``keys`` (schema, table) selects tables; those it names that are not
    in the catalog come back as one row with ``known = false``, and a table of the
    catalog that has no columns as one row with its table fields.
    """
    about_table = tables.select(*TABLE_KEY, "row_count").join(
        table_descriptions.select(
            *TABLE_KEY, F.col("description").alias("table_description"), "grain", "domain_hints",
            F.col("confidence").alias("table_confidence")),
        TABLE_KEY, "left")
    about_column = column_descriptions.select(
        *COLUMN_KEY, "description", "semantic_type", "pii_risk", "confidence")
    if keys is not None:
        keys = keys.select(*TABLE_KEY).distinct()
        columns = columns.join(keys, TABLE_KEY, "left_semi")
    shown = (
        columns.select(*TABLE_KEY, "ordinal", "column", "data_type", "nullable", "is_primary_key")
        .join(about_column, COLUMN_KEY, "left")
        .join(about_table, TABLE_KEY)
        .withColumn("known", F.lit(True))
    )
    if keys is None:
        return shown.drop("known")
    unknown = keys.join(tables, TABLE_KEY, "left_anti").withColumn("known", F.lit(False))
    bare = (
        keys.join(about_table, TABLE_KEY).join(columns.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_anti")
        .withColumn("known", F.lit(True)))
    return shown.unionByName(bare, allowMissingColumns=True).unionByName(unknown, allowMissingColumns=True)


def relationships_of(relationships: DataFrame, schema: str, table: str, direction: str = "both") -> DataFrame:
    """Relationships of one table."""
    _check(direction)
    outgoing = (F.col("source_schema") == schema) & (F.col("source_table") == table)
    incoming = (F.col("target_schema") == schema) & (F.col("target_table") == table)
    wanted = {"outgoing": outgoing, "incoming": incoming, "both": outgoing | incoming}[direction]
    return relationships.filter(wanted).select(*EDGE, "kind")


def incident(relationships: DataFrame, tables: DataFrame, direction: str = "both") -> DataFrame:
    """Relationships of every catalog table: the focal (schema, table), then the edge.

    Each edge is emitted for its ends, a self-edge once.  Only catalog tables are
    focal; a table that very many edges point at is spread over tasks.
    """
    _check(direction)
    source = F.struct(F.col("source_schema").alias("schema"), F.col("source_table").alias("table"))
    target = F.struct(F.col("target_schema").alias("schema"), F.col("target_table").alias("table"))
    ends = {"outgoing": F.array(source), "incoming": F.array(target),
            "both": F.array_distinct(F.array(source, target))}[direction]
    focal = relationships.select(F.explode(ends).alias("focal"), *EDGE, "kind").select("focal.*", *EDGE, "kind")
    return lookup_join(focal, tables.select(*TABLE_KEY).distinct(), TABLE_KEY, spread=EDGE)


def _check(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, got {direction!r}")
