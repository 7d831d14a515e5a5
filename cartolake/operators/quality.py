"""Catalog quality: coverage, orphans, risk distribution, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.schema import PII_RISKS, TABLE_KEY


def endpoints(relationships: DataFrame) -> DataFrame:
    """Both ends of every edge as (schema, table); a self-edge gives two rows."""
    ends = F.array(
        F.struct(F.col("source_schema").alias("schema"), F.col("source_table").alias("table")),
        F.struct(F.col("target_schema").alias("schema"), F.col("target_table").alias("table")),
    )
    return relationships.select(F.inline(ends))


def incident_counts(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edge ends per catalog table, zero included.  Counted map-side, then joined one-to-one."""
    counts = endpoints(relationships).groupBy(*TABLE_KEY).agg(F.count("*").alias("incident"))
    return tables.select(*TABLE_KEY).join(counts, TABLE_KEY, "left").withColumn(
        "incident", F.coalesce("incident", F.lit(0).cast("bigint")))


def orphans(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """Catalog tables without any relationship."""
    return tables.select(*TABLE_KEY).join(
        endpoints(relationships).distinct(), TABLE_KEY, "left_anti")


def coverage(tables: DataFrame, table_descriptions: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: counts and the shares of described and related tables (0.0 on an empty catalog)."""
    slots = table_descriptions.agg(
        F.count("description").alias("description_present"),
        F.count_if(F.col("description").isNull()).alias("description_null"),
    )
    linked = incident_counts(tables, relationships).agg(
        F.count("*").alias("table_count"),
        F.count_if(F.col("incident") > 0).alias("tables_with_relationships"),
        F.count_if(F.col("incident") == 0).alias("orphan_count"),
    )
    edges = relationships.agg(F.count("*").alias("relationship_count"))
    # One-row results side by side: stacked, then the only value per column.
    names = [*linked.columns, *slots.columns, *edges.columns]
    row = linked.unionByName(slots, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in names])
    share = lambda part: F.when(
        F.col("table_count") > 0, F.col(part) / F.col("table_count")).otherwise(0.0)
    return row.select(
        "*",
        share("description_present").alias("description_coverage"),
        share("tables_with_relationships").alias("relationship_coverage"),
    )


def pii_distribution(column_descriptions: DataFrame) -> DataFrame:
    """Columns per risk level; all levels are present."""
    counts = [F.count_if(F.col("pii_risk") == risk).alias(risk) for risk in PII_RISKS]
    levels = F.array(*[F.struct(F.lit(r).alias("pii_risk"), F.col(r).alias("n")) for r in PII_RISKS])
    return column_descriptions.agg(*counts).select(F.inline(levels))


def confidence(table_descriptions: DataFrame, column_descriptions: DataFrame) -> DataFrame:
    """Mean, minimum, maximum and count of confidences by level; no row for an empty level."""
    def level(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.avg("confidence").alias("mean"), F.min("confidence").alias("minimum"),
            F.max("confidence").alias("maximum"), F.count("confidence").alias("n"),
        ).filter("n > 0").select(F.lit(name).alias("level"), "*")

    described = table_descriptions.filter(F.col("description").isNotNull())
    return level(described, "table").unionByName(level(column_descriptions, "column"))
