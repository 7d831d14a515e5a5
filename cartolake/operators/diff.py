"""Structural comparison of two catalogs by stable keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.schema import EDGE, TABLE_KEY


def _sides(current: DataFrame, other: DataFrame, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """One row per key with flags ``cur``/``oth`` and the value of either side.

    Stack and group instead of a full outer join: duplicates collapse map-side
    and there is one shuffle.
    """
    carried = [F.col(value)] if value else []
    stacked = current.select(*keys, *carried, F.lit(True).alias("__cur")).unionByName(
        other.select(*keys, *carried, F.lit(False).alias("__cur")))
    aggs = [F.max(F.col("__cur")).alias("cur"), F.max(~F.col("__cur")).alias("oth")]
    if value:
        aggs += [F.max(F.when(F.col("__cur"), F.col(value))).alias("cur_value"),
                 F.max(F.when(~F.col("__cur"), F.col(value))).alias("oth_value")]
    return stacked.groupBy(*keys).agg(*aggs)


def table_changes(current: DataFrame, other: DataFrame) -> DataFrame:
    """Tables only one side has: (change_type, schema, table)."""
    change = F.when(F.col("cur"), "table_added").otherwise("table_removed")
    return _sides(current, other, TABLE_KEY).filter(F.col("cur") != F.col("oth")).select(
        change.alias("change_type"), *TABLE_KEY)


def relationship_changes(current: DataFrame, other: DataFrame) -> DataFrame:
    """Edges only one side has.  The kind is reported but is not part of the key.

    An edge listed as both declared and inferred reports ``inferred``, the later
    of the two in catalog order.
    """
    # The kind travels as a flag: fixed-width values keep the aggregation hash-based.
    flagged = lambda df: df.select(*EDGE, (F.col("kind") == "inferred").alias("inferred"))
    added = F.col("cur")
    inferred = F.when(added, F.col("cur_value")).otherwise(F.col("oth_value"))
    return _sides(flagged(current), flagged(other), EDGE, "inferred").filter(F.col("cur") != F.col("oth")).select(
        F.when(added, "relationship_added").otherwise("relationship_removed").alias("change_type"),
        *EDGE, F.when(inferred, "inferred").otherwise("declared").alias("kind"))


def description_changes(current: DataFrame, other: DataFrame) -> DataFrame:
    """Descriptions added, removed or changed; a failed slot and a missing one are the same.

    Hints compare as sets.  ``confidence_delta`` is current minus other, unrounded.
    """
    def present(df: DataFrame, prefix: str) -> DataFrame:
        names = ("description", "grain", "domain_hints", "confidence")
        return df.filter(F.col("description").isNotNull()).select(
            *TABLE_KEY, *[F.col(n).alias(f"{prefix}_{n}") for n in names], F.lit(True).alias(f"{prefix}_there"))

    pair = present(current, "cur").join(present(other, "oth"), TABLE_KEY, "full")
    none = F.array().cast("array<string>")
    hints = {p: F.coalesce(F.col(f"{p}_domain_hints"), none) for p in ("cur", "oth")}
    both = F.col("cur_there") & F.col("oth_there")
    compared = pair.select(
        *TABLE_KEY,
        F.when(F.col("oth_there").isNull(), "description_added")
        .when(F.col("cur_there").isNull(), "description_removed")
        .otherwise("description_changed").alias("change_type"),
        F.when(both, ~F.col("cur_description").eqNullSafe(F.col("oth_description"))).alias("text_changed"),
        F.when(both, ~F.col("cur_grain").eqNullSafe(F.col("oth_grain"))).alias("grain_changed"),
        F.when(both, F.col("cur_confidence") - F.col("oth_confidence")).alias("confidence_delta"),
        F.when(both, F.sort_array(F.array_except(hints["cur"], hints["oth"]))).alias("hints_added"),
        F.when(both, F.sort_array(F.array_except(hints["oth"], hints["cur"]))).alias("hints_removed"),
    )
    different = (
        F.col("text_changed") | F.col("grain_changed") | (F.col("confidence_delta") != 0.0)
        | (F.size("hints_added") > 0) | (F.size("hints_removed") > 0)
    )
    return compared.filter((F.col("change_type") != "description_changed") | different)


def diff(
    tables: DataFrame, other_tables: DataFrame,
    relationships: DataFrame, other_relationships: DataFrame,
    descriptions: DataFrame, other_descriptions: DataFrame,
) -> DataFrame:
    """All changes in one long result; columns a change type does not use are NULL."""
    edges = relationship_changes(relationships, other_relationships).select(
        "change_type", F.col("source_schema").alias("schema"), F.col("source_table").alias("table"),
        "source_column", *EDGE[3:], "kind")
    return (
        table_changes(tables, other_tables)
        .unionByName(edges, allowMissingColumns=True)
        .unionByName(description_changes(descriptions, other_descriptions), allowMissingColumns=True)
    )


def diff_counts(changes: DataFrame) -> DataFrame:
    """Number of changes per type."""
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))
