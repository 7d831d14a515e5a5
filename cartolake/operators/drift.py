"""Change between two scans: schema drift, what to describe again, score movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.schema import COLUMN_KEY, TABLE_KEY


def column_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Columns added, removed or retyped: (change_type, schema, table, column, old_type, new_type).

    A column is there if it has a row, whatever its type; unknown types equal each other.
    """
    stacked = current.select(*COLUMN_KEY, F.lit(True).alias("now"), "data_type").unionByName(
        previous.select(*COLUMN_KEY, F.lit(False).alias("now"), "data_type"))
    pair = stacked.groupBy(*COLUMN_KEY).agg(
        F.max("now").alias("now"), F.min("now").alias("only_now"),
        F.max(F.when(F.col("now"), F.col("data_type"))).alias("new_type"),
        F.max(F.when(~F.col("now"), F.col("data_type"))).alias("old_type"))
    change = (
        F.when(F.col("only_now"), "column_added")
        .when(~F.col("now"), "column_removed")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "column_retyped")
    )
    return pair.withColumn("change_type", change).filter(F.col("change_type").isNotNull()).select(
        "change_type", *COLUMN_KEY, "old_type", "new_type")


def table_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Tables added or removed, and row-count movement as a warning."""
    stacked = current.select(*TABLE_KEY, F.lit(1).alias("side"), "row_count").unionByName(
        previous.select(*TABLE_KEY, F.lit(0).alias("side"), "row_count"))
    pair = stacked.groupBy(*TABLE_KEY).agg(
        F.max("side").alias("now"), F.min("side").alias("before"),
        F.max(F.when(F.col("side") == 1, F.col("row_count"))).alias("new_count"),
        F.max(F.when(F.col("side") == 0, F.col("row_count"))).alias("old_count"))
    change = (
        F.when(F.col("before") == 1, "table_added").when(F.col("now") == 0, "table_removed")
        .when(F.col("new_count") != F.col("old_count"), "row_count_changed")
    )
    return pair.withColumn("change_type", change).filter(F.col("change_type").isNotNull()).select(
        "change_type", *TABLE_KEY, "old_count", "new_count",
        F.when(F.col("change_type") == "row_count_changed", F.col("new_count") - F.col("old_count"))
        .alias("row_count_delta"))


def _line() -> Column:
    """A column's structure as JSON with nulls kept: no two structures read the same."""
    return F.to_json(F.struct("column", "data_type", "nullable", "is_primary_key"), {"ignoreNullFields": "false"})


def fingerprints(columns: DataFrame, page_size: int = 1000) -> DataFrame:
    """A digest of each table's column structure: (schema, table, fingerprint).

    Digested in pages of ``page_size`` ordinals and then over the page digests,
    so a very wide table is never one long list.
    """
    page = F.floor((F.col("ordinal") - 1) / page_size).cast("int")
    ordered = lambda entry: F.sort_array(F.collect_list(entry))
    pages = columns.withColumn("page", page).withColumn("line", _line()).groupBy(*TABLE_KEY, "page").agg(
        F.sha2(F.array_join(F.transform(ordered(F.struct("ordinal", "line")), lambda x: x["line"]), "\n"), 256)
        .alias("digest"))
    return pages.groupBy(*TABLE_KEY).agg(
        F.sha2(F.array_join(F.transform(ordered(F.struct("page", "digest")), lambda x: x["digest"]), "\n"), 256)
        .alias("fingerprint"))


def stale_tables(current: DataFrame, stored: DataFrame, model: str, prompt_hash: str) -> DataFrame:
    """Tables to describe again, with the reason.

    ``current`` and ``stored`` carry schema, table, fingerprint; ``stored`` also
    model and prompt_hash, one row per described table.
    """
    before = stored.select(*TABLE_KEY, F.col("fingerprint").alias("old"), "model", "prompt_hash",
                           F.lit(True).alias("described"))
    reason = (
        F.when(F.col("described").isNull(), "new_table")
        .when(~F.col("fingerprint").eqNullSafe(F.col("old")), "columns_changed")
        .when(~F.col("model").eqNullSafe(F.lit(model)), "model_changed")
        .when(~F.col("prompt_hash").eqNullSafe(F.lit(prompt_hash)), "prompt_changed")
    )
    return current.join(before, TABLE_KEY, "left").select(*TABLE_KEY, reason.alias("reason")).filter(
        F.col("reason").isNotNull())


def score_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Per table: change of each judged dimension between two runs (tables scored in both)."""
    dims = ("accuracy", "specificity", "domain_inference")
    before = previous.select(*TABLE_KEY, *[F.col(d).alias(f"old_{d}") for d in dims])
    return current.join(before, TABLE_KEY).select(
        *TABLE_KEY, *[(F.col(d) - F.col(f"old_{d}")).alias(f"{d}_delta") for d in dims])
