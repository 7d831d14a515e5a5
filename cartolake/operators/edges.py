"""Precision and recall of inferred edges against declared ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.schema import EDGE


def compare_edges(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Distinct edges with a status: matched, missed or false_positive.

    Both sets are stacked and grouped once: one shuffle, combined map-side, and
    no join.
    """
    sides = declared.select(*EDGE, F.lit(1).alias("d"), F.lit(0).alias("i")).unionByName(
        inferred.select(*EDGE, F.lit(0).alias("d"), F.lit(1).alias("i")))
    both = sides.groupBy(*EDGE).agg(F.max("d").alias("d"), F.max("i").alias("i"))
    status = F.when(F.col("i") == 0, "missed").when(F.col("d") == 0, "false_positive").otherwise("matched")
    return both.select(*EDGE, status.alias("status"))


def edge_metrics(compared: DataFrame) -> DataFrame:
    """One row: counts, recall, precision, f1; a ratio without a denominator is NULL."""
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    counts = compared.agg(
        is_("matched", "missed").alias("declared_count"),
        is_("matched", "false_positive").alias("inferred_count"),
        is_("matched").alias("matched_count"),
    )
    ratios = counts.select(
        "*",
        F.when(F.col("declared_count") > 0, F.col("matched_count") / F.col("declared_count")).alias("recall"),
        F.when(F.col("inferred_count") > 0, F.col("matched_count") / F.col("inferred_count")).alias("precision"),
    )
    total = F.col("recall") + F.col("precision")
    return ratios.withColumn("f1", F.when(total > 0, 2 * F.col("recall") * F.col("precision") / total))


def edge_breakdown(compared: DataFrame) -> DataFrame:
    """The same counts per source table; every table shown has at least one edge."""
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    return compared.groupBy(
        F.col("source_schema").alias("schema"), F.col("source_table").alias("table")
    ).agg(
        is_("matched", "missed").alias("declared"),
        is_("matched").alias("inferred_correct"),
        is_("missed").alias("missed"),
        is_("false_positive").alias("false_positive"),
    )
