"""Value overlap as a tiebreaker between several possible targets of a column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.operators.containment import canonical
from cartolake.schema import EDGE, SOURCE


def containment(candidates: DataFrame, tables: Mapping[str, DataFrame], schema: str = "main") -> DataFrame:
    """Share of distinct source values found in each candidate target.

    Source values are reduced to distinct ones first (combined map-side), so no
    value is heavy in the join; target values are key columns and distinct by
    nature, and are reduced the same way.  Equal numbers meet whatever their type.
    The pairs compared are the candidate pairs only; their names pass through the
    driver, so any number of pairs is a case for ``containment.contained``.
    """
    # Names of the columns involved: bounded by the width of the given schemas.
    pairs = [tuple(r) for r in candidates.select(*EDGE).filter(
        (F.col("source_schema") == schema) & (F.col("target_schema") == schema)).distinct().collect()]
    spark = candidates.sparkSession
    if not pairs:
        return spark.createDataFrame([], ", ".join([*(f"{c} string" for c in EDGE),
                                                    "n_values bigint", "n_found bigint", "containment double"]))

    def values(table: str, column: str) -> DataFrame:
        return tables[table].select(canonical(tables[table].schema[column]).alias("value")).filter(
            "value IS NOT NULL").distinct()

    def stacked(ends: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            values(t, c).select(F.lit(t).alias(names[0]), F.lit(c).alias(names[1]), "value") for t, c in ends])

    sources = stacked(sorted({(p[1], p[2]) for p in pairs}), ("source_table", "source_column"))
    targets = stacked(sorted({(p[4], p[5]) for p in pairs}), ("target_table", "target_column"))
    wanted = spark.createDataFrame(pairs, ", ".join(f"{c} string" for c in EDGE))
    probes = sources.join(F.broadcast(wanted), ["source_table", "source_column"])
    found = probes.join(targets.withColumn("found", F.lit(1)), ["target_table", "target_column", "value"], "left")
    return found.groupBy(*EDGE).agg(
        F.count("*").alias("n_values"), F.count("found").alias("n_found")
    ).withColumn("containment", F.col("n_found") / F.col("n_values"))


def break_ties(contained: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The single best target per source at or above ``threshold``; a tie for best stays silent.

    Positive evidence only: no pair outside the candidates is ever proposed.
    """
    good = contained.filter(F.col("containment") >= threshold)
    best = good.groupBy(*SOURCE).agg(F.max("containment").alias("containment"))
    leaders = good.join(best, [*SOURCE, "containment"])
    single = leaders.groupBy(*SOURCE).agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    return leaders.join(single, SOURCE, "left_semi").select(*EDGE, "n_values", "n_found", "containment")
