"""Joins and ranks that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolake.session import materialize

# A key is spread once it has this many rows; smaller keys fit one task.
HOT_ROWS = 1_000_000
# At most this many keys are listed for broadcast.  Keys beyond the list are
# joined like any other key (and left to AQE), so results never depend on it.
HOT_KEYS = 10_000
# Tasks a hot key is spread over.
SALTS = 64


def hot_keys(freq: DataFrame, keys: Sequence[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The heaviest keys of a key/count table: at most HOT_KEYS rows, safe to broadcast."""
    return (
        freq.filter(F.col(count) >= hot_rows)
        .orderBy(F.col(count).desc())
        .limit(HOT_KEYS)
        .select(*keys)
    )


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    freq: DataFrame | None = None,
    count: str = "n",
    spread: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    total: int | None = None,
) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` that has at most one row per key.

    Hot keys get a salt: their rows are spread over ``salts`` tasks by a hash of
    the ``spread`` columns (all columns by default) and their single lookup row
    is repeated once per salt.  The salt is a function of row content, so a
    recomputed task produces the same placement.  ``freq`` is a ready key/count
    table when the caller has one; otherwise it is one partial aggregation over
    the key columns.  A caller that knows the ``total`` number of rows passes it:
    below ``hot_rows`` no key can be hot, and the join is a plain one.
    """
    keys = list(keys)
    if total is not None and total < hot_rows:
        return rows.join(lookup, keys, how)
    if freq is None:
        freq = rows.groupBy(*keys).agg(F.count("*").alias(count))
    freq_keys = [k for k in keys if k in freq.columns]
    hot = F.broadcast(hot_keys(freq, freq_keys, count, hot_rows).withColumn("__hot", F.lit(True)))
    by = list(spread) if spread else rows.columns
    salted_rows = (
        rows.join(hot, freq_keys, "left")
        .withColumn(
            "__salt",
            F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0),
        )
        .drop("__hot")
    )
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_lookup = (
        lookup.join(hot, freq_keys, "left")
        .withColumn(
            "__salt",
            F.explode(F.when(F.col("__hot"), every_salt).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hot")
    )
    return salted_rows.join(salted_lookup, [*keys, "__salt"], how).drop("__salt")


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank",
               partitions: int | None = None) -> DataFrame:
    """Number the rows of each group (1, 2, 3 …) by ``order`` without putting a group into one task.

    Rows are range-partitioned by group and order and written once, so that every
    row keeps its slice.  Ranks inside a slice are shifted by the sizes of the
    group's earlier slices.  A top-k per group does not need this: there Spark
    already filters by rank before the shuffle.
    """
    spark = df.sparkSession
    slices = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                               spark.sparkContext.defaultParallelism)
    sliced = materialize(
        df.repartitionByRange(slices, *group, *order).withColumn("__slice", F.spark_partition_id()), "ranked")
    sizes = sliced.groupBy(*group, "__slice").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy(*order))
    return (
        sliced.withColumn("__within", within).join(offsets, [*group, "__slice"])
        .withColumn(name, F.col("__offset") + F.col("__within"))
        .drop("__slice", "__within", "__offset")
    )
