"""Connected components over integer ids, for links that are found pair by pair.

Large-star and small-star in turn (Kiveris et al., SoCC 2014).  Every round is a
table in the shared checkpoint folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import materialize
from cartolake.operators.skew import HOT_ROWS, lookup_join


def _large_star(edges: DataFrame, total: int, hot_rows: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return lookup_join(both.filter("v > u"), least, ["u"], spread=["v"], hot_rows=hot_rows, total=2 * total).select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int, hot_rows: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = lookup_join(edges, least, ["u"], spread=["v"], hot_rows=hot_rows, total=total).filter("v > m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, component) for every id in ``edges`` (u, v; any order, loops ignored).

    ``component`` is the smallest id that can be reached.  No edges: no rows.  An id
    with ``hot_rows`` edges or more is spread over tasks.
    """
    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = materialize(edges, "links")
    seen = state(edges)
    while seen[0]:
        edges = materialize(_small_star(_large_star(edges, seen[0], hot_rows), seen[0], hot_rows), "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
