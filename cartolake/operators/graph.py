"""Connected components of the relationship graph.

Inferred edges stay in their schema, so edges are laid out by schema and each run
of them is contracted where it lies: a node gets the smallest node of its run's
component.  Only nodes of several runs link such roots, and only the graph of these
links passes through the rounds.

Alternating large-star/small-star (Kiveris et al., "Connected Components in
MapReduce and Beyond", SoCC 2014): the number of rounds grows with the logarithm
of the graph, not with its diameter, and a node with very many neighbours is
reduced to its minimum before it is joined back.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.operators.quality import endpoints
from cartolake.operators.skew import SALTS, hot_keys, lookup_join
from cartolake.schema import TABLE_KEY
from cartolake.session import materialize

# Functions that run in tasks travel with the plan: executors need no copy of this module.
register_pickle_by_value(sys.modules[__name__])

# Edges contracted at once in a task; where runs are cut changes what travels, not the result.
RUN_EDGES = 1 << 16
# A side of a join with at most so many rows of two numbers is broadcast.
BROADCAST_ROWS = 500_000


def _node_id(seed: int, schema: str, table: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(schema), F.col(table))


def _numbered_nodes(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Nodes with a 64-bit id, and the seed that makes the ids distinct.

    Ids keep the rounds to fixed-width rows.  They are checked for collisions
    exactly; a collision (in practice none) tries the next seed.
    """
    stored = materialize(nodes, "nodes")
    seed = 0
    while True:
        numbered = stored.withColumn("id", _node_id(seed, *TABLE_KEY))
        if not numbered.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").take(1):
            return numbered, seed
        seed += 1


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour."""
    both_ways = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    smallest = both_ways.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return (
        lookup_join(both_ways.filter("v > u"), smallest.select("u", "m"), ["u"], freq=smallest.select("u", "n"),
                    spread=["v"], total=total)
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them (edges have v < u)."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = (
        lookup_join(edges, smallest.select("u", "m"), ["u"], freq=smallest.select("u", "n"), spread=["v"],
                    total=total)
        .filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """True when the edges are stars: every node has one parent and no parent has one itself."""
    roles = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))))
    unsettled = roles.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter(
        (F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0)))
    return not unsettled.take(1)


def _run_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), and the smallest node each is connected with."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _contract(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of each run of edges (u, v)."""
    run = RUN_EDGES

    def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def roots() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in _run_roots(*(np.concatenate(c) for c in zip(*held)))], names=["id", "root"])

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, run):
                part = batch.slice(at, run)
                if held and rows + part.num_rows > run:
                    yield roots()
                    held, rows = [], 0
                held.append([part[c].to_numpy(zero_copy_only=False) for c in ("u", "v")])
                rows += part.num_rows
        if held:
            yield roots()

    return edges.select("u", "v").mapInArrow(contracted, "id long, root long")


def _few(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its measured rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """(schema, table, is_table, label) for catalog tables and for endpoints outside the catalog.

    Tables of one component share a label.  Endpoints that are not in the catalog
    are part of the graph.  Each round is written to the shared checkpoint folder;
    the driver sees counts and at most one row per round.
    """
    ends = ["source_schema", "source_table", "target_schema", "target_table"]
    pairs = materialize(
        relationships.select(*ends)
        .filter((F.col("source_schema") != F.col("target_schema")) | (F.col("source_table") != F.col("target_table"))), "pairs")
    nodes, seed = _numbered_nodes(
        tables.select(*TABLE_KEY, F.lit(True).alias("is_table"))
        .unionByName(endpoints(pairs).withColumn("is_table", F.lit(False)))
        .groupBy(*TABLE_KEY).agg(F.max("is_table").alias("is_table")))
    # Sorted by schema, runs of edges hold whole schemas; only a huge schema is spread over tasks.
    huge = hot_keys(pairs.groupBy("source_schema").agg(F.count("*").alias("n")), ["source_schema"], "n")
    laid = (
        pairs.join(F.broadcast(huge.withColumn("__hot", F.lit(True))), "source_schema", "left")
        .repartition("source_schema", F.when(F.col("__hot"), F.pmod(F.xxhash64("source_table"), F.lit(SALTS))))
        .sortWithinPartitions("source_schema"))
    runs = materialize(_contract(laid.select(
        _node_id(seed, *ends[:2]).alias("u"), _node_id(seed, *ends[2:]).alias("v"))), "runs")
    own = runs.groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("last"))
    # A run names a node once, so even one with very many edges has few roots to link.
    shared = materialize(own.filter("root < last").select("id", F.col("root").alias("v")), "shared")
    edges = materialize(
        runs.join(_few(shared), "id").filter("root != v").select(F.col("root").alias("u"), "v").distinct(), "links")
    total = 2 * edges.count()
    while total:
        # Rounds never add edges, so the first total bounds every later one.
        edges = materialize(_small_star(_large_star(edges, total), total), "components")
        if _settled(edges):
            break
    joined = _few(edges.select(F.col("u").alias("root"), F.col("v").alias("label")))
    roots = own.select("id", "root").join(joined, "root", "left").select("id", F.coalesce("label", "root").alias("label"))
    labels = nodes.join(roots, "id", "left").select(*TABLE_KEY, "is_table", F.coalesce("label", "id").alias("label"))
    # Sizes and summaries read the labels several times.
    return materialize(labels, "labels")


def component_sizes(labels: DataFrame) -> DataFrame:
    """Per component: nodes, and how many of them are catalog tables."""
    return labels.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("is_table")).alias("n_tables"))


def table_components(labels: DataFrame) -> DataFrame:
    """(schema, table, component_size) for catalog tables; a giant component is spread over tasks."""
    sizes = component_sizes(labels)
    return lookup_join(
        labels.filter("is_table"), sizes.select("label", F.col("n").alias("component_size")), ["label"],
        freq=sizes.select("label", "n"), spread=TABLE_KEY,
    ).select(*TABLE_KEY, "component_size")


def graph_summary(labels: DataFrame) -> DataFrame:
    """One row: components, largest, largest/tables, and tables reachable on average (self included)."""
    held = component_sizes(labels).filter("n_tables > 0")
    totals = held.agg(
        F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("largest_component_size"),
        F.sum("n_tables").alias("tables"), F.sum(F.col("n") * F.col("n_tables")).alias("reachable"))
    share = lambda c: F.when(F.col("tables") > 0, F.col(c) / F.col("tables")).otherwise(0.0)
    return totals.select(
        "components", "largest_component_size",
        share("largest_component_size").alias("largest_component_fraction"),
        share("reachable").alias("mean_reachable"))
