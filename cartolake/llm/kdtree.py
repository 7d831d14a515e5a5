"""Exact top-k by inner product: a KD-tree per shard, searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.llm.common import materialize

SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
LEAF_ROWS = 64
FOUND = "query_id long, vec_id long, score long"


class KDTree:
    """Median splits on the widest side; each node keeps the tight box of its points."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        lows, highs, spans, children = [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            start, end, parent = stack.pop()
            node = len(lows)
            if parent >= 0:
                children[parent].append(node)
            rows = points[self.order[start:end]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            lows.append(low)
            highs.append(high)
            spans.append((start, end))
            children.append([])
            widths = high - low
            axis = int(np.argmax(widths))
            if end - start > leaf_rows and widths[axis] > 0:
                middle = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(rows[:, axis], middle)]
                stack += [(start, start + middle, node), (start + middle, end, node)]
        self.low, self.high = np.array(lows), np.array(highs)
        self.spans, self.children = spans, children
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that any point of a node's box can have: queries by nodes."""
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same integers in the fastest type in which all their products are exact."""
    top = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (a, b)]
    reach = top[0] * top[1] * a.shape[1]
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
    return a.astype(kind), b.astype(kind)


def search_shard(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: list,
                 k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of the k best points of one shard for each query.

    ``floors`` holds, per query, the kth score known from another shard: boxes
    that cannot reach it are never opened.  Boxes that only equal it are, for a
    tie may go to a smaller id.
    """
    points, queries = _exact(points, queries)
    tree = KDTree(points)
    ids = ids[tree.order]
    bounds = tree.bounds(queries)
    for q, query_id in enumerate(query_ids):
        least = floors[q]
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first
        reach = bounds[q]
        queue = [(-reach[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if least is not None and -bound < least:
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    if least is None or reach[child] >= least:
                        heapq.heappush(queue, (-reach[child], child))
                continue
            start, end = tree.spans[node]
            scores = tree.points[start:end] @ queries[q]
            near = range(end - start) if least is None else np.flatnonzero(scores >= least)
            for i in near:
                if (vec_id := int(ids[start + i])) == query_id:
                    continue
                item = (int(scores[i]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (least is None or best[0][0] > least):
                least = best[0][0]
        for score, negative in best:
            yield int(query_id), -negative, max(-(1 << 63), min((1 << 63) - 1, score))


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def matrix(column: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
        values = column.combine_chunks().take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        return values.reshape(len(rows), dim)

    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        dims = np.array(points["dim"].to_numpy()), np.array(queries["dim"].to_numpy())
        for dim in np.unique(dims[1]):
            at, of = np.flatnonzero(dims[0] == dim), np.flatnonzero(dims[1] == dim)
            if len(at) and len(of):
                floors = queries["least"].take(pa.array(of)).to_pylist()
                found += search_shard(
                    points["vec_id"].to_numpy()[at], matrix(points["v"], at, int(dim)),
                    queries["vec_id"].to_numpy()[of], matrix(queries["v"], of, int(dim)), floors, k)
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return search


def quantised(vectors: DataFrame, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): floor(scale * x) of every usable vector, one row per id."""
    values = F.col(embedding)
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(
        usable, F.transform(values, lambda x: F.floor(x.cast("double") * F.lit(scale)))).alias("v"))
    return (
        rows.filter("vec_id is not null and size(v) > 0")
        .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    )


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], *, k: int = 5, scale: float = 256.0,
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to smaller ids.

    Points are dealt into shards of about ``shard_rows`` rows by a hash of their
    id and queries into blocks; a task holds one shard and one block.  Each query
    first searches the shard its own id belongs to; the kth score found there is
    carried to the search of all other shards.

    Vectors that are null or empty or hold null or non-finite components take no
    part, nor do rows without id.  Vectors of another dimension than the query's
    are no candidates.  Of several rows with one id the smallest vector counts.
    An empty table gives no rows; other columns are ignored.
    """
    points = materialize(quantised(vectors, scale), "points")
    spark = points.sparkSession
    total, asked = points.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // block_queries))
    numbered = points.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = numbered.filter(is_query(F.col("vec_id"))).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int"))
    cells = numbered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(asking: DataFrame) -> DataFrame:
        key = ["shard", "block"]
        fresh = asking.select(*(F.col(c).alias(c) for c in asking.columns))  # new column ids: both sides stem from points
        return cells.groupBy(*key).cogroup(fresh.groupBy(*key)).applyInArrow(_cell(k), FOUND)

    home = materialize(searched(queries.withColumn("least", F.lit(None).cast("long"))), "home")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = (
        queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
        .withColumnRenamed("shard", "home")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard != home").drop("home"))
    found = home if shards == 1 else home.unionByName(searched(others))
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
