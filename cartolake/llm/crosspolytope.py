"""Near-duplicate vectors by cross-polytope hashing, multiprobe buckets and verified pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import materialize, mixed, whole_groups
from cartolake.llm.components import components

TABLES = 10
HASHES = 2
PROBES = 3
# Vectors of one bucket that meet in one task; larger buckets are cut into blocks.
BLOCK_ROWS = 2048
# A cell (i, j) of blocks has the number i * CELLS + j; no bucket has as many blocks.
CELLS = 1 << 31
PAIRS_AT_ONCE = 1 << 17


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the width is a power of two."""
    rows, step = rows.copy(), 1
    n, width = rows.shape
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def codes(units: np.ndarray, labels: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """The buckets of unit vectors: rows by (tables * probes) 64-bit keys, no two equal in a row.

    A table rotates by three rounds of random signs and the Hadamard transform
    and takes the largest coordinate with its sign, ``hashes`` times.  The
    further probes replace the hash whose two largest coordinates are closest by
    the second of them, the next closest after that, and so on.
    """
    n, dim = units.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = units
    keys = np.empty((n, tables, probes), np.uint64)
    signs = np.random.Generator(np.random.PCG64([seed, width]))
    salt = mixed(labels.astype(np.int64).view(np.uint64) + np.uint64(dim << 32))
    for table in range(tables):
        first, second, gaps = [], [], []
        for _ in range(hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * signs.choice([-1.0, 1.0], width))
            size = np.abs(turned)
            top = np.argpartition(size, width - 2, axis=1)[:, -2:]
            by = np.take_along_axis(size, top, 1)
            swap = by[:, 0] > by[:, 1]
            top[swap] = top[swap][:, ::-1]
            names = top * 2 + (np.take_along_axis(turned, top, 1) < 0)
            first.append(names[:, 1].astype(np.uint64))
            second.append(names[:, 0].astype(np.uint64))
            gaps.append(np.abs(by[:, 0] - by[:, 1]))
        closest = np.argsort(np.array(gaps), axis=0, kind="stable")
        for probe in range(probes):
            key = salt + np.uint64(table + 1)
            for h in range(hashes):
                other = (closest[probe - 1] == h) if probe else np.zeros(n, bool)
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.where(other, second[h], first[h]))
            keys[:, table, probe] = key
    return keys.reshape(n, tables * probes)


def _units(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims):
        yield batch.take(pa.array(np.flatnonzero(dims == dim)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position each position is linked to, through any number of links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _padded(column: pa.ListArray) -> np.ndarray:
    """Lists of keys as rows of one width, filled up with the largest value."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), int(sizes.max(initial=0))), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def links(batch: pa.Table, least: float) -> dict[str, np.ndarray]:
    """Link counts and local roots of the vectors of whole buckets, sorted by (bucket, cell).

    A pair that shares several buckets counts in the smallest of them alone;
    ``own`` lists the buckets a vector shares with any other.
    """
    units, ids, bucket = _units(batch["v"].combine_chunks()), batch["vec_id"].to_numpy(), batch["bucket"].to_numpy()
    cell, block, weight = batch["cell"].to_numpy(), batch["block"].to_numpy(), batch["n"].to_numpy()
    own = _padded(batch["own"].combine_chunks())
    run = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])])) if len(ids) else cell
    ends = np.searchsorted(run, run, side="right")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Pairs of a run lie a fixed number of rows apart: all runs advance together.
    start = np.arange(len(ids))
    for apart in range(1, int((ends - start).max(initial=0))):
        a = start[ends - start > apart]
        b = a + apart
        # A cell of two different blocks holds the pairs across them; a cell of one block all its pairs.
        across = (cell[a] // CELLS == cell[a] % CELLS) | (block[a] != block[b])
        a, b = a[across], b[across]
        for i in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
            near = np.einsum("ij,ij->i", units[x], units[y]) >= least
            x, y = x[near], y[near]
            for j in range(0, len(x), 4096):
                p, q = x[j : j + 4096], y[j : j + 4096]
                shared = (own[p][:, :, None] == own[q][:, None, :]).any(axis=2)
                lowest = np.where(shared, own[p], np.iinfo(np.int64).max).min(axis=1)
                mine = lowest == bucket[p]
                found.append((p[mine], q[mine]))
    a = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([q for _, q in found]) if found else np.zeros(0, np.int64)
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, a, weight[b])
    np.add.at(n, b, weight[a])
    root = _roots(len(ids), a, b)
    hit = np.flatnonzero(n)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root[hit], ids[hit])
    return {"vec_id": ids[hit], "n": n[hit], "root": low[root[hit]]}


def _one_dim(table: pa.Table) -> Iterator[pa.Table]:
    dims = table["dim"].to_numpy()
    for dim in np.unique(dims):
        yield table.take(pa.array(np.flatnonzero(dims == dim)))


def near_vectors(vectors: DataFrame, *, least: float = 0.93, tables: int = TABLES, hashes: int = HASHES,
                 probes: int = PROBES, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label whose cosine reaches ``least``.

    Equal vectors of a label are one class with a weight, so copies are never
    paired with each other.  Each class joins its bucket and probe buckets in
    every table; buckets that one class has alone are dropped before the vectors
    travel, and large buckets are cut into blocks that meet two by two.  Every
    candidate pair is verified in double precision; a task returns link counts
    and a star per local component, not pairs.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    rows without label and rows without id link with nothing; a row without id
    has no component and is kept.  Of rows that repeat an id and vector each is a
    vector of its own; rows of one id share their component.  Empty table: no rows.
    """
    plan = (tables, hashes, min(probes, hashes + 1), seed)
    values = F.col("embedding")
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    nonzero = F.exists(values, lambda x: x != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.when(usable & nonzero, values.cast("array<double>")).alias("v"))
    taking = rows.filter("vec_id is not null and label is not null and v is not null")
    classes = materialize(taking.groupBy("label", "v").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("v")), "vector-classes")

    def entries(batches):
        for batch in batches:
            for part in _by_dim(batch):
                keys = codes(_units(part["v"]), part["label"].to_numpy(), *plan).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["rep"], part["label"], pa.ListArray.from_arrays(
                        pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))],
                    names=["rep", "label", "buckets"])

    # rep and label together name a class: one id may stand for vectors of two labels.
    entered = materialize(
        classes.select("rep", "label", "v", "dim").mapInArrow(entries, "rep long, label long, buckets array<long>")
        .select("rep", "label", F.explode(F.array_distinct("buckets")).alias("bucket")), "bucket-entries")
    sizes = entered.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block_rows)).cast("long")
    # The few buckets of a vector come together before they meet it, so it travels to them only once each.
    shared = entered.join(sizes, "bucket").groupBy("rep", "label").agg(
        F.collect_list(F.struct("bucket", blocks.alias("blocks"))).alias("shared"))
    placed = classes.join(shared, ["rep", "label"]).select(
        "rep", "label", "v", "dim", "n", F.col("shared.bucket").alias("own"), F.inline("shared")).withColumn(
        "block", F.pmod(F.xxhash64("rep", "label"), F.col("blocks")))
    # Block i meets block j >= i in cell (i, j); an unsplit bucket has the cell (0, 0).
    meets = placed.withColumn("cell", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda j: F.least(j, F.col("block")) * CELLS + F.greatest(j, F.col("block")))))
    spark = classes.sparkSession
    carried = meets.select("rep", "v", "dim", "n", "own", "bucket", "block", "cell")
    together = carried.repartition(F.col("bucket"), F.col("cell")).sortWithinPartitions("dim", "bucket", "cell")

    def linked(batches):
        for table in whole_groups(batches, ["dim", "bucket", "cell"]):
            for part in _one_dim(table.rename_columns(["vec_id" if c == "rep" else c for c in table.column_names])):
                out = links(part, least)
                yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in ("vec_id", "n", "root")],
                                                      names=["rep", "n", "root"])

    found = materialize(together.mapInArrow(linked, "rep long, n long, root long"), "vector-links")
    return _labelled(spark, rows, classes, found)


def _labelled(spark, rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy("rep").agg(F.sum("n").alias("far"))
    own = classes.select("label", "v", "rep", (F.col("n") - 1).alias("copies"))
    # Ids of copies reach their class's smallest id; ids shared by classes join them.
    members = rows.join(own, ["label", "v"], "left").select("vec_id", "rep", "copies")
    star = members.filter("rep is not null").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).union(star))
    return (
        members.join(counts, "rep", "left").join(roots, F.col("vec_id") == F.col("id"), "left")
        .select(
            "vec_id", (F.coalesce("copies", F.lit(0)) + F.coalesce("far", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
