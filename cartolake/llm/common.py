"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.session import materialize

__all__ = ["WORD", "materialize", "text_class", "small_side", "kept_ids", "read", "whole_groups", "mixed"]

# A word: a run of characters other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# A side of a join is broadcast up to this many (estimated) bytes; beyond it, it is shuffled.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_class(text: Column) -> Column:
    """16 bytes that are equal for equal texts only (the first half of SHA-256); null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def small_side(stored: DataFrame, size: Column) -> DataFrame:
    """``stored`` (a materialised table) with a broadcast hint if its measured size allows it.

    ``size`` is an expression for the bytes of a row.  Larger tables come back
    without a hint and take part in a shuffle join.
    """
    total = stored.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(stored) if total <= BROADCAST_BYTES else stored


def kept_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in the materialised one-column table ``ids`` (null equals null)."""
    side = small_side(ids.select(F.col(key).alias("__kept")).distinct(), F.lit(24))
    return docs.join(side, docs[key].eqNullSafe(F.col("__kept")), "left_semi")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but the last) that end where a group ends; batches come sorted by ``keys``."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        if held and not cut and last == tuple(c[-1] for c in columns):
            held.append(table)
            continue
        if not cut:  # one new group fills the batch: what is held has ended
            done, rest = pa.concat_tables(held) if held else None, table
        else:
            done, rest = pa.concat_tables([*held, table.slice(0, cut)]), table.slice(cut)
        if done is not None and done.num_rows >= rows:
            yield done
            done = None
        held = [t for t in (done, rest) if t is not None]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.concat_tables(held)
