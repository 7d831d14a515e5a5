"""Repeated windows of fixed length, found through content-chosen anchors.

Text is a row of units (bytes or words).  Of the k-grams inside a window the one
with the smallest hash is its anchor, the leftmost of equal ones.  Equal windows
have equal anchors at equal offsets, and neighbouring windows mostly share one, so
anchors are a small share of all positions: only they are shuffled to find what
may repeat, and only windows whose anchor repeats are compared.

Work is done on distinct texts.  A text that several documents have repeats
altogether; it is compared with other texts through one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import materialize, mixed, small_side, text_class
from cartolake.operators.skew import lookup_join

SEGMENT_UNITS = 1 << 18
# An anchor text at more places than this is not compared in one task but by window digests.
HOT_ANCHORS = 20_000
ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n (or more)."""
    have = _powers.get((base, 0))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SEGMENT_UNITS + (1 << 16))
        inverse = pow(base, -1, 1 << 64)
        grow = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
        have = _powers[base, 0] = (grow(base), grow(inverse))
    return have


def prefix(units: np.ndarray, base: int) -> np.ndarray:
    """Sums from which the polynomial hash of any run of units is a difference."""
    up = powers(base, len(units))[0]
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units + np.uint64(1)) * up[: len(units)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(base, len(sums))[1][start])


def gram_hashes(units: np.ndarray, k: int, base: int) -> np.ndarray:
    sums, down = prefix(units, base), powers(base, len(units))[1]
    n = max(0, len(units) - k + 1)
    return mixed((sums[k : k + n] - sums[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(units: np.ndarray, lengths: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, position, first window, last window, key) of every anchor of texts laid end to end.

    Positions and windows count from the text's start.  Texts shorter than a
    window have no anchors.
    """
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if len(units) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    grams = gram_hashes(units, k, ODD[0])
    # High half: hash; low half: place.  The smaller place wins between equal hashes.
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(ranked, window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - window + 1, 0))
    counts = np.maximum(lengths - window + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    windows = np.arange(len(text)) - first[text] + offsets[text]
    place = place[windows]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(
        place) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(place)]]) - 1 if len(place) else new
    text, place, base = text[new], place[new], offsets[text[new]]
    return text, place - base, windows[new] - base, windows[last] - base, grams[place]


def segments(lengths: np.ndarray, window: int, most: int = SEGMENT_UNITS) -> Iterator[list[tuple[int, int, int]]]:
    """Texts in portions of about ``most`` units: (text, from, to); parts of a long text overlap by a window less one."""
    portion, size = [], 0
    for i, n in enumerate(lengths):
        start = 0
        while True:
            end = min(int(n), start + most)
            portion.append((i, start, end))
            size += end - start
            if size >= most:
                yield portion
                portion, size = [], 0
            if end >= n:
                break
            start = end - window + 1
    if portion:
        yield portion


def anchors_of(texts: list[np.ndarray], window: int, k: int) -> list[tuple[np.ndarray, ...]]:
    """Per text: (positions, first windows, last windows, keys)."""
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in texts]
    for portion in segments(np.array([len(t) for t in texts], np.int64), window):
        lengths = np.array([b - a for _, a, b in portion], np.int64)
        units = np.concatenate([texts[i][a:b] for i, a, b in portion]) if portion else np.zeros(0, np.uint64)
        text, *found = anchors(units.astype(np.uint64, copy=False), lengths, window, k)
        edges = np.searchsorted(text, np.arange(len(portion) + 1))
        for j, (i, a, _) in enumerate(portion):
            cut = slice(edges[j], edges[j + 1])
            parts[i].append((*(f[cut] + a for f in found[:3]), found[3][cut]))
    out = []
    for found in parts:
        pos, first, last, key = (np.concatenate([f[c] for f in found]) for c in range(4))
        if len(found) > 1:  # an anchor on both sides of a cut
            new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]])) if len(pos) else np.zeros(0, np.int64)
            end = np.concatenate([new[1:], [len(pos)]]) - 1 if len(pos) else new
            pos, first, last, key = pos[new], first[new], last[end], key[new]
        out.append((pos, first, last, key))
    return out


def digests(units: tuple[np.ndarray, np.ndarray], window: int, starts: np.ndarray) -> np.ndarray:
    """128 bits for the window at each start, as two columns; ``units`` are two hashes of each unit."""
    pair = [run_hashes(prefix(u, b), starts, starts + window, b) for u, b in zip(units, ODD[2:])]
    return np.stack(pair, axis=1).view(np.int64)


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first, first + 1, ... last of every pair, one after the other."""
    sizes = last - first + 1
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


class Corpus:
    """The texts of ``docs`` in terms of ``units_of``, which makes a list of texts' bytes into unit hashes."""

    def __init__(self, docs: DataFrame, window: int, k: int, units_of: Callable[[list[bytes]], list[np.ndarray]]):
        self.window, self.k, self.units_of = window, k, units_of
        self.docs = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        signed = materialize(self.with_class(self.docs).mapInArrow(
            self._signer(), "doc_id long, cls binary, units long, keys array<long>, pos array<int>"), "signed")
        self.classes = materialize(signed.groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.max("units").alias("units")), "classes")
        self.signed = signed.join(
            self.classes.select(F.col("cls").alias("c"), "rep"),
            (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "rep", "keys", "pos")

    def with_class(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("cls", text_class(F.col("text")))

    def _signer(self):
        window, k, units_of = self.window, self.k, self.units_of

        def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    units = units_of(part["text"].cast(pa.binary()).to_pylist())
                    found = anchors_of(units, window, k)
                    yield pa.RecordBatch.from_arrays([
                        part["doc_id"], part["cls"], pa.array([len(u) for u in units], pa.int64()),
                        lists([f[3].view(np.int64) for f in found], pa.int64()),
                        lists([f[0] for f in found], pa.int32())], names=["doc_id", "cls", "units", "keys", "pos"])

        return sign

    def anchors(self) -> DataFrame:
        """(key, cls, rep, pos) of the anchors of distinct texts."""
        return self.signed.select("cls", "rep", F.explode(F.arrays_zip("keys", "pos")).alias("a")).select(
            F.col("a.keys").alias("key"), "cls", "rep", F.col("a.pos").alias("pos"))

    def repeated_anchors(self) -> tuple[DataFrame, DataFrame]:
        """The anchors whose key occurs more than once, rows of a frequent key spread over tasks; and (key, n) of such keys."""
        every = self.anchors()
        again = materialize(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "again")
        return lookup_join(every, again.select("key"), ["key"], freq=again, hot_rows=HOT_ANCHORS, spread=["cls", "pos"]), again

    def places(self, repeated: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        """(cls, rep, pos, hot): the repeated anchors of each text, those of very frequent anchor texts apart.

        ``counts`` is (key, n) of the repeated anchors, if they are counted already.
        """
        counts = repeated.groupBy("key").agg(F.count("*").alias("n")) if counts is None else counts
        often = counts.filter(F.col("n") > HOT_ANCHORS)
        often = materialize(often.select(F.col("key").alias("often")), "hot-anchors")
        marked = repeated.join(small_side(often, F.lit(16)), F.col("key") == F.col("often"), "left")
        return materialize(marked.groupBy("cls", "rep", F.col("often").isNotNull().alias("hot")).agg(
            F.sort_array(F.collect_set("pos")).alias("pos")), "places")

    def emit(self, places: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
        """``rows_of(cls, text bytes, units, (pos, first, last, key))`` for each text of ``places`` and its anchors there."""
        window, k, units_of = self.window, self.k, self.units_of
        # Broadcast if small; else both sides are shuffled by the text's class.
        side = small_side(places.select(F.col("cls").alias("c"), "rep", "pos"), F.lit(64) + F.size("pos") * 4)
        wanted = self.with_class(self.docs).join(
            side, (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "text", "pos")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    texts = part["text"].cast(pa.binary()).to_pylist()
                    units = units_of(texts)
                    made = []
                    for i, found in enumerate(anchors_of(units, window, k)):
                        mine = np.isin(found[0], part["pos"][i].values.to_numpy())
                        made.append(rows_of(part["cls"][i].as_py(), texts[i], units[i], tuple(f[mine] for f in found)))
                    if made:
                        yield from pa.Table.from_batches(made).combine_chunks().to_batches()

        return wanted.mapInArrow(run, schema)

    def frequent_windows(self, places: DataFrame, unit_pair: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(cls, start, end, a, b) of repeated windows at very frequent anchors, by counts of their 128-bit digests a, b.

        Counts are summed before they travel, so no task holds the windows of a key.
        """
        window = self.window

        def rows_of(cls, text, units, found):
            starts = spread(found[1], found[2])
            pair = digests(unit_pair(text), window, starts)
            return pa.RecordBatch.from_arrays(
                [pa.array([cls] * len(starts), pa.binary()), pa.array(starts), pa.array(pair[:, 0].copy()),
                 pa.array(pair[:, 1].copy())], names=["cls", "start", "a", "b"])

        rows = materialize(self.emit(places, rows_of, "cls binary, start long, a long, b long"), "frequent")
        twice = materialize(rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
        again = lookup_join(rows, twice.select("a", "b"), ["a", "b"], freq=twice, hot_rows=HOT_ANCHORS, spread=["cls", "start"])
        return again.select("cls", "start", (F.col("start") + window).alias("end"), "a", "b")

    def marked(self, spans: DataFrame) -> DataFrame:
        """Documents with what to remove: (doc_id, text, whole, spans).

        ``whole`` if several documents have the text and it holds a window;
        ``spans`` are (start, end), apart and in order, null where there are none.
        """
        def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["cls"], union_lists(batch["spans"])], names=["cls", "spans"])

        # Windows of neighbouring anchors overlap: a text is left with a few long spans.
        held = spans.groupBy("cls").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(
            merged, "cls binary, spans array<struct<start:long,end:long>>")
        copies = self.classes.select("cls", ((F.col("rows") > 1) & (F.col("units") >= self.window)).alias("whole"))
        marks = materialize(copies.join(held, "cls", "left").filter("whole or spans is not null").select(
            F.col("cls").alias("c"), "whole", F.when(~F.col("whole"), F.col("spans")).alias("spans")), "marks")
        side = small_side(marks, F.lit(64) + F.coalesce(F.size("spans"), F.lit(0)) * 24)
        return self.with_class(self.docs).join(side, F.col("cls") == F.col("c"), "left").select(
            "doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")


def union_lists(spans: pa.ListArray) -> pa.ListArray:
    """Each list of (start, end) as maximal runs, in order."""
    flat, sizes = spans.flatten(), np.diff(spans.offsets.to_numpy())
    start, end = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((start, row))
    start, end, row = start[by], end[by], row[by]
    # Rows one after the other on one line: a run ends where nothing before reaches on.
    far = row * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + far) if len(end) else end
    new = np.flatnonzero(np.concatenate([[True], (start + far)[1:] > reach[:-1]])) if len(end) else by
    last = np.append(new[1:], len(end)) - 1 if len(end) else by
    offsets = np.searchsorted(row[new], np.arange(len(sizes) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start[new]), pa.array(reach[last] - far[last])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), runs)


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching (start, end) spans as maximal ones, in order."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
