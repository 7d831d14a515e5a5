"""Repeated passages of words, prefiltered by a count-min sketch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.anchors import ODD, Corpus, digests, lists, prefix, run_hashes, sliced, spread, union
from cartolake.llm.common import materialize, mixed, whole_groups

WINDOW = 35
GRAM = 10
SKETCH_ROWS = 2
# Cells of a sketch row per anchor, at least.
CELLS_EACH = 4
BLOCK_BITS = 16
KEYS_AT_ONCE = 1 << 21
ROWS_AT_ONCE = 2048
LONG_WORD = 64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def word_hashes(texts: list[bytes], base: int = ODD[0]) -> list[np.ndarray]:
    """A 64-bit hash of every word of each text.

    Words over ``LONG_WORD`` bytes are hashed by a digest: for a polynomial modulo
    2^64 long words of two letters can be built that agree under every base.
    """
    out: list[np.ndarray] = []
    portion: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        portion.append(text)
        size += len(text)
        if size >= 1 << 19 or i + 1 == len(texts):
            joined = np.frombuffer(b"\n".join([*portion, b""]), np.uint8)
            gap = _SEPARATOR[joined]
            start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
            end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
            found = run_hashes(prefix(joined.astype(np.uint64), base), start, end, base)
            for at in np.flatnonzero(end - start > LONG_WORD):
                digest = hashlib.blake2b(joined[start[at] : end[at]].tobytes(), digest_size=8, key=base.to_bytes(8, "little"))
                found[at] = np.frombuffer(digest.digest(), np.uint64)[0]
            bounds = np.cumsum([0, *(len(t) + 1 for t in portion)])
            out += np.split(found, np.searchsorted(start, bounds[1:-1])) if len(portion) > 1 else [found]
            portion, size = [], 0
    return out


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return mixed(keys ^ np.uint64(ODD[row + 1])) & np.uint64(width - 1)


def sketch(signed: DataFrame, width: int) -> DataFrame:
    """(row, block, words): the cells of the merged sketch whose count is two or more, as bit sets of blocks.

    Each partition counts its own keys, up to two; what it sends is the list of
    its cells, not the sketch.  A block of cells is merged by adding up.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch["keys"].flatten().to_numpy().view(np.uint64))
            if sum(map(len, held)) >= KEYS_AT_ONCE:
                yield from part(np.concatenate(held))
                held = []
        if held:
            yield from part(np.concatenate(held))

    def part(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(SKETCH_ROWS):
            cell, n = np.unique(cells(keys, row, width), return_counts=True)
            block, first = np.unique(cell >> np.uint64(BLOCK_BITS), return_index=True)
            low = (cell & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
            ends = np.append(first[1:], len(cell))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(block), row, np.int32)), pa.array(block.astype(np.int64)),
                pa.array([low[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in zip(first, ends)], pa.binary())],
                names=["row", "block", "cells", "twice"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["row", "block"]):
            rows, blocks = table["row"].to_numpy(), table["block"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (blocks[1:] != blocks[:-1])]))
            cell, twice = table["cells"].to_pylist(), table["twice"].to_pylist()
            sets = []
            for a, b in zip(new, np.append(new[1:], len(rows))):
                total = np.zeros(1 << BLOCK_BITS, np.int64)
                for c, t in zip(cell[a:b], twice[a:b]):
                    at = np.frombuffer(c, "<u2")
                    total[at] += 1 + np.unpackbits(np.frombuffer(t, np.uint8), count=len(at))
                sets.append(np.packbits(total > 1, bitorder="little").view("<i8"))
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[new]), pa.array(blocks[new]), lists(sets, pa.int64())], names=["row", "block", "words"])

    parts = signed.select("keys").mapInArrow(count, "row int, block long, cells binary, twice binary")
    return parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(
        merge, "row int, block long, words array<long>")


def estimated_repeated(corpus: Corpus) -> DataFrame:
    """The anchors whose sketched count is two or more: all that repeat, and a few that do not."""
    total = corpus.signed.agg(F.sum(F.size("keys"))).first()[0] or 0
    width = 1 << max(BLOCK_BITS, (CELLS_EACH * total - 1).bit_length())
    merged = materialize(sketch(corpus.signed, width), "sketch")

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["keys"].flatten().to_numpy()
            sizes = np.diff(batch["keys"].offsets.to_numpy())
            text = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            at = [cells(keys.view(np.uint64), row, width).view(np.int64) for row in range(SKETCH_ROWS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch["cls"].take(text), batch["rep"].take(text), batch["pos"].flatten(),
                 *map(pa.array, at)], names=["key", "cls", "rep", "pos", *(f"cell{r}" for r in range(SKETCH_ROWS))])

    rows = corpus.signed.mapInArrow(placed, "key long, cls binary, rep long, pos int, " + ", ".join(
        f"cell{r} long" for r in range(SKETCH_ROWS)))
    for r in range(SKETCH_ROWS):
        own = merged.filter(F.col("row") == r).select(F.col("block").alias("b"), "words")
        inside = F.col(f"cell{r}").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        word = F.element_at("words", (F.shiftright(inside, 6) + 1).cast("int"))
        rows = rows.join(own, (F.shiftright(F.col(f"cell{r}"), BLOCK_BITS) == F.col("b")) & (
            F.getbit(word, inside.bitwiseAND(F.lit(63)).cast("int")) == 1)).drop("b", "words", f"cell{r}")
    return rows


def equal_windows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows whose digest occurs more than once, from rows with whole keys."""
    for table in whole_groups(sliced(batches, ROWS_AT_ONCE), ["key"], ROWS_AT_ONCE):
        pair = np.frombuffer(b"".join(table["digests"].to_pylist()), np.int64).reshape(-1, 2)
        first, n = table["first"].to_numpy(), table["n"].to_numpy()
        start, row = spread(first, first + n - 1), np.repeat(np.arange(len(n)), n)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        same = (pair[order][1:] == pair[order][:-1]).all(axis=1)
        again = np.zeros(len(pair), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        hit = np.flatnonzero(again)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row[hit]) != 0) | (np.diff(start[hit]) != 1)])) if len(
            hit) else hit
        end = np.append(new[1:], len(hit)) - 1 if len(hit) else hit
        yield pa.RecordBatch.from_arrays([
            table["cls"].combine_chunks().take(pa.array(row[hit[new]])), pa.array(start[hit[new]]),
            pa.array(start[hit[end]] + window)], names=["cls", "start", "end"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept, n_words, n_removed, spans): texts without the words of any repeated window of words.

    A word goes if some window of ``window`` consecutive words that covers it has
    the same words as a window that starts elsewhere, in the same document or
    another; windows are judged on the input.  ``kept`` joins the other words by
    one space; ``spans`` are the removed runs as (start, end) word positions.

    First a count-min sketch of window anchors is counted in each partition and
    merged; an anchor's count bounds its windows' counts from above.  Then only
    windows whose estimate is two or more are grouped by 128-bit digests.

    A null text counts as empty; such rows, and texts shorter than a window, keep
    all they have.  Rows of one id and text repeat each other.  Null ids stay
    null.  An empty table gives no rows; other columns are ignored.
    """
    corpus = Corpus(docs, window, gram, word_hashes)
    places = corpus.places(estimated_repeated(corpus))

    def rows_of(cls, text, units, found):
        pair = digests((units, word_hashes([text], ODD[1])[0]), window, spread(found[1], found[2]))
        sizes = found[2] - found[1] + 1
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.RecordBatch.from_arrays([
            pa.array(found[3].view(np.int64)), pa.array([cls] * len(sizes), pa.binary()), pa.array(found[1]),
            pa.array(sizes), pa.array([pair[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            names=["key", "cls", "first", "n", "digests"])

    candidates = corpus.emit(places.filter("not hot"), rows_of, "key long, cls binary, first long, n long, digests binary")
    spans = candidates.repartition("key").sortWithinPartitions("key").mapInArrow(
        lambda batches: equal_windows(batches, window), "cls binary, start long, end long")
    if places.filter("hot").take(1):
        spans = spans.unionByName(corpus.frequent_windows(
            places.filter("hot"), lambda text: tuple(word_hashes([text], b)[0] for b in ODD[:2])).drop("a", "b"))
    marked = corpus.marked(materialize(spans, "spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            kept, counts, removed, runs = [], [], [], []
            for text, whole, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["whole"].to_pylist(),
                                          batch["spans"].to_pylist()):
                words = _WORD.findall(text)
                gone = [(0, len(words))] if whole else union(spans)
                counts.append(len(words))
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words))
                removed.append(counts[-1] - len(words))
                runs.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "kept", "n_words", "n_removed", "spans"])

    return marked.mapInArrow(cut, "doc_id long, kept string, n_words long, n_removed long, "
                                  "spans array<struct<start:long,end:long>>")
