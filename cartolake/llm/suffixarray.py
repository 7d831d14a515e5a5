"""Repeated byte strings through enhanced suffix arrays and their tree of common-prefix intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.anchors import ODD, Corpus, sliced, union
from cartolake.llm.common import materialize, mixed, small_side, whole_groups

LENGTH = 400
GRAM = 64
ROWS_AT_ONCE = 2048
# Bytes right of an anchor that are compared in one round when repeats are followed to their ends.
STEP = 4096
_SPANS = "cls binary, start long, end long"


def aligned(pool: np.ndarray, start: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from each start, forwards (step 1) or backwards (-1), zero after its size."""
    width = max(1, int(size.max(initial=0)))
    out = np.zeros((len(start), width), np.uint8)
    if len(pool):
        at = np.arange(width, dtype=np.int32)
        for i in range(0, len(start), 512):  # the table of places is eight times the bytes
            inside = at[None, :] < size[i : i + 512, None]
            place = (start[i : i + 512, None] + step * at[None, :])[inside]
            out[i : i + 512][inside] = pool[place]
    return out


def sorted_rows(rows: np.ndarray, size: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """The order of byte rows, by other keys first; a row that is the beginning of another comes before it."""
    text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    return np.lexsort((size, text, *first[::-1]))


def common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The length of the common beginning of each row and the next."""
    same = rows[1:] == rows[:-1]
    at = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1)) if len(same) else np.zeros(0, np.int64)
    return np.minimum(at, np.minimum(size[1:], size[:-1]))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every maximal run of suffixes that share at least ``least`` bytes: a stack scan.

    The runs form a tree by inclusion; children come before their parents.
    """
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > length:
            shared, first = stack.pop()
            yield shared, first, i
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins (and the last ends), and the bytes of all."""
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    edges = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return edges, np.frombuffer(values.buffers()[2], np.uint8) if len(values) and edges[-1] else np.zeros(0, np.uint8)


def repeats(table: pa.Table, length: int) -> dict[str, np.ndarray]:
    """Where strings of ``length`` bytes or more repeat among the contexts of anchors with whole keys.

    The suffixes that start at the anchors are sorted; in each interval of
    their tree the parts left of the anchors are sorted backwards.  An occurrence
    shares as much to its left as its better neighbour there.
    """
    key, pos = table["key"].to_numpy(), table["pos"].to_numpy()
    near, far = table["near"].to_numpy(), table["far"].to_numpy()  # the nearest and farthest window start, left of the anchor
    edges, pool = bytes_of(table["context"])
    anchor = edges[:-1] + far
    right_size = length - near
    right = aligned(pool, anchor, right_size, 1)
    order = sorted_rows(right, right_size, key)
    key, pos, near, far, anchor, right_size, right = (x[order] for x in (key, pos, near, far, anchor, right_size, right))
    lcp = np.where(key[1:] == key[:-1], common(right, right_size), -1)
    left = aligned(pool, anchor - 1, far, -1)
    beside = common(left, far)
    least = max(1, length - int(far.max(initial=0)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pairs: list[tuple[int, int]] = []

    def add(rows: np.ndarray, best: np.ndarray, shared: int | np.ndarray) -> None:
        low, high = np.maximum(near[rows], length - shared), np.minimum(far[rows], best)
        hit = low <= high
        if hit.any():
            rows, low, high = rows[hit], low[hit], high[hit]
            found.append((rows, pos[rows] - high, pos[rows] - low + length))

    for shared, first, last in intervals(lcp, least):
        if last - first == 1:
            pairs.append((shared, first))
            continue
        rows = np.arange(first, last + 1)
        by = rows[sorted_rows(left[rows], far[rows])]
        near_by = common(left[by], far[by])
        add(by, np.maximum(np.append(near_by, 0), np.insert(near_by, 0, 0)), shared)
    if pairs:  # intervals of two suffixes, all at once
        shared, first = np.array(pairs, np.int64).T
        for i in (0, 1):
            add(first + i, beside[first], shared)
    whole = lambda c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64)
    return {"row": order[whole(0)], "start": whole(1), "end": whole(2)}


def repeated_spans(corpus: Corpus) -> DataFrame:
    """(cls, start, end): where repeated strings lie in distinct texts."""
    length = corpus.window
    places = corpus.places(*corpus.repeated_anchors())

    def rows_of(cls, text, units, found):
        pos, first, last, key = found
        return pa.RecordBatch.from_arrays([
            pa.array(key.view(np.int64)), pa.array([cls] * len(pos), pa.binary()), pa.array(pos), pa.array(pos - last),
            pa.array(pos - first), pa.array([text[a : b + length] for a, b in zip(first, last)], pa.binary())],
            names=["key", "cls", "pos", "near", "far", "context"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(sliced(batches, ROWS_AT_ONCE), ["key"], ROWS_AT_ONCE):
            out = repeats(table, length)
            yield pa.RecordBatch.from_arrays(
                [table["cls"].combine_chunks().take(pa.array(out["row"])), *(pa.array(np.asarray(out[c], np.int64)) for c in (
                    "start", "end"))], names=["cls", "start", "end"])

    contexts = corpus.emit(places.filter("not hot"), rows_of,
                           "key long, cls binary, pos long, near long, far long, context binary")
    spans = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(compare, _SPANS)
    if places.filter("hot").take(1):
        spans = spans.unionByName(corpus.frequent_windows(places.filter("hot"), byte_pair).drop("a", "b"))
    return materialize(spans, "repeats")


def byte_pair(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each byte."""
    return tuple(mixed(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(b)) for b in ODD[:2])


def byte_units(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in texts]


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, spans): texts without the bytes of any repeated string of ``length`` bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts
    elsewhere, in the same text or another; strings are judged on the input and
    never cross texts.  ``kept`` is binary, for a cut may split a character;
    ``spans`` are the removed runs as (start, end) byte positions.

    The suffixes compared are those at anchors: every repeated string has one, at
    the same offset in each of its occurrences.  Anchors are grouped by their first
    ``gram`` bytes, and each group's suffixes form a part of the suffix array.

    A null text counts as empty; texts shorter than ``length`` keep all they have.
    Rows of one id and text repeat each other.  Null ids stay null.  An empty table
    gives no rows; other columns are ignored.
    """
    corpus = Corpus(docs, length, gram, byte_units)
    marked = corpus.marked(repeated_spans(corpus))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            kept, counts, removed, runs = [], [], [], []
            for text, whole, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["whole"].to_pylist(),
                                          batch["spans"].to_pylist()):
                gone = [(0, len(text))] if whole else union(spans)
                ends = [0, *(x for run in gone for x in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])) if gone else text)
                counts.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                runs.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return marked.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, "
                                  "spans array<struct<start:long,end:long>>")


def maximal_repeats(table: pa.Table, length: int, floor: int, step: int) -> tuple[list[tuple], np.ndarray]:
    """Maximal repeats among contexts with whole keys, and the rows whose repeats go on.

    A row is an anchor with up to ``far`` + 1 bytes before it and up to ``step`` bytes
    from ``floor`` bytes after it on; rows of one key and ``head`` share the bytes
    between.  In every interval of the suffixes' tree the left parts form a tree of
    their own.  A node there is a maximal repeat if its left extensions differ, its
    rows lie in several children of the interval, and this anchor is that of its
    first window: so it is found at one anchor only.  One whose left extension
    reaches beyond the anchor's windows is rejected here and found further left.

    Repeats are (rows, bytes before the anchor, length, digest).  Rows that agree to the last byte at hand, while
    their left extensions differ, go on.
    """
    # Rows of one id and text are one place.
    spots = {spot: i for i, spot in enumerate(zip(*(table[c].to_pylist() for c in ("key", "cls", "pos"))))}
    single = np.array(sorted(spots.values()), np.int64)
    table = table.take(pa.array(single))
    key, near, far = (table[c].to_numpy() for c in ("key", "near", "far"))
    ended, head = np.array(table["ended"].to_pylist(), bool), table["head"].to_pylist()
    number = {h: i for i, h in enumerate(dict.fromkeys(head))}
    group = np.array([number[h] for h in head], np.int64)
    edges, pool = bytes_of(table["context"])
    left_size = table["before"].to_numpy()
    anchor = edges[:-1] + left_size
    right_size = edges[1:] - anchor
    right = aligned(pool, anchor, right_size, 1)
    order = sorted_rows(right, right_size, key, group)
    key, near, far, ended, group, left_size, anchor, right_size, right = (
        x[order] for x in (key, near, far, ended, group, left_size, anchor, right_size, right))
    lcp = np.where((key[1:] == key[:-1]) & (group[1:] == group[:-1]), common(right, right_size), -1)
    left = aligned(pool, anchor - 1, left_size, -1)
    found: list[tuple] = []
    further: list[np.ndarray] = []
    for shared, first, last in intervals(lcp, max(0 if floor else 1, length - floor - int(far.max(initial=0)))):
        rows, right_length = np.arange(first, last + 1), floor + shared
        by = rows[sorted_rows(left[rows], left_size[rows])]
        beside = common(left[by], left_size[by])
        if shared == step and np.count_nonzero(~ended[rows]) > 1:
            if (beside <= np.minimum(far[by[:-1]], far[by[1:]])).any():
                further.append(rows)
            continue
        child = np.concatenate([[0], np.cumsum(lcp[first:last] == shared)])
        for before, a, b in intervals(beside, max(0, length - right_length)):
            own = by[a : b + 1]
            branches = child[own - first]
            if near[own[0]] <= before <= far[own[0]] and branches.min() < branches.max():
                one = own[0]
                content = pool[anchor[one] - before : anchor[one] + shared].tobytes()
                name = hashlib.blake2b(b"%d %d " % (before, right_length) + head[order[one]] + content, digest_size=16).digest()
                found.append((single[order[own]], before, before + right_length, name))
    return found, single[order[np.concatenate(further)]] if further else np.zeros(0, np.int64)


_ROUND = "cls binary, start long, length long, name binary"


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """(repeat_id, length, doc_id, start, copies): every maximal repeat of ``length`` bytes or more, with all its occurrences.

    A maximal repeat is a string that occurs more than once and cannot be made
    longer on either side without losing an occurrence; the ends of a text differ
    from everything.  ``repeat_id`` is made of its bytes (the first half of their
    SHA-256).  A row is one occurrence in a distinct text, named by the smallest
    doc_id that has the text and the number of its ``copies``; a text with copies
    repeats as a whole.  A group of any size is rows, never one value.

    Repeats are followed to their ends in rounds of ``step`` bytes; only places
    whose left extensions differ go on, so a long repeat is followed once and not
    from each of its anchors.  Where an anchor's text occurs at more places than
    one task compares, each repeated window of ``length`` bytes there is a group of its own,
    and a text with copies lists its copies only.

    Null texts count as empty.  Rows of one id and text are copies.  Null ids stay
    null.  An empty table gives no rows; other columns are ignored.
    """
    corpus = Corpus(docs, length, gram, byte_units)
    places = corpus.places(*corpus.repeated_anchors())
    known = corpus.classes.select("cls", "rep")

    def contexts(here: DataFrame, floor: int) -> DataFrame:
        def rows_of(cls, text, units, found):
            pos, first, last, key = found
            far = pos - first
            before = np.minimum(far + 1, pos)
            return pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), pa.array([cls] * len(pos), pa.binary()), pa.array(pos), pa.array(pos - last),
                pa.array(far), pa.array(before), pa.array(len(text) - pos <= floor + step),
                pa.array([hashlib.blake2b(text[p : p + floor], digest_size=16).digest() if floor else b"" for p in pos], pa.binary()),
                pa.array([text[p - n : p] + text[p + floor : p + floor + step] for p, n in zip(pos, before)], pa.binary())],
                names=["key", "cls", "pos", "near", "far", "before", "ended", "head", "context"])

        return corpus.emit(here, rows_of, "key long, cls binary, pos long, near long, far long, before long, ended boolean, "
                                          "head binary, context binary")

    def follow(floor: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(sliced(batches, 256), ["key"], 256):
                found, further = maximal_repeats(table, length, floor, step)
                cls, pos = table["cls"].to_pylist(), table["pos"].to_pylist()
                out = [(cls[i], pos[i] - before, size, name) for rows, before, size, name in found for i in rows]
                out += [(cls[i], pos[i], None, None) for i in further]
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)],
                                                 names=["cls", "start", "length", "name"])

        return run

    here, floor, rounds = places.filter("not hot"), 0, []
    while True:
        made = materialize(contexts(here, floor).repartition("key").sortWithinPartitions("key").mapInArrow(
            follow(floor), _ROUND), "repeat-round")
        rounds.append(made.filter("name is not null"))
        further = made.filter("name is null")
        if not further.take(1):
            break
        here = materialize(further.groupBy("cls").agg(F.sort_array(F.collect_set(F.col("start").cast("int"))).alias("pos")).join(
            known, "cls"), "repeat-places")
        floor += step
    if places.filter("hot").take(1):
        windows = corpus.frequent_windows(places.filter("hot"), byte_pair).dropDuplicates(["cls", "start"])
        rounds.append(windows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").join(windows, ["a", "b"]).select(
            "cls", "start", F.lit(length).cast("long").alias("length"), F.unhex(F.concat(
                F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0"))).alias("name")))
    occurrences = materialize(reduce(DataFrame.unionByName, rounds), "occurrences")

    # One occurrence of each group is read again for the digest of its bytes.
    first = materialize(occurrences.groupBy("name").agg(F.min(F.struct("cls", "start", "length")).alias("at")).groupBy("at.cls").agg(
        F.collect_list(F.struct("name", "at.start", "at.length")).alias("groups")).join(known, "cls"), "group-places")
    side = small_side(first.select(F.col("cls").alias("c"), "rep", "groups"), F.lit(64) + F.size("groups") * 40)

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            names, ids = [], []
            for text, groups in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["groups"].to_pylist()):
                for g in groups:
                    names.append(g["name"])
                    ids.append(hashlib.sha256(text[g["start"] : g["start"] + g["length"]]).digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], names=["g", "repeat_id"])

    ids = corpus.with_class(corpus.docs).join(side, (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select(
        "text", "groups").mapInArrow(named, "g binary, repeat_id binary").dropDuplicates(["g"])
    parts = occurrences.join(ids, F.col("name") == F.col("g")).select("repeat_id", "length", "cls", "start")
    copied = corpus.classes.filter((F.col("rows") > 1) & (F.col("units") >= length)).select(
        F.col("cls").alias("repeat_id"), F.col("units").alias("length"), "cls", F.lit(0).cast("long").alias("start"))
    return parts.unionByName(copied).distinct().join(corpus.classes, "cls").select(
        "repeat_id", "length", F.col("rep").alias("doc_id"), "start", F.col("rows").alias("copies"))
