"""Near-duplicate documents by one-permutation hashing with optimal densification, bands and star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.anchors import ODD, lists, prefix, run_hashes
from cartolake.llm.common import materialize, mixed, small_side, text_class, whole_groups
from cartolake.llm.components import components
from cartolake.llm.substring import _WORD, word_hashes

SHINGLE_WORDS = 5
LEAST_PERCENT = 85
BANDS = 32
BAND_ROWS = 4
# Classes of a candidate cluster that are compared in one task; larger clusters are cut into blocks.
BLOCK_ROWS = 512
ROWS_AT_ONCE = 512
COLUMNS_AT_ONCE = 4096
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of lower-cased texts; one for a shorter text, none without words."""
    out = []
    for hashes in word_hashes([t.lower() for t in texts]):
        size = min(words, len(hashes))
        sums = prefix(mixed(hashes), ODD[1])
        start = np.arange(len(hashes) - size + 1 if size else 0)
        out.append(np.unique(run_hashes(sums, start, start + size, ODD[1])))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Rows of one-permutation MinHash values: the smallest hash in each equal part of the hash range.

    An empty bin copies the first non-empty bin of a random sequence that
    belongs to the bin, the same for all documents.
    """
    width = -(-(1 << 64) // bins)
    edges = np.array([i * width for i in range(bins)], np.uint64)
    out = np.full((len(sets), bins), EMPTY)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        held = np.flatnonzero(np.append(at[1:], len(s)) > at)
        out[i, held] = s[at[held]]
    row, bin_ = np.nonzero((out == EMPTY) & np.array([len(s) > 0 for s in sets], bool)[:, None])
    original, attempt = out.copy(), 0
    while len(row):
        attempt += 1
        donor = (mixed(np.arange(bins, dtype=np.uint64) * np.uint64(ODD[2]) + np.uint64(attempt)) % np.uint64(bins)).astype(
            np.int64)[bin_]
        value = original[row, donor]
        hit = value != EMPTY
        out[row[hit], bin_[hit]] = value[hit]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket per band of each signature."""
    parts = values.reshape(len(values), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(ODD[3]), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        key = mixed(key * np.uint64(ODD[0]) + parts[:, :, j])
    return key


def text_digest(text: bytes) -> bytes:
    """16 bytes that are equal for equal sequences of lower-cased words only."""
    return hashlib.sha256(b" ".join(_WORD.findall(text.lower()))).digest()[:16]


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all pairs whose Jaccard index reaches ``percent``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        shared = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], np.int64)
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        # Only shingles of several sets count; each chunk of them is a 0/1 matrix.
        name = np.cumsum(count > 1) - 1
        common = count[column] > 1
        row, column = row[common], name[column[common]]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        shared = np.zeros((len(sets), len(sets)), np.float64)
        total = int(column[-1]) + 1 if len(column) else 0
        for first in range(0, total, COLUMNS_AT_ONCE):
            a, b = np.searchsorted(column, [first, first + COLUMNS_AT_ONCE])
            holds = np.zeros((len(sets), min(COLUMNS_AT_ONCE, total - first)), np.float32)
            holds[row[a:b], column[a:b] - first] = 1
            shared += holds @ holds.T
        shared = np.rint(shared).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    return np.nonzero(np.triu(100 * shared >= percent * union, 1))


def stars(names: list[bytes], a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(name, smallest name linked to it) for everything in a link."""
    root = np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    least: dict[int, bytes] = {}
    touched = np.union1d(a, b)
    for i in touched:
        least[root[i]] = min(least.get(root[i], names[i]), names[i])
    return [(names[i], least[root[i]]) for i in touched]


def near_documents(docs: DataFrame, *, percent: int = LEAST_PERCENT, words: int = SHINGLE_WORDS, bands: int = BANDS,
                   band_rows: int = BAND_ROWS, block_rows: int = BLOCK_ROWS, identity: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents whose shingle sets have a Jaccard index of ``percent`` or more.

    Documents with the same lower-cased words are one class.  A class has a
    signature, cut into bands; classes that share a band's bucket are each joined
    to the bucket's smallest class alone, so a bucket of n classes has n - 1
    candidate edges.  What these stars connect is a candidate cluster.  Full
    shingle sets travel once to their cluster, where all its pairs are verified;
    a cluster beyond ``block_rows`` classes is cut into blocks that meet two by
    two.  A task returns one star per group it has verified, never pairs.

    Texts without words (also null ones) have no shingles and link with nothing.
    Rows without id link with nothing, have no component and are kept.  Rows that
    repeat an id and text are in one component and have the same ``kept``.  An
    empty table gives no rows; other columns are ignored.

    With ``identity`` rows also have ``own`` (``text_class`` of the text), ``cls``
    and ``first``: whether the row is of its component's smallest id and, of that
    id's texts in the component, of one class (or is without words or id).
    """
    extra = ["own"] if identity else []

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part["text"].cast(pa.binary()).to_pylist()
                sets = shingle_sets(texts, words)
                keys = band_keys(signatures(sets, bands * band_rows), bands).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array([text_digest(t) for t in texts], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), lists(list(keys), pa.int64()), *(part[c] for c in extra)],
                    names=["doc_id", "cls", "n", "keys", *extra])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.withColumn("own", text_class(F.col("text"))) if identity else rows
    signed = materialize(named.mapInArrow(sign, "doc_id long, cls binary, n long, keys array<long>" + "".join(
        f", {c} binary" for c in extra)), "signed")
    classes = materialize(signed.filter("n > 0 and doc_id is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep")), "classes")
    chosen = signed.join(classes.select(F.col("cls").alias("c"), "rep"), (F.col("cls") == F.col("c")) & (
        F.col("doc_id") == F.col("rep")))
    entries = chosen.select("cls", F.explode("keys").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).filter("hub != last")
    candidate = entries.join(hubs.select("bucket", "hub"), "bucket").filter("cls != hub").select(
        F.col("cls").alias("u"), F.col("hub").alias("v"))
    clusters = materialize(components(candidate), "clusters")

    blocks = F.ceil(F.col("size") / F.lit(block_rows)).cast("int")
    sizes = clusters.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size"))
    placed = clusters.join(sizes, F.col("component") == F.col("cluster")).join(
        classes, F.col("id") == F.col("cls")).select(
        F.col("id").alias("c"), "rep", "cluster", blocks.alias("blocks"),
        F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int").alias("block"))
    placed = materialize(placed, "placed")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    verified = materialize(_sets(rows, placed, words).withColumn("cell", F.explode(meets)).select(
        "cluster", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "cls", "shingles")
        .repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(_verifier(percent), "u binary, v binary"), "verified")
    found = components(verified)
    least = found.join(classes, F.col("id") == F.col("cls")).groupBy("component").agg(
        F.min("rep").alias("component_id"), *([F.min(F.struct("rep", "id"))["id"].alias("head")] if identity else []))
    near = found.join(least, "component").select("id", "component_id", *(["head"] if identity else []))
    first = F.coalesce((F.col("n") == 0) | ((F.col("doc_id") == F.col("rep")) & (F.col("cls") == F.coalesce("head", "cls"))), F.lit(True))
    return (
        signed.join(classes.select(F.col("cls").alias("c"), "rep"), F.col("cls") == F.col("c"), "left")
        .join(near, F.col("cls") == F.col("id"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(
            F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(
                F.coalesce("component_id", "rep"))).alias("component_id"),
            *(["own", "cls", F.when(F.col("doc_id").isNull(), True).otherwise(first).alias("first")] if identity else []))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _sets(rows: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """Shingle sets of the classes in ``placed``, from their first documents' texts."""
    side = small_side(placed, F.lit(80))

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part["text"].cast(pa.binary()).to_pylist()
                # One id may stand for several texts.
                own = [i for i, t in enumerate(texts) if text_digest(t) == part["c"][i].as_py()]
                made = shingle_sets([texts[i] for i in own], words)
                names = ["cls", "cluster", "blocks", "block"]
                yield pa.RecordBatch.from_arrays(
                    [*(part[c].take(pa.array(own, pa.int64())) for c in ("c", *names[1:])),
                     pa.array([s.tobytes() for s in made], pa.binary())], names=[*names, "shingles"])

    return rows.join(side, F.col("doc_id") == F.col("rep")).select("text", "c", "cluster", "blocks", "block").mapInArrow(
        shingled, "cls binary, cluster binary, blocks int, block int, shingles binary")


def _verifier(percent: int):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            out: list[tuple[bytes, bytes]] = []
            group = np.array([hash(k) for k in zip(*(table[c].to_pylist() for c in ("cluster", "i", "j")))])
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            names, held = table["cls"].to_pylist(), table["shingles"].to_pylist()
            for a, b in zip(new, np.append(new[1:], len(group))):
                sets = {n: np.frombuffer(s, np.uint64) for n, s in zip(names[a:b], held[a:b])}
                if len(sets) > 1:
                    own = list(sets)
                    out += stars(own, *linked_pairs(list(sets.values()), percent))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in out], pa.binary()) for c in (0, 1)], names=["u", "v"])

    return verify


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    def numbered() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                first = np.array([int.from_bytes(c[:8], "little", signed=True) for c in part["cluster"].to_pylist()], np.int64)
                yield part.append_column("first", pa.array(first))

    return whole_groups(numbered(), ["first", "i", "j"], ROWS_AT_ONCE)
