"""Ranked lexical search: the best documents of every item by NRA over impact-sorted lists.

Documents are counted where they lie and searched in shards of a bounded size; a task
carries every item's best scores from shard to shard, and only these leave it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolake.llm.common import materialize

BEST = 10
# Items are searched together as long as their terms take about this many bytes; more go in several rounds.
ITEM_BYTES = 16 << 20
# A shard ends with the batch that brings it to this many documents or postings.
SHARD_ROWS = 16_384
SHARD_POSTINGS = 2_000_000
# Postings read of each list in the first round of a search; every round reads twice as many.
FIRST_DEPTH = 32
# A term: a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a text to bytes of its terms: capitals become small, what is in no term becomes a space.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of each item's distinct texts."""
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    return (
        items.select("item_id", "text").distinct()
        .select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1))).alias("term"))
        .groupBy("item_id", "term").agg(F.count("*").alias("times")))


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with any term: all terms counted in n, those of the vocabulary by their place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary)}.get
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                found = text.translate(_BYTES).split() if text else ()
                if not found:
                    continue
                held = Counter(map(place, found))
                held.pop(None, None)
                ids.append(doc)
                sizes.append(len(found))
                terms.extend(held)
                tfs.extend(held.values())
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<bigint>")


class Shard:
    """Impact-sorted lists of some documents: per term the documents, dearest first."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((-impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, times: np.ndarray, floor: int, best: int = BEST,
               depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, scores) of all documents that can be among the ``best`` here and reach ``floor``, scores final.

        Every round reads the next postings of each list.  A document's score is at least
        what was read of it (lower) and at most that plus the next impacts of the lists
        it was not met in (upper).  Reading ends when no unmet document can reach the
        bound, which is the best-th lower score or ``floor``, and the scores of all that
        can are known in full; documents that tie with the bound are among them.
        """
        start, end = self.start[terms], self.start[terms + 1]
        lists = np.arange(len(terms))
        lower = np.zeros(len(self.ids), np.int64)
        met = np.zeros((len(terms), len(self.ids)), bool)
        at, candidates = 0, None
        while True:
            take = np.clip(end - start - at, 0, depth)
            which = np.repeat(lists, take)
            read = np.arange(take.sum()) + np.repeat(start + at - (np.cumsum(take) - take), take)
            docs = self.doc[read]
            np.add.at(lower, docs, self.impact[read] * times[which])
            met[which, docs] = True
            at, depth = at + depth, depth * 2
            left = start + at < end
            following = np.where(left, self.impact[np.where(left, start + at, 0)] * times if len(self.impact) else 0, 0)
            unmet = int(following.sum())
            some = np.flatnonzero(lower) if candidates is None else candidates
            low = lower[some]
            bound = max(floor, int(np.partition(low, -best)[-best]) if len(low) >= best else 0, 1)
            some = some[low + unmet >= bound]
            low = lower[some]
            high = low + unmet - following @ met[:, some] if unmet else low
            some, low, high = (x[high >= bound] for x in (some, low, high))
            if unmet < bound:
                candidates = some  # no other document can reach the bound any more
                if (high == low).all():
                    return self.ids[some], low


def _searcher(items: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int):
    """Per partition the best documents of every item: (item, doc_id, score)."""
    def shard(tables: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(tables).combine_chunks()
        terms, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy())
        doc, term = np.repeat(np.arange(len(sizes)), sizes), terms.flatten().to_numpy()
        tf = tfs.flatten().to_numpy()
        m = 100 - 75 + (75 * table["n"].to_numpy() * n_docs) // n_terms
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        return Shard(table["doc_id"].to_numpy(), doc, term, impact, len(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)

        def search(tables: list[pa.RecordBatch]) -> None:
            here = shard(tables)
            for i, (terms, times) in enumerate(items):
                ids, scores = found[i]
                floor = int(scores[-1]) if len(scores) == BEST else 0
                more, high = here.search(terms, times, floor)
                if len(more):
                    ids, scores = np.concatenate([ids, more]), np.concatenate([scores, high])
                    first = np.lexsort((ids, -scores))[:BEST]
                    found[i] = ids[first], scores[first]

        held, rows, postings = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows, postings = rows + batch.num_rows, postings + len(batch["terms"].flatten())
            if rows >= SHARD_ROWS or postings >= SHARD_POSTINGS:
                search(held)
                held, rows, postings = [], 0, 0
        if held:
            search(held)
        for at in range(0, len(found), 1000):
            part = found[at:at + 1000]
            which = np.repeat(np.arange(at, at + len(part)), [len(ids) for ids, _ in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int32()), pa.array(np.concatenate([p[0] for p in part]), pa.int64()),
                 pa.array(np.concatenate([p[1] for p in part]), pa.int64())], names=["item", "doc_id", "score"])

    return run


def _firsts(found: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)


def best_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's highest-scoring documents with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.
    Every row of ``docs`` is a document, so a repeated row is ranked as often as it stands
    there; one without doc_id counts in the statistics and is not ranked.  Null and empty
    texts have no terms.  Of repeated items one counts; different texts under one item_id
    are one item.  Equal scores go by doc_id.  Empty tables give no rows.  Items whose
    terms exceed ``ITEM_BYTES`` are searched in several rounds, whole items at a time.
    """
    wanted = materialize(item_terms(items), "items")
    total = wanted.agg(F.sum(F.length("term") + 24)).first()[0] or 0
    rounds = total // ITEM_BYTES + 1
    out = None
    for i in range(rounds):
        mine = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i) if rounds > 1 else wanted
        part = _search_round(docs, mine)
        out = part if out is None else out.unionByName(part)
    return out


def _search_round(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = wanted.toArrow()
    terms, places = np.unique(np.array([t.encode() for t in rows["term"].to_pylist()], object), return_inverse=True)
    counted = materialize(count_terms(docs, terms.tolist()), "counted")
    n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").select(
        F.col("item_id").cast(wanted.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
    if not n_docs or not len(terms):
        return none
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(terms), np.int64)
    df[held["term"].to_numpy()] = held["count"].to_numpy()
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    times, owners = rows["times"].to_numpy(), rows["item_id"].to_pylist()
    by_item: dict[object, list[int]] = {}
    for i, owner in enumerate(owners):
        by_item.setdefault(owner, []).append(i)
    # A term no document holds, or that weighs nothing, adds nothing.
    telling = (df > 0) & (weights > 0)
    asked = [(owner, kept) for owner, at in by_item.items() if (kept := [i for i in at if telling[places[i]]])]
    if not asked:
        return none
    search = _searcher([(places[at].astype(np.int64), times[at]) for _, at in asked], weights, n_docs, n_terms)
    found = counted.filter("doc_id is not null").mapInArrow(search, "item int, doc_id long, score long")
    # Ranked by shares of the documents first: no task sees all rows of an item.
    shared = _firsts(found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(32))), "item", "share").select("item", "doc_id", "score")
    names = spark.createDataFrame(
        pa.table({"item": pa.array(range(len(asked)), pa.int32()), "item_id": pa.array([o for o, _ in asked], rows["item_id"].type)}))
    # As many names as the round's items, whose terms are bounded.
    return _firsts(shared, "item").join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
