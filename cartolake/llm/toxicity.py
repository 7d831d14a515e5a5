"""Toxicity scores by a linear classifier that is regularised against swaps of identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import materialize, small_side

# Words that name groups of people; those of a line stand in for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("woman", "man", "girl", "boy", "lady", "gentleman"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("old", "young", "elderly", "blind", "deaf", "disabled"),
)
# Labelled rows a model is fitted on, at most; those with the smallest hashes of their ids are taken.
FIT_ROWS = 12_000
# Words and word beginnings the model looks at, at most, and the fewest fitted rows they must be in.
FEATURES = 1000
LEAST_ROWS = 3
# Half the likelihood-ratio statistic a feature must reach: beyond chance by far more than one in a thousand.
LEAST_EVIDENCE = 7.0
PREFIXES = (3, 4, 5, 6)
RIDGE = 1.0
SWAP_PENALTY = 1.0
THRESHOLD = 0.3
REMEMBER = 400_000
# Rows the driver makes dense at a time.
BLOCK_ROWS = 512
_TOKEN = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(token: str) -> list[str]:
    """A word as it is, and its beginnings with a mark."""
    return [token, *(token[:n] + "*" for n in PREFIXES if len(token) > n)]


def swaps(groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[str, str]:
    """Each identity term with the one that takes its place: the next of its line."""
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


@dataclass(frozen=True)
class Model:
    """Weights of features; a text's score is the logistic of the bias and the weights it holds."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        weights, known = self.weights, {}

        def of(text: str) -> float:
            held: set[str] = set()
            for token in set(_TOKEN.findall(text.lower())):
                found = known.get(token)
                if found is None:
                    if len(known) > REMEMBER:
                        known.clear()
                    found = known[token] = tuple(f for f in features(token) if f in weights)
                held.update(found)
            # Summed in order, so that equal texts score equally wherever they are read.
            total = self.bias + sum(weights[f] for f in sorted(held))
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return of


def fit_rows(held: Sequence[np.ndarray], y: np.ndarray, times: np.ndarray, width: int, swapped: np.ndarray,
             ridge: float = RIDGE, swap_penalty: float = SWAP_PENALTY, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression by Newton steps.

    Row i holds the features ``held[i]`` and counts ``times[i]`` times.  Besides the
    ridge, the difference between a sentence's features and those of its swapped form
    costs ``swap_penalty`` times the square of the score change before the logistic;
    ``swapped`` is the sum of these differences' outer products.  Rows are made dense
    ``BLOCK_ROWS`` at a time: memory is that of a few matrices of features by features.
    """
    n = len(y)
    sizes = np.array([len(h) for h in held], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(held) if n else np.zeros(0, np.int16)
    penalty = swapped * swap_penalty
    penalty[np.diag_indices(width)] += ridge

    def margins(w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[flat])])
        return sums[ends[1:]] - sums[ends[:-1]] + w[-1]

    def penalised(w: np.ndarray) -> np.ndarray:
        return np.append(penalty @ w[:-1], 1e-6 * w[-1])

    def loss(w: np.ndarray) -> float:
        z = margins(w)
        return float((times * (np.logaddexp(0, z) - y * z)).sum() + w @ penalised(w) / 2)

    w = np.zeros(width + 1)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margins(w), -30, 30)))
        gradient, hessian = penalised(w), np.zeros((width + 1, width + 1))
        hessian[:-1, :-1] = penalty
        hessian[np.diag_indices(width + 1)] += 1e-9
        hessian[-1, -1] += 1e-6
        for at in range(0, n, BLOCK_ROWS):
            part = slice(at, min(at + BLOCK_ROWS, n))
            dense = np.zeros((part.stop - at, width + 1))
            dense[:, -1] = 1
            dense[np.repeat(np.arange(part.stop - at), sizes[part]), flat[ends[at] : ends[part.stop]]] = 1
            gradient += dense.T @ (times[part] * (p[part] - y[part]))
            hessian += dense.T @ (dense * (times[part] * p[part] * (1 - p[part]))[:, None])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-9 * max(1.0, abs(now)):
            break
        w, now = w - size * step, new
    return w


def _examples(replace: dict[str, str]):
    """Rows of (id, label, features, swapped): ``swapped`` lists, per sentence with identity terms, what a swap takes and adds."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, changed = [], []
            for text in batch["text"].to_pylist():
                lowered = (text or "").lower()
                held.append(sorted({f for t in set(_TOKEN.findall(lowered)) for f in features(t)}))
                out = []
                if not replace.keys().isdisjoint(_TOKEN.findall(lowered)):
                    for sentence in _SENTENCE.split(lowered):
                        tokens = set(_TOKEN.findall(sentence))
                        if tokens & replace.keys():
                            old = {f for t in tokens for f in features(t)}
                            new = {f for t in tokens for f in features(replace.get(t, t))}
                            out.append(" ".join(["-" + f for f in sorted(old - new)] + ["+" + f for f in sorted(new - old)]))
                changed.append(out)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], batch["toxic"], pa.array(held, pa.list_(pa.string())),
                pa.array(changed, pa.list_(pa.string()))], names=["doc_id", "toxic", "features", "swapped"])

    return run


def _places(place: dict[str, int]):
    """Rows with the places of their features in ``place``, as 16-bit numbers in order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.array(sorted(place[f] for f in row if f in place), np.int16).tobytes() for row in batch["features"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"], pa.array(held, pa.binary())], names=["doc_id", "toxic", "held"])

    return run


def swap_products(rows: DataFrame, place: dict[str, int]) -> np.ndarray:
    """The sum of the outer products of all swaps in ``rows``, in terms of the features in ``place``.

    Tasks add up their own; the driver sees a matrix of features by features.
    """
    width = len(place)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), np.int64)
        for batch in batches:
            for changes in batch["swapped"]:
                for change in changes.values or ():
                    signs = {place[f[1:]]: 1 if f[0] == "+" else -1 for f in change.as_py().split() if f[1:] in place}
                    if signs:
                        at, sign = np.array(list(signs)), np.array(list(signs.values()))
                        total[np.ix_(at, at)] += np.outer(sign, sign)
        i, j = np.nonzero(total)
        for at in range(0, len(i), 10_000):
            a, b = i[at : at + 10_000], j[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], names=["i", "j", "v"])

    found = rows.filter(F.size("swapped") > 0).select("swapped").mapInArrow(run, "i long, j long, v long").groupBy(
        "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows_most: int = FIT_ROWS, most_features: int = FEATURES,
        groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """A model from at most ``fit_rows_most`` labelled documents.

    ``labels`` has doc_id and toxic (0 or 1; null labels are left out, the larger
    of several counts).  Features are the words and word beginnings whose presence
    tells most about the label.  The driver holds them, the sample's rows in terms
    of them and a matrix of features by features, all bounded by the parameters.  Without two different labels
    the model scores the share of 1s (a half without labels).
    """
    wanted = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")))
    sample = materialize(wanted.orderBy(F.xxhash64("id"), "id").limit(fit_rows_most), "fit-rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(
        texts.join(small_side(sample, F.lit(16)), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
        .mapInArrow(_examples(swaps(groups)), "doc_id long, toxic int, features array<string>, swapped array<string>"),
        "examples")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < ones < n:
        return Model({}, float(np.log((ones + 1) / (n - ones + 1))))
    p = lambda k, m: F.when(k > 0, k * F.log(k * n / m)).otherwise(0.0)
    counted = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("held"), F.sum("toxic").alias("k")).filter(F.col("held") >= LEAST_ROWS)
    # Half the likelihood-ratio statistic of presence against label.
    told = (p(F.col("k"), F.col("held") * ones) + p(F.col("held") - F.col("k"), F.col("held") * (n - ones))
            + p(ones - F.col("k"), (n - F.col("held")) * ones)
            + p(n - F.col("held") - ones + F.col("k"), (n - F.col("held")) * (n - ones)))
    telling = counted.withColumn("told", F.round(told, 6)).filter(F.col("told") >= LEAST_EVIDENCE)
    best = [r.feature for r in telling.orderBy(F.col("told").desc(), "feature").limit(most_features).select("feature").collect()]
    place = {f: i for i, f in enumerate(best)}
    held = rows.select("doc_id", "toxic", "features").mapInArrow(_places(place), "doc_id long, toxic int, held binary")
    # Rows alike count once, with their number: a repeated document takes no more room here.
    sparse = held.groupBy("doc_id", "toxic", "held").agg(F.count("*").alias("times")).orderBy("doc_id", "toxic", "held").toArrow()
    w = fit_rows([np.frombuffer(h, np.int16) for h in sparse["held"].to_pylist()], sparse["toxic"].to_numpy().astype(np.float64),
                 sparse["times"].to_numpy().astype(np.float64), len(best), swap_products(rows, place))
    return Model({f: float(v) for f, v in zip(best, w) if abs(v) > 1e-6}, float(w[-1]))


def score_of(text: Column, model: Model) -> Column:
    """The score (0 to 1) of a whole text; a null text scores like an empty one."""
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for texts in parts:
            yield pa.array([of(t or "") for t in texts.to_pylist()], pa.float64())

    from typing import Iterator as Parts

    run.__annotations__ = {"parts": Parts[pa.Array], "return": Parts[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), from whole texts alone.

    A null text scores like an empty one.  Columns of ``docs`` with these names
    are replaced; repeated rows score alike; an empty table gives no rows.
    """
    return docs.withColumn("score", score_of(F.col("text"), model)).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
