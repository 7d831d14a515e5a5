"""Quality scores by a sparse ensemble of rules over statistics of a text.

Paths of small boosted trees give rules, a lasso keeps few of them, and what it keeps
becomes one Spark column: texts are scored without any Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import materialize, small_side

# Labelled documents a model is fitted on, at most; those with the smallest hashes of their ids are taken.
FIT_ROWS = 12_000
# Trees, levels of splits, thresholds tried per statistic, and the fewest rows on either side of one.
TREES, LEVELS, THRESHOLDS, LEAST_ROWS = 24, 3, 24, 10
SHRINK = 0.3
# The lasso's weight, as a share of the rows, and its steps.
LASSO, STEPS = 0.001, 400
THRESHOLD = 0.3


def statistics() -> dict[str, Column]:
    """Statistics by name, over the columns of ``_parts``; all are 0 for an empty text."""
    text, words, lines, rest, marks = (F.col(f"__{c}") for c in ("text", "words", "lines", "rest", "marks"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n_chars = F.length(text)
    n_words = F.when(n_chars > 0, F.size(words)).otherwise(0)
    without = lambda pattern: F.length(F.regexp_replace(marks, pattern, ""))
    per_word = lambda pattern: share(F.length(marks) - without(pattern), n_words)
    return {
        "words": F.log1p(n_words.cast("double")),
        "word_length": share(n_chars - n_words + 1, n_words),
        "letters": share(n_chars - F.length(rest), n_chars),
        "capital_runs": share(F.regexp_count(text, F.lit(r"\p{Lu}{2,}")), n_words),
        "digits": share(F.length(marks) - without("[0-9]+"), n_chars),
        "symbols": share(without(r"[\p{N}.,;:!?'\"()-]+"), n_chars),
        "full_stops": per_word("[.?]+"),
        "exclamations": per_word("!+"),
        "commas": per_word("[,;:]+"),
        "bars": per_word(r"[|<>{}\[\]=_/\\]+"),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_per_line": share(n_words, F.size(lines)),
    }


NAMES = ("words", "word_length", "letters", "capital_runs", "digits", "symbols", "full_stops", "exclamations", "commas", "bars",
         "distinct_words", "distinct_lines", "words_per_line")


def _parts(docs: DataFrame) -> DataFrame:
    """The text, its words (parts between spaces), lines with text, what is no letter, and of that what is no space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("*", text.alias("__text")).select(
        "*", F.split("__text", " ").alias("__words"), F.regexp_replace("__text", r"\p{L}+", "").alias("__rest"),
        F.filter(F.split("__text", "\n"), lambda x: F.length(x) > 0).alias("__lines")).select(
        "*", F.regexp_replace("__rest", r"\s+", "").alias("__marks"))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of ``text`` as columns of their own, so that each is computed once for all rules."""
    return _parts(docs).select(
        *[F.col(f"`{c}`") for c in docs.columns], *[c.cast("double").alias(f"__s_{n}") for n, c in statistics().items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction: each condition is (place of a statistic, above, threshold); it has a weight in the model."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for at, above, threshold in self.conditions:
            out &= (x[:, at] > threshold) == above
        return out

    def column(self) -> Column:
        value = lambda at: F.col(f"__s_{NAMES[at]}")
        return reduce(Column.__and__, (value(at) > t if above else value(at) <= t for at, above, t in self.conditions))

    def __str__(self) -> str:
        return " and ".join(f"{NAMES[at]} {'>' if above else '<='} {t:.4g}" for at, above, t in self.conditions)


@dataclass(frozen=True)
class Model:
    """Rules with weights; a text's score is the logistic of the bias and the weights of the rules it meets."""

    rules: tuple[Rule, ...]
    bias: float

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + F.when(rule.column(), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _thresholds(x: np.ndarray) -> list[np.ndarray]:
    """Per statistic up to ``THRESHOLDS`` values between neighbouring values, at even shares of the rows."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        at = np.searchsorted(middle, np.quantile(column, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
        out.append(np.unique(middle[np.clip(at, 0, len(middle) - 1)]) if len(middle) else middle)
    return out


def _split(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, thresholds: list[np.ndarray]):
    """(place, threshold) of the split of ``rows`` that explains most of the residual, or None."""
    best, found = 1e-9, None
    n, total = len(rows), residual[rows].sum()
    for at, tried in enumerate(thresholds):
        if not len(tried):
            continue
        bins = np.searchsorted(tried, x[rows, at], side="left")  # threshold i is below the rows of bins over i
        count = n - np.cumsum(np.bincount(bins, minlength=len(tried) + 1))[:-1]
        above = total - np.cumsum(np.bincount(bins, residual[rows], len(tried) + 1))[:-1]
        fit = (count >= LEAST_ROWS) & (n - count >= LEAST_ROWS)
        gain = np.where(fit, above ** 2 / np.maximum(count, 1) + (total - above) ** 2 / np.maximum(n - count, 1), 0) - total ** 2 / n
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, found = gain[i], (at, float(tried[i]))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each once: every node but the roots is a rule."""
    thresholds = _thresholds(x)
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[tuple, Rule] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        residual, step = y - p, np.zeros(len(y))
        nodes = [((), np.arange(len(y)))]
        for _ in range(LEVELS):
            below = []
            for path, rows in nodes:
                split = _split(x, residual, rows, thresholds) if len(rows) >= 2 * LEAST_ROWS else None
                if split is None:
                    continue
                at, threshold = split
                above = x[rows, at] > threshold
                for side, part in ((True, rows[above]), (False, rows[~above])):
                    conditions = tuple(sorted({*path, (at, side, threshold)}))
                    found.setdefault(conditions, Rule(conditions))
                    step[part] = residual[part].sum() / max((p[part] * (1 - p[part])).sum(), 1e-3)
                    below.append((conditions, part))
            nodes = below
        if not step.any():
            break
        margin = margin + SHRINK * np.clip(step, -4, 4)
    return list(found.values())


def lasso_weights(held: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a lasso, by accelerated proximal steps."""
    n, width = held.shape
    design = np.hstack([held, np.ones((n, 1))])
    rate = 4 * n / max(np.linalg.norm(design, 2) ** 2, 1e-9)
    w = v = np.zeros(width + 1)
    momentum = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ v, -30, 30)))
        new = v - rate * (design.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        v = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows_most: int = FIT_ROWS) -> Model:
    """A model from the statistics of at most ``fit_rows_most`` labelled documents, which the driver holds.

    ``labels`` has doc_id and quality (0 or 1; null labels are left out, the larger of several
    counts).  An id with several texts gives the one with the least statistics.  Without two
    different labels the model scores the share of 1s (a half without labels).
    """
    wanted = labels.filter("quality is not null and doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").cast("int").alias("__y"))
    sample = materialize(wanted.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows_most), "fit-rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        small_side(sample, F.lit(16)), F.col("doc_id") == F.col("__id"))
    rows = with_statistics(texts).groupBy("doc_id", "__y").agg(F.min(F.struct(*[f"__s_{n}" for n in NAMES])).alias("s")).orderBy("doc_id").select("__y", "s.*").toArrow()
    y = rows["__y"].to_numpy().astype(np.float64)
    ones, n = y.sum(), len(y)
    if not 0 < ones < n:
        return Model((), float(np.log((ones + 1) / (n - ones + 1))))
    x = np.stack([rows[f"__s_{c}"].to_numpy() for c in NAMES], axis=1)
    rules = tree_rules(x, y)
    if not rules:
        return Model((), float(np.log((ones + 1) / (n - ones + 1))))
    weights, bias = lasso_weights(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64), y)
    kept = tuple(Rule(r.conditions, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6)
    return Model(kept, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), from whole texts alone.

    A null text scores like an empty one.  Columns of ``docs`` with these names are replaced;
    repeated rows score alike; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = with_statistics(docs).select(*[F.col(f"`{c}`") for c in own], model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
