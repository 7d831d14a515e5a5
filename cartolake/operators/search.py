"""Catalog search, ranking, and relevance metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolake.functions.text import grams
from cartolake.schema import TABLE_KEY
from cartolake.session import materialize

DEFAULT_LIMIT = 20
# Best place of a hit, in rank order (fixed names).
MATCH_TYPES = ("table_name", "column_name", "description_body")
# Needles evaluated by one pass over the texts; longer lists take several passes.
NEEDLES_PER_PASS = 100
# Characters of a piece in the search index.
GRAM = 3


def search_texts(
    tables: DataFrame, columns: DataFrame, table_descriptions: DataFrame, column_descriptions: DataFrame
) -> DataFrame:
    """Everything searchable as (schema, table, tier, text), lower-cased, one row per text.

    Kept flat on purpose: no per-table arrays are built, so a very wide table is
    just many rows.  Failed descriptions contribute nothing.
    """
    def texts(df: DataFrame, tier: int, *names: str) -> DataFrame:
        found = df.select(*TABLE_KEY, F.lit(tier).alias("tier"),
                          F.explode(F.array(*[F.lower(n) for n in names])).alias("text"))
        return found.filter(F.col("text").isNotNull())

    parts = [
        texts(tables, 0, "table"),
        texts(columns, 1, "column"),
        texts(table_descriptions.filter(F.col("description").isNotNull()), 2, "description", "grain"),
        texts(column_descriptions, 2, "description"),
    ]
    return reduce(DataFrame.unionByName, parts)


def search(texts: DataFrame, queries: Sequence[tuple[int, str]], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Ranked hits (query_id, rank, schema, table, match_type) for many queries at once.

    The needles are parameters of the plan: each text is tested against them where
    it is read and emits only the queries that hit, so no query-text pairs are
    joined.  The best tier per table is combined map-side, and the per-query
    top-k filter is applied before the shuffle as well as after it.
    """
    if limit < 0:
        raise ValueError(f"limit must not be negative, got {limit}")
    needles = [(query_id, text.lower()) for query_id, text in queries if text]
    spark = texts.sparkSession
    if not needles:
        return spark.createDataFrame([], "query_id int, rank int, schema string, `table` string, match_type string")
    passes = []
    for start in range(0, len(needles), NEEDLES_PER_PASS):
        tests = [F.when(F.col("text").contains(F.lit(needle)), F.lit(query_id))
                 for query_id, needle in needles[start:start + NEEDLES_PER_PASS]]
        passes.append(texts.select(*TABLE_KEY, "tier",
                                   F.explode(F.array_compact(F.array(*tests))).alias("query_id")))
    best = reduce(DataFrame.unionByName, passes).groupBy("query_id", *TABLE_KEY).agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("query_id").orderBy("tier", *TABLE_KEY)
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", *TABLE_KEY,
                F.element_at(F.array(*map(F.lit, MATCH_TYPES)), F.col("tier") + 1).alias("match_type"))
    )


@dataclass(frozen=True)
class SearchIndex:
    """Distinct texts (text_id, text) and the postings (gram, text_id) of their pieces of one to ``GRAM`` characters."""

    texts: DataFrame
    postings: DataFrame


def search_index(texts: DataFrame) -> SearchIndex:
    """The inverted index of ``search_texts``.

    Built on distinct texts, so a name that a million tables share has one set of postings.
    Ids are 64-bit hashes: texts that share one are both looked at, and told apart by the needle.
    """
    distinct = materialize(texts.select("text").distinct().select(F.xxhash64("text").alias("text_id"), "text"), "search-texts")
    pieces = F.flatten(F.array(*[F.coalesce(grams(F.col("text"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]))
    return SearchIndex(distinct, materialize(distinct.select(F.explode(pieces).alias("gram"), "text_id"), "search-index"))


def search_many(texts: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT, index: SearchIndex | None = None) -> DataFrame:
    """Ranked hits as ``search`` gives them, for any number of ``queries`` (query_id, query).

    Needles are rows, not parts of the plan: each meets the index by its rarest gram, the
    shortest of the postings that all its texts are in, and the texts found there are tested
    for the needle itself.  A needle shorter than a gram is a gram.  Equal needles are
    looked up once.  Empty and null needles find nothing.  Of the places of one text only
    the first few can be ranked, so a name that a million tables share meets its needles a few times.
    """
    if limit < 0:
        raise ValueError(f"limit must not be negative, got {limit}")
    index = search_index(texts) if index is None else index
    asked = queries.select("query_id", F.lower("query").alias("needle")).filter("needle <> ''")
    needles = materialize(asked.select("needle").distinct(), "needles")
    size = F.least(F.length("needle"), F.lit(GRAM))
    cut = needles.select("needle", F.explode(F.coalesce(*[
        F.when(size == n, grams(F.col("needle"), n)) for n in range(1, GRAM + 1)])).alias("gram"))
    # A gram the index lacks has 0 postings: it is the rarest and rules its needle out.
    frequency = index.postings.join(cut.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    counted = cut.join(frequency, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = counted.groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("rarest")).select("needle", "rarest.gram")
    found = index.postings.join(first, "gram").select("needle", "text_id").join(index.texts, "text_id").filter(F.col("text").contains(F.col("needle"))).select("needle", "text")
    # A table that ``limit`` others precede among the places of one text is preceded by them for every needle in it.
    # The rank counts tiers of a table apart, and those of equal places once.
    place = F.dense_rank().over(Window.partitionBy("text").orderBy("tier", *TABLE_KEY))
    places = texts.select(*TABLE_KEY, "tier", "text").withColumn("place", place).filter(
        F.col("place") <= limit * len(MATCH_TYPES)).groupBy("text", *TABLE_KEY).agg(F.min("tier").alias("tier"))
    best = places.join(found, "text").groupBy("needle", *TABLE_KEY).agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("needle").orderBy("tier", *TABLE_KEY)
    # Ranked per needle; the queries that share one get its few rows.
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return asked.join(ranked, "needle").select(
        "query_id", "rank", *TABLE_KEY,
        F.element_at(F.array(*map(F.lit, MATCH_TYPES)), F.col("tier") + 1).alias("match_type"))


def search_metrics(ranked: DataFrame, queries: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: precision over what was returned, recall over what was expected, reciprocal rank.

    ``queries`` has query_id and query, ``expected`` has query_id and key
    (``schema.table``).  Queries without hits or expectations score 0.
    """
    wanted = expected.select("query_id", "key").distinct()
    # At most limit rows per query reach this join.
    scored = (
        ranked.withColumn("key", F.concat_ws(".", *TABLE_KEY))
        .join(wanted.withColumn("hit", F.lit(True)), ["query_id", "key"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("returned"), F.count("hit").alias("hits"),
             F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"))
    )
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("expected"))
    zero = F.lit(0).cast("bigint")
    return (
        queries.join(scored, "query_id", "left").join(sizes, "query_id", "left")
        .select(
            "query_id", "query",
            F.coalesce("returned", zero).alias("returned"),
            F.coalesce("expected", zero).alias("expected"),
            F.coalesce("hits", zero).alias("hits"),
            F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0).alias("precision"),
            F.when(F.col("expected") > 0, F.coalesce("hits", zero) / F.col("expected"))
            .otherwise(0.0).alias("recall"),
            F.when(F.col("first_hit").isNotNull(), 1.0 / F.col("first_hit").cast("double"))
            .otherwise(0.0).alias("reciprocal_rank"),
        )
    )


def search_summary(per_query: DataFrame) -> DataFrame:
    """One row of means over all queries; zeros when there are none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query.agg(
        F.count("*").alias("query_count"),
        mean("reciprocal_rank").alias("mean_reciprocal_rank"),
        mean("precision").alias("mean_precision"),
        mean("recall").alias("mean_recall"),
    )
