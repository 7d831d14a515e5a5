"""Relationship mapping: declared foreign keys plus edges inferred from names.

A non-key column points at a single-column primary key of its own schema when
its name equals the key name, or ends with an underscore and the key name (then
never at its own table).  Instead of comparing every column with every key, each
column name is expanded into the few suffixes that could match, so both rules
are one equi-join on (schema, key).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.text import suffix_keys
from cartolake.operators.skew import HOT_ROWS, hot_keys
from cartolake.schema import EDGE, SOURCE, TABLE_KEY

# A key that more columns than this could point at is a catch-all, not a target.
PRESSURE_THRESHOLD = 15
# Names of key columns are told by a hash of so many bits before rows travel: 2^17 words at most are broadcast.
NAME_BITS = 23


def _named(columns: DataFrame, normalise: Callable[[Column], Column] | None) -> DataFrame:
    name = F.col("column")
    return columns.withColumn("match_name", normalise(name) if normalise else name)


def single_pks(columns: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Tables with exactly one key column: (schema, key, target_table, target_column)."""
    return (
        _named(columns, normalise).filter("is_primary_key")
        .groupBy(*TABLE_KEY)
        .agg(F.count("*").alias("n"), F.min("match_name").alias("key"),
             F.min("column").alias("target_column"))
        .filter("n = 1")
        .select("schema", "key", F.col("table").alias("target_table"), "target_column")
    )


def match_keys(columns: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Non-key columns with every key name they could refer to; ``direct`` marks the full name."""
    return (
        _named(columns, normalise).filter(~F.col("is_primary_key"))
        .select(*TABLE_KEY, "column", "match_name", F.explode(suffix_keys(F.col("match_name"))).alias("key"))
        .select(*TABLE_KEY, "column", "key", (F.col("key") == F.col("match_name")).alias("direct"))
        # Stated here, so that all branches of a plan agree and share one shuffle.
        .filter(F.col("schema").isNotNull() & F.col("key").isNotNull())
    )


def key_frequency(keys: DataFrame) -> DataFrame:
    """How many columns could refer to each (schema, key); map-side combined."""
    return keys.groupBy("schema", "key").agg(F.count("*").alias("n"))


def _bit(name: Column) -> tuple[Column, Column]:
    """The word and the bit in it that a hash of a name falls on."""
    place = F.pmod(F.xxhash64(name), F.lit(1 << NAME_BITS))
    return F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")


def owned(keys: DataFrame, columns: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``keys`` without names that no key column has; a few of these may stay, by equal hashes."""
    one, (word, bit) = F.lit(1).cast("long"), _bit(F.col("match_name"))
    words = (
        _named(columns, normalise).filter("is_primary_key")
        .groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("__bits")))
    word, bit = _bit(F.col("key"))
    held = F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(one) == 1
    return keys.join(F.broadcast(words), (word == F.col("__word")) & held, "left_semi")


def match_pressure(columns: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(schema, key, n) for every key name some single-column primary key carries."""
    names = single_pks(columns, normalise).select("schema", "key").distinct()
    return key_frequency(match_keys(columns, normalise)).join(names, ["schema", "key"])


def matches(
    columns: DataFrame,
    threshold: int = PRESSURE_THRESHOLD,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Source columns with the usable keys they match; ``targets`` is 1, or 2 for several.

    Owners of a key name are reduced to a count and their first and last table
    before the join, which makes it many-to-one: a popular key name never
    multiplies rows.  First and last also tell whether the column's own table is
    an owner whenever that decides between one target and several.  Usable keys
    match at most ``threshold`` columns each, so names above HOT_ROWS can be
    dropped on the map side, before any shuffle, as are names that no key column has.
    """
    keys, pks = owned(match_keys(columns, normalise), columns, normalise), single_pks(columns, normalise)
    freq = key_frequency(keys)
    owner = F.struct("target_table", "target_column")
    usable = (
        pks.groupBy("schema", "key")
        .agg(F.count("*").alias("owners"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner"))
        .join(freq, ["schema", "key"])
        .filter(F.col("n") <= threshold)
        .drop("n")
    )
    too_hot = F.broadcast(hot_keys(freq, ["schema", "key"], "n", max(HOT_ROWS, threshold + 1)))
    found = keys.join(too_hot, ["schema", "key"], "left_anti").join(usable, ["schema", "key"])
    # A role-prefixed name never points at its own table.
    is_first = F.col("first_owner.target_table") == F.col("table")
    is_last = F.col("last_owner.target_table") == F.col("table")
    skip_own = ~F.col("direct") & (is_first | is_last)
    other = F.when(is_first, F.col("last_owner")).otherwise(F.col("first_owner"))
    return found.select(
        *TABLE_KEY, "column", "key", "direct",
        F.least(F.col("owners") - skip_own.cast("int"), F.lit(2)).cast("int").alias("targets"),
        F.when(skip_own, other).otherwise(F.col("first_owner")).alias("target"),
    ).filter("targets > 0")


def infer_edges(
    columns: DataFrame,
    threshold: int = PRESSURE_THRESHOLD,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Edges of source columns with exactly one possible target, ignoring declared keys."""
    return (
        matches(columns, threshold, normalise)
        .groupBy(*TABLE_KEY, "column")
        .agg(F.sum("targets").alias("n"), F.min("target").alias("target"))
        .filter("n = 1")
        .select(
            F.col("schema").alias("source_schema"), F.col("table").alias("source_table"),
            F.col("column").alias("source_column"), F.col("schema").alias("target_schema"),
            F.col("target.target_table").alias("target_table"),
            F.col("target.target_column").alias("target_column"),
        )
    )


def ambiguous_candidates(
    columns: DataFrame,
    foreign_keys: DataFrame | None = None,
    threshold: int = PRESSURE_THRESHOLD,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """All (source, target) pairs of undeclared source columns with several targets.

    Only keys below the pressure threshold take part, so the output has at most
    ``threshold`` rows per owner table.
    """
    found = matches(columns, threshold, normalise)
    many = (
        found.groupBy(*TABLE_KEY, "column").agg(F.sum("targets").alias("n")).filter("n > 1").drop("n")
    )
    if foreign_keys is not None:
        declared = foreign_keys.select(
            F.col("source_schema").alias("schema"), F.col("source_table").alias("table"),
            F.col("source_column").alias("column")).distinct()
        many = many.join(declared, [*TABLE_KEY, "column"], "left_anti")
    return (
        found.select(*TABLE_KEY, "column", "key", "direct")
        .join(many, [*TABLE_KEY, "column"], "left_semi")
        .join(single_pks(columns, normalise), ["schema", "key"])
        .filter(F.col("direct") | (F.col("target_table") != F.col("table")))
        .select(
            F.col("schema").alias("source_schema"), F.col("table").alias("source_table"),
            F.col("column").alias("source_column"), F.col("schema").alias("target_schema"),
            "target_table", "target_column",
        )
    )


def map_relationships(
    columns: DataFrame,
    foreign_keys: DataFrame | None = None,
    threshold: int = PRESSURE_THRESHOLD,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Declared edges as given, plus inferred edges for columns without a declared one."""
    inferred = infer_edges(columns, threshold, normalise)
    if foreign_keys is None:
        return inferred.withColumn("kind", F.lit("inferred"))
    declared = foreign_keys.select(*EDGE).withColumn("kind", F.lit("declared"))
    undeclared = inferred.join(foreign_keys.select(*SOURCE).distinct(), SOURCE, "left_anti")
    return declared.unionByName(undeclared.withColumn("kind", F.lit("inferred")))
