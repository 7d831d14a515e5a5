"""How much of a column's values another column holds, for all candidate pairs at once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.schema import SOURCE, TARGET
from cartolake.session import materialize

# Values of a column that its sketch keeps, about.
SKETCH_VALUES = 256


def canonical(field: T.StructField) -> Column:
    """A value as text that equal numbers share whatever their type: 1, 1.0 and 1.00 are one value."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(9e15))
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    text = value.cast("string")
    if isinstance(field.dataType, T.StringType):
        # Long texts travel as digests; the mark keeps both forms apart.
        return F.when(F.octet_length(text) > 64, F.concat(F.lit("\x00"), F.sha2(text, 256))).otherwise(text)
    return text


def distinct_values(tables: Mapping[str, DataFrame], columns: Mapping[str, list[str]]) -> DataFrame:
    """(table, column, value): the distinct values of the given columns, one pass per table, written once."""
    parts = []
    for table, names in columns.items():
        fields = [f for f in tables[table].schema.fields if f.name in set(names)]
        cells = [F.struct(F.lit(f.name).alias("column"), canonical(f).alias("value")) for f in fields]
        parts.append(tables[table].select(F.lit(table).alias("table"), F.inline(F.array(*cells))))
    return materialize(reduce(DataFrame.unionByName, parts).filter("value is not null").distinct(), "values")


def _sketch(values: DataFrame) -> DataFrame:
    """The values whose hashes lie below their column's bound: about ``SKETCH_VALUES`` of each, all of a smaller column."""
    n = values.groupBy("table", "column").agg(F.count("*").alias("n_values"))
    bound = F.lit(2.0 ** 62) * F.least(F.lit(1.0), F.lit(float(SKETCH_VALUES)) / F.col("n_values"))
    place = F.shiftrightunsigned(F.xxhash64("value"), 2)
    return values.join(F.broadcast(n), ["table", "column"]).filter(place <= bound)


def contained(pairs: DataFrame, tables: Mapping[str, DataFrame], least: float = 0.0) -> DataFrame:
    """``pairs`` (edges, any number, as rows) with n_values, n_found and containment of the source in the target.

    Each column is read once and reduced to its distinct values.  Where a pair must reach
    ``least``, samples of the sources' values are looked up first, and pairs whose sample
    lies clearly below it are not counted in full; with 0 every pair is exact.  Nulls do not
    count; a source without values has a containment of 0.
    """
    ends = pairs.select(*SOURCE, *TARGET).distinct()
    used = ends.select(F.col("source_table").alias("t"), F.col("source_column").alias("c")).union(
        ends.select("target_table", "target_column")).distinct()
    # One row per column of the given tables at most.
    columns: dict[str, list[str]] = {}
    for r in used.collect():
        columns.setdefault(r["t"], []).append(r["c"])
    if not columns:
        return pairs.sparkSession.createDataFrame([], ", ".join(
            [*(f"{c} string" for c in (*SOURCE, *TARGET)), "n_values bigint", "n_found bigint", "containment double"]))
    values = distinct_values(tables, columns)
    counts = values.groupBy("table", "column").agg(F.count("*").alias("n_values"))
    source = lambda df: df.select(
        F.col("table").alias("source_table"), F.col("column").alias("source_column"), "value")
    target = values.select(F.col("table").alias("target_table"), F.col("column").alias("target_column"), "value")
    # Pairs of columns of tables whose schemas the driver holds.
    listed = materialize(ends, "pairs")

    def looked_up(these: DataFrame, sources: DataFrame) -> DataFrame:
        asked = source(sources).join(F.broadcast(these), ["source_table", "source_column"])
        return asked.join(target.withColumn("hit", F.lit(1)), ["target_table", "target_column", "value"], "left").groupBy(
            *SOURCE, *TARGET).agg(F.count("*").alias("seen"), F.count("hit").alias("n_found"))

    kept = listed
    if least > 0:
        sampled = looked_up(listed, _sketch(values))
        # Four standard deviations of a sample's share below what is asked.
        slack = 4 * F.sqrt(F.lit(0.25) / F.col("seen"))
        kept = materialize(listed.join(F.broadcast(sampled.filter(F.col("n_found") / F.col("seen") < least - slack).select(*SOURCE, *TARGET)),
                                       [*SOURCE, *TARGET], "left_anti"), "likely-pairs")
    found = looked_up(kept, values)
    sized = kept.join(F.broadcast(counts.select(F.col("table").alias("source_table"), F.col("column").alias("source_column"), "n_values")),
                      ["source_table", "source_column"], "left")
    out = sized.join(found.drop("seen"), [*SOURCE, *TARGET], "left").select(
        *SOURCE, *TARGET, F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"),
        F.coalesce("n_found", F.lit(0)).cast("bigint").alias("n_found"))
    share = F.when(F.col("n_values") > 0, F.col("n_found") / F.col("n_values")).otherwise(0.0)
    return out.withColumn("containment", share).filter(F.col("containment") >= least)
