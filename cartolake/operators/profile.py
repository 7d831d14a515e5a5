"""Profiling of the data tables: counts, keys, personal data, empty columns.

Inputs are ``{table name: DataFrame}``.  Each table is read once per profile with
only the columns that matter; results are rows, one per column.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.functions.classify import pii_risk, semantic_type

# Value patterns by kind (ASCII classes only, no look-around).
EVIDENCE = {
    # One character before the sign is enough to tell, and keeps the search linear in long runs.
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "phone": r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}\b",
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"(AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(api|secret)[_-]?key\s*[:=]\s*[A-Za-z0-9]{16,})",
}
# A literal each match must contain, where the pattern has one: a byte search that
# spares most texts the regular expression.
REQUIRED = {"email": ("@",), "ipv4": (".",), "phone": (" ", "-"), "national_id": ("-",),
            "secret": ("AKIA", "-----BEGIN", "key")}
# Texts longer than this are compared by digest when values are counted.
DIGEST_BYTES = 64


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact rows per table, zero included.

    A bare row reads no column data; all tables are counted map-side into one shuffle.
    """
    rows = _union([df.select(F.lit(name).alias("table")) for name, df in tables.items()])
    counts = rows.groupBy("table").agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(name,) for name in tables], "`table` string")
    return names.join(counts, "table", "left").select(
        "table", F.coalesce("n", F.lit(0).cast("bigint")).alias("row_count"))


def _is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _family(field: T.StructField) -> tuple[str, Column]:
    """A column as one of three value types, so that few shuffles cover many columns."""
    value = F.col(f"`{field.name}`")
    kind = field.dataType
    if _is_integral(kind) or isinstance(kind, T.BooleanType):
        return "bigint", value.cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", value.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # Microseconds since the epoch: an exact stand-in.
        return "bigint", F.unix_micros(value.cast("timestamp"))
    if not isinstance(kind, T.StringType):
        value = F.to_json(F.struct(value.alias("v"))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) \
            else value.cast("string")
        value = F.when(F.col(f"`{field.name}`").isNotNull(), value)
    # Long texts are shuffled as their SHA-256; the tag keeps both forms apart.
    token = F.when(F.octet_length(value) > DIGEST_BYTES, F.concat(F.lit("h"), F.sha2(value, 256))).otherwise(
        F.concat(F.lit("v"), value))
    return "string", token


def key_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact rows, nulls, distinct values and uniqueness of every column.

    Cells are turned into (table, ordinal, value) and grouped once per value
    type.  Repeated values collapse map-side, so a value that fills a third of a
    table costs nothing extra; nothing wider than 64 bytes is shuffled.
    """
    cells: dict[str, list[DataFrame]] = {}
    names = []
    for table, df in tables.items():
        by_family: dict[str, list[Column]] = {}
        for ordinal, field in enumerate(df.schema.fields, start=1):
            family, value = _family(field)
            by_family.setdefault(family, []).append(
                F.struct(F.lit(ordinal).alias("ordinal"), value.alias("value")))
            names.append((table, ordinal, field.name, _is_integral(field.dataType)))
        for family, items in by_family.items():
            cells.setdefault(family, []).append(
                df.select(F.lit(table).alias("table"), F.inline(F.array(*items))))
    counted = [
        _union(parts).groupBy("table", "ordinal", "value").agg(F.count("*").alias("n"))
        .groupBy("table", "ordinal")
        .agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
             F.count("value").alias("n_distinct"))
        for parts in cells.values()
    ]
    return _with_names(_union(counted), names).select(
        "table", "ordinal", "column", "integral", "rows", "nulls", "n_distinct",
        ((F.col("nulls") == 0) & (F.col("n_distinct") == F.col("rows"))).alias("is_unique"))


def _with_names(df: DataFrame, names: list[tuple]) -> DataFrame:
    # One row per column of the given schemas, which the driver already holds.
    known = df.sparkSession.createDataFrame(names, "`table` string, ordinal int, `column` string, integral boolean")
    return df.join(F.broadcast(known), ["table", "ordinal"])


def choose_keys(profile: DataFrame) -> DataFrame:
    """The primary key of each table: its first integral, unique, non-null column."""
    first = F.min(F.struct("ordinal", "column"))
    return (
        profile.filter(F.col("integral") & F.col("is_unique") & (F.col("rows") > 0))
        .groupBy("table").agg(first.alias("k")).select("table", "k.ordinal", "k.column")
    )


def _integral_cells(df: DataFrame, table: str, columns: list[tuple[int, str]]) -> DataFrame:
    cells = [F.struct(F.lit(o).alias("ordinal"), F.col(f"`{name}`").cast("bigint").alias("value"))
             for o, name in columns]
    return df.select(F.lit(table).alias("table"), F.inline(F.array(*cells)))


def discover_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The keys of ``choose_keys`` without counting every column.

    Pass one reads the integral columns and rules out those with NULLs or with a
    value range too small to be unique (fewer possible values than rows).  Its
    result, one row per integral column of the given schemas, tells pass two
    which few columns to read again in search of repeated values.
    """
    integral = {
        table: [(o, f.name) for o, f in enumerate(df.schema.fields, start=1) if _is_integral(f.dataType)]
        for table, df in tables.items()}
    integral = {table: columns for table, columns in integral.items() if columns}
    spark = next(iter(tables.values())).sparkSession
    keys = "`table` string, ordinal int, `column` string"
    if not integral:
        return spark.createDataFrame([], keys)
    span = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1
    possible = {(r["table"], r["ordinal"]) for r in (
        _union([_integral_cells(tables[t], t, columns) for t, columns in integral.items()])
        .groupBy("table", "ordinal")
        .agg(F.count("*").alias("rows"), F.count("value").alias("filled"),
             F.min("value").alias("low"), F.max("value").alias("high"))
        .filter((F.col("filled") == F.col("rows")) & (span >= F.col("rows")))
        .select("table", "ordinal").collect())}
    left = {t: [(o, n) for o, n in columns if (t, o) in possible] for t, columns in integral.items()}
    left = {t: columns for t, columns in left.items() if columns}
    if not left:
        return spark.createDataFrame([], keys)
    unique = (
        _union([_integral_cells(tables[t], t, columns) for t, columns in left.items()])
        .groupBy("table", "ordinal", "value").agg(F.count("*").alias("n"))
        .groupBy("table", "ordinal").agg(F.max("n").alias("n")).filter("n = 1").drop("n")
    )
    named = spark.createDataFrame([(t, o, n) for t, columns in left.items() for o, n in columns], keys)
    first = F.min(F.struct("ordinal", "column"))
    return (
        unique.join(F.broadcast(named), ["table", "ordinal"])
        .groupBy("table").agg(first.alias("k")).select("table", "k.ordinal", "k.column")
    )


def profiled_columns(tables: Mapping[str, DataFrame], keys: DataFrame, schema: str = "main") -> DataFrame:
    """Catalog column rows for data tables, with the chosen keys marked."""
    rows = [(schema, table, ordinal, f.name, f.dataType.simpleString(), f.nullable)
            for table, df in tables.items() for ordinal, f in enumerate(df.schema.fields, start=1)]
    listed = keys.sparkSession.createDataFrame(
        rows, "schema string, `table` string, ordinal int, `column` string, data_type string, nullable boolean")
    marked = keys.select("table", "column", F.lit(True).alias("__pk"))
    return listed.join(marked, ["table", "column"], "left").select(
        "schema", "table", "ordinal", "column", "data_type", "nullable",
        F.coalesce("__pk", F.lit(False)).alias("is_primary_key"), F.lit(None).cast("string").alias("default"))


def _text_columns(df: DataFrame) -> list[tuple[int, str]]:
    return [(o, f.name) for o, f in enumerate(df.schema.fields, start=1) if isinstance(f.dataType, T.StringType)]


def _matches(value: Column, kind: str) -> Column:
    found = value.rlike(EVIDENCE[kind])
    if kind in REQUIRED:
        found = reduce(lambda a, b: a | b, [value.contains(part) for part in REQUIRED[kind]]) & found
    return found


def _cells(df: DataFrame, table: str, items: list[Column]) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.inline(F.array(*items)))


def pii_evidence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per text column and pattern: filled rows and rows that match.

    One pass over whole texts and one exchange for all tables: a cell becomes a flag per
    pattern where it is read, and flags are counted map-side.
    """
    parts, names = [], []
    for table, df in tables.items():
        texts = _text_columns(df)
        names += [(table, name) for _, name in texts]
        if texts:
            parts.append(_cells(df, table, [
                F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").isNotNull().alias("filled"),
                         *[_matches(F.col(f"`{name}`"), kind).alias(kind) for kind in EVIDENCE])
                for _, name in texts]))
    spark = next(iter(tables.values())).sparkSession
    none = F.lit(0).cast("bigint")
    if not parts:
        return spark.createDataFrame([], "`table` string, `column` string, kind string, filled bigint, matched bigint")
    counted = _union(parts).groupBy("table", "column").agg(
        F.count_if("filled").alias("filled"), *[F.count_if(kind).alias(kind) for kind in EVIDENCE])
    # Columns of empty tables have no cells.  One name per column of schemas the driver holds.
    known = spark.createDataFrame(names, "`table` string, `column` string").join(counted, ["table", "column"], "left")
    return known.select("table", "column", F.coalesce("filled", none).alias("filled"), F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.coalesce(kind, none).alias("matched")) for kind in EVIDENCE]))).select(
        "table", "column", "kind", "filled", "matched")


def null_compaction(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per column: whether any row has a value.  Empty tables keep all their columns.

    Flags of cells, counted map-side; one exchange for all tables.
    """
    names = [(table, o, f.name) for table, df in tables.items() for o, f in enumerate(df.schema.fields, start=1)]
    filled = _union([
        _cells(df, table, [F.struct(F.lit(o).alias("ordinal"), F.col(f"`{f.name}`").isNotNull().alias("filled"))
                           for o, f in enumerate(df.schema.fields, start=1)])
        for table, df in tables.items()]).groupBy("table", "ordinal").agg(F.bool_or("filled").alias("keep"))
    known = next(iter(tables.values())).sparkSession.createDataFrame(names, "`table` string, ordinal int, `column` string")
    return known.join(filled, ["table", "ordinal"], "left").select(
        "table", "ordinal", "column", F.coalesce("keep", F.lit(True)).alias("keep"))


def compact(df: DataFrame, kept: DataFrame, table: str) -> DataFrame:
    """Project a table onto the columns that hold a value (reads one flag row per column)."""
    names = [r["column"] for r in kept.filter((F.col("table") == table) & F.col("keep")).orderBy("ordinal")
             .select("column").collect()]
    return df.select(*[F.col(f"`{n}`") for n in names])


# Share of filled rows that must match before value evidence counts.
EVIDENCE_SHARE = 0.1
_HIGH_KINDS = ("email", "card", "phone", "national_id", "secret")
_LEVELS = ("none", "low", "medium", "high")


def classify(columns: DataFrame, evidence: DataFrame | None = None, share: float = EVIDENCE_SHARE) -> DataFrame:
    """Columns with semantic_type and pii_risk by name; value evidence can only raise the risk."""
    named = columns.withColumn("semantic_type", semantic_type()).withColumn("pii_risk", pii_risk())
    if evidence is None:
        return named
    strong = evidence.filter((F.col("filled") > 0) & (F.col("matched") / F.col("filled") >= share))
    seen = strong.groupBy("table", "column").agg(
        F.max(F.when(F.col("kind").isin(*_HIGH_KINDS), 3).otherwise(2)).alias("__seen"))
    levels = F.array(*map(F.lit, _LEVELS))
    rank = F.array_position(levels, F.col("pii_risk")) - 1
    return named.join(seen, ["table", "column"], "left").withColumn(
        "pii_risk", F.element_at(levels, (F.greatest(rank, F.coalesce("__seen", F.lit(0))) + 1).cast("int"))
    ).drop("__seen")
