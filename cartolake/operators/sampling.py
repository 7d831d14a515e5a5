"""Row samples: coercion, redaction, and the decision on sampling requests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolake.functions.text import let
from cartolake.operators.skew import lookup_join
from cartolake.schema import PROTECTED_RISKS, TABLE_KEY
from cartolake.session import materialize

DEFAULT_ROWS = 5
MAX_ROWS = 20
BINARY_PLACEHOLDER = "<binary>"


def sample(df: DataFrame, n: int = DEFAULT_ROWS, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows, in any order the source gives, or by ``order_by`` when stated."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError(f"n must be a non-negative int, got {n!r}")
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def sample_tables(tables: Mapping[str, DataFrame], n: int = DEFAULT_ROWS) -> DataFrame:
    """A coerced sample of every table as (table, row): each row one JSON object, NULLs kept."""
    parts = [
        coerce(sample(df, n)).select(
            F.lit(name).alias("table"),
            F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _iso(value: Column, zoned: bool) -> Column:
    """ISO text with a six-digit fraction only when there is one."""
    text = value.cast("timestamp_ntz").cast("string")
    fraction = F.substring_index(text, ".", -1)
    iso = F.concat(
        F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T")),
        F.when(text.contains("."), F.concat(F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(""))
    return F.concat(iso, F.date_format(value, "xxx")) if zoned else iso


def coerce_column(name: str, kind: T.DataType) -> Column:
    """One column in JSON-ready form; types JSON already has pass unchanged."""
    value = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        out = value.cast("string")
    elif isinstance(kind, T.TimestampNTZType):
        out = _iso(value, zoned=False)
    elif isinstance(kind, T.TimestampType):
        out = _iso(value, zoned=True)
    elif isinstance(kind, T.DecimalType):
        out = value.cast("double")
    elif isinstance(kind, T.BinaryType):
        out = F.when(value.isNotNull(), BINARY_PLACEHOLDER)
    else:
        out = value
    return out.alias(name)


def coerce(df: DataFrame) -> DataFrame:
    """Rows in JSON-ready form.  Only top-level columns change."""
    return df.select(*[coerce_column(f.name, f.dataType) for f in df.schema.fields])


def protected_columns(column_descriptions: DataFrame, schema: str, table: str) -> set[str]:
    """Names classified high or medium for one table (reads at most its column rows)."""
    rows = column_descriptions.filter(
        (F.col("schema") == schema) & (F.col("table") == table) & F.col("pii_risk").isin(*PROTECTED_RISKS)
    ).select("column").distinct().collect()
    return {r["column"] for r in rows}


def redact(
    df: DataFrame,
    column_descriptions: DataFrame | None,
    schema: str,
    table: str,
    *,
    allow_pii: bool = False,
    on_missing: str = "pass",
) -> DataFrame:
    """Replace protected columns by NULL of the same type; the row shape stays.

    It is a projection, so protected columns are not even read.  A table without
    column descriptions is passed as it is, or fully redacted with
    ``on_missing='redact'``.
    """
    if on_missing not in ("pass", "redact"):
        raise ValueError(f"on_missing must be 'pass' or 'redact', got {on_missing!r}")
    if allow_pii:
        return df
    names: set[str] = set()
    described = False
    if column_descriptions is not None:
        names = protected_columns(column_descriptions, schema, table)
        described = bool(names) or bool(column_descriptions.filter(
            (F.col("schema") == schema) & (F.col("table") == table)).take(1))
    if not described and on_missing == "redact":
        names = set(df.columns)
    return df.select(*[
        (F.lit(None).cast(f.dataType) if f.name in names else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields])


def decide(limit: Column, known: Column, row_count: Column, default: int = DEFAULT_ROWS,
           cap: int = MAX_ROWS) -> list[Column]:
    """The four result columns of a request.  Checks run in this order: limit, cap, table."""
    asked = F.coalesce(limit, F.lit(default))
    outcome = (
        F.when(asked < 1, "rejected_invalid_limit")
        .when(asked > cap, "rejected_cap")
        .when(~known, "rejected_unknown_table")
        .otherwise("ok")
    )
    ok = outcome == "ok"
    return [
        outcome.alias("outcome"), asked.alias("limit_requested"), F.when(ok, asked).alias("limit_effective"),
        F.when(ok & row_count.isNotNull(), F.least(row_count, asked.cast("bigint"))).alias("rows_returned"),
    ]


def adjudicate(requests: DataFrame, tables: DataFrame, default: int = DEFAULT_ROWS, cap: int = MAX_ROWS) -> DataFrame:
    """Decide sampling requests (request_id, schema, table, limit); never clamps, never reads rows.

    ``rows_returned`` follows from the row count and is NULL where that is unknown.  Requests
    for one popular table are spread over tasks.  A streaming ``requests`` works
    the same way, by a plain stream-static join.
    """
    known = tables.select(*TABLE_KEY, "row_count", F.lit(True).alias("__known"))
    if requests.isStreaming:
        joined = requests.join(known, TABLE_KEY, "left")
    else:
        joined = lookup_join(requests, known, TABLE_KEY, "left", spread=["request_id"])
    is_known = F.coalesce(F.col("__known"), F.lit(False))
    return joined.select(
        "request_id", F.lit("sample").alias("tool"), *TABLE_KEY,
        *decide(F.col("limit"), is_known, F.col("row_count"), default, cap))


SAMPLES = "schema string, `table` string, rank int, row string, error string, cells array<struct<filled:boolean,json:string>>"


def json_cells(names: Sequence[str]) -> Column:
    """A row as an array of its columns, each with whether it is filled and its member of the row's JSON object."""
    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        member = let(F.to_json(F.struct(value), {"ignoreNullFields": "false"}), lambda j: F.substr(j, F.lit(2), F.length(j) - 2))
        return F.struct(value.isNotNull().alias("filled"), member.alias("json"))

    return F.array(*[cell(name) for name in names])


def table_samples(
    spark: SparkSession,
    tables: Mapping[tuple[str, str], Callable[[], DataFrame]],
    column_descriptions: DataFrame | None,
    *,
    cap: int = MAX_ROWS,
    key_columns: Mapping[tuple[str, str], Sequence[str]] | None = None,
    allow_pii: bool = False,
    on_missing: str = "pass",
    workers: int = 5,
) -> DataFrame:
    """The ``cap`` rows of each table with the smallest hashes: (schema, table, rank, row, error, cells).

    One pass per table serves any number of requests: every task keeps its ``cap`` best
    rows, so nothing but these is moved.  With ``key_columns`` a pass over these finds the hashes
    that stay, and a second one reads the rows that have them: a joined table moves its keys only.  Rows are redacted before they are hashed or
    read, then coerced, one JSON object each; ``cells`` are its
    columns (see ``json_cells``).  The hash is the MD5 of ``key_columns``, which
    must identify rows, or else of the redacted row, so a sample does not depend on how a
    table is stored.  An
    empty table gives one row without rank.  A table that cannot be read gives one row
    with its error; the others are not affected.
    """
    def one(item: tuple[tuple[str, str], Callable[[], DataFrame]]) -> DataFrame | str:
        (schema, table), load = item
        try:
            shown = coerce(redact(load(), column_descriptions, schema, table, allow_pii=allow_pii, on_missing=on_missing))
            row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
            names = (key_columns or {}).get((schema, table))
            own = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]) if names else row
            # Only the rows that stay are written as JSON.
            hashed = shown.withColumn("__by", F.md5(own))
            if names:
                # The keys alone tell which hashes stay; only rows with these travel through what the table is made of.
                last = hashed.select("__by").orderBy("__by").limit(cap).agg(F.max("__by")).first()[0]
                hashed = hashed.filter(F.col("__by") <= F.lit(last)) if last is not None else hashed
            first = hashed.orderBy("__by").limit(cap)
            return materialize(first.select(F.col("__by").alias("by"), F.to_json(
                F.struct(*[F.col(f"`{c}`") for c in shown.columns]), {"ignoreNullFields": "false"}).alias("row"),
                json_cells(shown.columns).alias("cells")), "sample")
        except (PySparkException, Py4JJavaError) as exc:
            return f"{type(exc).__name__}: {str(exc).splitlines()[0]}"

    found = list(tables.items())
    with ThreadPoolExecutor(workers) as pool:
        results = list(pool.map(one, found))
    errors = [(*key, None, None, r, None) for (key, _), r in zip(found, results) if isinstance(r, str)]
    out = spark.createDataFrame(errors, SAMPLES)
    for (key, _), stored in zip(found, results):
        if isinstance(stored, str):
            continue
        schema, table = (F.lit(k) for k in key)
        # At most ``cap`` rows of one table.
        listed = stored.agg(F.sort_array(F.collect_list(F.struct("by", "row", "cells"))).alias("rows"))
        out = out.unionByName(listed.select(
            schema.alias("schema"), table.alias("table"), F.posexplode_outer("rows").alias("at", "r")).select(
            *TABLE_KEY, (F.col("at") + 1).cast("int").alias("rank"), F.col("r.row").alias("row"), F.lit(None).cast("string").alias("error"),
            F.col("r.cells").alias("cells")))
    return materialize(out, "samples")


def sample_requests(requests: DataFrame, tables: DataFrame, samples: DataFrame, default: int = DEFAULT_ROWS,
                    cap: int = MAX_ROWS) -> DataFrame:
    """Requests decided and answered: the columns of ``adjudicate`` with counted ``rows_returned``, and ``rows``.

    ``samples`` is the output of ``table_samples``.  A request for a table that could not be
    read has the outcome ``db_error``.  Requests for one popular table are spread over tasks.
    ``rows`` (JSON texts) is NULL unless the outcome is ok; drop it for the audit.
    """
    per_table = samples.groupBy(*TABLE_KEY).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "row")))), lambda r: r["row"])
        .alias("__rows"), F.max("error").alias("__error"))
    decided = adjudicate(requests, tables, default, cap).drop("rows_returned")
    joined = lookup_join(decided, per_table, TABLE_KEY, "left", spread=["request_id"])
    unread = (F.col("outcome") == "ok") & (F.col("__error").isNotNull() | F.col("__rows").isNull())
    answered = joined.withColumn("outcome", F.when(unread, "db_error").otherwise(F.col("outcome"))).withColumn(
        "rows", F.when(F.col("outcome") == "ok", F.slice("__rows", F.lit(1), F.col("limit_effective"))))
    return answered.select(
        "request_id", "tool", *TABLE_KEY, "outcome", "limit_requested",
        F.when(F.col("outcome") == "ok", F.col("limit_effective")).alias("limit_effective"),
        F.when(F.col("outcome") == "ok", F.size("rows").cast("bigint")).alias("rows_returned"), "rows")
