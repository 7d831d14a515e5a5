"""Report and audit sinks, and the search ground truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.operators.skew import group_rank
from cartolake.schema import EDGE, TABLE_KEY

ARTIFACT_VERSION = 1
_KEEP_NULLS = {"ignoreNullFields": "false"}


class GroundTruthError(ValueError):
    """A ground-truth file without usable queries."""


def envelope(mode: str, bundle: str, metrics: DataFrame, details: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A report as rows (mode, bundle, section, payload): one metrics object, one row per detail.

    Details stay rows instead of one nested document, so a report over a large
    catalog is written in parallel; JSON lines of it are the report file.
    """
    def section(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(mode).alias("mode"), F.lit(bundle).alias("bundle"), F.lit(name).alias("section"),
                         F.to_json(F.struct("*"), _KEEP_NULLS).alias("payload"))
    parts = [section(metrics, "metrics"), *[section(df, name) for name, df in (details or {}).items()]]
    return reduce(DataFrame.unionByName, parts)


def ordered_edges(relationships: DataFrame) -> DataFrame:
    """Edges in report order: declared first, then inferred, each by source and target."""
    return relationships.orderBy("kind", *EDGE)


def edge_report(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Edges with their ``position`` in the report: declared ones as their source lists them, then inferred ones by source.

    ``declared`` carries the order of its source within a table as constraint_name and
    ordinal.  Positions are counted in slices, so no task sorts the whole list.
    """
    none = {"constraint_name": F.lit(None).cast("string"), "ordinal": F.lit(None).cast("int")}
    edges = declared.select(*EDGE, F.lit("declared").alias("kind"), "constraint_name", F.col("ordinal").cast("int").alias("ordinal"))
    edges = edges.unionByName(inferred.select(*EDGE, F.lit("inferred").alias("kind")).withColumns(none))
    order = ["kind", *EDGE[:2], "constraint_name", "ordinal", *EDGE[2:]]
    return group_rank(edges, [], order, "position").select("position", "kind", *EDGE)


def report_lists(sections: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Lists of a report, each in its own order: (section, position, payload) from {section: (rows, order)}.

    Names sort by code point, NULL first; equal keys go by payload.  Sorted by
    section and position, the rows are the printed lists.
    """
    parts = [
        df.select(F.lit(name).alias("section"), F.array(*[F.col(c).cast("string") for c in order]).alias("__key"),
                  F.to_json(F.struct("*"), _KEEP_NULLS).alias("payload"))
        for name, (df, order) in sections.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    return group_rank(stacked, ["section"], ["__key", "payload"], "position").select("section", "position", "payload")


def truncated(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first n rows for a printed report, in order."""
    return df.orderBy(*order_by).limit(n)


def artifact(
    summary: DataFrame, scores: DataFrame, *, bundle: str, generator_model: str | None, judge_model: str,
    prompt_hash: Column, run_timestamp: Column | None = None,
) -> DataFrame:
    """A versioned record of one judging run, as rows like ``envelope``.

    The ``run`` row carries versions and metrics; every judged table is an
    ``evaluated`` row, and each scored one a ``table`` row with its scores.
    Append it to a dataset partitioned by run to keep a history.
    """
    now = run_timestamp if run_timestamp is not None else F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = summary.select(
        F.lit(ARTIFACT_VERSION).alias("schema_version"), now.alias("run_timestamp"), F.lit(bundle).alias("bundle"),
        F.lit(generator_model).cast("string").alias("generator_model"), F.lit(judge_model).alias("judge_model"),
        prompt_hash.alias("prompt_version_hash"), F.struct(*summary.columns).alias("metrics"))
    details = {"evaluated": scores.select(*TABLE_KEY), "table": scores.filter("status = 'ok'").drop("status")}
    return envelope("descriptions", bundle, head, details).withColumn(
        "section", F.when(F.col("section") == "metrics", "run").otherwise(F.col("section")))


def append_audit(audit: DataFrame, path: str) -> None:
    """Append decided requests to the audit dataset.  Records never hold row content."""
    audit.write.mode("append").parquet(path)


def validate_ground_truth(raw: DataFrame) -> DataFrame:
    """Check entries (item_id, query, expected array) and report each one's error, NULL when valid."""
    error = (
        F.when(F.coalesce(F.col("query"), F.lit("")) == "", "missing query")
        .when(F.col("expected").isNull() | F.exists("expected", lambda x: x.isNull()), "expected must be strings"))
    return raw.withColumn("error", error)


def ground_truth(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, expected) of the valid entries: (query_id, query) and (query_id, key)."""
    valid = validate_ground_truth(raw).filter(F.col("error").isNull())
    return (valid.select(F.col("item_id").alias("query_id"), "query"),
            valid.select(F.col("item_id").alias("query_id"), F.explode("expected").alias("key")))


def read_ground_truth(spark, path: str) -> DataFrame:
    """(item_id, query, expected) from one JSON document {"queries": [{"query", "expected"}, ...]}.

    Items are numbered from 0 as they stand in the file.  Types are kept apart: a
    query that is no string, or an expectation that is no list of strings, is NULL
    and so an error of ``validate_ground_truth``; extra fields are ignored.  A
    document without a non-empty list of queries raises.
    """
    document = spark.read.text(path, wholetext=True).select(
        F.try_variant_get(F.try_parse_json("value"), "$.queries", "array<variant>").alias("items"))
    files = document.select(F.coalesce(F.size("items"), F.lit(-1)).alias("n")).take(2)
    if len(files) != 1 or files[0]["n"] < 1:
        raise GroundTruthError(f"{path}: expected one JSON document with a non-empty list 'queries'")
    is_text = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "STRING"
    query, expected = (F.try_variant_get("item", f"$.{name}", kind) for name, kind in (
        ("query", "variant"), ("expected", "array<variant>")))
    return document.select(F.posexplode("items").alias("item_id", "item")).select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.when(is_text(query), F.try_variant_get("item", "$.query", "string")).alias("query"),
        F.when(F.forall(expected, is_text), F.try_variant_get("item", "$.expected", "array<string>")).alias("expected"))
