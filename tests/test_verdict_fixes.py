"""Cases that once went wrong: passwords with @ and /, unknown types in drift, ambiguous fingerprints, wide tables."""

from pyspark.sql import functions as F

from cartolake.functions.dsn import scrub_text
from cartolake.functions import classify
from cartolake.operators import ask, drift, enrich
from cartolake.sources import constraints


def test_passwords_with_marks(spark):
    cases = {
        "postgres://bob:a/b@h": "postgres://bob:***@h", "postgres://bob:p@ss@h": "postgres://bob:***@h",
        "x://u:p%40q@h/db and y://:z@k": "x://u:***@h/db and y://:***@k", "no://user@host here": "no://user@host here",
        "a: b@c": "a: b@c", "http://h:80/a@b": "http://h:80/a@b"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.withColumn("s", scrub_text(F.col("t"))).collect()} == cases


COLUMNS = ("schema string, `table` string, ordinal int, `column` string, data_type string, nullable boolean, "
           "is_primary_key boolean, `default` string")


def rows(spark, *columns):
    return spark.createDataFrame(
        [("s", "t", i, c, d, True, False, None) for i, (c, d) in enumerate(columns, 1)], COLUMNS)


def test_unknown_types_are_types(spark):
    now, then = rows(spark, ("same", None), ("lost", None), ("new", None)), rows(spark, ("same", None), ("lost", "int"), ("old", None))
    got = {(r["column"], r.change_type) for r in drift.column_drift(now, then).collect()}
    assert got == {("lost", "column_retyped"), ("new", "column_added"), ("old", "column_removed")}


def test_fingerprints_tell_structures_apart(spark):
    a, b = rows(spark, ("a:b", "c")), rows(spark, ("a", "b:c"))
    assert drift.fingerprints(a).first().fingerprint != drift.fingerprints(b).first().fingerprint
    assert drift.fingerprints(rows(spark, ("a", None))).first().fingerprint != drift.fingerprints(
        rows(spark, ("a", ""))).first().fingerprint


def test_wide_tables_are_one_row(spark):
    wide = rows(spark, *((f"c{i}", "int") for i in range(12_000)))
    folded = constraints.fold_tables(wide.withColumn("row_count", F.lit(1).cast("long"))).collect()
    assert len(folded) == 1 and folded[0].n_columns == 12_000
    assert enrich.table_prompts(wide).count() == 1


def test_names_of_people_and_measures(spark):
    df = spark.createDataFrame([(c, "orders", "int", False) for c in (
        "customer_name", "emailAddress", "product_name", "account_no", "taxi_zone", "o_totalprice", "tax", "item_count")],
        "`column` string, `table` string, data_type string, is_primary_key boolean")
    got = {r["column"]: (r.risk, r.kind) for r in df.select(
        "column", classify.pii_risk().alias("risk"), classify.semantic_type().alias("kind")).collect()}
    assert [got[c][0] for c in ("customer_name", "emailAddress", "product_name")] == ["high", "high", "none"]
    assert [got[c][1] for c in ("account_no", "taxi_zone", "o_totalprice", "tax", "item_count")] == [
        "dimension", "dimension", "measure", "measure", "measure"]


def test_describe_keeps_tables_without_columns(spark):
    columns = rows(spark, ("a", "int"))
    tables = spark.createDataFrame([("s", "t", 1), ("s", "bare", 2)], "schema string, `table` string, row_count bigint")
    td = spark.createDataFrame([], "schema string, `table` string, description string, grain string, "
                                   "domain_hints array<string>, confidence double")
    cd = spark.createDataFrame([], "schema string, `table` string, `column` string, description string, "
                                   "semantic_type string, pii_risk string, confidence double")
    keys = spark.createDataFrame([("s", "t"), ("s", "bare"), ("s", "ghost")], "schema string, `table` string")
    got = {(r["table"], r["column"], r.row_count, r.known) for r in ask.describe(columns, tables, td, cd, keys).collect()}
    assert got == {("t", "a", 1, True), ("bare", None, 2, True), ("ghost", None, None, False)}
