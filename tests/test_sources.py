import pytest
from conftest import COLUMN_DDL
from pyspark.sql import functions as F

from cartolake.functions import dsn as D
from cartolake.operators import ask, drift, overlap
from cartolake.sources import bundle as B
from cartolake.sources import constraints as C
from cartolake.sources import reports, snapshot

KCU = ("constraint_schema string, constraint_name string, schema string, `table` string, `column` string, ordinal int, "
       "position_in_unique_constraint int")


@pytest.fixture
def info(spark):
    columns = spark.createDataFrame(
        [("public", "users", "user_id", 1, "uuid", "uuid", "NO", None),
         ("public", "users", "tags", 3, "ARRAY", "_text", "YES", None),
         ("public", "users", "status", 2, "USER-DEFINED", "order_status", "YES", "'new'"),
         ("public", "v", "x", 1, "int", "int4", "YES", None),
         ("other", "items", "a", 1, "int", "int4", "NO", None), ("other", "items", "b", 2, "int", "int4", "NO", None)],
        "schema string, `table` string, `column` string, ordinal int, data_type string, udt_name string, "
        "is_nullable string, `default` string")
    tables = spark.createDataFrame(
        [("public", "users", "BASE TABLE"), ("public", "v", "VIEW"), ("other", "items", "BASE TABLE")],
        "schema string, `table` string, table_type string")
    usage = spark.createDataFrame(
        [("public", "users_pk", "public", "users", "user_id", 1, None),
         ("public", "users_uq", "public", "users", "user_id", 1, None),
         ("public", "users_uq", "public", "users", "status", 2, None),
         ("other", "items_pk", "other", "items", "a", 1, None), ("other", "items_pk", "other", "items", "b", 2, None),
         ("public", "x_fk", "public", "users", "status", 1, 2), ("public", "x_fk", "public", "users", "tags", 2, 1)], KCU)
    constraints = spark.createDataFrame(
        [("public", "users_pk", "PRIMARY KEY"), ("public", "users_uq", "UNIQUE"), ("other", "items_pk", "PRIMARY KEY"),
         ("public", "x_fk", "FOREIGN KEY")], "constraint_schema string, constraint_name string, constraint_type string")
    referential = spark.createDataFrame(
        [("public", "x_fk", "other", "items_pk", "DB")],
        "constraint_schema string, constraint_name string, unique_constraint_schema string, "
        "unique_constraint_name string, unique_constraint_catalog string")
    stats = spark.createDataFrame([("public", "users", -1), ("other", "items", 0)],
                                  "schema string, `table` string, row_count bigint")
    return columns, tables, usage, constraints, referential, stats


def test_discover_columns(info):
    columns, tables, usage, constraints, _, stats = info
    rows = C.discover_columns(columns, tables, usage, constraints, stats).collect()
    got = {(r["table"], r["column"]): (r["data_type"], r["nullable"], r["is_primary_key"], r["row_count"]) for r in rows}
    assert got == {("users", "user_id"): ("uuid", False, True, None), ("users", "tags"): ("_text", True, False, None),
                   ("users", "status"): ("order_status", True, False, None), ("items", "a"): ("int", False, True, 0),
                   ("items", "b"): ("int", False, True, 0)}
    assert len(rows) == 5


def test_scopes_and_fallbacks(info):
    columns, tables, usage, constraints, _, stats = info
    assert C.discover_columns(columns, tables, schemas=[]).count() == 0
    only = C.discover_columns(columns, tables, usage, constraints, stats, schemas=["other"])
    assert {r["table"] for r in only.collect()} == {"items"}
    bare = C.discover_columns(columns, tables)
    assert bare.filter("is_primary_key or row_count is not null").count() == 0 and bare.count() == 5
    assert C.scope(tables, default="other").count() == 1


def test_user_schemas(spark):
    names = ["public", "pg_catalog", "information_schema", "pg_temp_1", "pgx", "public"]
    schemata = spark.createDataFrame([(n,) for n in names], "schema string")
    assert sorted(r[0] for r in C.user_schemas(schemata).collect()) == ["pgx", "public"]


def test_fold_pages(info):
    columns, tables, usage, constraints, _, stats = info
    found = C.discover_columns(columns, tables, usage, constraints, stats)
    folded = {r["table"]: [c["column"] for c in r["columns"]] for r in C.fold_tables(found).collect()}
    assert folded == {"users": ["user_id", "status", "tags"], "items": ["a", "b"]}
    pages = C.fold_tables(found, page_size=2).filter("`table` = 'users'").orderBy("page").collect()
    assert [[c["column"] for c in p["columns"]] for p in pages] == [["user_id", "status"], ["tags"]]


def test_composite_foreign_key_alignment(info):
    _, _, usage, constraints, referential, _ = info
    pairs = {(r["source_column"], r["target_column"]) for r in C.foreign_key_pairs(referential, usage).collect()}
    assert pairs == {("status", "b"), ("tags", "a")}
    feed = C.constraint_feed(constraints, usage, referential)
    assert {(r["constraint_type"], r["source_column"], r["target_table"]) for r in feed.collect()} == {
        ("PRIMARY KEY", "user_id", None), ("PRIMARY KEY", "a", None), ("PRIMARY KEY", "b", None),
        ("FOREIGN KEY", "status", "items"), ("FOREIGN KEY", "tags", "items")}
    assert {r["status"] for r in C.split_cross_dataset(feed).collect()} == {"dropped"}


@pytest.mark.parametrize("bound, dropped", [("db", False), ("Db", False), ("main", True)])
def test_cross_database(info, bound, dropped):
    _, _, usage, _, referential, _ = info
    assert {r["dropped"] for r in C.split_cross_database(referential, usage, bound).collect()} == {dropped}


def test_unknown_target_is_dropped(info):
    _, _, usage, _, referential, _ = info
    gone = referential.withColumn("unique_constraint_name", F.lit("gone")).withColumn(
        "unique_constraint_catalog", F.lit(None).cast("string"))
    assert {r["dropped"] for r in C.split_cross_database(gone, usage, "db").collect()} == {True}
    assert C.foreign_key_pairs(gone, usage).count() == 0


def test_dotted_identifiers(spark):
    df = spark.createDataFrame([("s", "a"), ("s.x", "b"), ("s", "c.d")], "schema string, `table` string")
    kept, bad = C.quarantine_dotted(df)
    assert (kept.count(), bad.count()) == (1, 2)
    assert C.reject_dotted(kept).count() == 1
    with pytest.raises(Exception, match="contains"):
        C.reject_dotted(df).collect()


def test_known_count(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (7.0,), (None,)], "c double").select(C.known_count(F.col("c")).alias("c"))
    assert [r["c"] for r in df.collect()] == [None, 0, 7, None]


# -- snapshots ----------------------------------------------------------------
def test_snapshot_isolates_failures(spark, tmp_path):
    good = str(tmp_path / "good")
    spark.createDataFrame([(1, [("a", 1)])], "id int, items array<struct<n:string,q:int>>").write.parquet(good)
    (tmp_path / "bad").mkdir()
    rows = snapshot.snapshot(spark, {("s", "good"): good, ("s", "gone"): str(tmp_path / "none"),
                                     ("s", "bad"): str(tmp_path / "bad")}).collect()
    assert {(r["table"], r["column"], r["data_type"]) for r in rows if r["error"] is None} == {
        ("good", "id", "int"), ("good", "items", "RECORD<n string, q int> REPEATED")}
    assert {r["table"] for r in rows if r["error"]} == {"gone", "bad"}


def test_snapshot_of_spark_catalog(spark):
    spark.range(1).createOrReplaceTempView("snap_me")
    rows = [r for r in snapshot.snapshot_catalog(spark).collect() if r["table"] == "snap_me"]
    assert [(r["column"], r["data_type"], r["nullable"]) for r in rows] == [("id", "bigint", False)]


# -- bundle -------------------------------------------------------------------
@pytest.fixture
def bundle(spark, catalog, tables, fks):
    td = spark.createDataFrame([("s", "a", "A", "g", ["h"], 0.5), ("s", "b", None, None, None, None)],
                               "schema string, `table` string, description string, grain string, "
                               "domain_hints array<string>, confidence double")
    cd = spark.createDataFrame([("s", "a", "id", "d", "identifier", "none", 0.5)],
                               "schema string, `table` string, `column` string, description string, "
                               "semantic_type string, pii_risk string, confidence double")
    rels = fks("s.a.id > s.b.id").withColumn("kind", F.lit("inferred"))
    return B.Bundle(tables("s.a", "s.b"), catalog({"s.a": "id*", "s.b": "id*"}), td, cd, rels,
                    B.make_meta(spark, "lake", "main"))


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_bundle_round_trip(spark, bundle, tmp_path, fmt):
    path = str(tmp_path / "b")
    assert B.read_bundle(spark, path, fmt) is None
    B.write_bundle(bundle, path, fmt)
    B.write_bundle(bundle, path, fmt)
    again = B.read_bundle(spark, path, fmt)
    for name in B.PARTS:
        a, b = getattr(bundle, name), getattr(again, name)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    meta = again.meta.first()
    assert meta["schema_version"] == 1 and meta["generated_at"].endswith("Z") and len(meta["generated_at"]) == 20
    counts = {r["what"]: r["n"] for r in B.bundle_counts(again.tables, again.table_descriptions, again.relationships).collect()}
    assert counts == {"tables": 2, "descriptions_present": 1, "descriptions_null": 1, "relationships": 1}


def test_bundle_version_and_integrity(spark, bundle, tmp_path):
    path = str(tmp_path / "b")
    B.write_bundle(bundle, path)
    bundle.meta.withColumn("schema_version", F.lit(2)).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(B.BundleVersionError):
        B.read_bundle(spark, path)
    bundle.meta.write.mode("overwrite").parquet(f"{path}/meta")
    bundle.table_descriptions.filter("`table` = 'a'").write.mode("overwrite").parquet(f"{path}/table_descriptions")
    with pytest.raises(B.BundleIntegrityError, match="missing_description: s.b"):
        B.read_bundle(spark, path)


def test_key_codec(spark):
    df = spark.createDataFrame([("t1.orders",), ("orders",), (".x",), ("x.",), ("a.b.c",), ("",)], "key string")
    rows = [(r["key"], r["status"], r["schema"], r["table"]) for r in B.decode_keys(df).collect()]
    assert rows == [("t1.orders", "ok", "t1", "orders"), ("orders", "malformed", None, None),
                    (".x", "malformed", None, None), ("x.", "malformed", None, None),
                    ("a.b.c", "dotted_table", None, None), ("", "malformed", None, None)]


# -- asking -------------------------------------------------------------------
def test_describe(spark, bundle):
    keys = spark.createDataFrame([("s", "a"), ("s", "zzz")], "schema string, `table` string")
    rows = {r["table"]: r for r in ask.describe(
        bundle.columns, bundle.tables, bundle.table_descriptions, bundle.column_descriptions, keys).collect()}
    assert rows["a"]["known"] and rows["a"]["table_description"] == "A" and rows["a"]["semantic_type"] == "identifier"
    assert rows["zzz"]["known"] is False and rows["zzz"]["column"] is None
    everything = ask.describe(bundle.columns, bundle.tables, bundle.table_descriptions, bundle.column_descriptions)
    row = everything.filter("`table` = 'b'").first()
    assert row["column"] == "id" and row["description"] is None and row["table_description"] is None


def test_incident(tables, fks):
    rels = fks("s.a.x > s.b.y", "s.b.p > s.b.q", "s.c.x > gone.z.y").withColumn("kind", F.lit("declared"))
    t = tables("s.a", "s.b", "s.c")
    def count(direction):
        rows = ask.incident(rels, t, direction).groupBy("table").count().collect()
        return {r["table"]: r["count"] for r in rows}
    assert count("both") == {"a": 1, "b": 2, "c": 1}
    assert count("outgoing") == {"a": 1, "b": 1, "c": 1}
    assert count("incoming") == {"b": 2}
    for direction in ask.DIRECTIONS:
        one = ask.relationships_of(rels, "s", "b", direction).count()
        assert one == count(direction).get("b", 0)
    with pytest.raises(ValueError):
        ask.incident(rels, t, "sideways")


def test_discover(tables):
    assert ask.discover(tables("s.a", "t.b"), "t").count() == 1


# -- reports ------------------------------------------------------------------
def test_ground_truth(spark):
    raw = spark.createDataFrame(
        [(1, "q", ["s.a", "s.b"]), (2, "", ["s.a"]), (3, None, []), (4, "q4", None), (5, "q5", ["a", None]), (6, "q6", [])],
        "item_id bigint, query string, expected array<string>")
    errors = {r["item_id"]: r["error"] for r in reports.validate_ground_truth(raw).collect()}
    assert [errors[i] is None for i in range(1, 7)] == [True, False, False, False, False, True]
    queries, expected = reports.ground_truth(raw)
    assert queries.count() == 2 and expected.count() == 2


def test_read_ground_truth(spark, tmp_path):
    file = tmp_path / "truth.json"
    file.write_text("""{"queries": [
      {"query": "orders", "expected": ["shop.orders"]}, {"query": 5, "expected": ["a"]}, {"query": "q", "expected": [1, "b"]},
      {"query": "q", "expected": [null]}, {"query": "q", "expected": "a"}, "text", {"query": "none", "expected": [], "more": 1},
      {"query": "", "expected": []}, null]}""")
    rows = reports.validate_ground_truth(reports.read_ground_truth(spark, str(file))).orderBy("item_id").collect()
    assert [r["item_id"] for r in rows] == list(range(9))
    types = "expected must be strings"
    assert [r["error"] for r in rows] == [
        None, "missing query", types, types, types, "missing query", None, "missing query", "missing query"]
    assert rows[0]["expected"] == ["shop.orders"] and rows[6]["expected"] == []


@pytest.mark.parametrize("text", ["", "{", "[]", "{}", '{"queries": []}', '{"queries": "q"}', '{"queries": null}'])
def test_ground_truth_without_queries(spark, tmp_path, text):
    (tmp_path / "truth.json").write_text(text)
    with pytest.raises(reports.GroundTruthError):
        reports.read_ground_truth(spark, str(tmp_path / "truth.json"))


def test_envelope_keeps_nulls(spark):
    metrics = spark.createDataFrame([(1, None)], "a int, b double")
    rows = reports.envelope("quality", "b1", metrics, {"orphan": spark.range(2)}).collect()
    assert [(r["mode"], r["section"]) for r in rows] == [("quality", "metrics"), ("quality", "orphan"), ("quality", "orphan")]
    assert rows[0]["payload"] == '{"a":1,"b":null}'
    assert reports.truncated(spark.range(30), ["id"]).count() == 10


def test_ordered_edges(fks):
    rels = fks("s.b.x > s.c.y", "s.a.x > s.c.y").withColumn("kind", F.lit("inferred")).unionByName(
        fks("s.z.x > s.c.y").withColumn("kind", F.lit("declared")))
    assert [r["source_table"] for r in reports.ordered_edges(rels).collect()] == ["z", "a", "b"]


def test_audit_appends(spark, tmp_path):
    path = str(tmp_path / "audit")
    for _ in range(2):
        reports.append_audit(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6


# -- scrubbing ----------------------------------------------------------------
LABELS = [
    ("postgresql://u:p@Host:5432/db", "u@host:5432/db"), ("snowflake://alice@acct/DB/SCHEMA", "alice@acct/DB/SCHEMA"),
    ("bigquery://my-project", "my-project"), ("postgresql://h/", "h"), ("pg://u:a@b@h/x?y=1#z", "u@h/x"),
    ("duckdb:///data/x.db", "unknown"), ("snowflake", "unknown"), ("", "unknown"), ("pg://h:port/x", "unknown"),
    ("pg://h:99999/x", "unknown"), ("pg://:pw@h/x", "h/x"), ("pg://[::1]:5432/x", "::1:5432/x"), ("localhost:5432/x", "unknown"),
]


def test_labels(spark):
    df = spark.createDataFrame(LABELS, "dsn string, want string").withColumn("got", D.connection_label(F.col("dsn")))
    assert [(r["dsn"], r["got"]) for r in df.collect()] == LABELS


SCRUBS = [
    ("failed to connect to postgresql://u:hunter2@h:5432/d", "postgresql://u:hunter2@h:5432/d", "failed to connect to u@h:5432/d"),
    ("nothing here", "postgresql://u:hunter2@h:5432/d", "nothing here"),
    ("at pg://user:a+b(c)?.*@host:5432/db (x)", "pg://user:a+b(c)?.*@host:5432/db", "at unknown (x)"),
    ("password 's3cr3t' is wrong for 'alice'", "sf://alice:s3cr3t@acct/DB", "password '***' is wrong for 'alice'"),
    ("'s@cr3t' and s%40cr3t", "sf://alice:s%40cr3t@acct/DB", "'***' and ***"),
    ("snowflake.errors: refused", "snowflake", "snowflake.errors: refused"),
    ("at sf://alice@acct/DB", "sf://alice@acct/DB", "at alice@acct/DB"),
    ("text", "", "text"), ("text", None, "text"),
]


def test_scrub_dsn(spark):
    df = spark.createDataFrame(SCRUBS, "message string, dsn string, want string")
    got = df.select("want", D.scrub_dsn(F.col("message"), F.col("dsn")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_scrub_text(spark):
    df = spark.createDataFrame([("a pg://u:pw@h/x b http://x.org/y c ftp://me:it@z, redis://:k3y@r:1 d http://h:80/a@b",), (None,)], "m string")
    got = [r["m"] for r in D.scrub(df, "m").collect()]
    assert got == ["a pg://u:***@h/x b http://x.org/y c ftp://me:***@z, redis://:***@r:1 d http://h:80/a@b", None]


# -- change over time ---------------------------------------------------------
def test_drift(spark, catalog):
    now = catalog({"s.a": "id* x", "s.b": "id*"})
    before = spark.createDataFrame(
        [("s", "a", 1, "id", "string", False, True, None), ("s", "a", 2, "y", "int", True, False, None),
         ("s", "b", 1, "id", "int", False, True, None)], COLUMN_DDL)
    rows = {(r["table"], r["column"]): r["change_type"] for r in drift.column_drift(now, before).collect()}
    assert rows == {("a", "id"): "column_retyped", ("a", "x"): "column_added", ("a", "y"): "column_removed"}
    stored = drift.fingerprints(before).withColumn("model", F.lit("m")).withColumn("prompt_hash", F.lit("p"))
    extra = catalog({"s.a": "id* x", "s.b": "id*", "s.c": "id*"})
    stale = {r["table"]: r["reason"] for r in drift.stale_tables(drift.fingerprints(extra), stored, "m", "p").collect()}
    assert stale == {"a": "columns_changed", "c": "new_table"}
    by_model = drift.stale_tables(drift.fingerprints(before), stored, "m2", "p").collect()
    assert {r["reason"] for r in by_model} == {"model_changed"}
    assert {r["reason"] for r in drift.stale_tables(drift.fingerprints(before), stored, "m", "p2").collect()} == {
        "prompt_changed"}


def test_fingerprint_pages_are_order_free(catalog):
    columns = catalog({"s.w": " ".join(f"c{i}" for i in range(50))})
    a = drift.fingerprints(columns, page_size=7).first()["fingerprint"]
    b = drift.fingerprints(columns.repartition(6, "column"), page_size=7).first()["fingerprint"]
    assert a == b


def test_overlap_tiebreak(spark, fks):
    tables = {"src": spark.createDataFrame([(i % 10,) for i in range(50)] + [(None,)], "v int"),
              "whole": spark.range(10), "half": spark.range(6), "same": spark.range(12)}
    pairs = fks("main.src.v > main.whole.id", "main.src.v > main.half.id")
    shares = {r["target_table"]: r["containment"] for r in overlap.containment(pairs, tables).collect()}
    assert shares == {"whole": 1.0, "half": 0.6}
    chosen = overlap.break_ties(overlap.containment(pairs, tables)).collect()
    assert [r["target_table"] for r in chosen] == ["whole"]
    tied = fks("main.src.v > main.whole.id", "main.src.v > main.same.id")
    assert overlap.break_ties(overlap.containment(tied, tables)).count() == 0
    assert overlap.break_ties(overlap.containment(pairs, tables), threshold=1.1).count() == 0
