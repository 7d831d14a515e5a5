import datetime
import decimal

import pytest
from conftest import plan_of
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cartolake.operators import profile, sampling
from cartolake.streaming import audit
from cartolake.streaming.audit import audit_stream

CD = ("schema string, `table` string, `column` string, description string, semantic_type string, pii_risk string, "
      "confidence double")


@pytest.fixture
def people(spark, tmp_path):
    path = str(tmp_path / "people")
    spark.createDataFrame(
        [(1, "Ann", "a@x.org", "Oslo", 3), (2, "Bob", None, "Rome", 4)],
        "id int, name string, email string, city string, n int").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def described(spark):
    return spark.createDataFrame(
        [("s", "people", c, "d", "dimension", r, 0.9)
         for c, r in [("id", "none"), ("name", "medium"), ("email", "high"), ("city", "low")]], CD)


def test_redaction_nulls_protected_columns_and_keeps_types(people, described):
    out = sampling.redact(people, described, "s", "people")
    assert out.schema.simpleString() == people.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == [(1, None, None, "Oslo", 3), (2, None, None, "Rome", 4)]


def test_redacted_columns_are_not_read(people, described):
    schema = plan_of(sampling.redact(people, described, "s", "people")).split("ReadSchema:")[1].splitlines()[0]
    assert "email" not in schema and "name" not in schema and "city" in schema


def test_redaction_switches(people, described):
    assert sampling.redact(people, described, "s", "people", allow_pii=True) is people
    assert sampling.redact(people, described, "s", "other").filter("email is not null").count() == 1
    closed = sampling.redact(people, described, "s", "other", on_missing="redact")
    assert closed.filter("id is not null or city is not null").count() == 0
    assert closed.columns == people.columns
    with pytest.raises(ValueError):
        sampling.redact(people, described, "s", "people", on_missing="maybe")


@pytest.mark.parametrize("bad", [-1, 2.5, "3", True])
def test_sample_limit_must_be_a_count(people, bad):
    with pytest.raises(ValueError):
        sampling.sample(people, bad)


def test_sample(people):
    assert sampling.sample(people, 0).count() == 0
    assert [r["id"] for r in sampling.sample(people, 1, ["id"]).collect()] == [1]
    rows = sampling.sample_tables({"people": people, "again": people}, 1).collect()
    assert sorted(r["table"] for r in rows) == ["again", "people"]
    assert all('"email":' in r["row"] for r in rows)


def test_coercion(spark):
    when = datetime.datetime(2024, 3, 1, 4, 5, 6, 70)
    df = spark.createDataFrame(
        [(when, when.replace(microsecond=0), datetime.date(2024, 3, 1), decimal.Decimal("1.50"), bytearray(b"x"),
          [1, 2], "t"), (None,) * 7],
        "a timestamp_ntz, b timestamp, c date, d decimal(9,2), e binary, f array<int>, g string")
    full, empty = sampling.coerce(df).collect()
    assert tuple(full) == ("2024-03-01T04:05:06.000070", "2024-03-01T04:05:06+00:00", "2024-03-01", 1.5, "<binary>",
                           [1, 2], "t")
    assert tuple(empty) == (None,) * 7


REQUESTS = [(1, "s", "a", None), (2, "s", "a", 20), (3, "s", "a", 21), (4, "s", "a", 0), (5, "s", "gone", 5),
            (6, "s", "gone", 99), (7, "s", "b", 7), (8, "s", "gone", -1)]
WANT = {1: ("ok", 5, 5, 3), 2: ("ok", 20, 20, 3), 3: ("rejected_cap", 21, None, None),
        4: ("rejected_invalid_limit", 0, None, None), 5: ("rejected_unknown_table", 5, None, None),
        6: ("rejected_cap", 99, None, None), 7: ("ok", 7, 7, None), 8: ("rejected_invalid_limit", -1, None, None)}
REQUEST_DDL = "request_id bigint, schema string, `table` string, `limit` int"


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("s", "a", 3), ("s", "b", None)], "schema string, `table` string, row_count bigint")


def outcomes(df):
    return {r["request_id"]: (r["outcome"], r["limit_requested"], r["limit_effective"], r["rows_returned"])
            for r in df.collect()}


def test_adjudicate(spark, known):
    assert outcomes(sampling.adjudicate(spark.createDataFrame(REQUESTS, REQUEST_DDL), known)) == WANT


def test_adjudicate_stream(spark, known, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "audit")
    spark.createDataFrame(REQUESTS, REQUEST_DDL).write.parquet(source)
    stream = spark.readStream.schema(REQUEST_DDL).parquet(source)
    query = audit_stream(stream, known, sink, str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert outcomes(spark.read.parquet(sink)) == WANT


# -- profiling ----------------------------------------------------------------
def test_profile_and_keys(spark):
    t = spark.createDataFrame(
        [(1, 10, 1.5, "x", True, [1]), (2, 10, None, "x" * 100, None, [1]), (3, 12, 1.5, "x" * 101, True, None)],
        "id int, g bigint, f double, s string, b boolean, a array<int>")
    rows = {r["column"]: (r["rows"], r["nulls"], r["n_distinct"], r["is_unique"])
            for r in profile.key_profile({"t": t}).collect()}
    assert rows == {"id": (3, 0, 3, True), "g": (3, 0, 2, False), "f": (3, 1, 1, False), "s": (3, 0, 3, True),
                    "b": (3, 1, 1, False), "a": (3, 1, 1, False)}


def test_both_ways_to_find_keys_agree(spark):
    tables = {
        "dup": spark.createDataFrame([(1, 5), (9, 6), (1, 7)], "x bigint, y int"),
        "nul": spark.createDataFrame([(None, 1), (2, 2)], "x int, y int"),
        "text": spark.createDataFrame([("a",), ("b",)], "s string"),
        "empty": spark.createDataFrame([], "x int"),
        "wide": spark.createDataFrame([(-2**63, 1), (2**63 - 1, 1)], "x bigint, y bigint"),
    }
    slow = profile.choose_keys(profile.key_profile(tables))
    fast = profile.discover_keys(tables)
    want = {("dup", 2, "y"), ("nul", 2, "y"), ("wide", 1, "x")}
    assert {tuple(r) for r in slow.collect()} == want
    assert {tuple(r) for r in fast.collect()} == want


def test_row_counts_include_empty_tables(spark):
    counts = profile.row_counts({"a": spark.range(3), "b": spark.range(0)})
    assert {tuple(r) for r in counts.collect()} == {("a", 3), ("b", 0)}


def test_null_compaction(spark):
    t = spark.createDataFrame([(1, None, None), (None, None, 2)], "a int, b string, c int")
    kept = profile.null_compaction({"t": t, "e": spark.createDataFrame([], "z int")})
    assert {(r["column"], r["keep"]) for r in kept.collect()} == {("a", True), ("b", False), ("c", True), ("z", True)}
    assert profile.compact(t, kept, "t").columns == ["a", "c"]


def test_evidence_prefilter_changes_nothing(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    with_prefilter = {r["kind"]: r["matched"] for r in profile.pii_evidence({"d": texts}).collect()}
    plain = texts.agg(*[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in profile.EVIDENCE.items()]).first()
    assert with_prefilter == plain.asDict()


def test_evidence_raises_the_risk(spark, catalog):
    columns = catalog({"s.t": "id* memo blob"})
    seen = spark.createDataFrame([("t", "blob", "email", 10, 9), ("t", "memo", "ipv4", 10, 5), ("t", "id", "card", 100, 1)],
                                 "`table` string, `column` string, kind string, filled bigint, matched bigint")
    risks = {r["column"]: r["pii_risk"] for r in profile.classify(columns, seen).collect()}
    assert risks == {"id": "none", "memo": "medium", "blob": "high"}


def test_every_request_is_audited_once(spark, tables, tmp_path, monkeypatch):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "audit", "checkpoint"))
    known, asked = [tables("s.a")], "request_id int, schema string, `table` string, limit int"

    def arrive(*rows):
        spark.createDataFrame(rows, asked).coalesce(1).write.mode("append").parquet(source)

    def run(decide=lambda batch: sampling.adjudicate(batch, known[-1]), where=checkpoint):
        audit.audit_batches(spark.readStream.schema(asked).parquet(source), decide, sink, where).awaitTermination()

    def records():
        return sorted((r.request_id, r.outcome) for r in audit.read_audit(spark, sink).collect())

    assert audit.read_audit(spark, sink) is None
    arrive((1, "s", "a", 5), (2, "s", "b", 5))
    run(lambda batch: sampling.adjudicate(batch, known[-1]).withColumn("rows", F.array(F.lit("content"))))
    assert records() == [(1, "ok"), (2, "rejected_unknown_table")] and "rows" not in audit.read_audit(spark, sink).columns
    # Lost before it is published: no trace, and decided by the tables of the restart.
    arrive((3, "s", "b", 5))
    with pytest.raises(StreamingQueryException):
        run(lambda batch: sampling.adjudicate(batch, known[-1]).withColumn("tool", F.raise_error("lost")))
    assert len(records()) == 2
    known.append(tables("s.a", "s.b"))
    run()
    assert records()[2:] == [(3, "ok")]
    # Lost after it is published, before Spark notes it: passed over, though the tables changed.
    publish = audit._Files.publish

    def publish_and_fail(files, number, content):
        publish(files, number, content)
        raise RuntimeError("lost")

    arrive((4, "s", "b", 5), (5, "s", "a", 21))
    with monkeypatch.context() as m:
        m.setattr(audit._Files, "publish", publish_and_fail)
        with pytest.raises(StreamingQueryException):
            run()
    known.append(tables("s.z"))
    before = records()
    assert before[3:] == [(4, "ok"), (5, "rejected_cap")]
    run()
    assert records() == before
    arrive((6, "s", "z", 1))
    run()
    assert records() == [*before, (6, "ok")]
    # Another stream audits to the same place from the start.
    run(where=str(tmp_path / "other"))
    assert len(records()) == 12
