"""Whole runs: resumed descriptions, answered samples, many needles, versions, discovered keys, containment."""

from __future__ import annotations

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cartolake.functions.dsn import scrub_dsn
from cartolake.operators import containment, keys, profile, resume, sampling, search, secrets
from cartolake.sources import bundle, versions
from conftest import plan_of


# -- resumable descriptions ---------------------------------------------------
def flaky(broken=(), prose=(), cut=()):
    """A model that fails by table; built here so that it ships to the workers by value."""
    def answer(prompt):
        table = prompt.split("Table: s.")[1].split("\n")[0]
        if table in broken:
            raise TimeoutError(table)
        if table in prose:
            return "no idea"
        names = [line[4:].split(":")[0] for line in prompt.splitlines() if line.startswith("  - ")]
        text = json.dumps({"description": "d", "grain": "g", "domain_hints": [], "confidence": 1, "columns": [
            {"name": n, "description": "x", "semantic_type": "other", "pii_risk": "none", "confidence": 1} for n in names]})
        return text[:-5] if table in cut and "could not be read" not in prompt else text
    return answer


def run(log, columns, model="m", **flaws):
    _, described, events = resume.describe_resumable(
        columns, flaky(**flaws), log, model, attempts=2, backoff=0.0, parallelism=2, calls_per_task=2)
    return ({r.table: (r.event, r.error_reason, r.accepted_calls, r.calls) for r in events.collect()},
            {r.table for r in described.select("table").distinct().collect()})


def test_a_resumed_run_repeats_no_accepted_call(spark, catalog, tmp_path):
    columns = catalog({f"s.t{i}": "id* a b" for i in range(9)})
    log = resume.ResponseLog(spark, str(tmp_path / "log"))
    assert log.rows().count() == 0
    first, described = run(log, columns, broken=["t1", "t2"], prose=["t3"], cut=["t4"])
    assert first["t0"] == ("ok", None, 1, 1) and first["t3"] == ("failed", "bad_json", 2, 2) and first["t4"] == ("parse_retry", None, 2, 2)
    assert first["t1"] == ("provider_error", "TimeoutError: t1", 0, 2)
    assert described == {f"t{i}" for i in (0, 4, 5, 6, 7, 8)}
    before = log.rows().count()
    second, described = run(log, columns, broken=["t2"], prose=["t3"], cut=["t4"])
    # Only t1 and t2 are asked: one answer, two errors.
    assert log.rows().count() == before + 3
    assert second["t1"] == ("ok", None, 1, 3) and second["t2"][:1] + second["t2"][2:] == ("provider_error", 0, 4)
    assert second["t3"] == first["t3"] and "t1" in described
    run(log, columns)
    done = log.rows().count()
    third, _ = run(log, columns, broken=[f"t{i}" for i in range(9)])
    assert log.rows().count() == done and third["t2"][0] == "ok"
    # Another model, or a prompt that changed, is another call.
    run(log, columns, model="other")
    assert log.rows().filter("model = 'other' and outcome = 'ok' and request = 1").count() == 9
    changed = columns.withColumn("data_type", F.when(F.col("table") == "t0", "bigint").otherwise(F.col("data_type")))
    run(log, changed)
    assert log.rows().filter("model = 'm' and outcome = 'ok' and `table` = 't0'").count() == 2


def test_prompts_are_written_once_and_answers_read_once(spark, catalog, tmp_path, monkeypatch):
    """While no call has an answer its prompt is not copied; results come from what was read of the answers, not from reading them anew."""
    columns, log, labels = catalog({f"s.t{i}": "id* a" for i in range(6)}), resume.ResponseLog(spark, str(tmp_path / "log")), []
    plain = resume.materialize
    monkeypatch.setattr(resume, "materialize", lambda df, label: labels.append(label) or plain(df, label))

    def described(**flaws):
        labels.clear()
        tables, rows, _ = resume.describe_resumable(
            columns, flaky(**flaws), log, "m", attempts=1, backoff=0.0, parallelism=2, calls_per_task=2)
        assert all("parse_json" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (tables, rows))
        return {r.table for r in rows.collect()}

    assert described(broken=["t1"]) == {f"t{i}" for i in (0, 2, 3, 4, 5)}
    # The reminders, none of which is open, are looked for in the log.
    assert labels.count("prompts") == 1 and labels.count("pending") == 1
    assert described() == {f"t{i}" for i in range(6)} and log.rows().count() == 7


def test_answers_of_finished_tasks_outlive_a_failed_job(spark, tmp_path):
    log = resume.ResponseLog(spark, str(tmp_path / "log"))
    good = spark.createDataFrame([("s", "t", 0, 1, "h", "m", "raw", "ok", None, 1)], resume.LOG).toPandas()

    def answered(batches):
        import time

        for batch in batches:
            if 1 in set(batch["id"]):
                time.sleep(6)
                raise RuntimeError("lost")
            yield good

    # Two tasks side by side: one ends, the other fails later.
    with pytest.raises(Exception, match="lost"):
        log.append(spark.range(0, 2, 1, 2).mapInPandas(answered, resume.LOG))
    assert log.accepted().count() == 1


def test_merge_of_descriptions(spark):
    tables = "schema string, `table` string, description string"
    current = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "new"), ("s", "failed")], "schema string, `table` string")
    stored = spark.createDataFrame([("s", "a", "1"), ("s", "b", "1"), ("s", "gone", "1"), ("s", "failed", "1")], tables)
    stale = spark.createDataFrame([("s", "b"), ("s", "new"), ("s", "failed")], "schema string, `table` string")
    new = spark.createDataFrame([("s", "b", "2"), ("s", "new", "2"), ("s", "failed", None), ("s", "a", "ignored")], tables)
    column = tables + ", `column` string"
    old_columns = spark.createDataFrame([("s", "a", "1", "x"), ("s", "b", "1", "x"), ("s", "failed", "1", "x")], column)
    new_columns = spark.createDataFrame([("s", "b", "2", "x"), ("s", "b", "2", "y"), ("s", "new", "2", "x")], column)
    merged, columns = resume.merge_descriptions(current, stored, old_columns, stale, new, new_columns)
    assert {(r.table, r.description) for r in merged.collect()} == {("a", "1"), ("b", "2"), ("new", "2"), ("failed", None)}
    assert sorted((r.table, r.description, r.column) for r in columns.collect()) == [("a", "1", "x"), ("b", "2", "x"), ("b", "2", "y"), ("new", "2", "x")]


def test_a_slice_reads_its_own_prompts_and_cores_bound_rounds_of_tasks(spark, tmp_path, monkeypatch):
    prompts = spark.range(400).select(F.lit("s").alias("schema"), F.format_string("t%d", "id").alias("table"), F.lit(0).alias("part"),
                                      F.format_string("Table: s.t%d\n  - id: int", "id").alias("prompt"))
    spans = [resume._share(i, 7) for i in range(7)]
    assert spans[0][0] == -(1 << 63) and spans[-1][1] == (1 << 63) - 1 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    asked, plain = [], resume.enrich.generate

    def generate(part, fn, **how):
        asked.append((plan_of(part), part.count(), how["parallelism"]))
        return plain(part, fn, **how)

    monkeypatch.setattr(resume.enrich, "generate", generate)
    # (parallelism, calls per task): slices of so many tasks; four cores bound four calls by themselves.
    for parallelism, calls_per_task, jobs, tasks in ((2, 10, 20, 2), (4, 10, 10, 4), (40, 400, 1, 40), (4, 2, resume.ROUNDS, 13)):
        log = resume.ResponseLog(spark, str(tmp_path / f"{parallelism}-{calls_per_task}"))
        asked.clear()
        n = resume.ask(resume.calls(prompts, 1, "m"), flaky(), log, attempts=1, parallelism=parallelism, calls_per_task=calls_per_task).count()
        assert n == 400 and len(asked) == jobs and sum(a[1] for a in asked) == 400 and {a[2] for a in asked} == {tasks}
        # The filter reaches the files, where the prompts lie in its order.
        assert jobs == 1 or all("GreaterThanOrEqual(at," in a[0] for a in asked)


# -- samples ------------------------------------------------------------------
def test_sample_requests(spark, tmp_path):
    people = spark.createDataFrame([(i, f"name {i}", i % 3) for i in range(50)], "id long, full_name string, kind int").repartition(4)
    few = spark.createDataFrame([(1, "x"), (2, "y")], "id long, note string")
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"no parquet at all, but long enough to be opened")
    tables = {("s", "people"): lambda: people, ("s", "few"): lambda: few, ("s", "none"): lambda: few.limit(0),
              ("s", "missing"): lambda: spark.read.parquet(str(tmp_path / "nothing")),
              ("s", "bad"): lambda: spark.read.schema("id long").parquet(str(bad))}
    described = spark.createDataFrame([("s", "people", "full_name", "high"), ("s", "people", "kind", "low")],
                                      "schema string, `table` string, `column` string, pii_risk string")
    samples = sampling.table_samples(spark, tables, described)
    assert {r.table for r in samples.filter("error is not null").collect()} == {"missing", "bad"}
    known = spark.createDataFrame([(s, t, None) for s, t in tables], "schema string, `table` string, row_count bigint")
    asked = [(1, "people", 3), (2, "people", None), (3, "people", 20), (4, "people", 21), (5, "people", 0), (6, "few", 20),
             (7, "none", 5), (8, "missing", 5), (9, "bad", 5), (10, "unknown", 5), (11, "missing", 99)]
    requests = spark.createDataFrame([(i, "s", t, n) for i, t, n in asked], "request_id int, schema string, `table` string, limit int")
    got = {r.request_id: r for r in sampling.sample_requests(requests, known, samples).collect()}
    assert {i: r.outcome for i, r in got.items()} == {
        1: "ok", 2: "ok", 3: "ok", 4: "rejected_cap", 5: "rejected_invalid_limit", 6: "ok", 7: "ok", 8: "db_error", 9: "db_error",
        10: "rejected_unknown_table", 11: "rejected_cap"}
    assert [got[i].rows_returned for i in (1, 2, 3, 6, 7)] == [3, 5, 20, 2, 0]
    assert all(got[i].rows is None and got[i].rows_returned is None and got[i].limit_effective is None for i in (4, 5, 8, 9, 10, 11))
    assert got[1].rows == got[3].rows[:3] and got[2].rows == got[3].rows[:5]
    rows = [json.loads(r) for r in got[3].rows]
    assert all(r["full_name"] is None and r["kind"] == r["id"] % 3 for r in rows) and len({r["id"] for r in rows}) == 20
    # The sample is a function of the rows, not of their storage.
    again = sampling.table_samples(spark, {("s", "people"): lambda: people.repartition(7)}, described)
    assert [r.row for r in again.orderBy("rank").collect()] == got[3].rows
    # All columns pass where personal data are allowed.
    free = sampling.table_samples(spark, {("s", "few"): lambda: few}, None, allow_pii=True, cap=1, key_columns={("s", "few"): ["id"]})
    assert json.loads(free.first().row)["note"] in "xy"


# -- search -------------------------------------------------------------------
def test_many_needles_equal_direct_search(spark):
    rng = random.Random(7)
    words = ["order", "orders", "customer key", "naïve", "a", "ab", "x_y", "100%", "Total Price", "zz"]
    rows = [("s", f"t{i % 23}", rng.randint(0, 2), " ".join(rng.choices(words, k=rng.randint(1, 4))).lower()) for i in range(300)]
    texts = spark.createDataFrame(rows, "schema string, `table` string, tier int, text string")
    asked = [(1, "ORDER"), (2, "a"), (3, "ab"), (4, "key"), (5, "qqq"), (6, ""), (7, None), (8, "ïve"), (9, "0%"), (10, "r c"),
             (11, "order"), (12, "total price"), (13, "xyzabc"), (14, "_"), (15, "orderx")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = search.search(texts, [(i, q) for i, q in asked if q], limit=7)
    got = search.search_many(texts, queries, limit=7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "ORDER" not in plan_of(got) and "total price" not in plan_of(got)
    assert search.search_many(texts, queries.limit(0)).collect() == []
    assert search.search_many(texts.limit(0), queries).collect() == []


def test_places_of_a_shared_text_are_ranked_before_needles_meet_them(spark):
    # One table has a text in many places and tiers; a needle must still find the tables behind it.
    rows = [("s", "t0", tier, "shared name") for tier in (0, 1, 2) for _ in range(5)]
    rows += [("s", f"t{i}", 2, "shared name") for i in range(1, 9)] + [("s", "t5", 1, "a name"), (None, "t9", 2, "shared name")]
    texts = spark.createDataFrame(rows, "schema string, `table` string, tier int, text string").repartition(3)
    asked = [(1, "name"), (2, "shared"), (3, "a n")]
    for limit in (0, 1, 3, 50):
        got = search.search_many(texts, spark.createDataFrame(asked, "query_id int, query string"), limit=limit)
        assert sorted(map(str, got.collect())) == sorted(map(str, search.search(texts, asked, limit=limit).collect()))
    # Cut per text where the texts are read, before the needles are joined.
    plan = plan_of(search.search_many(texts, spark.createDataFrame(asked, "query_id int, query string"), limit=3))
    assert "WindowGroupLimit" in plan and "dense_rank(tier" in plan


# -- keys ---------------------------------------------------------------------
def brute_keys(rows, names, most):
    found = []
    for size in range(1, most + 1):
        for columns in combinations(range(len(names)), size):
            if any(set(k) <= set(columns) for k in found) or any(r[i] is None for r in rows for i in columns):
                continue
            if rows and len({tuple(r[i] for i in columns) for r in rows}) == len(rows):
                found.append(columns)
    return {tuple(names[i] for i in k) for k in found}


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 12), rng.choice("abcdef"), rng.randint(0, 9), i // 2, rng.choice([1, 1, 1, None]), 1.5) for i in range(60)]
    names = ["p", "q", "r", "half", "holes", "price"]
    df = spark.createDataFrame(rows, "p int, q string, r long, half int, holes int, price double").repartition(3)
    got, n = keys.minimal_keys(df)
    assert n == 60 and set(got) == brute_keys(rows, names[:5], 3)


@pytest.mark.parametrize("look", [1 << 20, 40])
def test_keys_of_any_number_of_columns_are_found(spark, monkeypatch, look):
    """Every set of columns counts, whole, also where a first look sees a share of the rows only."""
    monkeypatch.setattr(keys, "LOOK", look)
    rows = [((i >> 3) & 3, (i >> 1) & 3, i & 1, i >> 5, "x") for i in range(128)]
    names = ["a", "b", "digest", "d", "same"]
    df = spark.createDataFrame(rows, "a int, b int, digest int, d int, same string").repartition(3)
    got, n = keys.minimal_keys(df)
    assert n == 128 and got == [("a", "b", "digest", "d")] and set(got) == brute_keys(rows, names, 5)


def test_one_repeat_is_enough(spark, monkeypatch):
    """A set that nearly identifies rows is no key; a table with a repeated row has none."""
    monkeypatch.setattr(keys, "LOOK", 5000)
    rng = random.Random(1)
    rows = [(i, i % 50, rng.choice("ab"), rng.randint(0, 400), i // 2) for i in range(4000)]
    rows[17] = (rows[3901][0], *rows[17][1:])
    kinds, names = "a int, b int, c string, d int, e int", ["a", "b", "c", "d", "e"]
    assert set(keys.minimal_keys(spark.createDataFrame(rows, kinds))[0]) == brute_keys(rows, names, 5)
    assert keys.minimal_keys(spark.createDataFrame([*rows, rows[5]], kinds)) == ([], 4001)


def test_keys_of_small_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert keys.minimal_keys(empty) == ([], 0)
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string")
    assert keys.minimal_keys(twice) == ([], 2)
    text = spark.createDataFrame([("a", "b\x00c"), ("a\x00b", "c")], "a string, b string")
    found = keys.discover_composite_keys(spark, {"t": text, "none": empty, "only": spark.createDataFrame([(1.5,)], "x double")})
    assert sorted((r.table, *r.columns) for r in found.collect()) == [("t", "a"), ("t", "b")]
    assert [tuple(r.columns) for r in keys.primary_keys(found).collect()] == [("a",)]


# -- containment --------------------------------------------------------------
def test_containment_of_all_pairs(spark):
    tables = {
        "a": spark.createDataFrame([(i % 40, f"k{i}", None) for i in range(400)], "id int, code string, empty int"),
        "b": spark.createDataFrame([(float(i), f"k{i}") for i in range(30)], "id double, code string"),
        "c": spark.range(0, 20).select(F.col("id").cast("decimal(10,2)").alias("id"), F.lit("x" * 100).alias("code")),
        "d": spark.createDataFrame([("x" * 100,), ("x" * 99,)], "code string")}
    ends = [("a", "id", "b", "id"), ("a", "id", "c", "id"), ("c", "id", "a", "id"), ("a", "code", "b", "code"),
            ("d", "code", "c", "code"), ("a", "empty", "b", "id"), ("b", "id", "c", "id")]
    pairs = spark.createDataFrame([("m", s, x, "m", t, y) for s, x, t, y in ends] * 2,
                                  "source_schema string, source_table string, source_column string, target_schema string, "
                                  "target_table string, target_column string")
    got = {(r.source_table, r.source_column, r.target_table): (r.n_values, r.n_found) for r in containment.contained(pairs, tables).collect()}
    assert got == {("a", "id", "b"): (40, 30), ("a", "id", "c"): (40, 20), ("c", "id", "a"): (20, 20), ("a", "code", "b"): (400, 30),
                   ("d", "code", "c"): (2, 1), ("a", "empty", "b"): (0, 0), ("b", "id", "c"): (30, 20)}
    half = containment.contained(pairs, tables, least=0.6)
    assert {(r.source_table, r.target_table) for r in half.collect()} == {("a", "b"), ("c", "a"), ("b", "c")}


# -- versions -----------------------------------------------------------------
def small_bundle(spark, tables):
    from cartolake import schema as S
    rows = [("s", t) for t in tables]
    return bundle.Bundle(
        tables=spark.createDataFrame([(*r, 1) for r in rows], S.TABLES),
        columns=spark.createDataFrame([(*r, 1, "id", "int", False, True, None) for r in rows], S.COLUMNS),
        table_descriptions=spark.createDataFrame([(*r, "d", "g", [], 1.0) for r in rows], S.TABLE_DESCRIPTIONS),
        column_descriptions=spark.createDataFrame([(*r, "id", "d", "other", "none", 1.0) for r in rows], S.COLUMN_DESCRIPTIONS),
        relationships=spark.createDataFrame([], S.RELATIONSHIPS), meta=bundle.make_meta(spark, "files", "db"))


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert versions.read_version(spark, path) is None and versions.versions(spark, path) == []
    assert versions.write_version(small_bundle(spark, ["a"]), path) == 1
    reader = versions.read_version(spark, path)
    assert versions.write_version(small_bundle(spark, ["a", "b"]), path, after=1) == 2
    assert [r.table for r in reader.tables.collect()] == ["a"]
    assert versions.read_version(spark, path).tables.count() == 2 and versions.read_version(spark, path, 1).tables.count() == 1
    assert versions.read_version(spark, path, 9) is None
    with pytest.raises(versions.PublishConflict):
        versions.write_version(small_bundle(spark, ["c"]), path, after=1)
    assert versions.versions(spark, path) == [1, 2] and versions.read_version(spark, path).tables.count() == 2
    # A version that is written but not published is seen by nobody.
    small_bundle(spark, ["z"]).tables.write.parquet(f"{path}/v-unpublished/tables")
    assert versions.read_version(spark, path).tables.count() == 2
    versions.write_version(small_bundle(spark, ["a"]), path)
    assert versions.drop_versions(spark, path, keep=1) == [1, 2] and versions.versions(spark, path) == [3]
    with pytest.raises(ValueError):
        versions.drop_versions(spark, path, keep=0)


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "catalog")
    files = versions._Files(spark, path)
    files.publish(1, {"folder": "x", "schema_version": 1})
    with pytest.raises(versions.PublishConflict):
        files.publish(1, {"folder": "y", "schema_version": 1})
    assert files.manifest(1)["folder"] == "x"


@pytest.mark.parametrize("damage,error", [
    ("shape", bundle.BundleIntegrityError), ("type", bundle.BundleIntegrityError), ("gone", bundle.BundleIntegrityError),
    ("meta", bundle.BundleIntegrityError), ("version", bundle.BundleVersionError), ("orphan", bundle.BundleIntegrityError),
    ("json", bundle.BundleIntegrityError)])
def test_wrong_shapes_raise(spark, tmp_path, damage, error):
    import shutil
    path = tmp_path / "catalog"
    good = small_bundle(spark, ["a"])
    if damage == "orphan":
        good = bundle.Bundle(**{**good.__dict__, "tables": small_bundle(spark, ["a", "b"]).tables})
    versions.write_version(good, str(path))
    manifest = path / "_published" / "000000000001.json"
    folder = path / json.loads(manifest.read_text())["folder"]
    if damage in ("shape", "type"):
        new = good.columns.drop("data_type") if damage == "shape" else good.columns.withColumn("ordinal", F.col("ordinal").cast("string"))
        new.write.mode("overwrite").parquet(str(folder / "columns"))
    elif damage == "gone":
        shutil.rmtree(folder / "relationships")
    elif damage == "meta":
        good.meta.limit(0).write.mode("overwrite").parquet(str(folder / "meta"))
    elif damage == "version":
        (path / "_published" / ".000000000001.json.crc").unlink(missing_ok=True)
        manifest.write_text(json.dumps({"folder": folder.name, "schema_version": 2}))
    elif damage == "json":
        (path / "_published" / ".000000000001.json.crc").unlink(missing_ok=True)
        manifest.write_text("{")
    with pytest.raises(error):
        versions.read_version(spark, str(path))


def test_mail_evidence_in_long_runs(spark):
    from cartolake.operators import profile

    texts = ["a" * 300_000 + " @", "x" * 300_000 + "@host.org", "me@host.org", "@host.org", "me@host", "me@ host.org", None]
    table = {"t": spark.createDataFrame([(t,) for t in texts], "note string")}
    found = {r.kind: r.matched for r in profile.pii_evidence(table).collect()}
    pattern = profile.EVIDENCE["email"]
    assert [r[0] for r in table["t"].select(F.col("note").rlike(pattern)).collect()] == [False, True, True, False, False, False, None]
    assert found["email"] == 2


# -- one pass over a batch of tables ------------------------------------------
def test_exchanges_of_a_profile_do_not_grow_with_the_tables(spark):
    one = {"t0": spark.createDataFrame([(1, "a@b.org", None), (2, None, None)], "id int, mail string, empty string")}
    many = {f"t{i}": one["t0"] for i in range(12)} | {"none": one["t0"].limit(0).filter("false")}
    exchanges = lambda df: plan_of(df).split("(1)")[0].count("Exchange")
    for build in (profile.pii_evidence, profile.null_compaction, profile.key_profile, profile.row_counts):
        assert exchanges(build(many)) <= exchanges(build(one)) + 1, build.__name__  # one for the limit of the empty table
    found = {(r.table, r.column): (r.filled, r.matched) for r in profile.pii_evidence(many).filter("kind = 'email'").collect()}
    assert found["t7", "mail"] == (1, 1) and found["t7", "empty"] == (0, 0) == found["none", "mail"] and len(found) == 26
    kept = {(r.table, r.column): r.keep for r in profile.null_compaction(many).collect()}
    assert not kept["t3", "empty"] and kept["t3", "mail"] and kept["none", "empty"] and len(kept) == 39
    assert profile.pii_evidence({"numbers": spark.range(3)}).count() == 0


# -- many secrets -------------------------------------------------------------
def hidden(texts, known):
    """Every text with every secret it holds replaced, the longest first, one by one."""
    masks = {}
    for secret, mask in known:
        if secret and secret.strip():
            masks[secret] = min(masks.get(secret, mask or ""), mask or "")
    out = []
    for text in texts:
        found = [s for s in masks if text is not None and s in text]
        for secret in sorted(found, key=lambda s: (-len(s), s.encode())):
            text = text.replace(secret, masks[secret])
        out.append(text)
    return out


def scrubbed(spark, texts, known):
    rows = spark.createDataFrame([(i, t, f"row {i}", i * 2) for i, t in enumerate(texts)], "id int, `a text` string, row string, digest int")
    secret_rows = spark.createDataFrame(known, "secret string, mask string")
    got = secrets.scrub_known(rows.repartition(3), "a text", secret_rows)
    assert got.columns == rows.columns
    found = sorted(got.collect())
    assert [(r[0], r[2], r[3]) for r in found] == [(i, f"row {i}", i * 2) for i in range(len(texts))]
    return [r[1] for r in found]


def test_secrets_of_any_kind(spark):
    known = [("p", "1"), ("pa", "2"), ("two words", "3"), (" lead and trail ", "4"), ("x", None), ("pa", "0"), (None, "5"), ("", "6"), ("  ", "7"),
             ("\u00e9\u4e2d\U0001f600ab", "8"), ("\U0001f600", "9"), ("line\nbreak", "10"), (r"$1\\.*", r"$2"), ("longsecret1", "L"), ("longsecret12", "M")]
    texts = ["pap p", "", None, "a two  words", "a two words b", " lead and trail  lead", "xx", "a\u00e9\u4e2d\U0001f600ab\U0001f600",
             "line\nbreak line", r"as $1\\.* is", "longsecret12 longsecret1 longsecret123", "  ", "PA"] + ["equal pa"] * 5
    assert scrubbed(spark, texts, known) == hidden(texts, known)
    assert scrubbed(spark, texts, [(None, "x"), (" ", "y")]) == texts
    assert scrubbed(spark, [], known) == []


def test_secrets_across_the_blocks_of_a_long_word(spark, monkeypatch):
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abc") for _ in range(n))
    known = [(noise(n), f"<{n}>") for n in (1023, 1024, 1030, 1500, 40, 12, 9)] + [("Zq", "z")]
    long = noise(1017) + "Zq" + noise(3) + known[3][0] + noise(500) + known[5][0] + noise(4) + known[0][0] + "Zq"
    texts = [long, noise(1_000_000) + known[4][0], known[1][0], known[2][0] + known[6][0], "Zq", noise(1024)]
    assert scrubbed(spark, texts, known) == hidden(texts, known)
    # The same with both sides of each join shuffled.
    monkeypatch.setattr(secrets, "SMALL_BYTES", 0)
    assert scrubbed(spark, texts[:1] + texts[2:], known) == hidden(texts[:1] + texts[2:], known)


def test_random_secrets_equal_brute_force(spark):
    r = random.Random(7)
    word = lambda a, b: "".join(r.choice("ab :/@") for _ in range(r.randint(a, b)))
    known = [(word(1, 14), f"[{i % 5}]") for i in range(300)]
    texts = [word(0, 60) for _ in range(120)]
    assert scrubbed(spark, texts, known) == hidden(texts, known)


def test_secrets_of_connection_strings(spark):
    dsns = ["postgresql://u:p%40ss@H:5/db", "duckdb", "", None, "mysql://host/x", "pg://:only@h"]
    known = {(r.secret, r.mask) for r in secrets.known_secrets(spark.createDataFrame([(d,) for d in dsns], "dsn string")).collect()}
    assert known == {("postgresql://u:p%40ss@H:5/db", "u@h:5/db"), ("p%40ss", "***"), ("p@ss", "***"), ("mysql://host/x", "host/x"),
                     ("pg://:only@h", "h"), ("only", "***")}
    # One string and one message: what scrub_dsn says.
    row = spark.createDataFrame([("at postgresql://u:p%40ss@H:5/db: p@ss, p%40ss", dsns[0])], "message string, dsn string")
    got = secrets.scrub_known(row, "message", secrets.known_secrets(row)).first()
    assert got.message == row.select(scrub_dsn(F.col("message"), F.col("dsn"))).first()[0]


def test_progress_counts_what_the_log_holds(spark, catalog, tmp_path):
    columns = catalog({f"s.t{i}": "id* a" for i in range(9)})
    log, heard = resume.ResponseLog(spark, str(tmp_path / "log")), []

    def hear(progress):
        heard.append(progress)
        raise RuntimeError("a callback that fails")

    _, _, events = resume.describe_resumable(columns, flaky(broken=["t1"], cut=["t4"]), log, "m", attempts=2, backoff=0.0,
                                             parallelism=2, calls_per_task=2, on_progress=hear)
    first, second = ([p for p in heard if p.request == r] for r in (1, 2))
    # Three slices of nine calls, then the one that failed again; one reminder.
    assert [p.event for p in first] == ["started", "answered"] * 4 and [p.event for p in second] == ["started", "answered"]
    assert first[0] == resume.Progress("started", 1, 0, 9, 0) and first[-1] == resume.Progress("answered", 1, 8, 9, 2)
    assert second[-1] == resume.Progress("answered", 2, 1, 1, 0)
    rows = log.rows()
    assert rows.filter("outcome = 'ok'").count() == first[-1].index + second[-1].index
    assert rows.filter("outcome <> 'ok'").count() == first[-1].errors
    assert events.filter("event in ('ok', 'parse_retry')").count() == first[-1].index
