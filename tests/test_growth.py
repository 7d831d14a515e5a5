"""What travels must not grow faster than the rows."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from cartolake.functions.classify import pii_risk, semantic_type
from cartolake.operators import enrich, judge, keys, sampling, secrets
from cartolake.plans import answers, tenants
from cartolake.schema import COLUMNS, TABLE_KEY


def test_secrets_meet_tokens_not_all_grams_of_words(spark, monkeypatch):
    """Words that share tokens cost a row per secret's token, not a row per gram of each word."""
    written = {}
    plain = secrets.materialize

    def counted(df, label):
        stored = plain(df, label)
        written[label] = stored.count()
        return stored

    monkeypatch.setattr(secrets, "materialize", counted)
    r = random.Random(5)
    urls = [f"postgresql://user{i}:word{i}@host{i % 3}.example.com:54{i % 7}/db{i % 5}" for i in range(60)]
    lines = [f"failed at {u} for 'word{i}' {r.randint(0, 9)}" for i, u in enumerate(urls)]
    known = [(u, "<url>") for u in urls[::2]] + [(f"word{i}", "***") for i in range(60)] + [("--", "dashes"), ("://host9", "none")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, "a--b", "x---y", "--"])], "id int, t string")
    got = [x.t for x in secrets.scrub_known(rows, "t", spark.createDataFrame(known, "secret string, mask string")).orderBy("id").collect()]

    def hidden(text):
        for secret, mask in sorted(known, key=lambda k: (-len(k[0]), k[0])):
            text = text.replace(secret, mask)
        return text

    assert got == [hidden(t) for t in [*lines, "a--b", "x---y", "--"]]
    assert written["postings"] < 10 * len(urls)


def test_samples_of_a_joined_table_move_only_keys(spark):
    """Columns beside the keys are read, and so moved, for the sampled rows alone."""
    n, read = 4000, spark.sparkContext.accumulator(0)

    @F.udf("string")
    def wide(i):
        read.add(1)
        return f"row {i} " * 20

    left = spark.range(n).withColumn("wide", wide(F.col("id")))
    right = spark.range(n).select(F.col("id").alias("other_id"), (F.col("id") % 7).alias("group"))
    got = sampling.table_samples(
        spark, {("s", "t"): lambda: left.join(right, F.col("id") == F.col("other_id"))}, None, cap=5,
        key_columns={("s", "t"): ["id"]}).orderBy("rank").collect()
    first = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:5]
    assert [json.loads(r.row)["id"] for r in got] == first and [r.rank for r in got] == [1, 2, 3, 4, 5]
    assert read.value < 100


def test_judge_prompts_move_columns_once(spark):
    """One exchange for columns and their descriptions together, one for the descriptions of tables."""
    columns = spark.createDataFrame(
        [("s", "t", i, c, "int", True, False, None) for i, c in ((2, "b"), (1, "a"), (3, "b"), (4, None))], COLUMNS)
    told = spark.createDataFrame(
        [("s", "t", c, f"{c}{n}", "measure", "none") for c, n in (("b", 1), ("b", 2), (None, 3), ("z", 4))],
        "schema string, `table` string, `column` string, description string, semantic_type string, pii_risk string")
    tables = spark.createDataFrame(
        [("s", "t", "about t", "one", ["h"])], "schema string, `table` string, description string, grain string, domain_hints array<string>")
    prompts = judge.judge_prompts(columns, tables, told)
    text = prompts.first().prompt
    assert [line.split(":")[0] for line in text.split("\nSchema:\n")[1].split("\nDescription")[0].split("\n")] == ["  - a", "  - b", "  - b"]
    body = json.loads(text.split("(JSON):\n")[1].split("\n")[0])
    assert [c["description"] for c in body["columns"]] == ["b1", "b2", "b1", "b2"]
    assert prompts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_key_search_moves_digests_not_values(spark, monkeypatch):
    """Values of columns meet only where a digest repeats; a digest that differing rows share rules no key out."""
    n = 300
    rows = spark.range(n).select(F.col("id").alias("a"), F.concat(F.lit("x" * 500), (F.col("id") % 299).cast("string")).alias("b"))
    assert keys._digest(("a", "b"))._jc.toString().startswith("xxhash64")
    assert keys._unique(rows, ("a",)) and not keys._unique(rows, ("b",))
    monkeypatch.setattr(keys, "_digest", lambda columns: F.col(columns[0]) % 10)
    assert keys._unique(rows, ("a",)) and keys._unique(rows, ("a", "b"))


def test_tasks_grow_with_the_tenants(spark, monkeypatch, tmp_path):
    spark.range(90).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(tenants, "TASK_TENANTS", 3)
    found = tenants.tenant_keys(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 30 and found.count() == 90


def _tenants(spark, path):
    spark.createDataFrame([(k,) for k in [*range(60), 7, 8, 9, 9, 10, None, None]], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    return tenants.Tenants(spark, str(path))


def test_answers_are_written_where_the_tenants_are(spark, tmp_path):
    """No exchange but that of the tenants' keys; repeated and null keys give the answers that grouped columns give."""
    t, k, first = _tenants(spark, tmp_path), F.col("k"), F.col("ordinal") == 1
    layout = t._layout().withColumnRenamed("underlying", "data_type")
    made = F.concat(
        F.lit('{"name":"'), F.when((k % 8 == 2) & first, "swapped").otherwise(F.col("column")), F.lit('","description":"The '), "column",
        F.lit('","semantic_type":"'), semantic_type(), F.lit('","pii_risk":"'), F.when((k % 8 == 3) & first, "PII").otherwise(pii_risk()),
        F.lit('","confidence":'), F.when(k % 8 == 5, '"0.5"').otherwise("0.5"), F.lit("}"))
    entries = layout.withColumn("object", made).groupBy("k", *TABLE_KEY).agg(F.sort_array(F.collect_list(F.struct("ordinal", "object"))).alias("e"))
    want = {(r.k, r.table): [e["object"] for e in r.e][:len(r.e) - (r.k is not None and r.k % 8 == 1)] for r in entries.collect()}
    documents = answers._documents(t)
    assert documents._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.k, r.table): r.text.split('"columns":[')[1].rsplit('],"confidence":', 1)[0] for r in documents.collect()}
    assert len(got) == documents.count() and got == {key: ",".join(e) for key, e in want.items()}


def test_answers_are_looked_at_as_a_whole_first(spark, tmp_path, monkeypatch):
    """A whole list is told to be right by its type and values; a closer look gives the same, and the fence is read once."""
    t = _tenants(spark, tmp_path)

    def read():
        parsed = enrich.parse_descriptions(answers.first_answers(t), t.columns())
        plan = parsed.verdicts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") == 1
        return [sorted(map(str, df.collect())) for df in (parsed.verdicts, parsed.table_descriptions, parsed.column_descriptions)]

    got = read()
    assert any("status='ok'" in r for r in got[0]) and any("bad_enum" in r for r in got[0])
    plain, seen = enrich._sound, []
    monkeypatch.setattr(enrich, "_sound", lambda *of: seen.append(of) or plain(*of) & False)
    assert read() == got and seen
