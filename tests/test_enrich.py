import json

import pytest
from conftest import plan_of

from cartolake.operators import enrich, judge
from cartolake.plans import answers

LAYOUT = {"s.users": "user_id* email", "s.orders": "order_id* user_id"}


def good(*names, **changes):
    columns = [{"name": n, "description": f"The {n}", "semantic_type": "other", "pii_risk": "none", "confidence": 0.5}
               for n in names]
    return {"description": "D", "grain": "G", "domain_hints": ["h"], "columns": columns, "confidence": 0.9, **changes}


def verdict(spark, columns, raw, table="users"):
    raw = raw if isinstance(raw, str) else json.dumps(raw)
    responses = spark.createDataFrame([("s", table, 0, raw)], "schema string, `table` string, part int, raw string")
    parsed = enrich.parse_descriptions(responses, columns)
    row = parsed.verdicts.first()
    return row["reason"], parsed


def changed(field, value, column=0):
    doc = good("user_id", "email")
    if value is None and field.endswith("!"):
        doc["columns"][column].pop(field[:-1])
    else:
        doc["columns"][column][field] = value
    return doc


def without(field):
    doc = good("user_id", "email")
    doc.pop(field)
    return doc


CASES = [
    ("plain", good("user_id", "email"), None),
    ("fenced", "```json\n" + json.dumps(good("user_id", "email")) + "\n```  ", None),
    ("fenced without tag", "  ```\n" + json.dumps(good("user_id", "email"), indent=1) + "\n```", None),
    ("fence inside prose", "Here:\n```json\n{}\n```", "bad_json"),
    ("prose", "I cannot do that.", "bad_json"),
    ("cut off", json.dumps(good("user_id", "email"))[:-5], "bad_json"),
    ("trailing text", json.dumps(good("user_id", "email")) + " done", "bad_json"),
    ("two documents", json.dumps(good("user_id", "email")) * 2, "bad_json"),
    ("two in a row", json.dumps(good("user_id", "email")) + ",{}", "bad_json"),
    ("stray bracket", json.dumps(good("user_id", "email")) + "] x", "bad_json"),
    ("stray brace", json.dumps(good("user_id", "email")) + "} x", "bad_json"),
    ("empty", "", "bad_json"),
    ("surrounding space", " \n" + json.dumps(good("user_id", "email")) + "\n ", None),
    ("repeated key", json.dumps(good("user_id", "email"))[:-1] + ',"confidence":"high"}', "bad_number"),
    ("array", "[1]", "missing_field"),
    ("null", "null", "missing_field"),
    ("number", "3", "missing_field"),
    ("no columns", without("columns"), "missing_field"),
    ("too few", good("user_id"), "column_count"),
    ("too many", good("user_id", "email", "x"), "column_count"),
    ("swapped", good("email", "user_id"), "column_name"),
    ("other case", good("USER_ID", "email"), "column_name"),
    ("name not text", changed("name", 5), "column_name"),
    ("column not object", good("user_id", "email", columns=["user_id", "email"]), "missing_field"),
    ("no column description", changed("description!", None), "missing_field"),
    ("null column description", changed("description", None), None),
    ("bad type", changed("semantic_type", "key"), "bad_enum"),
    ("bad risk", changed("pii_risk", "PII"), "bad_enum"),
    ("null risk", changed("pii_risk", None), "bad_enum"),
    ("text confidence", changed("confidence", "high"), "bad_number"),
    ("numeric text confidence", changed("confidence", " 0.5 "), None),
    ("java-only number", changed("confidence", "1.0f"), "bad_number"),
    ("null confidence", changed("confidence", None), "bad_number"),
    ("no column confidence", changed("confidence!", None), "missing_field"),
    ("boolean confidence", changed("confidence", True), None),
    ("no table description", without("description"), "missing_field"),
    ("no grain", without("grain"), "missing_field"),
    ("no hints", without("domain_hints"), None),
    ("null hints", good("user_id", "email", domain_hints=None), "bad_hints"),
    ("number hints", good("user_id", "email", domain_hints=3), "bad_hints"),
    ("no confidence", without("confidence"), "missing_field"),
    ("table confidence text", good("user_id", "email", confidence="high"), "bad_number"),
    ("table confidence list", good("user_id", "email", confidence=[1]), "bad_number"),
]


def test_parse_cases(spark, catalog):
    # One response per case, each for its own schema, so that one job checks all of them.
    columns = catalog({f"c{i}.users": "user_id* email" for i in range(len(CASES))})
    rows = [(f"c{i}", "users", 0, raw if isinstance(raw, str) else json.dumps(raw)) for i, (_, raw, _) in enumerate(CASES)]
    responses = spark.createDataFrame(rows, "schema string, `table` string, part int, raw string")
    parsed = enrich.parse_descriptions(responses, columns)
    got = {r["schema"]: r["reason"] for r in parsed.verdicts.collect()}
    assert {CASES[int(s[1:])][0]: r for s, r in got.items()} == {name: reason for name, _, reason in CASES}
    accepted = {r["schema"] for r in parsed.table_descriptions.collect()}
    assert accepted == {s for s, r in got.items() if r is None}
    assert parsed.column_descriptions.count() == 2 * len(accepted)


def test_parsed_values(spark, catalog):
    reason, parsed = verdict(spark, catalog(LAYOUT), changed("confidence", "0.25", 1))
    assert reason is None
    assert tuple(parsed.table_descriptions.first())[3:] == ("D", "G", ["h"], 0.9)
    assert {r["column"]: r["confidence"] for r in parsed.column_descriptions.collect()} == {
        "user_id": 0.5, "email": 0.25}


def test_first_error_in_column_order_wins(spark, catalog):
    doc = good("user_id", "email")
    doc["columns"][0]["confidence"] = "x"
    doc["columns"][1]["name"] = "nope"
    doc["confidence"] = "y"
    assert verdict(spark, catalog(LAYOUT), doc)[0] == "bad_number"


def test_raw_start_is_kept_on_failure(spark, catalog):
    _, parsed = verdict(spark, catalog(LAYOUT), "x" * 900)
    assert len(parsed.verdicts.first()["raw_start"]) == 500


def test_wide_tables_are_split_and_come_back_whole(spark, catalog):
    columns = catalog({"s.wide": " ".join(f"c{i}" for i in range(25))})
    prompts = enrich.table_prompts(columns, part_size=10)
    assert sorted((r["part"], r["n_columns"]) for r in prompts.collect()) == [(0, 10), (1, 10), (2, 5)]
    assert prompts.filter("is_wide").count() == 0
    td, cd, events = enrich.describe_tables(columns, answers.offline_model(), part_size=10, backoff=0.0)
    assert cd.count() == 25 and td.first()["description"] == "Rows about wide"
    assert {r["event"] for r in events.collect()} == {"ok"}


def test_prompt_content(spark, catalog):
    wide = " ".join(["k*"] + [f"c{i}" for i in range(29)])
    columns = catalog({"s.users": "user_id* email", "s.wide": wide})
    rows = spark.createDataFrame([(1, None), (2, None)], "user_id int, email string")
    samples = enrich.samples_block(rows, "s", "users")
    prompts = {r["table"]: r for r in enrich.table_prompts(columns, samples).collect()}
    text = prompts["users"]["prompt"]
    assert "Table: s.users\n" in text
    assert "  - user_id: int, nullable=false, pk=true\n  - email: int, nullable=true, pk=false\n" in text
    assert '[{"user_id":1},{"user_id":2}]' in text and "without 1 empty columns" in text
    assert enrich.WIDTH_GUIDANCE not in text
    assert prompts["wide"]["is_wide"] and enrich.WIDTH_GUIDANCE in prompts["wide"]["prompt"]


def scripted(folder, script):
    """A model with a list of behaviours per table, one per call; calls are counted in files, tasks being processes."""
    import re
    from pathlib import Path
    folder, answer = str(folder), answers.offline_model()

    def model(prompt):
        table = re.search(r"^Table: \S*\.(\S+)$", prompt, re.M).group(1)
        calls = Path(folder) / table
        n = len(calls.read_text()) if calls.exists() else 0
        calls.write_text("x" * (n + 1))
        plan = script.get(table, ["good"])
        step = plan[min(n, len(plan) - 1)]
        if step == "raise":
            raise RuntimeError("provider down")
        return answer(prompt) if step == "good" else "not json"
    return model


def test_describe_outcomes(spark, catalog, tmp_path):
    names = ["fine", "second", "hopeless", "down", "late", "mixed"]
    columns = catalog({f"s.{n}": "id* x" for n in names})
    model = scripted(tmp_path, {"second": ["bad", "good"], "hopeless": ["bad"], "down": ["raise"],
                             "late": ["raise", "raise", "good"], "mixed": ["bad", "raise", "bad", "good"]})
    td, cd, events = enrich.describe_tables(columns, model, backoff=0.0, parallelism=2)
    got = {r["table"]: (r["event"], r["error_reason"]) for r in events.collect()}
    assert got == {"fine": ("ok", None), "second": ("parse_retry", None), "hopeless": ("failed", "bad_json"),
                   "down": ("provider_error", "RuntimeError: provider down"), "late": ("ok", None),
                   "mixed": ("parse_retry", None)}
    assert {r["table"]: r["description"] is not None for r in td.collect()} == {
        "fine": True, "second": True, "hopeless": False, "down": False, "late": True, "mixed": True}
    assert cd.count() == 8
    assert [len((tmp_path / n).read_text()) for n in names] == [1, 2, 2, 3, 3, 4]
    assert events.filter("elapsed_ms is null or elapsed_ms < 0").count() == 0
    summary = enrich.scan_summary(events).first()
    assert (summary["total"], summary["ok"], summary["failed"], summary["provider_errors"]) == (6, 4, 2, 1)
    assert {r["table"] for r in enrich.failed_tables(events).collect()} == {"hopeless", "down"}


def test_generate_retries_and_isolates(spark, tmp_path):
    model = scripted(tmp_path, {"a": ["raise", "good"], "b": ["raise"]})
    prompts = spark.createDataFrame([("s", t, 0, f"Table: s.{t}\n") for t in "abc"],
                                    "schema string, `table` string, part int, prompt string")
    rows = {r["table"]: (r["outcome"], r["attempts"]) for r in enrich.generate(prompts, model, backoff=0.0).collect()}
    assert rows == {"a": ("ok", 2), "b": ("provider_error", 3), "c": ("ok", 1)}


def test_python_runs_only_where_text_is_generated(spark, catalog):
    columns = catalog(LAYOUT)
    prompts = enrich.table_prompts(columns)
    assert "MapInPandas" not in plan_of(prompts)
    assert "MapInPandas" in plan_of(enrich.generate(prompts.select(*enrich.PART_KEY, "prompt"), answers.offline_model()))


# -- judging ------------------------------------------------------------------
def judge_raw(score, reasoning='"r"'):
    return '{"accuracy":{"score":%s,"reasoning":%s},"specificity":{"score":3},"domain_inference":{"score":4,"reasoning":null}}' % (
        score, reasoning)


@pytest.mark.parametrize("raw, accuracy", [
    (judge_raw("4"), 4), (judge_raw("9"), 5), (judge_raw("-2"), 1), (judge_raw('"4"'), 4), (judge_raw('" 4 "'), 4),
    (judge_raw("4.7"), 4), (judge_raw('"4.7"'), None), (judge_raw("null"), None), (judge_raw("true"), 1),
    (judge_raw('"x"'), None), ('{"accuracy":5,"specificity":{"score":3},"domain_inference":{"score":4}}', None),
    ('{"accuracy":{"score":4}}', None), ("prose", None), ("```json\n" + judge_raw("2") + "\n```", 2),
])
def test_score_parsing(spark, raw, accuracy):
    df = spark.createDataFrame([("s", "t", raw)], "schema string, `table` string, raw string")
    row = judge.parse_scores(df).first()
    assert row["accuracy"] == accuracy and row["status"] == ("failed" if accuracy is None else "ok")
    if accuracy is not None:
        assert (row["accuracy_reasoning"], row["specificity_reasoning"], row["domain_inference_reasoning"]) == ("r", "", "")


def test_evaluate_descriptions(spark, catalog):
    columns = catalog({"s.a": "id* x", "s.b": "id* x", "s.c": "id* x"})
    td = spark.createDataFrame(
        [("s", "a", "A", "g", ["h"], 0.5), ("s", "b", None, None, None, None), ("s", "c", "C", "g", [], 0.5)],
        "schema string, `table` string, description string, grain string, domain_hints array<string>, confidence double")
    cd = spark.createDataFrame(
        [("s", "a", "id", "d", "identifier", "none", 0.5)],
        "schema string, `table` string, `column` string, description string, semantic_type string, pii_risk string, confidence double")
    seen = judge.judge_prompts(columns, td, cd).collect()
    assert {r["table"] for r in seen} == {"a", "c"}
    text = next(r["prompt"] for r in seen if r["table"] == "a")
    assert '"columns":[{"name":"id","description":"d"' in text and "Sample" not in text

    reply = judge_raw("2")

    def model(prompt):
        if "s.c" in prompt:
            raise RuntimeError("down")
        return reply
    scores, summary = judge.evaluate_descriptions(columns, td, cd, model)
    row = summary.first()
    assert (row["scored_count"], row["total_judge_failures"], row["skipped_null"], row["flagged_count"]) == (1, 1, 1, 1)
    assert row["mean_accuracy"] == 2.0
    assert [r["table"] for r in judge.flagged(scores).collect()] == ["a"]
    only = spark.createDataFrame([("s", "b")], "schema string, `table` string")
    _, summary = judge.evaluate_descriptions(columns, td, cd, model, tables=only)
    assert tuple(summary.first()) == (0, 0, 0, 0.0, 0.0, 0.0, 1)
