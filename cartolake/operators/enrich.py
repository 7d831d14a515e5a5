"""Batch text descriptions: prompts, generation, strict parsing, retry.

Tables wider than ``part_size`` ordinals are described in several parts, so one
prompt, one response and one group stay bounded; ordinary tables are part 0.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions import jsonvalue as J
from cartolake.functions.text import let, once, strip_fence
from cartolake.operators.sampling import DEFAULT_ROWS, json_cells
from cartolake.schema import PII_RISKS, SEMANTIC_TYPES, TABLE_KEY
from cartolake.session import materialize

WIDE_TABLE = 30
# One prompt per table of any width; a smaller part size is the caller's choice.
PART_SIZE = (1 << 31) - 1
RAW_KEPT = 500
ATTEMPTS = 3
PARALLELISM = 5
PART_KEY = [*TABLE_KEY, "part"]

INSTRUCTIONS = (
    "Describe the table and every column in business terms, using only what the names, types and "
    "sample rows support. For each column give semantic_type (identifier, dimension, measure or other) "
    "and pii_risk (none, low, medium or high), judging by the name first and the values second, and a "
    "confidence between 0 and 1."
)
ANSWER_SHAPE = (
    "Answer with one JSON object and nothing else: {\"description\", \"grain\", \"domain_hints\": [..], "
    "\"columns\": [{\"name\", \"description\", \"semantic_type\", \"pii_risk\", \"confidence\"}], "
    "\"confidence\"}. Give the columns in the order listed, one object each."
)
WIDTH_GUIDANCE = "This table is wide: describe each column in a short noun phrase.\n"
REMINDER = "The last answer could not be read. Send only the JSON object described above."


def prompt_version(*extra: str) -> str:
    """The prompt template as one text; stored as its hash next to every result."""
    return "\n".join([INSTRUCTIONS, ANSWER_SHAPE, WIDTH_GUIDANCE, REMINDER, *extra])


def prompt_hash(*extra: str) -> Column:
    return F.sha2(F.lit(prompt_version(*extra)), 256)


def _part(part_size: int) -> Column:
    return F.floor((F.col("ordinal") - 1) / part_size).cast("int").alias("part")


def _column_line() -> Column:
    flag = lambda c: F.col(c).cast("string")
    return F.concat(F.lit("  - "), "column", F.lit(": "), "data_type", F.lit(", nullable="), flag("nullable"),
                    F.lit(", pk="), flag("is_primary_key"))


def _column_lines(columns: DataFrame, part_size: int) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("ordinal", _column_line().alias("line"))))
    return columns.withColumn("part", _part(part_size)).groupBy(*PART_KEY).agg(
        F.array_join(F.transform(entries, lambda x: x["line"]), "\n").alias("lines"),
        F.count("*").alias("n_columns"))


def table_prompts(columns: DataFrame, samples: DataFrame | None = None, part_size: int = PART_SIZE) -> DataFrame:
    """One prompt per table part: (schema, table, part, n_columns, is_wide, prompt).

    ``samples`` has schema, table, samples (a JSON array as text) and
    omitted_columns (columns left out because no sampled row fills them).
    """
    lines = _column_lines(columns, part_size)
    if samples is None:
        lines = lines.withColumn("samples", F.lit("[]")).withColumn("omitted_columns", F.lit(0))
    else:
        lines = lines.join(samples.select(*TABLE_KEY, "samples", "omitted_columns"), TABLE_KEY, "left").select(
            *PART_KEY, "lines", "n_columns", F.coalesce("samples", F.lit("[]")).alias("samples"),
            F.coalesce("omitted_columns", F.lit(0)).alias("omitted_columns"))
    wide = F.col("n_columns") >= WIDE_TABLE
    note = F.when(F.col("omitted_columns") > 0, F.concat(
        F.lit(", without "), F.col("omitted_columns").cast("string"), F.lit(" empty columns"))).otherwise("")
    prompt = F.concat(
        F.lit(INSTRUCTIONS + "\n\nTable: "), "schema", F.lit("."), "table", F.lit("\nColumns:\n"), "lines",
        F.lit("\nSample rows (JSON"), note, F.lit("):\n"), "samples", F.lit("\n"),
        F.when(wide, WIDTH_GUIDANCE).otherwise(""), F.lit(ANSWER_SHAPE))
    return lines.select(*PART_KEY, "n_columns", wide.alias("is_wide"), prompt.alias("prompt"))


def _without_empty_columns() -> list[Column]:
    """``samples`` and ``omitted_columns`` of ``rows`` (an array of arrays of cells).

    Columns that no row fills are left out, unless that would leave none.
    """
    width = F.size(F.get("rows", F.lit(0)))
    filled = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists("rows", lambda r: F.get(r, i)["filled"]))
    kept = let(filled, lambda some: F.when(F.size(some) > 0, some).otherwise(F.sequence(F.lit(0), width - 1)))
    body = let(kept, lambda keep: F.transform("rows", lambda r: F.concat(
        F.lit("{"), F.array_join(F.transform(keep, lambda i: F.get(r, i)["json"]), ","), F.lit("}"))))
    some_rows = F.size("rows") > 0
    return [
        F.when(some_rows, F.concat(F.lit("["), F.array_join(body, ","), F.lit("]"))).otherwise("[]").alias("samples"),
        F.when(some_rows, width - F.size(kept)).otherwise(0).alias("omitted_columns")]


def samples_block(rows: DataFrame, schema: str, table: str) -> DataFrame:
    """The ``samples`` row of one table from its (few) sampled rows, empty columns left out.

    ``rows`` is the output of ``sample``: its size is the sampling limit.  It is
    evaluated once, for its rows may differ from one evaluation to the next.
    """
    held = rows.select(json_cells(rows.columns).alias("cells")).agg(F.collect_list("cells").alias("rows"))
    return held.select(F.lit(schema).alias("schema"), F.lit(table).alias("table"), *_without_empty_columns())


def sample_blocks(samples: DataFrame, n: int = DEFAULT_ROWS) -> DataFrame:
    """The ``samples`` rows of all tables of ``sampling.table_samples``: their first ``n`` rows, empty columns left out.

    A group is at most ``n`` rows of one table.  A table without rows, or one that
    cannot be read, has an empty list and loses no column.
    """
    held = samples.groupBy(*TABLE_KEY).agg(F.sort_array(F.collect_list(
        F.when(F.col("rank") <= n, F.struct("rank", "cells")))).alias("ranked"))
    return held.select(*TABLE_KEY, F.transform("ranked", lambda r: r["cells"]).alias("rows")).select(
        *TABLE_KEY, *_without_empty_columns())


def generate(
    prompts: DataFrame,
    fn: Callable[[str], str],
    *,
    parallelism: int = PARALLELISM,
    attempts: int = ATTEMPTS,
    backoff: float = 1.0,
) -> DataFrame:
    """Call ``fn`` once per prompt: the key columns, then raw, outcome, attempts, error, elapsed_ms.

    Concurrency is the number of partitions.  An exception is retried with
    doubling pauses and then recorded as ``provider_error``; it never fails the
    job.  Write the result before using it twice, or paid calls repeat.
    """
    keys = [f for f in prompts.schema.fields if f.name != "prompt"]
    names = [f.name for f in keys]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    results = ["raw", "outcome", "attempts", "error", "elapsed_ms"]

    def call(text: str) -> tuple:
        start = time.monotonic()
        taken = lambda: int((time.monotonic() - start) * 1000)
        for attempt in range(1, attempts + 1):
            try:
                return fn(text), "ok", attempt, None, taken()
            except Exception as exc:  # noqa: BLE001 - the provider boundary
                error = f"{type(exc).__name__}: {exc}"
            if attempt < attempts:
                time.sleep(backoff * 2 ** (attempt - 1))
        return None, "provider_error", attempts, error, taken()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [call(text) for text in batch["prompt"]]
            out = batch[names].copy()
            out[results] = pd.DataFrame(answers, index=out.index, columns=results, dtype="object")
            yield out

    return prompts.repartition(parallelism, *TABLE_KEY).mapInPandas(
        run, f"{kinds}, raw string, outcome string, attempts int, error string, elapsed_ms bigint")


# Checks on a returned column, in the order they are made.
_COLUMN_CHECKS = ("missing_field", "column_name", "missing_field", "missing_field", "bad_enum",
                  "missing_field", "bad_enum", "missing_field", "bad_number")


_COLUMN_FIELDS = ("name", "description", "semantic_type", "pii_risk")
_COLUMN_TEXTS = "array<struct<" + ", ".join(f"{n}: string" for n in _COLUMN_FIELDS) + ", confidence: double>>"
# The type of a list of columns all of whose fields that matter are texts and numbers, others left out.
_PLAIN = r"^ARRAY<OBJECT<confidence: (DECIMAL\([0-9]+,[0-9]+\)|BIGINT|DOUBLE), description: STRING, name: STRING, pii_risk: STRING, semantic_type: STRING>>$"


def _sound(shape: Column, texts: Column, expected: Column) -> Column:
    """Whether returned columns pass all checks, told by the type and the values of the whole list; others need a closer look."""
    outside = lambda n, allowed: F.size(F.array_except(texts[n], F.array(*map(F.lit, allowed)))) > 0
    blank = F.exists(texts, lambda c: c["name"].isNull() | c["description"].isNull() | c["confidence"].isNull())
    return F.coalesce(shape.rlike(_PLAIN) & (texts["name"] == expected) & ~outside("semantic_type", SEMANTIC_TYPES)
                      & ~outside("pii_risk", PII_RISKS) & ~blank, F.lit(False))


def _read_columns(value: Column) -> Column:
    """The fields of all returned columns: texts, presence and types where they matter; NULL for what is no list."""
    # One pass over the list finds the fields of every object.
    found = F.try_variant_get(value, "$", "array<struct<" + ", ".join(f"{n}: variant" for n in (*_COLUMN_FIELDS, "confidence")) + ">>")
    return F.transform(found, lambda f: F.struct(
        *[J.text(f[n]).alias(n) for n in _COLUMN_FIELDS], J.as_float(f["confidence"]).alias("confidence"),
        *[f[n].isNotNull().alias(f"has_{n}") for n in (*_COLUMN_FIELDS, "confidence")],
        *[(J.kind(f[n]) == "STRING").alias(f"is_text_{n}") for n in ("name", "semantic_type", "pii_risk")]))


def _column_error(c: Column, expected: Column) -> Column:
    """Index of the first failed check of a returned column, or NULL."""
    word_in = lambda n, allowed: F.coalesce(c[f"is_text_{n}"] & c[n].isin(*allowed), F.lit(False))
    failures = [
        ~c["has_name"], ~F.coalesce(c["is_text_name"] & (c["name"] == expected), F.lit(False)),
        ~c["has_description"],
        ~c["has_semantic_type"], ~word_in("semantic_type", SEMANTIC_TYPES),
        ~c["has_pii_risk"], ~word_in("pii_risk", PII_RISKS),
        ~c["has_confidence"], c["confidence"].isNull(),
    ]
    first = F.lit(None).cast("int")
    for index, failed in reversed(list(enumerate(failures))):
        first = F.when(failed, index).otherwise(first)
    return first


def _hints(value: Column) -> Column:
    """domain_hints as an array: absent gives none, a string gives its characters, else NULL."""
    none = F.array().cast("array<string>")
    letters = F.when(J.text(value) == "", none).otherwise(F.split(J.text(value), ""))
    return (
        F.when(value.isNull(), none)
        .when(J.kind(value) == "STRING", letters)
        .otherwise(F.try_variant_get(value, "$", "array<string>"))
    )


class Parsed:
    """Results of strict parsing: one verdict per response, and the accepted rows."""

    def __init__(self, verdicts: DataFrame, table_descriptions: DataFrame, column_descriptions: DataFrame) -> None:
        self.verdicts = verdicts
        self.table_descriptions = table_descriptions
        self.column_descriptions = column_descriptions


def parse_descriptions(responses: DataFrame, columns: DataFrame, part_size: int = PART_SIZE, hold: bool = False) -> Parsed:
    """Check responses (schema, table, part, raw) against the catalog columns.

    A response is accepted only if it is valid JSON with exactly the expected
    columns in the expected order, allowed enum values and numeric confidences.
    The reason of the first failed check is reported, with the start of the raw
    text.  With ``hold`` the responses are read once and what was read is written, for
    results that are looked at several times; else each result reads them anew.
    """
    names = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"])
    expected = columns.withColumn("part", _part(part_size)).groupBy(*PART_KEY).agg(names.alias("expected"))
    # Answers travel to the expected names as they came: what is read from one is wider.
    read = (
        responses.select(*PART_KEY, "raw").join(expected, PART_KEY, "left")
        .select(*PART_KEY, "raw", "expected", once(body=strip_fence(F.col("raw"))))
        .select(*PART_KEY, "raw", "expected", once(doc=J.parse(F.col("body"))))
        .select(*PART_KEY, "raw", "expected", F.col("doc").isNotNull().alias("is_json"), once(
            d=J.record(F.col("doc"), "description", "grain", "domain_hints", "columns", "confidence")))
        .select(
            *PART_KEY, "expected", "is_json", F.left("raw", F.lit(RAW_KEPT)).alias("raw_start"), once(
                listed=F.col("d.columns"), shape=J.kind(F.col("d.columns")), texts=F.try_variant_get("d.columns", "$", _COLUMN_TEXTS),
                has_description=F.col("d.description").isNotNull(), has_grain=F.col("d.grain").isNotNull(),
                description=J.text(F.col("d.description")), grain=J.text(F.col("d.grain")),
                domain_hints=_hints(F.col("d.domain_hints")),
                has_confidence=F.col("d.confidence").isNotNull(), confidence=J.as_float(F.col("d.confidence"))))
        .select("*", once(sound=_sound(F.col("shape"), F.col("texts"), F.col("expected"))))
        .select("*", once(items=F.when(~F.col("sound"), _read_columns(F.col("listed"))))).drop("listed", "shape")
    )
    failed = F.filter(F.zip_with("items", "expected", _column_error), lambda e: e.isNotNull())
    first_failed = F.element_at(F.array(*map(F.lit, _COLUMN_CHECKS)), F.col("failed_check") + 1)
    reason = (
        F.when(~F.col("is_json"), "bad_json")
        .when(F.col("texts").isNull(), "missing_field")
        .when(F.size("texts") != F.coalesce(F.size("expected"), F.lit(0)), "column_count")
        .when(F.col("failed_check").isNotNull(), first_failed)
        .when(~F.col("has_description") | ~F.col("has_grain"), "missing_field")
        .when(F.col("domain_hints").isNull(), "bad_hints")
        .when(~F.col("has_confidence"), "missing_field")
        .when(F.col("confidence").isNull(), "bad_number")
    )
    judged = read.select("*", once(failed_check=F.get(failed, F.lit(0)))).select("*", once(reason=reason)).withColumn(
        "status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))
    ok = F.col("status") == "ok"
    fields = (*_COLUMN_FIELDS, "confidence")
    read_closer = F.transform("items", lambda c: F.struct(*[c[n].alias(n) for n in fields]))
    judged = judged.withColumn("items", F.when(F.col("sound"), F.col("texts")).otherwise(read_closer))
    if hold:
        told = ("expected", "items", "description", "grain", "domain_hints", "confidence")
        judged = materialize(judged.select(
            *PART_KEY, "status", "reason", F.when(~ok, F.col("raw_start")).alias("raw_start"), *[F.when(ok, F.col(c)).alias(c) for c in told]), "parsed")
    accepted = judged.filter(ok)
    return Parsed(
        judged.select(*PART_KEY, "status", "reason", F.when(~ok, F.col("raw_start")).alias("raw_start")),
        accepted.select(*PART_KEY, "description", "grain", "domain_hints", "confidence"),
        accepted.select(*TABLE_KEY, F.inline(F.zip_with("items", "expected", lambda c, name: F.struct(
            name.alias("column"), *[c[n].alias(n) for n in ("description", "semantic_type", "pii_risk", "confidence")])))),
    )


def resolve_outcomes(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Outcome per response from the verdicts of the first and the repeated request.

    ok, parse_retry (accepted the second time) or failed, with the last reason.
    """
    verdict = first.select(*PART_KEY, F.col("status").alias("s1"), F.col("reason").alias("r1"))
    if second is None:
        verdict = verdict.withColumn("s2", F.lit(None).cast("string")).withColumn("r2", F.lit(None).cast("string"))
    else:
        verdict = verdict.join(
            second.select(*PART_KEY, F.col("status").alias("s2"), F.col("reason").alias("r2")), PART_KEY, "left")
    event = (
        F.when(F.col("s1") == "ok", "ok").when(F.col("s2") == "ok", "parse_retry").otherwise("failed"))
    return verdict.select(
        *PART_KEY, event.alias("event"),
        F.when(event == "failed", F.coalesce("r2", "r1")).alias("error_reason"))


def describe_tables(
    columns: DataFrame,
    fn: Callable[[str], str],
    *,
    samples: DataFrame | None = None,
    parallelism: int = PARALLELISM,
    attempts: int = ATTEMPTS,
    backoff: float = 1.0,
    part_size: int = PART_SIZE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Describe every table: (table_descriptions, column_descriptions, outcomes).

    A response that cannot be read is asked for once more with a reminder; if
    that fails too the table is ``failed`` for good.  A provider error in either
    call starts the table over, at most ``attempts`` times.  Raw responses are
    written before they are parsed, so a lost executor repeats no accepted call.
    Tables without an accepted description get a row with a NULL description;
    outcomes carry the event, the error and the time spent in calls.
    """
    prompts = table_prompts(columns, samples, part_size).select(*PART_KEY, "prompt")
    pending = prompts
    outcomes, accepted, accepted_columns, calls = [], [], [], []
    for attempt in range(1, attempts + 1):
        call = lambda asked: materialize(
            generate(asked, fn, parallelism=parallelism, attempts=1), "responses")
        first = call(pending)
        parsed = parse_descriptions(first.filter("outcome = 'ok'"), columns, part_size)
        verdicts = materialize(parsed.verdicts, "verdicts")
        again = pending.join(verdicts.filter("status = 'failed'"), PART_KEY, "left_semi")
        second = call(again.withColumn("prompt", F.concat("prompt", F.lit("\n\n" + REMINDER))))
        reparsed = parse_descriptions(second.filter("outcome = 'ok'"), columns, part_size)
        both = first.unionByName(second)
        calls.append(both.select(*PART_KEY, "elapsed_ms"))
        errors = materialize(both.filter("outcome = 'provider_error'").select(*PART_KEY, "error"), "errors")
        settled = resolve_outcomes(verdicts, reparsed.verdicts).join(errors, PART_KEY, "left_anti")
        outcomes.append(settled)
        for result in (parsed, reparsed):
            accepted.append(result.table_descriptions)
            accepted_columns.append(result.column_descriptions)
        if attempt < attempts:
            if not errors.take(1):
                break
            time.sleep(backoff * 2 ** (attempt - 1))
            pending = prompts.join(errors, PART_KEY, "left_semi")
        else:
            outcomes.append(errors.select(*PART_KEY, F.lit("provider_error").alias("event"),
                                          F.col("error").alias("error_reason")))
    union = lambda parts: materialize(_stack(parts), "described")
    spent = _stack(calls).groupBy(*PART_KEY).agg(F.sum("elapsed_ms").alias("elapsed_ms"))
    events, descriptions, column_rows = union(outcomes).join(spent, PART_KEY), union(accepted), union(accepted_columns)
    table_rows, described = whole_tables(columns, events, descriptions, column_rows)
    return table_rows, described, events


def whole_tables(columns: DataFrame, events: DataFrame, descriptions: DataFrame, column_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descriptions of the tables all of whose parts are described; part 0 speaks for the table, others get an empty slot."""
    whole = events.groupBy(*TABLE_KEY).agg(F.bool_and(F.col("event").isin("ok", "parse_retry")).alias("whole"))
    done = whole.filter("whole").select(*TABLE_KEY)
    spoken = descriptions.filter("part = 0").drop("part").join(done, TABLE_KEY, "left_semi")
    table_rows = columns.select(*TABLE_KEY).distinct().join(spoken, TABLE_KEY, "left")
    return table_rows, column_rows.join(done, TABLE_KEY, "left_semi")


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan_summary(outcomes: DataFrame) -> DataFrame:
    """One row: schemas, tables, and tables by final event."""
    count = lambda *names: F.count_if(F.col("event").isin(*names))
    # Tables are unique rows; schemas are counted over distinct names first.
    return outcomes.groupBy("schema").agg(
        F.count("*").alias("t"), count("ok").alias("o"), count("parse_retry").alias("r"),
        count("failed").alias("f"), count("provider_error").alias("p"),
    ).agg(
        F.count("*").alias("schema_count"), F.sum("t").alias("total"), F.sum(F.col("o") + F.col("r")).alias("ok"),
        F.sum("r").alias("ok_after_retry"), F.sum(F.col("f") + F.col("p")).alias("failed"),
        F.sum("p").alias("provider_errors"))


def failed_tables(outcomes: DataFrame) -> DataFrame:
    """Failed tables with their reason."""
    return outcomes.filter(F.col("event").isin("failed", "provider_error")).select(
        *TABLE_KEY, F.coalesce("error_reason", F.lit("unknown error")).alias("error_reason"))
