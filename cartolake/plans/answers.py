"""Deterministic stand-ins for model answers over the tenant catalog."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions.classify import pii_risk, semantic_type
from cartolake.functions.text import once
from cartolake.plans.tenants import BASE, TABLE_POSITIONS, _inline
from cartolake.schema import TABLE_KEY


def _objects(columns: Column) -> Column:
    """Each column's JSON object, with the defects some tenants' answers have."""
    k = F.col("k")

    def written(c: Column) -> Column:
        first = c["ordinal"] == 1
        named = F.when((k % 8 == 2) & first, "swapped").otherwise(c["column"])
        risk = F.when((k % 8 == 3) & first, "PII").otherwise(c["pii_risk"])
        sure = F.when(k % 8 == 5, '"0.5"').otherwise("0.5")
        return F.concat(
            F.lit('{"name":"'), named, F.lit('","description":"The '), c["column"], F.lit('","semantic_type":"'),
            c["semantic_type"], F.lit('","pii_risk":"'), risk, F.lit('","confidence":'), sure, F.lit("}"))

    return F.transform(columns, written)


def _layout(spark: SparkSession) -> Column:
    """The layout's tables, each with its columns in order and what the rules say of them: (table, p, columns), inline."""
    names = ["table", "p", "ordinal", "column", "kind", "data_type", "is_primary_key", "in_key"]
    told = spark.range(1).select(F.expr(_inline(BASE)).alias(*names)).select(
        "table", "p", "ordinal", "column", semantic_type().alias("semantic_type"), pii_risk().alias("pii_risk")).collect()
    fields = ("ordinal", "column", "semantic_type", "pii_risk")
    return F.inline(F.array(*[F.struct(F.lit(table).alias("table"), F.lit(p).alias("p"), F.array(*[
        F.struct(*[F.lit(r[f]).alias(f) for f in fields])
        for r in sorted(told, key=lambda r: r["ordinal"]) if r["p"] == p]).alias("columns")) for table, p in TABLE_POSITIONS]))


def _documents(t) -> DataFrame:
    # A tenant that comes several times has every column as often, in one answer per table.
    tenants = t.keys.groupBy("k", "schema").agg(F.count("*").cast("int").alias("times"))
    whole = tenants.select("k", "schema", "times", _layout(t.spark)).filter((F.col("table") != "attrs") | (F.col("k") % 3 == 0))
    entries = F.flatten(F.transform(_objects(F.col("columns")), lambda x: F.array_repeat(x, F.col("times"))))
    listed = whole.select("k", "p", *TABLE_KEY, once(entries=entries))
    kept = F.when(F.col("k") % 8 == 1, F.slice("entries", 1, F.size("entries") - 1)).otherwise(F.col("entries"))
    sure = F.when(F.col("k") % 8 == 4, '"high"').otherwise("0.9")
    text = F.concat(
        F.lit('{"description":"Rows about '), "table", F.lit('","grain":"one row per '), "table",
        F.lit('","domain_hints":["'), "table", F.lit('","sales"],"columns":['),
        F.array_join(kept, ","), F.lit('],"confidence":'), sure, F.lit("}"))
    return listed.select("k", "p", *TABLE_KEY, once(text=text))


def first_answers(t) -> DataFrame:
    """Answers to the first request: most are right, some fenced, cut off, or wrong."""
    k = F.col("k")
    raw = (
        F.when(k % 24 == 7, F.lit("I cannot describe this table."))
        .when(k % 8 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
        .when(k % 8 == 6, F.left("text", F.length("text") - 10))
        .otherwise(F.col("text")))
    return _documents(t).select(*TABLE_KEY, F.lit(0).alias("part"), raw.alias("raw"))


def second_answers(t) -> DataFrame:
    """Answers to the repeated request: cut-off answers are complete now for even positions."""
    k, p = F.col("k"), F.col("p")
    raw = F.when((k % 8 == 6) & (p % 2 == 1), F.left("text", F.length("text") - 10)).otherwise(F.col("text"))
    return _documents(t).select(*TABLE_KEY, F.lit(0).alias("part"), raw.alias("raw"))


def judge_answers(t, shift: int = 0) -> DataFrame:
    """Judge answers: valid, out of range, numeric strings, fractions, without reasoning, prose."""
    k = F.col("k") + shift
    score = F.when(k % 6 == 1, "9").when(k % 6 == 2, '"4"').when(k % 6 == 3, "4.7").otherwise(
        (1 + F.pmod(k + F.col("p"), F.lit(5))).cast("string"))
    note = F.when(k % 6 == 4, "").otherwise(',"reasoning":"because"')
    entry = lambda s: F.concat(F.lit('{"score":'), s, note, F.lit("}"))
    text = F.concat(F.lit('{"accuracy":'), entry(score), F.lit(',"specificity":'), entry(F.lit("3")),
                    F.lit(',"domain_inference":'), entry(score), F.lit("}"))
    raw = F.when(k % 6 == 5, "The description is good.").otherwise(text)
    return t._tables().select(*TABLE_KEY, raw.alias("raw"))


def offline_model() -> Callable[[str], str]:
    """A generator that needs no network: it reads the prompt's own column lines.

    Built here so that it ships to the workers by value, whatever their path.
    """
    def answer(prompt: str) -> str:
        table = re.search(r"^Table: \S*\.(\S+)$", prompt, re.M).group(1)
        columns = [
            {"name": name, "description": f"The {name}", "semantic_type": "identifier" if pk == "true" else "other",
             "pii_risk": "none", "confidence": 0.5}
            for name, pk in re.findall(r"^  - (\S+): .*, pk=(true|false)$", prompt, re.M)]
        return json.dumps({"description": f"Rows about {table}", "grain": f"one row per {table}",
                           "domain_hints": [table], "columns": columns, "confidence": 0.5}, separators=(",", ":"))
    return answer
