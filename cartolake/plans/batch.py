"""Registered queries of whole runs: resumed descriptions and judgements, answered samples, many needles, versions, keys, reports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cartolake.functions.classify import pii_risk
from cartolake.functions.text import strip_prefix
from cartolake.operators import (
    containment, diff, drift, edges, enrich, judge, keys, overlap, profile, resume, sampling, search, secrets)
from cartolake.operators import relationships as rel
from cartolake.plans import answers
from cartolake.plans.queries import (
    REAL_TABLES, _compared, _connections, _previous_columns, _real_columns, query, real, s5_foreign_key_pairs, s12_integrity,
    tenant_query)
from cartolake.plans.tenants import LAYOUT
from cartolake.schema import COLUMNS, EDGE, TABLE_KEY
from cartolake.session import checkpoint_dir, materialize
from cartolake.sources import bundle, reports, snapshot, versions
from cartolake.streaming import audit

NEEDLE_NAMES = sorted({name for name, _ in LAYOUT} | {c for _, columns in LAYOUT for c, _, _ in columns})
# What identifies the rows of the given tables.
ROW_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def flawed_model(outage: bool) -> Callable[[str], str]:
    """The offline model with flaws that depend on the table alone; in an outage it answers no tenant with k % 3 = 1."""
    plain = answers.offline_model()

    def answer(prompt: str) -> str:
        schema, table = re.search(r"^Table: (\S*)\.(\S+)$", prompt, re.M).groups()
        k = int(schema[1:])
        if (outage and k % 3 == 1) or (k % 5 == 4 and table == "orders"):
            raise RuntimeError("busy")
        if table == "pages":
            return "I cannot describe this table."
        text = plain(prompt)
        # A first answer that is cut off; the reminder helps.
        return text[:-9] if k % 8 == 6 and "could not be read" not in prompt else text

    return answer


@tenant_query
def u4_describe_tables(t):
    """A run during an outage and the run that resumes it: what each table came to, and the calls it took in all."""
    columns = t.columns()
    log = resume.ResponseLog(t.spark, _scratch(t.spark))
    how = {"parallelism": t.spark.sparkContext.defaultParallelism, "calls_per_task": 4000, "backoff": 0.0}
    resume.describe_resumable(columns, flawed_model(True), log, "offline", attempts=1, **how)
    tables, described, events = resume.describe_resumable(columns, flawed_model(False), log, "offline", attempts=2, **how)
    width = described.groupBy(*TABLE_KEY).agg(F.count("*").alias("n_columns"))
    return tables.join(events.drop("part"), TABLE_KEY).join(width, TABLE_KEY, "left").select(
        *TABLE_KEY, "description", "event", "error_reason", "accepted_calls", "calls",
        F.coalesce("n_columns", F.lit(0)).cast("bigint").alias("n_columns"))


@tenant_query
def u9_progress(t):
    """What an interrupted run and the one that resumes it tell of their calls, and (run 0) what their log holds."""
    columns, log, told = t.columns(), resume.ResponseLog(t.spark, _scratch(t.spark)), []
    for run, outage in ((1, True), (2, False)):
        def hear(p: resume.Progress, run=run) -> None:
            told.append((run, p.request, p.event, p.index, p.total, p.errors))

        resume.describe_resumable(
            columns, flawed_model(outage), log, "offline", attempts=run, on_progress=hear, backoff=0.0,
            parallelism=t.spark.sparkContext.defaultParallelism, calls_per_task=4000)
    # Two rows per slice of calls.
    heard = t.spark.createDataFrame(told, "run int, request int, event string, answered bigint, total bigint, errors bigint")
    ends = heard.groupBy("run", "request").agg(
        *[F.max(c).alias(c) for c in ("answered", "total", "errors")],
        (F.count_if(F.col("event") == "started") == F.count_if(F.col("event") == "answered")).alias("every_slice_ended"))
    ok = F.count_if(F.col("outcome") == "ok")
    return ends.unionByName(log.rows().groupBy("request").agg(
        F.lit(0).alias("run"), ok.alias("answered"), F.count("*").alias("total"), (F.count("*") - ok).alias("errors"),
        F.lit(True).alias("every_slice_ended")))


def flawed_judge(outage: bool) -> Callable[[str], str]:
    """A judge whose scores follow from the names; in an outage it answers no tenant with k % 3 = 1."""
    def answer(prompt: str) -> str:
        schema, table = re.search(r"^Table: (\S*)\.(\S+)$", prompt, re.M).groups()
        k = int(schema[1:])
        if (outage and k % 3 == 1) or (k % 5 == 4 and table == "orders"):
            raise RuntimeError("busy")
        if table == "pages":
            return "A fine description."
        marks = {"accuracy": 1 + k % 5, "specificity": len(table), "domain_inference": k % 4}
        return json.dumps({name: {"score": score, "reasoning": "by name"} for name, score in marks.items()})

    return answer


@tenant_query
def u7_evaluate(t):
    """Scores of all described tables after a run in an outage and the run that resumes it, with the calls they took."""
    log = resume.ResponseLog(t.spark, _scratch(t.spark))
    described = (t.columns(), t.table_descriptions(), t.column_descriptions())
    how = {"parallelism": t.spark.sparkContext.defaultParallelism, "calls_per_task": 4000, "backoff": 0.0}
    resume.judge_resumable(*described, flawed_judge(True), log, "judge", **how)
    scores, _ = resume.judge_resumable(*described, flawed_judge(False), log, "judge", attempts=2, **how)
    spent = log.rows().groupBy(*TABLE_KEY).agg(F.count("*").alias("calls"))
    return scores.join(spent, TABLE_KEY).select(
        *TABLE_KEY, "status", *judge.DIMENSIONS, "accuracy_reasoning", "calls")


def _sampled_tables(spark, sf_dir):
    """The given tables (vectors as thousandths), one with empty columns, and one of 32 columns."""
    tables = real(spark, sf_dir)
    tables["embeddings"] = tables["embeddings"].withColumn(
        "embedding", F.transform("embedding", lambda x: F.floor(x * 1000).cast("int")))
    tables["sparse"] = tables["events"].select(
        "event_id", F.lit(None).cast("string").alias("note"), "ts", F.lit(None).cast("double").alias("amount"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("even_user"))
    tables["order_lines"] = (
        tables["lineitem"].join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(tables["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(tables["supplier"], F.col("l_suppkey") == F.col("s_suppkey")))
    return tables, {**ROW_KEYS, "sparse": ["event_id"], "order_lines": ROW_KEYS["lineitem"]}


@query
def u2_prompts_with_samples(spark, sf_dir):
    """Prompts with sample rows: empty columns left out, wide tables told to be brief."""
    tables, by = _sampled_tables(spark, sf_dir)
    columns = spark.createDataFrame(
        [("main", name, i, f.name, snapshot.render_type(f.dataType), True, f.name in by[name], None)
         for name, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)], COLUMNS)
    samples = sampling.table_samples(
        spark, {("main", name): lambda df=df: df for name, df in tables.items()}, None, cap=enrich.DEFAULT_ROWS,
        key_columns={("main", name): key for name, key in by.items()})
    blocks = enrich.sample_blocks(samples)
    return enrich.table_prompts(columns, blocks).join(blocks.select(*TABLE_KEY, "omitted_columns"), TABLE_KEY).select(
        *TABLE_KEY, "part", "n_columns", "is_wide", "omitted_columns", F.length("prompt").alias("prompt_length"),
        F.md5("prompt").alias("prompt_md5"))


@query
def p1_column_types(spark, sf_dir):
    """Columns of the given tables, of orders with nested lines and of a table that cannot be read, and whether any row fills them."""
    tables = real(spark, sf_dir)
    lines = tables["lineitem"].groupBy("l_orderkey").agg(F.sort_array(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_quantity", F.struct("l_returnflag", "l_shipdate").alias("state")))).alias("lines"))
    nested = tables["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.struct("o_custkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price")).alias("about"), "lines",
        F.create_map("o_orderstatus", "o_orderpriority").alias("status"), F.array(F.array("o_custkey")).alias("grid"),
        F.lit(None).cast("date").alias("closed"), F.lit(None).cast("binary").alias("seal"))
    path = _scratch(spark)
    nested.write.parquet(path)
    paths = {("main", n): f"{sf_dir}/{n}.parquet" for n in [*REAL_TABLES, "broken"]} | {("lake", "nested"): path}
    filled = profile.null_compaction({**tables, "nested": spark.read.parquet(path)})
    return snapshot.snapshot(spark, paths).join(filled.drop("column"), ["table", "ordinal"], "left").select(
        *TABLE_KEY, "ordinal", "column", "data_type", "nullable", F.col("error").isNotNull().alias("unreadable"), "keep")


@tenant_query
def r2_edge_report(t):
    return reports.edge_report(s5_foreign_key_pairs(t), t.relationships().filter("kind = 'inferred'"))


@tenant_query
def r3_report_lists(t):
    """The sorted lists of a comparison, of an integrity check and of a relationship report."""
    return reports.report_lists({
        "tables": (diff.table_changes(t.tables(), t.other_tables()), ["change_type", *TABLE_KEY]),
        "integrity": (s12_integrity(t), ["problem", *TABLE_KEY]),
        "breakdown": (edges.edge_breakdown(_compared(t)), TABLE_KEY)})


@tenant_query
def e3_merge(t):
    """Descriptions after tables that changed were described again; those that went are gone."""
    k = F.to_number(F.substr("schema", F.lit(2)), F.lit("999999999999")).cast("bigint")
    stored_prints = drift.fingerprints(_previous_columns(t)).select(
        *TABLE_KEY, "fingerprint", F.lit("model").alias("model"), F.when(k % 13 == 0, "old").otherwise("now").alias("prompt_hash"))
    # Several branches read it: the structures are digested once.
    stale = materialize(drift.stale_tables(drift.fingerprints(t.columns()), stored_prints, "model", "now"), "stale")
    ghost = t.keys.filter("k % 4 = 0").select(
        "schema", F.lit("gone").alias("table"), F.lit("old rows").alias("description"), F.lit("x").alias("grain"),
        F.array(F.lit("x")).alias("domain_hints"), F.lit(0.5).alias("confidence"))
    stored = t.table_descriptions().unionByName(ghost)
    described = t.table_descriptions().join(stale.select(*TABLE_KEY), TABLE_KEY, "left_semi")
    new = described.withColumn("description", F.concat("description", F.lit(" v2")))
    new_columns = t.column_descriptions().join(stale.select(*TABLE_KEY), TABLE_KEY, "left_semi").withColumn(
        "description", F.concat("description", F.lit(" v2")))
    tables, columns = resume.merge_descriptions(t.tables(), stored, t.column_descriptions(), stale, new, new_columns)
    width = columns.groupBy(*TABLE_KEY).agg(
        F.count("*").alias("n_columns"), F.count_if(F.col("description").endswith(" v2")).alias("n_new"))
    none = F.lit(0).cast("bigint")
    return tables.join(width, TABLE_KEY, "left").select(
        *TABLE_KEY, "description", F.coalesce("n_columns", none).alias("n_columns"), F.coalesce("n_new", none).alias("n_new"))


@query
def j9_sample_requests(spark, sf_dir):
    """A request per customer for rows of the given tables, of one that can not be read and of one nobody knows."""
    paths = {("main", n): f"{sf_dir}/{n}.parquet" for n in [*REAL_TABLES, "broken"]}
    load = lambda path: lambda: spark.read.parquet(path)
    described = snapshot.snapshot(spark, paths).filter("error is null").withColumn("pii_risk", pii_risk())
    known = described.select(*TABLE_KEY).distinct().withColumn("row_count", F.lit(None).cast("bigint")).unionByName(
        spark.range(1).select(F.lit("main").alias("schema"), F.lit("broken").alias("table"), F.lit(None).cast("bigint").alias("row_count")))
    samples = sampling.table_samples(
        spark, {key: load(path) for key, path in paths.items()}, described, key_columns={("main", n): k for n, k in ROW_KEYS.items()})
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, [*REAL_TABLES, "broken", "nowhere"]))
    limits = F.array(*[F.lit(v).cast("int") for v in (None, 1, 5, 20, 21, 0, -3)])
    requests = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("request_id"), F.lit("main").alias("schema"), F.get(names, (k % 16).cast("int")).alias("table"),
        F.get(limits, (k % 7).cast("int")).alias("limit"))
    answered = sampling.sample_requests(requests, known, samples)
    columns = list(dict.fromkeys(c for names in ROW_KEYS.values() for c in names))
    # A row holds the key columns of its own table only.
    key = lambda row: F.concat_ws("-", *[F.get_json_object(row, f"$.{c}") for c in columns])
    return answered.select(
        "request_id", "tool", *TABLE_KEY, "outcome", "limit_requested", "limit_effective", "rows_returned",
        F.array_join(F.transform("rows", key), ",").alias("row_keys"),
        (F.size(F.filter("rows", lambda r: r.contains('"c_name":null')))).alias("names_hidden"))


def _needles(spark, sf_dir):
    """A needle per order: a piece of a name, in either case."""
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, NEEDLE_NAMES))
    piece = F.substring(F.get(names, (k % len(NEEDLE_NAMES)).cast("int")), (k % 4 + 1).cast("int"), (k % 6).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("query_id"), F.when(k % 11 == 0, F.concat(F.lit("the "), piece)).when(k % 5 == 0, F.upper(piece)).otherwise(piece).alias("query"))


@tenant_query
def r1_search_many(t):
    texts = search.search_texts(t.tables(), t.columns(), t.table_descriptions(), t.column_descriptions())
    return search.search_many(texts, _needles(t.spark, t.sf_dir), limit=3)


@query
def a2_composite_keys(spark, sf_dir):
    found = keys.discover_composite_keys(spark, real(spark, sf_dir))
    return found.select("table", F.array_join("columns", ",").alias("columns"), "rows")


def _doubled(spark, sf_dir):
    """The given tables, and second owners of three keys: half, all and none of the first ones' values."""
    tables = real(spark, sf_dir)
    tables["customer_old"] = tables["customer"].filter("c_custkey % 2 = 0")
    tables["part_copy"] = tables["part"].filter("true")
    tables["supplier_new"] = tables["supplier"].withColumn("s_suppkey", -F.col("s_suppkey") - 1)
    return tables


def _all_pairs(tables):
    columns = _real_columns(tables)
    pairs = rel.infer_edges(columns, normalise=strip_prefix).select(*EDGE).unionByName(
        rel.ambiguous_candidates(columns, normalise=strip_prefix).select(*EDGE))
    return pairs.distinct()


@query
def e1_containment_all(spark, sf_dir):
    tables = _doubled(spark, sf_dir)
    shown = containment.contained(_all_pairs(tables), tables)
    return shown.select(*EDGE, "n_values", "n_found", F.round("containment", 6).alias("containment"))


@query
def e1_ties_all(spark, sf_dir):
    tables = _doubled(spark, sf_dir)
    chosen = overlap.break_ties(containment.contained(_all_pairs(tables), tables, least=0.5))
    return chosen.select(*EDGE, "n_values", "n_found", F.round("containment", 6).alias("containment"))


@tenant_query
def s10_versions(t):
    """What readers of the first and of the latest version see, the first one opened before the second was written."""
    path = _scratch(t.spark)
    k = F.to_number(F.substr("schema", F.lit(2)), F.lit("999999999999")).cast("bigint")
    part = lambda df, old: df.filter(k % 2 == 0) if old else df

    def catalog(old: bool) -> bundle.Bundle:
        return bundle.Bundle(
            tables=part(t.tables(), old), columns=part(t.columns(), old), table_descriptions=part(t.table_descriptions(), old),
            column_descriptions=part(t.column_descriptions(), old),
            relationships=t.foreign_keys().withColumn("kind", F.lit("declared")).filter(
                F.to_number(F.substr("source_schema", F.lit(2)), F.lit("999999999999")) % 2 == 0 if old else F.lit(True)),
            meta=bundle.make_meta(t.spark, "files", "tenants"))

    first = versions.write_version(catalog(True), path)
    reader = versions.read_version(t.spark, path)
    second = versions.write_version(catalog(False), path, after=first)
    latest = versions.read_version(t.spark, path)

    def seen(number: int, found: bundle.Bundle):
        return bundle.bundle_counts(found.tables, found.table_descriptions, found.relationships).select(
            F.lit(number).alias("version"), "what", "n")

    return seen(first, reader).unionByName(seen(second, latest))


@query
def p7_scrub_known(spark, sf_dir):
    """Log lines and documents without the connection strings and passwords of every second order."""
    lines = _connections(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select((-F.col("doc_id") - 1).alias("id"), F.col("text").alias("message"))
    clean = secrets.scrub_known(
        lines.select("id", "message").unionByName(documents), "message", secrets.known_secrets(lines.filter("id % 2 = 0")))
    return clean.select("id", F.md5("message").alias("text_md5"))


@tenant_query
def s16_audit_stream(t):
    """Requests in three parts; the second is decided in vain once, and again when the catalog has grown."""
    spark, path = t.spark, _scratch(t.spark)
    asked = t.sample_requests()
    k = F.to_number(F.substr("schema", F.lit(2)), F.lit("999999999999")).cast("bigint")
    latest = [t.tables().filter(k % 2 == 0)]

    def decide(batch, fail=False):
        decided = sampling.adjudicate(batch, latest[-1])
        return decided.withColumn("limit_effective", F.raise_error("lost").cast("int")) if fail else decided

    def run(how) -> None:
        stream = spark.readStream.schema(asked.schema).parquet(f"{path}/requests")
        audit.audit_batches(stream, how, f"{path}/audit", f"{path}/checkpoint").awaitTermination()

    for part in range(3):
        asked.filter(F.col("request_id") % 3 == part).write.mode("append").parquet(f"{path}/requests")
        if part == 1:
            try:
                run(lambda batch: decide(batch, fail=True))
            except StreamingQueryException:
                latest.append(t.tables())
        run(decide)
    return audit.read_audit(spark, f"{path}/audit")


QUERIES = (u4_describe_tables, u9_progress, u7_evaluate, u2_prompts_with_samples, p1_column_types, r2_edge_report, r3_report_lists, e3_merge, j9_sample_requests, r1_search_many, a2_composite_keys, e1_containment_all, e1_ties_all,
           s10_versions, p7_scrub_known, s16_audit_stream)
