"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Catalog queries run on the tenant catalog derived from ``customer``; data
queries run on the given tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions import dsn as D
from cartolake.functions.classify import pii_risk, semantic_type
from cartolake.functions.text import once, strip_prefix
from cartolake.operators import ask, diff, drift, edges, enrich, graph, judge, overlap, profile, quality
from cartolake.operators import relationships as rel
from cartolake.operators import sampling, search
from cartolake.plans import answers
from cartolake.plans.tenants import Tenants
from cartolake.schema import EDGE, TABLE_KEY
from cartolake.session import configure, materialize
from cartolake.sources import bundle, constraints, reports, snapshot

REAL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]
# Needles of the search queries, with the names of tables expected in tenants t1..t5.
SEARCHES = [(1, "order", ["orders"]), (2, "KEY", ["orders", "lineitem"]), (3, "name", ["version", "customer"]),
            (4, "doc", ["documents"]), (5, "one row", ["region"]), (6, "rows about p", ["part", "pages"]),
            (7, "zzz", ["orders"]), (8, "", ["orders"]), (9, "custkey", ["customer", "orders"]),
            (10, "a1", [])]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
    return fn


def tenant_query(fn: Callable[[Tenants], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tenants(configure(spark), sf_dir))
    return fn


def real(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in (names or REAL_TABLES)}


def _real_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog rows of data tables, written once: they feed several branches of a plan."""
    return materialize(profile.profiled_columns(tables, profile.discover_keys(tables)), "columns")


# -- sources ------------------------------------------------------------------
@tenant_query
def s1_discover_columns(t):
    return constraints.discover_columns(
        t.info_columns(), t.info_tables(), t.key_usage(), t.constraints(), t.stats()).drop("default")


@query
def s2_snapshot(spark, sf_dir):
    listed = snapshot.snapshot(spark, {("main", n): f"{sf_dir}/{n}.parquet" for n in REAL_TABLES})
    counts = profile.row_counts(real(spark, sf_dir))
    return listed.join(F.broadcast(counts), "table").select("table", "ordinal", "column", "row_count")


@tenant_query
def s3_list_schemas(t):
    return constraints.user_schemas(t.schemata())


@tenant_query
def s4_schema_scope(t):
    return constraints.scope(t.info_tables(), schemata=t.schemata())


@tenant_query
def s5_foreign_key_pairs(t):
    return constraints.foreign_key_pairs(t.referential(), t.key_usage())


@tenant_query
def s6_cross_database(t):
    return constraints.split_cross_database(t.referential(), t.key_usage(), "main")


@tenant_query
def s6_cross_dataset(t):
    feed = constraints.constraint_feed(t.constraints(), t.key_usage(), t.referential())
    return constraints.split_cross_dataset(feed)


@tenant_query
def s7_constraint_feed(t):
    return constraints.constraint_feed(t.constraints(), t.key_usage(), t.referential())


@tenant_query
def s8_without_constraints(t):
    return constraints.discover_columns(t.info_columns(), t.info_tables()).drop("default")


@tenant_query
def a6_fold_tables(t):
    found = constraints.discover_columns(
        t.info_columns(), t.info_tables(), t.key_usage(), t.constraints(), t.stats())
    listed = F.array_join(F.transform("columns", lambda c: F.concat(c["column"], F.lit(" "), c["data_type"])), ", ")
    return constraints.fold_tables(found).select(*TABLE_KEY, "page", "n_columns", "row_count", listed.alias("listed"))


@tenant_query
def p3_dotted(t):
    names = t._tables().select(
        "schema", F.when(F.col("k") % 12 == 0, F.concat("table", F.lit(".bak"))).otherwise(F.col("table")).alias("table"))
    accepted, rejected = constraints.quarantine_dotted(names)
    return accepted.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))


@tenant_query
def p11_known_counts(t):
    return t.tables()


# -- data profile -------------------------------------------------------------
@query
def a1_row_counts(spark, sf_dir):
    return profile.row_counts(real(spark, sf_dir))


@query
def a2_key_profile(spark, sf_dir):
    return profile.key_profile(real(spark, sf_dir)).drop("integral")


@query
def a2_choose_keys(spark, sf_dir):
    return profile.choose_keys(profile.key_profile(real(spark, sf_dir)))


@query
def a2_discover_keys(spark, sf_dir):
    return profile.discover_keys(real(spark, sf_dir))


@query
def a5_pii_evidence(spark, sf_dir):
    return profile.pii_evidence(real(spark, sf_dir))


@query
def p5_null_compaction(spark, sf_dir):
    # Columns without values by construction, next to the given ones.
    tables = real(spark, sf_dir)
    tables["orders"] = tables["orders"].withColumn("o_note", F.lit(None).cast("string"))
    tables["events"] = tables["events"].withColumn("big", F.when(F.col("value") > 1e12, F.col("value")))
    return profile.null_compaction(tables)


@tenant_query
def p12_classify_columns(t):
    return t.columns().select(
        *TABLE_KEY, "column", semantic_type().alias("semantic_type"), pii_risk().alias("pii_risk"))


@query
def p12_classify_real_columns(spark, sf_dir):
    tables = real(spark, sf_dir)
    columns = _real_columns(tables)
    return profile.classify(columns, profile.pii_evidence(tables)).select(
        "table", "column", "semantic_type", "pii_risk")


# -- relationships ------------------------------------------------------------
@query
def j3_profiled_tables(spark, sf_dir):
    tables = real(spark, sf_dir)
    columns = _real_columns(tables)
    return rel.map_relationships(columns, normalise=strip_prefix)


@tenant_query
def j3_map_relationships(t):
    return t.relationships()


@tenant_query
def j1_direct_matches(t):
    return _match_rows(rel.matches(t.columns()).filter("direct"))


@tenant_query
def j2_role_matches(t):
    return _match_rows(rel.matches(t.columns()).filter("NOT direct"))


def _match_rows(found: DataFrame) -> DataFrame:
    return found.select(*TABLE_KEY, "column", "key", "targets")


@tenant_query
def j5_catch_all_keys(t):
    return rel.match_pressure(t.columns()).filter(F.col("n") > rel.PRESSURE_THRESHOLD)


@tenant_query
def a3_single_pks(t):
    return rel.single_pks(t.columns()).select("schema", "key", "target_table")


@tenant_query
def a4_match_pressure(t):
    return rel.match_pressure(t.columns())


@tenant_query
def w4_ambiguous_candidates(t):
    """With a second owner of doc_id per even tenant, two columns have two possible targets."""
    extra = t.keys.filter("k % 2 = 0").select(
        "schema", F.lit("documents_old").alias("table"), F.lit(1).alias("ordinal"), F.lit("doc_id").alias("column"),
        F.lit("bigint").alias("data_type"), F.lit(False).alias("nullable"), F.lit(True).alias("is_primary_key"),
        F.lit(None).cast("string").alias("default"))
    return rel.ambiguous_candidates(t.columns().unionByName(extra), t.foreign_keys())


def _with_old_customers(spark, sf_dir) -> dict[str, DataFrame]:
    tables = real(spark, sf_dir, "customer", "orders", "nation", "lineitem", "part", "supplier", "region")
    tables["customer_old"] = tables["customer"].filter("c_custkey % 2 = 0")
    return tables


@query
def e1_containment(spark, sf_dir):
    tables = real(spark, sf_dir, "customer", "orders", "nation", "lineitem", "part", "supplier", "region")
    columns = _real_columns(tables)
    shown = overlap.containment(rel.infer_edges(columns, normalise=strip_prefix), tables)
    return shown.select(*EDGE, "n_values", "n_found", F.round("containment", 6).alias("containment"))


@query
def e1_overlap_tiebreak(spark, sf_dir):
    tables = _with_old_customers(spark, sf_dir)
    columns = _real_columns(tables)
    pairs = rel.ambiguous_candidates(columns, normalise=strip_prefix)
    chosen = overlap.break_ties(overlap.containment(pairs, tables))
    return chosen.select(*EDGE, "n_values", "n_found", F.round("containment", 6).alias("containment"))


# -- asking the catalog -------------------------------------------------------
@tenant_query
def p9_discover(t):
    return ask.discover(t.tables())


@tenant_query
def j6_describe(t):
    shown = ask.describe(t.columns(), t.tables(), t.table_descriptions(), t.column_descriptions())
    return shown.select(
        *TABLE_KEY, "ordinal", "column", "data_type", "is_primary_key", "description", "semantic_type", "pii_risk",
        F.round("confidence", 6).alias("confidence"), "row_count", "table_description", "grain",
        F.array_join("domain_hints", "|").alias("domain_hints"),
        F.round("table_confidence", 6).alias("table_confidence"))


@tenant_query
def j7_incident(t):
    return ask.incident(t.relationships(), t.tables())


def _texts(t):
    return search.search_texts(t.tables(), t.columns(), t.table_descriptions(), t.column_descriptions())


def _ranked(t):
    return search.search(_texts(t), [(i, q) for i, q, _ in SEARCHES])


@tenant_query
def r1_search(t):
    return _ranked(t)


@query
def s9_sample(spark, sf_dir):
    lineitem = real(spark, sf_dir, "lineitem")["lineitem"]
    first = sampling.sample(lineitem, 20, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query
def p2_coerce(spark, sf_dir):
    tables = real(spark, sf_dir, "orders", "events")
    orders = tables["orders"].select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
        F.col("o_orderstatus").cast("binary").alias("raw"))
    events = tables["events"].select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("ts").cast("date").alias("day"),
        F.col("value").cast("decimal(14,2)").alias("amount"), F.col("event_type").cast("binary").alias("raw"))
    return sampling.coerce(orders.unionByName(events))


@query
def p4_redacted_sample(spark, sf_dir):
    tables = real(spark, sf_dir, "customer")
    columns = _real_columns(tables)
    described = profile.classify(columns)
    return sampling.redact(tables["customer"], described, "main", "customer")


@tenant_query
def j9_adjudicate(t):
    return sampling.adjudicate(t.sample_requests(), t.tables())


# -- evaluation ---------------------------------------------------------------
@tenant_query
def a7_quality(t):
    row = quality.coverage(t.tables(), t.table_descriptions(), t.relationships())
    return row.select(
        "table_count", "tables_with_relationships", "orphan_count", "description_present", "description_null",
        "relationship_count", F.round("description_coverage", 6).alias("description_coverage"),
        F.round("relationship_coverage", 6).alias("relationship_coverage"))


@tenant_query
def a8_orphans(t):
    return quality.orphans(t.tables(), t.relationships())


@tenant_query
def a8_incident_counts(t):
    return quality.incident_counts(t.tables(), t.relationships())


@tenant_query
def a9_pii_distribution(t):
    return quality.pii_distribution(t.column_descriptions())


@tenant_query
def a10_confidence(t):
    r = lambda c: F.round(c, 6).alias(c)
    return quality.confidence(t.table_descriptions(), t.column_descriptions()).select(
        "level", r("mean"), r("minimum"), r("maximum"), "n")


def _compared(t):
    return edges.compare_edges(t.foreign_keys(), rel.infer_edges(t.columns()))


@tenant_query
def o1_edge_status(t):
    return _compared(t)


@tenant_query
def a11_edge_prf(t):
    r = lambda c: F.round(c, 6).alias(c)
    return edges.edge_metrics(_compared(t)).select(
        "declared_count", "inferred_count", "matched_count", r("recall"), r("precision"), r("f1"))


@tenant_query
def a12_breakdown(t):
    return edges.edge_breakdown(_compared(t))


def _search_scores(t):
    spark = t.spark
    queries = spark.createDataFrame([(i, q) for i, q, _ in SEARCHES], "query_id int, query string")
    wanted = spark.createDataFrame(
        [(i, f"t{k}.{name}") for i, _, names in SEARCHES for k in range(1, 6) for name in names],
        "query_id int, key string")
    return search.search_metrics(_ranked(t), queries, wanted)


@tenant_query
def a13_search_metrics(t):
    r = lambda c: F.round(c, 6).alias(c)
    return _search_scores(t).select(
        "query_id", "query", "returned", "expected", "hits", r("precision"), r("recall"), r("reciprocal_rank"))


@tenant_query
def a13_search_summary(t):
    r = lambda c: F.round(c, 6).alias(c)
    return search.search_summary(_search_scores(t)).select(
        "query_count", r("mean_reciprocal_rank"), r("mean_precision"), r("mean_recall"))


@tenant_query
def o2_table_changes(t):
    return diff.table_changes(t.tables(), t.other_tables())


def _diff(t):
    return diff.diff(
        t.tables(), t.other_tables(), t.relationships(), t.relationships(threshold=30),
        t.table_descriptions(), t.other_table_descriptions())


@tenant_query
def o3_diff(t):
    return _diff(t).select(
        "change_type", *TABLE_KEY, "source_column", *EDGE[3:], "kind", "text_changed", "grain_changed",
        F.round("confidence_delta", 6).alias("confidence_delta"),
        F.array_join("hints_added", "|").alias("hints_added"),
        F.array_join("hints_removed", "|").alias("hints_removed"))


@tenant_query
def o3_diff_counts(t):
    return diff.diff_counts(_diff(t))


@tenant_query
def w1_round_robin(t):
    return judge.round_robin(t.tables(), t.table_descriptions(), 500)


@tenant_query
def w1_round_robin_all(t):
    return judge.round_robin(t.tables(), t.table_descriptions())


@tenant_query
def g1_components(t):
    return graph.table_components(graph.components(t.tables(), t.relationships()))


@tenant_query
def a16_graph_summary(t):
    summary = graph.graph_summary(graph.components(t.tables(), t.relationships()))
    return summary.select(
        "components", "largest_component_size",
        F.round("largest_component_fraction", 6).alias("largest_component_fraction"),
        F.round("mean_reachable", 6).alias("mean_reachable"))


# -- descriptions -------------------------------------------------------------
@tenant_query
def u2_prompts(t):
    return enrich.table_prompts(t.columns())


def _parsed(t):
    return enrich.parse_descriptions(answers.first_answers(t), t.columns())


@tenant_query
def u3_parse_descriptions(t):
    return _parsed(t).verdicts.select(*TABLE_KEY, "status", "reason", "raw_start")


@tenant_query
def u3_parsed_tables(t):
    return _parsed(t).table_descriptions.select(
        *TABLE_KEY, "description", "grain", F.array_join("domain_hints", "|").alias("domain_hints"), "confidence")


@tenant_query
def u3_parsed_columns(t):
    return _parsed(t).column_descriptions


@tenant_query
def u4_retry_outcomes(t):
    first = _parsed(t).verdicts
    second = enrich.parse_descriptions(answers.second_answers(t), t.columns()).verdicts
    return enrich.resolve_outcomes(first, second).drop("part")


@tenant_query
def u1_generate(t):
    prompts = enrich.table_prompts(t.columns()).select(*TABLE_KEY, "part", "prompt")
    cores = t.spark.sparkContext.defaultParallelism
    raw = enrich.generate(prompts, answers.offline_model(), parallelism=cores, backoff=0.0)
    return raw.select(*TABLE_KEY, "outcome", "attempts", F.length("raw").alias("answer_length"))


@tenant_query
def u5_judge_prompts(t):
    return judge.judge_prompts(t.columns(), t.table_descriptions(), t.column_descriptions())


@tenant_query
def u6_parse_scores(t):
    return judge.parse_scores(answers.judge_answers(t))


@tenant_query
def a14_judge_summary(t):
    summary = judge.judge_summary(judge.parse_scores(answers.judge_answers(t)), t.table_descriptions())
    return summary.select(
        "scored_count", "total_judge_failures", "flagged_count", "skipped_null",
        *[F.round(f"mean_{d}", 6).alias(f"mean_{d}") for d in judge.DIMENSIONS])


@tenant_query
def a14_flagged(t):
    return judge.flagged(judge.parse_scores(answers.judge_answers(t))).select(*TABLE_KEY, *judge.DIMENSIONS)


@tenant_query
def u8_prompt_hash(t):
    return enrich.table_prompts(t.columns()).select(
        *TABLE_KEY, F.sha2("prompt", 256).alias("prompt_hash"), enrich.prompt_hash().alias("template_hash"))


@tenant_query
def a15_scan_summary(t):
    return enrich.scan_summary(t.outcomes())


@tenant_query
def a15_failed_tables(t):
    return enrich.failed_tables(t.outcomes())


# -- sinks and scrubbing ------------------------------------------------------
@tenant_query
def s12_integrity(t):
    dropped = t._slots().filter(~((F.col("table") == "region") & (F.col("k") % 50 == 0))).select(*TABLE_KEY)
    ghosts = t.keys.filter("k % 40 = 0").select("schema", F.lit("ghost").alias("table"))
    return bundle.check_integrity(t.tables(), dropped.unionByName(ghosts))


@tenant_query
def s13_key_codec(t):
    s, name, k = F.col("schema"), F.col("table"), F.col("k")
    key = (
        F.when(k % 6 == 0, name).when(k % 6 == 1, F.concat(F.lit("."), name))
        .when(k % 6 == 2, F.concat(s, F.lit("."))).when(k % 6 == 3, F.concat(s, F.lit(".a."), name))
        .otherwise(F.concat(s, F.lit("."), name)))
    return bundle.decode_keys(t._tables().select("k", "p", key.alias("key")))


@tenant_query
def a17_bundle_counts(t):
    return bundle.bundle_counts(t.tables(), t.table_descriptions(), t.relationships())


def _connections(spark, sf_dir):
    """A log line per order, with the connection string it was made with."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    scheme = F.when(k % 4 == 0, "postgresql").when(k % 4 == 1, "snowflake").otherwise("duckdb")
    password = F.when(k % 3 == 0, F.concat(F.lit("p%40ss"), c)).otherwise(F.concat(F.lit("pw"), c, F.lit("x")))
    port = F.when(k % 5 == 0, ":5432").otherwise("")
    path = F.when(k % 7 == 0, "").when(k % 7 == 1, "/").otherwise(F.concat(F.lit("/db"), (k % 10).cast("string")))
    full = F.concat(scheme, F.lit("://user"), c, F.lit(":"), password, F.lit("@Host"), (k % 9).cast("string"),
                    F.lit(".example.com"), port, path)
    bare = F.concat(scheme, F.lit("://host"), c, port, path)
    dsn = F.when(k % 11 == 0, scheme).when(k % 11 == 1, bare).when(k % 11 == 2, F.lit("")).otherwise(full)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), once(dsn=dsn, c=c))
    message = F.concat(
        F.lit("connect to "), "dsn", F.lit(" failed: password 'p@ss"), "c", F.lit("' or 'pw"), "c",
        F.lit("x' rejected by snowflake.errors; see ftp://bob:secret@files/x"))
    return orders.select("id", "dsn", once(message=message))


@query
def p7_scrub(spark, sf_dir):
    return D.scrub(_connections(spark, sf_dir), "message", "dsn").select("id", "message")


@query
def p7_scrub_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return D.scrub(documents, "text").select("doc_id", F.md5("text").alias("text_md5"))


@query
def p8_connection_label(spark, sf_dir):
    return _connections(spark, sf_dir).select("id", D.connection_label(F.col("dsn")).alias("label"))


@query
def p8_page_label(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", D.connection_label(F.col("url")).alias("label"))


@tenant_query
def s15_envelope(t):
    metrics = quality.pii_distribution(t.column_descriptions())
    orphans = quality.orphans(t.tables(), t.relationships())
    return reports.envelope("quality", "tenants", metrics, {"orphan_table": orphans})


@tenant_query
def s14_artifact(t):
    scores = judge.parse_scores(answers.judge_answers(t))
    counts = judge.judge_summary(scores).select("scored_count", "total_judge_failures", "flagged_count")
    return reports.artifact(
        counts, scores.select("status", *TABLE_KEY, *judge.DIMENSIONS), bundle="tenants", generator_model=None,
        judge_model="offline", prompt_hash=enrich.prompt_hash(), run_timestamp=F.lit("2024-01-01T00:00:00Z"))


@tenant_query
def s17_ground_truth(t):
    k = F.col("k")
    raw = t._tables().select(
        (k * 100 + F.col("p")).alias("item_id"),
        F.when(k % 9 == 0, F.lit("")).when(k % 9 != 1, F.col("table")).alias("query"),
        F.when(k % 7 == 0, F.lit(None).cast("array<string>"))
        .when(k % 7 == 1, F.array(F.col("table"), F.lit(None).cast("string")))
        .otherwise(F.array(F.concat_ws(".", "schema", "table"))).alias("expected"))
    return reports.validate_ground_truth(raw).select("item_id", "query", "error")


# -- change over time ---------------------------------------------------------
def _previous_columns(t):
    """An earlier scan: some columns missing, some retyped, some since removed."""
    k = F.col("k")
    layout = t._layout().withColumnRenamed("underlying", "data_type")
    kept = layout.filter(~((k % 6 == 0) & (F.col("column") == "url")))
    retyped = kept.withColumn("data_type", F.when((k % 10 == 3) & (F.col("data_type") == "int"), "smallint")
                              .otherwise(F.col("data_type")))
    gone = t.keys.filter("k % 8 = 0").select("schema", F.lit("orders").alias("table"), F.lit(7).alias("ordinal"),
                                             F.lit("clerk").alias("column"), F.lit("string").alias("data_type"),
                                             F.lit(False).alias("is_primary_key"))
    rows = retyped.select(*TABLE_KEY, "ordinal", "column", "data_type", "is_primary_key").unionByName(gone)
    return rows.withColumn("nullable", ~F.col("is_primary_key"))


@tenant_query
def e2_column_drift(t):
    return drift.column_drift(t.columns(), _previous_columns(t))


@tenant_query
def e2_table_drift(t):
    k = F.col("k")
    before = t._tables().filter(~((k % 4 == 1) & (F.col("table") == "pages"))).select(
        *TABLE_KEY, F.when(k % 3 == 0, k * 10 + F.col("p")).otherwise(k).cast("bigint").alias("row_count"))
    return drift.table_drift(t.tables(), before)


@tenant_query
def e3_fingerprints(t):
    return drift.fingerprints(t.columns())


@tenant_query
def e3_incremental(t):
    k = F.to_number(F.substr("schema", F.lit(2)), F.lit("999999999999")).cast("bigint")
    stored = drift.fingerprints(_previous_columns(t)).filter(~((k % 5 == 4) & (F.col("table") == "part"))).select(
        *TABLE_KEY, "fingerprint",
        F.when(k % 9 == 0, "old-model").otherwise("model").alias("model"),
        F.when(k % 13 == 0, "old").otherwise("now").alias("prompt_hash"))
    return drift.stale_tables(drift.fingerprints(t.columns()), stored, "model", "now")


@tenant_query
def e4_score_delta(t):
    now = judge.parse_scores(answers.judge_answers(t)).filter("status = 'ok'")
    before = judge.parse_scores(answers.judge_answers(t, shift=1)).filter("status = 'ok'")
    return drift.score_delta(now, before)
