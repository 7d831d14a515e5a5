"""A catalog with many tenants, derived from ``customer``.

Every customer key ``k`` becomes a schema ``t<k>`` that holds the test tables
with their one-letter prefixes removed, plus tables for the special cases: a
catch-all key (``version.name`` against ``attrs``), role prefixes and a
self-reference (``review``).  Everything below is a function of ``k`` and the
table's position ``p``, so the catalog grows with the data and a SQL engine can
state the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions.classify import pii_risk, semantic_type
from cartolake.operators.relationships import map_relationships

# (table, [(column, type, key)]); a "|" in the type separates kind and underlying name.
LAYOUT = [
    ("region", [("regionkey", "int", 1), ("name", "string", 0)]),
    ("nation", [("nationkey", "int", 1), ("name", "string", 0), ("regionkey", "int", 0)]),
    ("customer", [("custkey", "bigint", 1), ("name", "string", 0), ("nationkey", "int", 0),
                  ("acctbal", "double", 0), ("mktsegment", "string", 0)]),
    ("supplier", [("suppkey", "bigint", 1), ("name", "string", 0), ("nationkey", "int", 0),
                  ("acctbal", "double", 0)]),
    ("part", [("partkey", "bigint", 1), ("name", "string", 0), ("brand", "string", 0),
              ("type", "string", 0), ("size", "int", 0), ("retailprice", "double", 0)]),
    ("orders", [("orderkey", "bigint", 1), ("custkey", "bigint", 0), ("orderstatus", "string", 0),
                ("totalprice", "double", 0), ("orderdate", "timestamp", 0),
                ("orderpriority", "string", 0)]),
    ("lineitem", [("orderkey", "bigint", 1), ("partkey", "bigint", 0), ("suppkey", "bigint", 0),
                  ("linenumber", "int", 1), ("quantity", "double", 0), ("extendedprice", "double", 0),
                  ("discount", "double", 0), ("tax", "double", 0), ("returnflag", "string", 0),
                  ("linestatus", "string", 0), ("shipdate", "timestamp", 0)]),
    ("events", [("event_id", "bigint", 1), ("ts", "timestamp", 0), ("user_id", "bigint", 0),
                ("event_type", "string", 0), ("value", "double", 0),
                ("props", "USER-DEFINED|jsonb", 0)]),
    ("documents", [("doc_id", "bigint", 1), ("text", "string", 0), ("lang", "string", 0),
                   ("source", "string", 0), ("n_chars", "bigint", 0)]),
    ("embeddings", [("vec_id", "bigint", 1), ("embedding", "ARRAY|_float4", 0), ("label", "int", 0)]),
    ("pages", [("page_id", "bigint", 1), ("url", "string", 0), ("html", "string", 0)]),
    ("benchmark", [("item_id", "bigint", 1), ("text", "string", 0)]),
    ("labels", [("doc_id", "bigint", 0), ("quality", "int", 0), ("toxic", "int", 0)]),
    ("conversations", [("conv_id", "bigint", 1), ("turn", "bigint", 1), ("role", "string", 0),
                       ("text", "string", 0)]),
    ("version", [("name", "string", 1), ("applied_at", "timestamp", 0)]),
    ("attrs", [(f"a{i}_name", "string", 0) for i in range(18)]),
    ("review", [("review_id", "bigint", 1), ("source_doc_id", "bigint", 0),
                ("parent_review_id", "bigint", 0)]),
]

# Rows of the layout: (table, p, ordinal, column, kind, underlying, is key, ordinal in key).
BASE = []
for _p, (_table, _columns) in enumerate(LAYOUT):
    _in_key = 0
    for _ordinal, (_column, _type, _key) in enumerate(_columns, start=1):
        _kind, _, _underlying = _type.partition("|")
        _in_key += _key
        BASE.append((_table, _p, _ordinal, _column, _kind, _underlying or _kind, bool(_key),
                     _in_key if _key else 0))
TABLE_POSITIONS = [(name, p) for p, (name, _) in enumerate(LAYOUT)]


def _inline(rows: list[tuple]) -> str:
    """``inline(array(struct(...), ...))``: a generator over literal rows, no join."""
    def text(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return f"'{v}'" if isinstance(v, str) else str(v)
    return "inline(array(" + ", ".join(
        "struct(" + ", ".join(text(v) for v in row) + ")" for row in rows) + "))"


# A task makes the catalog of so many tenants, about.
TASK_TENANTS = 10_000


def tenant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row per tenant, spread over the cores, and over more tasks as they grow, before it fans out ~100-fold."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tasks = max(spark.sparkContext.defaultParallelism, -(-customer.count() // TASK_TENANTS))
    k = F.col("k")
    return (
        customer.select(F.col("c_custkey").alias("k"))
        .repartition(tasks, k)
        .select(k, F.concat(F.lit("t"), k.cast("string")).alias("schema"))
    )


class Tenants:
    """Lazy DataFrames of the derived catalog."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.keys = tenant_keys(spark, sf_dir)

    def _layout(self) -> DataFrame:
        names = ["table", "p", "ordinal", "column", "kind", "underlying", "is_primary_key", "in_key"]
        return (
            self.keys.select("k", "schema", F.expr(_inline(BASE)).alias(*names))
            .filter((F.col("table") != "attrs") | (F.col("k") % 3 == 0))
        )

    def _tables(self) -> DataFrame:
        return (
            self.keys.select("k", "schema", F.expr(_inline(TABLE_POSITIONS)).alias("table", "p"))
            .filter((F.col("table") != "attrs") | (F.col("k") % 3 == 0))
        )

    # -- catalog rows ---------------------------------------------------------
    def columns(self) -> DataFrame:
        return self._layout().select(
            "schema", "table", "ordinal", "column", F.col("underlying").alias("data_type"),
            (~F.col("is_primary_key")).alias("nullable"), "is_primary_key",
            F.lit(None).cast("string").alias("default"),
        )

    def stats(self) -> DataFrame:
        k = F.col("k")
        raw = (
            F.when(k % 5 == 0, F.lit(-1))
            .when(k % 5 == 2, F.lit(0))
            .when(k % 5 != 1, k * 10 + F.col("p"))
        )
        return self._tables().select("schema", "table", raw.cast("bigint").alias("row_count"))

    def tables(self) -> DataFrame:
        from cartolake.sources.constraints import known_count

        return self.stats().withColumn("row_count", known_count(F.col("row_count")))

    # -- information-schema snapshot ------------------------------------------
    def info_columns(self) -> DataFrame:
        return self._layout().select(
            "schema", "table", "column", "ordinal", F.col("kind").alias("data_type"),
            F.col("underlying").alias("udt_name"),
            F.when(F.col("is_primary_key"), "NO").otherwise("YES").alias("is_nullable"),
            F.lit(None).cast("string").alias("default"),
        )

    def info_tables(self) -> DataFrame:
        view = (F.col("table") == "labels") & (F.col("k") % 7 == 3)
        return self._tables().select(
            "schema", "table", F.when(view, "VIEW").otherwise("BASE TABLE").alias("table_type")
        )

    def schemata(self) -> DataFrame:
        k = F.col("k").cast("string")
        names = F.array("schema", F.concat(F.lit("pg_temp_"), k), F.lit("information_schema"),
                        F.lit("pg_catalog"), F.concat(F.lit("pgx"), k))
        return self.keys.select(F.explode(names).alias("schema"))

    def _links(self) -> DataFrame:
        """Foreign-key columns: one row per column of every foreign-key constraint."""
        rows = [
            # name, table, column, ordinal, position in target, target constraint
            ("customer_nation_fk", "customer", "nationkey", 1, 1, "nation_pk"),
            ("orders_customer_fk", "orders", "custkey", 1, 1, "customer_pk"),
            ("events_user_fk", "events", "user_id", 1, 1, "users_pk"),
            ("attrs_conv_fk", "attrs", "a0_name", 1, 2, "conversations_pk"),
            ("attrs_conv_fk", "attrs", "a1_name", 2, 1, "conversations_pk"),
        ]
        names = ["constraint_name", "table", "column", "ordinal", "position", "target"]
        k, name = F.col("k"), F.col("constraint_name")
        present = (
            F.when(name == "events_user_fk", k % 10 == 0)
            .when(name == "attrs_conv_fk", k % 3 == 0)
            .otherwise(k % 2 == 0)
        )
        return self.keys.select("k", "schema", F.expr(_inline(rows)).alias(*names)).filter(present)

    def key_usage(self) -> DataFrame:
        none = F.lit(None).cast("int")
        primary = self._layout().filter("is_primary_key").select(
            F.col("schema").alias("constraint_schema"),
            F.concat("table", F.lit("_pk")).alias("constraint_name"),
            "schema", "table", "column", F.col("in_key").alias("ordinal"),
            none.alias("position_in_unique_constraint"),
        )
        unique = self.keys.select(
            F.col("schema").alias("constraint_schema"), F.lit("customer_uq").alias("constraint_name"),
            "schema", F.lit("customer").alias("table"), F.lit("custkey").alias("column"),
            F.lit(1).alias("ordinal"), none.alias("position_in_unique_constraint"),
        )
        archive = self.keys.filter("k = 0").select(
            F.lit("archive").alias("constraint_schema"), F.lit("users_pk").alias("constraint_name"),
            F.lit("archive").alias("schema"), F.lit("users").alias("table"),
            F.lit("user_id").alias("column"), F.lit(1).alias("ordinal"),
            none.alias("position_in_unique_constraint"),
        )
        foreign = self._links().select(
            F.col("schema").alias("constraint_schema"), "constraint_name", "schema", "table",
            "column", "ordinal", F.col("position").alias("position_in_unique_constraint"),
        )
        return primary.unionByName(unique).unionByName(archive).unionByName(foreign)

    def constraints(self) -> DataFrame:
        primary = self._layout().filter("in_key = 1").select(
            F.col("schema").alias("constraint_schema"),
            F.concat("table", F.lit("_pk")).alias("constraint_name"),
            F.lit("PRIMARY KEY").alias("constraint_type"),
        )
        unique = self.keys.select(
            F.col("schema").alias("constraint_schema"), F.lit("customer_uq").alias("constraint_name"),
            F.lit("UNIQUE").alias("constraint_type"),
        )
        archive = self.keys.filter("k = 0").select(
            F.lit("archive").alias("constraint_schema"), F.lit("users_pk").alias("constraint_name"),
            F.lit("PRIMARY KEY").alias("constraint_type"),
        )
        foreign = self._links().filter("ordinal = 1").select(
            F.col("schema").alias("constraint_schema"), "constraint_name",
            F.lit("FOREIGN KEY").alias("constraint_type"),
        )
        return primary.unionByName(unique).unionByName(archive).unionByName(foreign)

    def referential(self) -> DataFrame:
        k, name = F.col("k"), F.col("constraint_name")
        archive = F.col("target") == "users_pk"
        gone = (name == "orders_customer_fk") & (k % 22 == 0)
        catalog = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 6 == 0, "OTHER").otherwise("MAIN")
        return self._links().filter("ordinal = 1").select(
            F.col("schema").alias("constraint_schema"), "constraint_name",
            F.when(archive, "archive").otherwise(F.col("schema")).alias("unique_constraint_schema"),
            F.when(gone, "gone_pk").otherwise(F.col("target")).alias("unique_constraint_name"),
            catalog.alias("unique_constraint_catalog"),
        )

    # -- relationships --------------------------------------------------------
    def foreign_keys(self) -> DataFrame:
        rows = [
            ("customer", "nationkey", "nation", "nationkey", 2),
            ("orders", "custkey", "customer", "custkey", 2),
            ("events", "user_id", "users", "user_id", 10),
        ]
        names = ["source_table", "source_column", "target_table", "target_column", "every"]
        edges = self.keys.select("k", "schema", F.expr(_inline(rows)).alias(*names)).filter("k % every = 0")
        target = F.when(F.col("target_table") == "users", "archive").otherwise(F.col("schema"))
        return edges.select(
            F.col("schema").alias("source_schema"), "source_table", "source_column",
            target.alias("target_schema"), "target_table", "target_column",
        )

    def relationships(self, threshold: int = 15) -> DataFrame:
        return map_relationships(self.columns(), self.foreign_keys(), threshold)

    # -- descriptions ---------------------------------------------------------
    def _slots(self) -> DataFrame:
        k, table = F.col("k"), F.col("table")
        hints = F.when(k % 2 == 1, F.array(F.lit("sales"), table)).otherwise(F.array(table, F.lit("sales")))
        return self._tables().select(
            "k", "p", "schema", "table", ((k + F.col("p")) % 7 != 0).alias("filled"),
            F.concat(F.lit("Rows about "), table).alias("description"),
            F.concat(F.lit("one row per "), table).alias("grain"),
            hints.alias("domain_hints"),
            (F.lit(0.5) + (k % 50) / F.lit(100.0)).cast("double").alias("confidence"),
        )

    @staticmethod
    def _null_unfilled(slots: DataFrame) -> DataFrame:
        keep = [F.when(F.col("filled"), F.col(c)).alias(c)
                for c in ("description", "grain", "domain_hints", "confidence")]
        return slots.select("schema", "table", *keep)

    def table_descriptions(self) -> DataFrame:
        return self._null_unfilled(self._slots())

    def column_descriptions(self) -> DataFrame:
        layout = self._layout().withColumnRenamed("underlying", "data_type")
        return layout.filter((F.col("k") + F.col("p")) % 7 != 0).select(
            "schema", "table", "column",
            F.concat(F.lit("The "), "column").alias("description"),
            semantic_type().alias("semantic_type"), pii_risk().alias("pii_risk"),
            (F.lit(0.4) + (F.col("ordinal") % 6) / F.lit(10.0)).alias("confidence"),
        )

    # -- the other side of a comparison ---------------------------------------
    def other_tables(self) -> DataFrame:
        kept = self._tables().filter(~((F.col("table") == "pages") & (F.col("k") % 4 == 1)))
        extra = self.keys.filter("k % 4 = 2").select("schema", F.lit("audit_log").alias("table"))
        return kept.select("schema", "table").unionByName(extra)

    def other_table_descriptions(self) -> DataFrame:
        k = F.col("k")
        slots = (
            self._slots()
            .withColumn("description", F.when(k % 9 == 0, F.concat("description", F.lit(" v2")))
                        .otherwise(F.col("description")))
            .withColumn("grain", F.when(k % 13 == 0, F.concat("grain", F.lit(" v2"))).otherwise(F.col("grain")))
            .withColumn("domain_hints", F.when(k % 8 == 0, F.array_append("domain_hints", F.lit("extra")))
                        .otherwise(F.reverse("domain_hints")))
            .withColumn("filled", F.when(k % 17 == 0, F.lit(False)).when(k % 19 == 0, F.lit(True))
                        .otherwise(F.col("filled")))
        )
        return self._null_unfilled(slots)

    # -- requests, responses, runs --------------------------------------------
    def sample_requests(self) -> DataFrame:
        k = F.col("k")
        limits = F.array(*[F.lit(v).cast("int") for v in (None, 1, 5, 20, 21, 0, -3)])
        name = F.when(k % 12 == 0, F.concat("table", F.lit("_x"))).otherwise(F.col("table"))
        return self._tables().select(
            (k * 100 + F.col("p")).alias("request_id"), "schema", name.alias("table"),
            F.get(limits, (k % 7).cast("int")).alias("limit"),
        )

    def outcomes(self) -> DataFrame:
        k, p = F.col("k"), F.col("p")
        event = (
            F.when((k + p) % 7 == 0, F.when(k % 2 == 0, "failed").otherwise("provider_error"))
            .when((k + p) % 5 == 0, "parse_retry").otherwise("ok")
        )
        return self._tables().select(
            "schema", "table", event.alias("event"),
            F.when(event == "failed", "bad_json").when(event == "provider_error", "timeout")
            .alias("error_reason"),
            (100 + k % 900).cast("bigint").alias("elapsed_ms"),
        )
