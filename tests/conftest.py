import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartolake.session import configure  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("cartolake-tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


COLUMN_DDL = ("schema string, `table` string, ordinal int, `column` string, data_type string, nullable boolean, "
              "is_primary_key boolean, `default` string")


@pytest.fixture
def catalog(spark):
    """catalog({"schema.table": "key* other ..."}): column rows, a star marks key columns."""
    def build(layout):
        rows = []
        for name, spec in layout.items():
            schema, table = name.split(".")
            for i, column in enumerate(spec.split(), start=1):
                key = column.endswith("*")
                rows.append((schema, table, i, column.rstrip("*"), "int", not key, key, None))
        return spark.createDataFrame(rows, COLUMN_DDL)
    return build


@pytest.fixture
def tables(spark):
    def build(*names):
        rows = [(*n.split(".")[:2], None) for n in names]
        return spark.createDataFrame(rows, "schema string, `table` string, row_count bigint")
    return build


EDGE_DDL = ("source_schema string, source_table string, source_column string, "
            "target_schema string, target_table string, target_column string")


@pytest.fixture
def fks(spark):
    """fks("s.orders.user_id > s.users.user_id", ...)"""
    def build(*edges):
        rows = [tuple(p for end in e.split(" > ") for p in end.split(".")) for e in edges]
        return spark.createDataFrame(rows, EDGE_DDL)
    return build


def edge_texts(df):
    """Edges as 'table.column > table.column' (schemas left out), sorted."""
    return sorted(f"{r['source_table']}.{r['source_column']} > {r['target_table']}.{r['target_column']}"
                  for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
