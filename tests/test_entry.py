import os
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import SF

import __spark_entry__ as entry
import check
from cartolake.plans.oracle import ORACLE
from cartolake.plans.queries import QUERIES

ROOT = Path(check.__file__).parent
# All queries take minutes; set CARTOLAKE_ALL=1 (or run check.py) for every one of them.
SAMPLE = ["s1_discover_columns", "s5_foreign_key_pairs", "j3_map_relationships", "j3_profiled_tables", "r1_search",
          "j9_adjudicate", "o3_diff", "g1_components", "u3_parse_descriptions", "p7_scrub", "e3_incremental"]


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.queries()) >= set(entry.oracle_sql()) >= set(ORACLE)


def test_flagship(spark):
    edges = {f"{r['source_column']} > {r['target_table']}" for r in entry.entry(spark).collect()}
    assert {"o_custkey > customer", "l_orderkey > orders", "c_nationkey > nation"} <= edges


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("CARTOLAKE_ALL") else SAMPLE)
def test_query_equals_sql(spark, name):
    ok, text, _, _ = check.compare(spark, check.connect(SF), SF, name)
    assert ok, text


def test_results_do_not_depend_on_partitioning(spark):
    def run():
        return sorted(map(tuple, entry.queries()["j3_map_relationships"](spark, SF).collect()))
    want = run()
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert run() == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
