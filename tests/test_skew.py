import random

import pytest

from cartolake.operators.skew import group_rank, lookup_join


def data(spark):
    rng = random.Random(7)
    keys = ["hot"] * 400 + [f"k{rng.randrange(40)}" for _ in range(200)] + [None] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string").repartition(5)
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(30)]], "k string, v int")
    return rows, lookup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_a_plain_join(spark, how):
    rows, lookup = data(spark)
    want = sorted(map(tuple, rows.join(lookup, "k", how).select("id", "k").collect()))
    got = lookup_join(rows, lookup, ["k"], how, hot_rows=10, salts=8)
    assert sorted(map(tuple, got.select("id", "k").collect())) == want


def test_hot_key_is_spread(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, lookup = data(spark)
        joined = lookup_join(rows, lookup, ["k"], hot_rows=100, salts=16).filter("k = 'hot'")
        sizes = [n for n in joined.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
        assert sum(sizes) == 400 and len(sizes) > 1 and max(sizes) < 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_small_total_means_a_plain_join(spark):
    rows, lookup = data(spark)
    got = lookup_join(rows, lookup, ["k"], total=605)
    assert "__salt" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == rows.join(lookup, "k").count()


def test_group_rank_matches_a_window(spark):
    rng = random.Random(3)
    names = [("big", f"t{i:05d}") for i in range(900)] + [(f"s{i % 7}", f"t{i}") for i in range(100)]
    rng.shuffle(names)
    df = spark.createDataFrame(names, "g string, n string")
    want = {}
    for g, n in sorted(names):
        want[(g, n)] = want.get(g, 0) + 1
        want[g] = want[(g, n)]
    got = {(r["g"], r["n"]): r["rank"] for r in group_rank(df, ["g"], ["n"], partitions=8).collect()}
    assert got == {k: v for k, v in want.items() if isinstance(k, tuple)}
