import random

import pytest

from cartolake.operators import graph, skew


def labels_of(catalog_tables, edges):
    """Components by union-find; returns {table: (root set size)} for catalog tables."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for t in catalog_tables:
        find(t)
    for a, b in edges:
        parent[find(a)] = find(b)
    sizes = {}
    for x in list(parent):
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    return {t: sizes[find(t)] for t in catalog_tables}


def run(tables, fks, names, edges):
    t = tables(*[f"s.{n}" for n in names])
    r = fks(*[f"s.{a}.x > s.{b}.y" for a, b in edges])
    labels = graph.components(t, r)
    return {x["table"]: x["component_size"] for x in graph.table_components(labels).collect()}, labels


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(tables, fks, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    edges = [(rng.choice(names + ["ghost1", "ghost2"]), rng.choice(names)) for _ in range(22)]
    got, labels = run(tables, fks, names, edges)
    want = labels_of(names, edges)
    assert got == want
    row = graph.graph_summary(labels).first()
    assert row["largest_component_size"] == max(want.values())
    assert row["mean_reachable"] == pytest.approx(sum(want.values()) / len(want))


def test_long_chain_takes_few_rounds(tables, fks, monkeypatch):
    rounds = []
    real = graph._small_star
    monkeypatch.setattr(graph, "_small_star", lambda *a: rounds.append(1) or real(*a))
    names = [f"n{i:03d}" for i in range(100)]
    order = names[:]
    random.Random(1).shuffle(order)
    got, _ = run(tables, fks, names, list(zip(order, order[1:])))
    assert set(got.values()) == {100}
    assert len(rounds) <= 8


def test_star_with_a_hot_centre(tables, fks, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(graph, "lookup_join", lambda *a, **kw: skew.lookup_join(*a, **kw, hot_rows=3, salts=4))
    names = [f"n{i}" for i in range(20)]
    got, _ = run(tables, fks, names, [(n, "centre") for n in names])
    assert set(got.values()) == {21}


def test_phantom_endpoints_count_and_self_edges_do_not_join(tables, fks):
    got, labels = run(tables, fks, ["a", "b", "c"], [("a", "ghost"), ("b", "b")])
    assert got == {"a": 2, "b": 1, "c": 1}
    row = graph.graph_summary(labels).first()
    assert (row["components"], row["largest_component_size"]) == (3, 2)
    assert row["mean_reachable"] == pytest.approx(4 / 3)


def test_component_may_exceed_the_table_count(tables, fks):
    _, labels = run(tables, fks, ["a"], [("a", "g1"), ("a", "g2")])
    assert graph.graph_summary(labels).first()["largest_component_fraction"] == 3.0


def test_empty_catalog(tables, fks, spark):
    labels = graph.components(tables("s.a").filter("false"), fks("s.a.x > s.b.y").filter("false"))
    assert tuple(graph.graph_summary(labels).first()) == (0, 0, 0.0, 0.0)


def test_id_collisions_try_another_seed(tables, fks, monkeypatch):
    from pyspark.sql import functions as F
    real = graph._node_id
    seeds = []

    def weak(seed, schema, table):
        seeds.append(seed)
        return F.lit(7).cast("bigint") if seed == 0 else real(seed, schema, table)
    monkeypatch.setattr(graph, "_node_id", weak)
    got, _ = run(tables, fks, ["a", "b", "c", "d"], [("a", "b"), ("c", "d")])
    assert set(got.values()) == {2} and max(seeds) == 1


@pytest.mark.parametrize("run_edges", [1, 3, 40])
def test_runs_of_edges_are_linked_by_shared_nodes(tables, fks, spark, monkeypatch, run_edges):
    monkeypatch.setattr(graph, "RUN_EDGES", run_edges)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 5)
    rng = random.Random(run_edges)
    names = [f"s{i % 4}.n{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice([*names, "x.ghost"])) for _ in range(30)]
    labels = graph.components(tables(*names), fks(*[f"{a}.c > {b}.d" for a, b in [*edges, *edges[:9]]]))
    got = {f"{x['schema']}.{x['table']}": x["component_size"] for x in graph.table_components(labels).collect()}
    assert got == labels_of(names, edges)


def test_edges_that_stay_in_their_schema_need_no_rounds(tables, fks, monkeypatch):
    """What is connected within a schema is contracted where it lies; rounds see links of schemas only."""
    rounds = []
    real = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda edges, total: rounds.append(edges.count()) or real(edges, total))
    names = [f"s{i % 5}.n{i:02d}" for i in range(50)]
    chains = list(zip(names, names[5:]))
    labels = graph.components(tables(*names), fks(*[f"{a}.c > {b}.d" for a, b in chains]))
    got = {x["component_size"] for x in graph.table_components(labels).collect()}
    assert got == {10} and not rounds


def test_null_names_are_nodes_of_their_own(tables, fks, spark):
    listed = tables("s.a", "s.b").unionByName(spark.createDataFrame([(None, "a", None)], tables("s.a").schema))
    edge = spark.createDataFrame([("s", "a", "x", None, "b", "y"), (None, "a", "x", None, "a", "y")], fks("s.a.x > s.b.y").schema)
    labels = graph.components(listed, edge)
    got = {(x["schema"], x["table"]): x["component_size"] for x in graph.table_components(labels).collect()}
    assert got == {("s", "a"): 2, ("s", "b"): 1, (None, "a"): 1}
