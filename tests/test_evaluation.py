import pytest
from conftest import SF, edge_texts, plan_of

from cartolake.operators import diff, edges, judge, quality, search
from cartolake.operators.relationships import infer_edges
from cartolake.plans.tenants import Tenants

TD = "schema string, `table` string, description string, grain string, domain_hints array<string>, confidence double"
CD = ("schema string, `table` string, `column` string, description string, semantic_type string, pii_risk string, "
      "confidence double")


# -- edges --------------------------------------------------------------------
def test_edge_metrics_and_breakdown(catalog, fks):
    columns = catalog({"s.products": "product_id*", "s.orders": "order_id* user_id",
                       "s.items": "item_id* order_id product_id"})
    declared = fks("s.items.order_id > s.orders.order_id", "s.orders.user_id > s.users.user_id",
                   "s.items.order_id > s.orders.order_id")
    compared = edges.compare_edges(declared, infer_edges(columns))
    row = edges.edge_metrics(compared).first()
    assert (row["declared_count"], row["inferred_count"], row["matched_count"]) == (2, 2, 1)
    assert (row["recall"], row["precision"], row["f1"]) == (0.5, 0.5, 0.5)
    by_table = {r["table"]: tuple(r)[2:] for r in edges.edge_breakdown(compared).collect()}
    assert by_table == {"items": (1, 1, 0, 1), "orders": (1, 0, 1, 0)}
    assert edge_texts(compared.filter("status = 'missed'")) == ["orders.user_id > users.user_id"]


def test_edge_metrics_without_denominators(fks):
    some, none = fks("s.a.x > s.b.y"), fks("s.a.x > s.b.y").filter("false")
    row = edges.edge_metrics(edges.compare_edges(none, some)).first()
    assert (row["recall"], row["precision"], row["f1"]) == (None, 0.0, None)
    row = edges.edge_metrics(edges.compare_edges(some, none)).first()
    assert (row["recall"], row["precision"], row["f1"]) == (0.0, None, None)
    row = edges.edge_metrics(edges.compare_edges(some, fks("s.a.x > s.c.y"))).first()
    assert (row["recall"], row["precision"], row["f1"]) == (0.0, 0.0, None)


# -- quality ------------------------------------------------------------------
def test_coverage_and_orphans(spark, tables, fks):
    t = tables("s.a", "s.b", "s.c")
    td = spark.createDataFrame([("s", "a", "A", "g", [], 0.9), ("s", "b", None, None, None, None),
                                ("s", "c", "C", "g", [], 0.5)], TD)
    rels = fks("s.a.x > s.b.y", "s.a.x > s.a.y", "s.a.x > s.ghost.y")
    row = quality.coverage(t, td, rels).first()
    assert (row["table_count"], row["description_present"], row["description_null"]) == (3, 2, 1)
    assert row["relationship_coverage"] == pytest.approx(2 / 3) and row["relationship_count"] == 3
    assert [r["table"] for r in quality.orphans(t, rels).collect()] == ["c"]
    counts = {r["table"]: r["incident"] for r in quality.incident_counts(t, rels).collect()}
    assert counts == {"a": 4, "b": 1, "c": 0}


def test_quality_of_nothing(spark, tables, fks):
    empty = spark.createDataFrame([], TD)
    row = quality.coverage(tables("s.a").filter("false"), empty, fks("s.a.x > s.b.y").filter("false")).first()
    assert (row["table_count"], row["description_coverage"], row["relationship_coverage"]) == (0, 0.0, 0.0)
    columns = spark.createDataFrame([], CD)
    assert {(r["pii_risk"], r["n"]) for r in quality.pii_distribution(columns).collect()} == {
        ("none", 0), ("low", 0), ("medium", 0), ("high", 0)}
    assert quality.confidence(empty, columns).count() == 0


# -- search -------------------------------------------------------------------
@pytest.fixture
def texts(spark, catalog, tables):
    t = tables("s.users", "s.orders", "s.events", "a.misc")
    columns = catalog({"s.users": "user_id* email", "s.orders": "order_id* user_id", "s.events": "event_id*",
                       "a.misc": "x*"})
    td = spark.createDataFrame([("s", "users", "People who log in", "one per person", ["zebra"], 0.9),
                                ("s", "orders", "Purchases", None, [], 0.9),
                                ("s", "events", None, None, None, None), ("a", "misc", "User notes", "g", [], 0.9)], TD)
    cd = spark.createDataFrame([("s", "users", "email", "Contact address", "dimension", "high", 0.9)], CD)
    return search.search_texts(t, columns, td, cd)


def hits(df):
    return [(r["query_id"], r["rank"], f"{r['schema']}.{r['table']}", r["match_type"])
            for r in df.orderBy("query_id", "rank").collect()]


def test_search_tiers_and_order(texts):
    assert hits(search.search(texts, [(1, "USER")])) == [
        (1, 1, "s.users", "table_name"), (1, 2, "s.orders", "column_name"), (1, 3, "a.misc", "description_body")]


def test_search_bodies(texts):
    assert [h[2] for h in hits(search.search(texts, [(1, "contact addr")]))] == ["s.users"]
    assert [h[2] for h in hits(search.search(texts, [(1, "one per")]))] == ["s.users"]
    assert hits(search.search(texts, [(1, "zebra"), (2, "int"), (3, "")])) == []


def test_search_limit(texts):
    assert len(hits(search.search(texts, [(1, "user")], limit=2))) == 2
    assert hits(search.search(texts, [(1, "user")], limit=0)) == []
    with pytest.raises(ValueError):
        search.search(texts, [(1, "user")], limit=-1)


def test_search_many_needles_in_passes(texts, monkeypatch):
    queries = [(i, w) for i, w in enumerate(["user", "email", "order", "event", "purch", "x"])]
    want = hits(search.search(texts, queries))
    monkeypatch.setattr(search, "NEEDLES_PER_PASS", 2)
    assert hits(search.search(texts, queries)) == want


def test_search_metrics(spark, texts):
    queries = spark.createDataFrame([(1, "user"), (2, "nothing"), (3, "email")], "query_id int, query string")
    expected = spark.createDataFrame([(1, "s.orders"), (1, "s.ghost"), (1, "s.orders"), (2, "s.users")],
                                     "query_id int, key string")
    ranked = search.search(texts, [(1, "user"), (2, "nothing"), (3, "email")])
    per_query = search.search_metrics(ranked, queries, expected)
    rows = {r["query_id"]: r for r in per_query.collect()}
    assert rows[1]["precision"] == pytest.approx(1 / 3) and rows[1]["recall"] == 0.5
    assert rows[1]["reciprocal_rank"] == 0.5
    assert (rows[2]["precision"], rows[2]["recall"], rows[2]["reciprocal_rank"]) == (0, 0, 0)
    assert (rows[3]["returned"], rows[3]["recall"]) == (1, 0)
    summary = search.search_summary(per_query).first()
    assert summary["query_count"] == 3 and summary["mean_reciprocal_rank"] == pytest.approx(1 / 6)
    assert tuple(search.search_summary(per_query.filter("false")).first()) == (0, 0.0, 0.0, 0.0)


def test_search_plan_limits_before_the_shuffle(spark):
    t = Tenants(spark, SF)
    ranked = search.search(search.search_texts(
        t.tables(), t.columns(), t.table_descriptions(), t.column_descriptions()), [(1, "order"), (2, "doc")])
    plan = plan_of(ranked)
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# -- diff ---------------------------------------------------------------------
def test_diff(spark, tables, fks):
    from pyspark.sql import functions as F
    cur_rel = fks("s.a.x > s.b.y", "s.a.z > s.c.y").withColumn("kind", F.lit("inferred"))
    oth_rel = fks("s.a.x > s.b.y", "s.a.w > s.c.y").withColumn("kind", F.lit("declared"))
    cur = [("s", "same", "d", "g", ["a", "b"], 0.5), ("s", "text", "d2", "g", ["a"], 0.5),
           ("s", "grain", "d", "g2", ["a"], 0.5), ("s", "conf", "d", "g", ["a"], 0.75),
           ("s", "hints", "d", "g", ["a", "c"], 0.5), ("s", "new", "d", "g", [], 0.5),
           ("s", "lost", None, None, None, None), ("s", "both_null", None, None, None, None)]
    oth = [("s", "same", "d", "g", ["b", "a"], 0.5), ("s", "text", "d", "g", ["a"], 0.5),
           ("s", "grain", "d", "g", ["a"], 0.5), ("s", "conf", "d", "g", ["a"], 0.5),
           ("s", "hints", "d", "g", ["b", "a"], 0.5), ("s", "new", None, None, None, None),
           ("s", "lost", "d", "g", [], 0.5), ("s", "gone", "d", "g", [], 0.5)]
    changes = diff.diff(tables("s.a", "s.b"), tables("s.b", "s.c"), cur_rel, oth_rel,
                        spark.createDataFrame(cur, TD), spark.createDataFrame(oth, TD))
    rows = {(r["change_type"], r["table"]): r for r in changes.collect()}
    assert set(rows) == {
        ("table_added", "a"), ("table_removed", "c"), ("relationship_added", "a"), ("relationship_removed", "a"),
        ("description_added", "new"), ("description_removed", "lost"), ("description_removed", "gone"),
        ("description_changed", "text"), ("description_changed", "grain"), ("description_changed", "conf"),
        ("description_changed", "hints")}
    assert rows["relationship_added", "a"]["kind"] == "inferred"
    assert rows["relationship_removed", "a"]["kind"] == "declared"
    assert rows["description_changed", "conf"]["confidence_delta"] == 0.25
    assert rows["description_changed", "hints"]["hints_added"] == ["c"]
    assert rows["description_changed", "hints"]["hints_removed"] == ["b"]
    assert {r["change_type"]: r["n"] for r in diff.diff_counts(changes).collect()}["description_changed"] == 4


def test_diff_of_equal_bundles_is_empty(spark):
    t = Tenants(spark, SF)
    same = diff.description_changes(t.table_descriptions(), t.table_descriptions())
    assert same.count() == 0


# -- round robin --------------------------------------------------------------
def test_round_robin(spark, tables):
    t = tables("a.z", "a.b", "a.c", "b.x", "c.m", "c.n")
    td = spark.createDataFrame(
        [(s, n, None if n == "c" else "d", "g", [], 0.5) for s, n in
         [("a", "z"), ("a", "b"), ("a", "c"), ("b", "x"), ("c", "m"), ("c", "n")]], TD)
    everything = [(r["round"], f"{r['schema']}.{r['table']}") for r in
                  judge.round_robin(t, td).orderBy("round", "schema").collect()]
    assert everything == [(1, "a.b"), (1, "b.x"), (1, "c.m"), (2, "a.z"), (2, "c.n")]
    first = judge.round_robin(t, td, 4).orderBy("position").collect()
    assert [f"{r['schema']}.{r['table']}" for r in first] == ["a.b", "b.x", "c.m", "a.z"]
    assert judge.round_robin(t, td, 99).count() == 5
