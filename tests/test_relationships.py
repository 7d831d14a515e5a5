import itertools
import random

import pytest
from conftest import edge_texts, plan_of

from cartolake.functions.text import strip_prefix
from cartolake.operators import relationships as R


def inferred(columns, **kw):
    return edge_texts(R.map_relationships(columns, **kw).filter("kind = 'inferred'"))


def test_direct_name_match(catalog):
    assert inferred(catalog({"s.users": "user_id* email", "s.orders": "order_id* user_id"})) == [
        "orders.user_id > users.user_id"]


def test_role_prefix_match(catalog):
    assert inferred(catalog({"s.docs": "doc_id*", "s.assay": "assay_id* src_doc_id mydoc_id xdoc_id"})) == [
        "assay.src_doc_id > docs.doc_id"]


def test_bare_suffix_without_underscore_is_no_match(catalog):
    assert inferred(catalog({"s.a": "id*", "s.b": "b_key* paid"})) == []


def test_schemas_are_separate(catalog):
    assert inferred(catalog({"s.users": "user_id*", "t.orders": "order_id* user_id"})) == []


def test_case_matters(catalog):
    assert inferred(catalog({"s.users": "user_id*", "s.orders": "order_id* USER_ID"})) == []


def test_two_owners_are_ambiguous(catalog):
    assert inferred(catalog({"s.a": "molregno*", "s.b": "molregno*", "s.c": "c_id* molregno"})) == []


def test_two_suffixes_are_ambiguous(catalog):
    assert inferred(catalog({"s.a": "name_id*", "s.b": "id*", "s.c": "c_key* x_name_id"})) == []


def test_own_table_is_skipped_for_role_prefix_only(catalog):
    layout = {"s.emp": "emp_id* manager_emp_id", "s.x": "x_id* emp_id"}
    assert inferred(catalog(layout)) == ["x.emp_id > emp.emp_id"]


def test_own_table_skipped_leaves_the_other_owner(catalog):
    layout = {"s.a": "id* parent_id", "s.b": "id*"}
    assert inferred(catalog(layout)) == ["a.parent_id > b.id"]


def test_own_table_with_two_others_stays_ambiguous(catalog):
    layout = {"s.a": "id*", "s.b": "id* parent_id", "s.c": "id*"}
    assert inferred(catalog(layout)) == []


def test_composite_key_columns_are_neither_source_nor_target(catalog):
    layout = {"s.orders": "order_id*", "s.items": "order_id* line_no* qty", "s.notes": "note_id* line_no"}
    assert inferred(catalog(layout)) == []


def test_key_column_is_never_a_source(catalog):
    assert inferred(catalog({"s.users": "user_id*", "s.profiles": "user_id*"})) == []


@pytest.mark.parametrize("extra, kept", [(14, True), (15, False)])
def test_catch_all_threshold(catalog, extra, kept):
    # pressure = extra role-prefixed columns + one direct one
    layout = {"s.v": "name*", "s.w": "w_id* name", "s.x": " ".join(["x_id*"] + [f"a{i}_name" for i in range(extra)])}
    found = inferred(catalog(layout))
    assert ("w.name > v.name" in found) is kept
    assert len(found) == (extra + 1 if kept else 0)


def test_excluded_key_stops_causing_ambiguity(catalog):
    wide = " ".join(["x_key*"] + [f"c{i}_id" for i in range(16)])
    layout = {"s.any": "id*", "s.docs": "doc_id*", "s.x": wide, "s.y": "y_key* src_doc_id"}
    assert inferred(catalog(layout)) == ["y.src_doc_id > docs.doc_id"]


def test_declared_edges_pass_and_block(catalog, fks):
    columns = catalog({"s.users": "user_id*", "s.orders": "order_id* user_id"})
    declared = fks("s.orders.user_id > gone.people.person_id")
    rows = R.map_relationships(columns, declared).collect()
    assert [(r["kind"], r["target_table"]) for r in rows] == [("declared", "people")]


def test_pressure_counts_declared_sources_and_each_name_once(catalog):
    layout = {"s.a": "id*", "s.b": "id*", "s.c": "c_key* id x_id"}
    rows = R.match_pressure(catalog(layout)).collect()
    assert [(r["key"], r["n"]) for r in rows] == [("id", 2)]


def test_normalise_is_an_option(catalog):
    layout = {"s.customer": "c_custkey*", "s.orders": "o_orderkey* o_custkey"}
    assert inferred(catalog(layout)) == []
    assert inferred(catalog(layout), normalise=strip_prefix) == ["orders.o_custkey > customer.c_custkey"]


def test_empty_catalog(catalog):
    assert inferred(catalog({"s.x": "x*"}).filter("false")) == []


def brute_force(layout, threshold):
    """The naming rules by nested loops."""
    tables = {name: spec.split() for name, spec in layout.items()}
    pks = {n: [c[:-1] for c in cs if c.endswith("*")] for n, cs in tables.items()}
    owners = {n: p[0] for n, p in pks.items() if len(p) == 1}
    plain = [(n, c) for n, cs in tables.items() for c in cs if not c.endswith("*")]
    pressure = {pk: sum(c == pk or c.endswith("_" + pk) for _, c in plain) for pk in set(owners.values())}
    edges, many = [], []
    for n, c in plain:
        found = {(t, pk) for t, pk in owners.items() if pressure[pk] <= threshold
                 and (c == pk or (c.endswith("_" + pk) and t != n))}
        texts = [f"{n.split('.')[1]}.{c} > {t.split('.')[1]}.{pk}" for t, pk in found]
        (edges if len(found) == 1 else many).extend(texts)
    return sorted(edges), sorted(many)


@pytest.mark.parametrize("seed", range(4))
def test_random_catalogs_match_nested_loops(catalog, seed):
    rng = random.Random(seed)
    words = ["id", "doc_id", "a_doc_id", "name", "key", "x_key", "y"]
    layout = {}
    for i in range(12):
        columns = rng.sample([f"{p}{w}" for p, w in itertools.product(["", "p_", "q_"], words)], 6)
        columns = [c + ("*" if j < rng.choice([0, 1, 1, 1, 2]) else "") for j, c in enumerate(columns)]
        layout[f"s.t{i}"] = " ".join(columns)
    columns = catalog(layout)
    edges, many = brute_force(layout, 6)
    assert edge_texts(R.infer_edges(columns, 6)) == edges
    assert edge_texts(R.ambiguous_candidates(columns, threshold=6)) == many


def test_hot_key_is_dropped_before_the_join(catalog, monkeypatch):
    monkeypatch.setattr(R, "HOT_ROWS", 5)
    wide = " ".join(["x_key*"] + [f"c{i}_id" for i in range(20)])
    layout = {"s.any": "id*", "s.docs": "doc_id*", "s.x": wide, "s.y": "y_key* src_doc_id"}
    assert inferred(catalog(layout)) == ["y.src_doc_id > docs.doc_id"]


def test_plan_has_no_nested_loop(spark):
    from conftest import SF

    from cartolake.plans.tenants import Tenants
    plan = plan_of(Tenants(spark, SF).relationships())
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_names_that_no_key_has_stay_where_they_are(catalog, monkeypatch):
    columns = catalog({"s.users": "user_id* name", "s.orders": "order_id* user_id total_sum", "z.notes": "text user_id"})
    keys = R.match_keys(columns)
    assert {r["key"] for r in R.owned(keys, columns).collect()} == {"user_id"}
    want = sorted(map(tuple, R.infer_edges(columns).collect()))
    monkeypatch.setattr(R, "NAME_BITS", 1)
    assert sorted(map(tuple, R.infer_edges(columns).collect())) == want
    assert [(r[1], r[2], r[4]) for r in want] == [("orders", "user_id", "users")]
