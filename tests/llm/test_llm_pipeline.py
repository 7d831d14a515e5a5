"""The pipeline's stages: columns, decisions, and agreement with the operators they call."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cartolake.llm import mixing

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 0),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 0),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "de", "b", 0),
    (3, "one two three", None, None, None), (None, None, "en", "b", 3), (None, "mail me at some.one@example.org now", "en", "a", 0),
    (4, "", "en", "c", 0), (5, "w " * 500, "en", "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_near_copies_leave_one_row(spark, docs):
    got = cp.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 1, 3, 4, 5]


def test_near_copies_from_four_fifths_on(spark):
    """86 of 106 shingles (0.81) make a near copy, 81 of 111 (0.73) do not."""
    words = [f"w{i}" for i in range(100)]
    changed = lambda *at: " ".join("new" + w if i in at else w for i, w in enumerate(words))
    other = lambda *at: changed(*at).replace("w", "v")
    rows = [(1, changed(), "en", "a", 0), (2, changed(30, 60), "en", "a", 0), (3, other(), "en", "a", 0),
            (4, other(20, 45, 70), "en", "a", 0)]
    got = cp.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_near_copies_of_ids_with_several_texts(spark):
    """Each text of an id is judged by itself: one that is a copy goes, one that is not stays."""
    text = lambda p, *at: " ".join(f"new{p}{i}" if i in at else f"{p}{i}" for i in range(60))
    rows = [(3, text("a"), "en", "a", 0), (5, text("b"), "en", "a", 0), (5, text("a", 30), "en", "a", 0), (5, text("c"), "de", "b", 1),
            (5, text("c"), "en", "a", 0), (6, text("d"), "en", "a", 0), (6, text("d", 30), "en", "a", 0), (6, text("d").upper(), "en", "a", 0),
            (7, text("c", 30), "en", "a", 0), (8, "", "en", "a", 0), (8, " ", "en", "a", 0), (8, "", "en", "b", 0)]
    got = collections.Counter((r.doc_id, (r.text or " ").lower().split(" ")[0]) for r in cp.drop_near_copies(
        spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect())
    assert got == {(3, "a0"): 1, (5, "b0"): 1, (5, "c0"): 1, (6, "d0"): 1, (8, ""): 2}


def test_private_data_go(spark, docs):
    got = cp.replace_private(spark, docs, "").collect()
    assert len(got) == len(ROWS)
    assert not any("some.one" in (r.text or "") for r in got)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_mixing_takes_what_the_mix_says(spark, docs):
    told = mixing.mix(docs)[0].collect()
    got = cp.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    want, have = collections.Counter(), collections.Counter()
    for r in told:
        want[r.doc_id, r.source] += r.taken
    for r in got.collect():
        have[r.doc_id, r.source] += len((r.text or "").split())
    assert {k: v for k, v in want.items() if v} == dict(have)


def test_a_cut_document_keeps_its_spacing(spark):
    rows = [(i, "".join(f" w{i}{k}" + ("\n\n  " if k % 3 == 0 else "\t") for k in range(50 * i)), "en", "abc"[i % 3], 0) for i in range(1, 7)]
    texts, got = {r[0]: r[1] for r in rows}, cp.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert any(r.text != texts[r.doc_id] for r in got)
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got)


def test_run(spark, tmp_path):
    """Toxic documents and copies are gone, and every id of what is left is packed once."""
    words = ["river", "stone", "quiet", "table", "green", "paper", "music", "window"]
    rows = [(i, " ".join(words[(i * k + k * k) % 8] + str(i * k % 91) for k in range(1, 40)) + (" scumbag" if i % 5 == 0 else ""),
             "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(1000 + i, rows[1][1], "en", "s1", 0) for i in range(10)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 5 == 0)) for r in rows[:150]], "doc_id long, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    got = cp.run(spark, str(tmp_path))
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert not any(i % 5 == 0 for i in ids if i < 200) and not any(i >= 1000 for i in ids)
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.filter("n != end or n > 4096").count() == 0
