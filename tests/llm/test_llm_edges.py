"""Long texts, built collisions, full value spaces, clashing columns and empty tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartolake.llm import crosspolytope, minhash, packing, substring, surrogates, toxicity
from cartolake.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def parity_words(n=1024):
    """Two words whose polynomial hashes modulo 2^64 agree under every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_that_polynomials_confuse(spark):
    one, other = parity_words()
    texts = [" ".join([w] + [f"w{i}" for i in range(39)]) for w in (one, other)]
    rows = [(1, " ".join([one] * 1 + texts[0].split()[1:])), (2, " ".join([other] + [f"v{i}" for i in range(39)])), (3, one), (4, other)]
    hashes = substring.word_hashes([one.encode(), other.encode()])
    assert hashes[0][0] != hashes[1][0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in substring.remove_repeated(docs).collect()} == {0}
    found = {r.doc_id: r.component_id for r in minhash.near_documents(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4}
    copies = spark.createDataFrame([(1, f"{one} x " * 40), (2, f"{one} x " * 40)], "doc_id long, text string")
    assert {r.n_removed for r in substring.remove_repeated(copies).collect()} == {80}


def test_surrogates_of_very_long_texts(spark):
    rows = [(1, "x@" + "a." * 100_000 + "com"), (2, "a" * 1_000_000), (3, "1" * 1_000_000), (4, "+1 " * 50_000),
            (5, "Mr. " + "A" * 1_000_000), (6, "a.b-c@" * 50_000), (7, "1.2.3.4 " * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in surrogates.pseudonymise(docs).collect()}
    assert len(got) == len(rows) and got[2] == rows[1][1] and "1.2.3.4" not in got[7]


def remainder_97(account):
    text = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def test_surrogate_identities(spark):
    rows = [(1, "(988) 555-2485"), (2, "+1 988 555 2485"), (3, "988-555-2485"), (4, "IBAN DE89 3704 0044 0532 0130 00."),
            (5, "DE89370400440532013000"), (6, "GB82 WEST 1234 5698 7654 32"), (7, "Dr. Jane Doe and Prof. Doe")]
    got = {r.doc_id: r.text for r in surrogates.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    digits = {i: re.sub(r"\D", "", got[i]) for i in (1, 2, 3)}
    assert digits[1] == digits[3] == digits[2][1:] != "9885552485" and got[2].startswith("+1 ")
    german, plain = re.search(r"DE[\d ]+", got[4]).group(), got[5]
    assert german.replace(" ", "") == plain != "DE89370400440532013000"
    assert remainder_97(plain) == 1 == remainder_97(got[6]) and got[6][:2] == "GB"
    assert not {"Jane", "Doe"} & set(re.findall(r"\w+", got[7]))
    assert got[7].split()[2] == got[7].split()[-1]


def test_surrogates_of_a_full_space(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "LONG_FROM", 3)
    entities = spark.range(9000).select(F.lit("secret").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("norm"))
    got = surrogates.replacements(entities).collect()
    old, new = {r.norm for r in got}, {r.new for r in got}
    assert len(new) == 9000 == len(old) and not old & new
    names = spark.range(20_000).select(F.lit("name-surname").alias("kind"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("norm"))
    assert surrogates.replacements(names).select("new").distinct().count() == 20_000


def test_equal_rows_go_to_many_groups(spark):
    docs = spark.range(0, 3000, 1, 30).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same words here " * 20).alias("text"))
    got = packing.pack(docs, tokenizer(), group_bytes=20_000)
    assert got.select(F.shiftright("sequence_id", 32).alias("g")).distinct().count() > 20
    assert got.filter("start = 0").count() == 3000


def test_cells_of_many_blocks():
    # Blocks 1 and 65537 of a bucket: their cell is no cell of one block.
    cell = 1 * crosspolytope.CELLS + 65537
    assert cell // crosspolytope.CELLS != cell % crosspolytope.CELLS


def test_newton_steps_end_at_the_least_loss():
    rng = np.random.default_rng(3)
    x = rng.random((700, 9)) < 0.3
    y = (rng.random(700) < 1 / (1 + np.exp(-(x @ rng.normal(size=9))))).astype(float)
    times = rng.integers(1, 4, 700).astype(float)
    swapped = np.diag(np.arange(9.0))
    w = toxicity.fit_rows([np.flatnonzero(r).astype(np.int16) for r in x], y, times, 9, swapped.copy())
    z = x @ w[:-1] + w[-1]
    p = 1 / (1 + np.exp(-z))
    gradient = x.T @ (times * (p - y)) + w[:-1] + swapped @ w[:-1]
    assert np.abs(gradient).max() < 1e-3 and abs((times * (p - y)).sum()) < 1e-3


def test_repeated_labelled_rows_count_each(spark):
    rows = [(i, ("vile rotten " if i % 2 else "calm river ") + f"w{i % 7}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    model, again = toxicity.fit(once, labels), toxicity.fit(once.repartition(3), labels)
    assert model == again and toxicity.score(once, model).filter("predicted = doc_id % 2").count() == 60
    twice = toxicity.fit(once.unionAll(once), labels)
    assert twice.weights.keys() >= model.weights.keys()


STAGE = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_entities int, count int, size int, key string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns_and_take_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    text = "The quiet river ran under the stone bridge near market street. "
    rows = [(i, text * (i + 1) + f"number {i}", "en", "ab"[i % 2], 1, -1.0, 7, 8, 9, 10, "k") for i in range(6)]
    rows += [rows[0], (20, None, None, None, None, None, None, None, None, None, None), (21, "", "en", "a", 0, 0.0, 0, 0, 0, 0, "")]
    docs = spark.createDataFrame(rows, STAGE)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.collect() == []
    got = stage(spark, docs, SF)
    if name == "packing":
        assert got.select("doc_id").distinct().count() == 8
        return
    assert got.columns == docs.columns
    kept = [r for r in got.collect() if r.doc_id is not None and r.doc_id < 6]
    assert kept and {(r.score, r.predicted, r.n_entities, r["count"], r.size, r.key) for r in kept} == {(-1.0, 7, 8, 9, 10, "k")}
