"""Ranked search, rule ensembles and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolake.llm import dialogue, ranked, rules
from cartolake.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, score string, rank string, n int, terms string"


# -- ranked search ------------------------------------------------------------
def brute_ranking(docs, items):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    texts = {}
    for item, text in set(items):
        texts.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in texts.items():
        scored = []
        for d, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in terms.items() if c[t])
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(scored)[:10], start=1)]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)]  # ties beyond the ten
    docs += [(500, None), (501, ""), (502, "..., ;"), (503, "Ünïcode É W1"), (None, docs[3][1]), docs[5], docs[5],
             (504, "w1 " * 5000)]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)]
    items += [(50, docs[3][1]), (51, "nowhere"), (52, None), (53, ""), (54, "W1 w1, w1-W2"), (55, "É ünïcode"), items[0], (0, "w3")]
    return docs, items


@pytest.mark.parametrize("shard,depth", [(16_384, 32), (7, 1)])
def test_ranked_equals_brute_force(spark, monkeypatch, shard, depth):
    monkeypatch.setattr(ranked, "SHARD_ROWS", shard)
    monkeypatch.setattr(ranked.Shard.search, "__defaults__", (10, depth))
    docs, items = search_rows()
    given = spark.createDataFrame([(d, t, "s", "r", 1, "t") for d, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = sorted(map(tuple, ranked.best_documents(given, asked).collect()), key=repr)
    assert got == brute_ranking(docs, items)


def test_ranked_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_BYTES", 1500)
    docs, items = search_rows()
    given = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = ranked.best_documents(given, asked)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_ranking(docs, items)


def test_ranked_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.best_documents(docs, items).collect() == []
    assert ranked.best_documents(items.withColumnRenamed("item_id", "doc_id"), items.filter("false")).collect() == []


def test_reading_stops_early():
    # One document far ahead in every list: the ends of long lists are not read.
    n = 5000
    doc = np.tile(np.arange(n), 2)
    term = np.repeat([0, 1], n)
    impact = np.where(doc < 10, 10_000 - doc, 1).astype(np.int64)
    shard = ranked.Shard(np.arange(n), doc, term, impact, 2)

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                Counted.read += at.size
            return super().__getitem__(at)

    shard.doc = shard.doc.view(Counted)
    ids, scores = shard.search(np.array([0, 1]), np.array([1, 1]), 0)
    assert sorted(ids.tolist()) == list(range(10)) and Counted.read < 200
    assert sorted(scores.tolist(), reverse=True) == [2 * (10_000 - i) for i in range(10)]


# -- rules --------------------------------------------------------------------
def quality_rows():
    rng = random.Random(5)
    words = ["river", "stone", "walk", "under", "the", "of", "a", "light", "paper", "market", "seven", "green"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) + (rng.choice(".,") if rng.random() < 0.2 else "") for _ in range(rng.randint(5, 80)))
        kind = i % 4
        if kind == 1:
            text = " ".join(w + rng.choice(["###", "$$", "%%%"]) for w in text.split())
        rows.append((i, text, int(kind != 1)))
    return rows


def test_rules(spark):
    rows = quality_rows()
    docs = spark.createDataFrame(
        [(i, t, "q", 9) for i, t, _ in rows] + [(900, None, "q", 9), (901, "", None, 9), (902, "", "z", 9), rows[0][:2] + ("q", 9),
                                                (903, "word " * 200_000, "q", 9)],
        "doc_id long, text string, score string, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5] + [(7, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    model = rules.fit(docs, labels)
    assert 0 < len(model.rules) < 80
    scored = rules.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score", "predicted"]
    got = {r.doc_id: r for r in scored.collect()}
    held = [(got[i].predicted, q) for i, _, q in rows if i % 5 == 0]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert got[900].score == got[901].score == got[902].score and 0 <= got[903].score <= 1
    assert "ArrowEval" not in scored._jdf.queryExecution().toString() and "Python" not in scored._jdf.queryExecution().toString()
    # The compiled column is the sum of the rules that hold.
    values = rules.with_statistics(docs.filter("doc_id < 300")).select("doc_id", *[f"__s_{n}" for n in rules.NAMES]).collect()
    x = np.array([tuple(r)[1:] for r in values])
    total = model.bias + sum(r.weight * r.holds(x) for r in model.rules)
    assert np.allclose(1 / (1 + np.exp(-total)), [got[r.doc_id].score for r in values])
    again = rules.fit(docs.repartition(5), labels.repartition(2))
    assert [str(r) for r in again.rules] == [str(r) for r in model.rules]


def test_statistics(spark):
    docs = spark.createDataFrame([("Ab CD ef!!\n\nAb 12 | x.",), ("",), (None,)], "text string")
    got = [r.asDict() for r in rules.with_statistics(docs).collect()]
    want = {"letters": 9 / 22, "capital_runs": 1 / 6, "digits": 2 / 22, "symbols": 1 / 22, "full_stops": 1 / 6, "exclamations": 2 / 6,
            "bars": 1 / 6, "distinct_words": 1.0, "distinct_lines": 1.0, "words_per_line": 3.0}
    for name, value in want.items():
        assert got[0][f"__s_{name}"] == pytest.approx(value), name
    assert all(v == 0 for r in got[1:] for k, v in r.items() if k != "text")


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in rules.score(docs, rules.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in rules.score(docs, rules.fit(docs, ones)).collect()} == {0.75}
    assert rules.score(docs.filter("false"), rules.fit(docs, ones)).collect() == []


# -- conversations ------------------------------------------------------------
TOKENS = [(i, m, c) for i in ("s", "u", "a", "") for m, c in ((False, False), (False, True), (True, False))]
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """Every way to edit the rows with up to two inserts between, by (cost, audit)."""
    inserts = [("", 0, ""), *[("I", 2, x) for x in "ua"], *[("II", 4, x + y) for x in "ua" for y in "ua"]]
    options = []
    for initial, must, cut in rows:
        own = [("D", 3, "")]
        if not must:
            own += [("K", int(cut), initial or "?"), ("R", 2 + cut, "u"), ("R", 2 + cut, "a")]
        options.append([tuple(map(lambda x, y: x + y, a, b)) for a in inserts for b in own])
    best = None
    for ways in itertools.product(*options, inserts):
        if LEGAL.fullmatch("".join(w[2] for w in ways)):
            found = sum(w[1] for w in ways), "".join(w[0] for w in ways)
            best = found if best is None else min(best, found)
    return best


def whole_audits(rows):
    """Dynamic programme over the grammar's automaton that keeps whole edit texts."""
    to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(now):
        for _ in range(6):
            for q, (k, a) in list(now.items()):
                for x in set("ua") & set(to[q]):
                    now[to[q][x]] = min(now.get(to[q][x], (math.inf, "")), (k + 2, a + "I"))
        return now

    now = {0: (0, "")}
    for initial, must, cut in rows:
        new = {}
        for q, (k, a) in inserted(now).items():
            ways = [(q, (k + 3, a + "D"))]
            if not must:
                ways += [(to[q][x], (k + 2 + cut, a + "R")) for x in set("ua") & set(to[q])]
                if initial in to[q]:
                    ways.append((to[q][initial], (k + cut, a + "K")))
            for p, v in ways:
                new[p] = min(new.get(p, (math.inf, "")), v)
        now = new
    return min(v for q, v in inserted(now).items() if q in (0, 3))


def test_cheapest_edits_equal_all_edits():
    for n in (0, 1, 2):
        for rows in itertools.product(TOKENS, repeat=n):
            assert dialogue.cheapest(rows) == brute_repair(rows), rows


def test_cheapest_edits_of_long_conversations():
    rng = random.Random(2)
    for _ in range(600):
        rows = rng.choices(TOKENS, weights=[rng.random() ** 3 for _ in TOKENS], k=rng.randint(3, 60))
        assert dialogue.cheapest(rows) == whole_audits(rows), rows
    machine, frontier = dialogue.Repair(), 0
    for _ in range(20_000):
        frontier = machine.steps[machine.step(frontier, dialogue._code(*rng.choice(TOKENS)))][0]
    assert len(machine.frontiers) < 100


def brute_report(rows, ids):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) by plain loops."""
    out = []
    for conv in {i for i in ids}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).digest()[:16]))
        turns = {t for t, *_ in mine if t is not None}
        seen, faults, tokens = set(), Counter(), []
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            tokens.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tokens, tokens[1:]))
        cost, audit = whole_audits(tokens)
        repaired, need, row = [], "user", iter(mine)
        for edit in audit:
            _, role, text = (None, need, "") if edit == "I" else next(row)
            if edit == "D":
                continue
            role = role if edit == "K" else need
            repaired.append(f"{role}:{text}")
            need = "assistant" if role[:1] == "u" else "user"
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


ROWS = "conv_id long, turn long, role string, text string, audit string, cost int"


def conversation_rows():
    rng = random.Random(9)
    texts = ["Yes.", "Well", "No!\n", " \t", "", None, "Why? ", "x" * 100_000 + ".", "Ünï."]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts))
            for c in range(40) for _ in range(rng.randint(1, 9))]
    rows += [(None, i, "user", "Same.") for i in range(6)] + [(77, 1, "user", "Same.")] * 4 + [(78, None, "user", "A.")]
    rows += [(90, i, "user" if i % 3 else "assistant", f"t{i}.") for i in range(3000)]
    return rows


def test_report_equals_brute_force(spark):
    rows = conversation_rows()
    ids = [r[0] for r in rows] + [1000]
    given = spark.createDataFrame([(*r, "a", 1) for r in rows], ROWS).repartition(5)
    every = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    got = dialogue.repair_report(given, every)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_report(rows, ids)


def test_edits_in_pieces_and_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE", 7)
    rows = conversation_rows()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    plan = dialogue.plan_repairs(given)
    want = {r[0]: r[-2:] for r in brute_report(rows, [r[0] for r in rows])}
    assert {r.conv_id: (r.audit, r.repaired_sha256) for r in dialogue.digests(given, plan).collect()} == want
    kept = {}
    for r in sorted(dialogue.repaired(given, plan).collect(), key=lambda r: r.step):
        kept.setdefault(r.conv_id, []).append(r)
    for conv, (audit, digest) in want.items():
        mine = kept.get(conv, [])
        assert [r.step for r in mine] == list(range(1, len(mine) + 1))
        assert "".join(r.edit for r in mine) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == digest


def test_damage(spark):
    rows = [(c, t, r, "One. Two! Three?") for c in (*range(30), None) for t, r in ((0, "system"), (1, None), (None, "assistant"))]
    want = []
    for c, t, r, x in rows:
        r = " " if r is None else r
        mark = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if mark == 4 else r, "" if mark == 1 else re.sub("[.!?]", "", x) if mark == 2 else x)
        want += [row] * (0 if mark == 0 else 2 if mark == 3 else 1)
    got = dialogue.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_report(dialogue.damage(none), none).collect() == []


def test_registered_conversations(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in dialogue.damage(given).collect()]
    got = QUERIES["op13_conversations"](spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_report(rows, [r.conv_id for r in given.collect()])


def test_registered_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality is not null")
    scored = QUERIES["op12_quality"](spark, folder)
    right = scored.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*"))
    share, n = right.first()
    assert n > 30 and share > 0.95
