"""Maximal repeats with all their occurrences, against brute force."""

import collections
import hashlib
import random

import pytest

from cartolake.llm import anchors, suffixarray

LENGTH, GRAM = 40, 8


def texts():
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abc d") for _ in range(n))
    a, b, long_ = prose(60), prose(90), prose(700)
    out = [prose(200), a + prose(20) + b, prose(30) + a + "x", prose(10) + a + b, "q" + b + a, a, a[5:] + "z" + b[:50],
           long_, prose(50) + long_, "y" + long_[100:], long_[:-3] + "é" * 30, "xy" * 60, "z" + "xy" * 45, "\x00" * 90 + "k", "m" + "\x00" * 70,
           a + a + a, prose(39), "", None, long_ + long_[:300], "é" * 40]
    return out


def rows():
    listed = list(enumerate(texts()))
    # Copies, the same row twice, one text under several ids and under none.
    return [*listed, (100, listed[3][1]), (3, listed[3][1]), listed[9], (None, listed[7][1]), (101, listed[0][1]), (None, None)]


def brute(length, windows=False):
    """{bytes: {(doc_id, start)}}"""
    docs = {}
    for i, t in rows():
        docs.setdefault((t or "").encode(), []).append(i)
    name = {t: min((i for i in ids if i is not None), default=None) for t, ids in docs.items()}
    where = collections.defaultdict(list)
    for t in docs:
        for s in range(len(t) - length + 1):
            where[t[s : s + length]].append((t, s))
    found = set()
    for w, places in where.items():
        if windows:
            found |= {w} if len(places) > 1 else set()
            continue
        for n, (t, i) in enumerate(places):
            for u, j in places[:n]:
                if i and j and t[i - 1] == u[j - 1]:
                    continue
                k = length
                while i + k < len(t) and j + k < len(u) and t[i + k] == u[j + k]:
                    k += 1
                found.add(t[i : i + k])
    whole = {t for t, ids in docs.items() if len(ids) > 1 and len(t) >= length}
    out = {w: {(name[t], s, len(docs[t])) for t, s in where[w[:length]] if t[s : s + len(w)] == w} for w in found | whole}
    # Among windows, a text that has copies is listed for itself.
    return out | {t: {(name[t], 0, len(docs[t]))} for t in whole if windows}


@pytest.mark.parametrize("hot, step", [(20_000, 64), (20_000, 4096), (1, 64)])
def test_repeat_groups(spark, monkeypatch, hot, step):
    monkeypatch.setattr(anchors, "HOT_ANCHORS", hot)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in suffixarray.repeat_groups(docs, LENGTH, GRAM, step).collect():
        got[bytes(r.repeat_id), r.length].append((r.doc_id, r.start, r.copies))
    want = brute(LENGTH, windows=hot == 1)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {
        (hashlib.sha256(w).digest()[:16], len(w)): sorted(v, key=repr) for w, v in want.items()}
    assert len(want) > 30


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixarray.repeat_groups(docs).collect() == []
