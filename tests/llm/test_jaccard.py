"""Jaccard join against all pairs of a small fixture."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from readloom.llm import jaccard


def brute(rows, size, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and den * len(a & b) >= num * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    names = {k: min((rows[i][0] for i, x in enumerate(label) if x == k and rows[i][0] is not None), default=None) for k in label}
    return sorted(((r[0], len(s), names[k] if s else r[0]) for r, s, k in zip(rows, sets, label)), key=str)


def texts(seed, families=5, copies=12, words=80):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(20))
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t) if rng.random() < 0.7 else passage + "\n" + " ".join(t))
    return out


EDGE = ["", None, "  \t\n ", "one", "One", "one two", "ONE\ttwo", "one two three", "é É", "x " * 5000, "x " * 4000]


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100), (2, 100, 100)])
def test_same_as_all_pairs(spark, monkeypatch, size, num, den):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "HOT_TOKENS", 5)
    rows = list(enumerate(texts(1) + EDGE + EDGE))
    df = spark.createDataFrame([(i, t, "a", i) for i, t in rows], "doc_id long, text string, node string, gid long").repartition(5)
    got = sorted(map(tuple, jaccard.jaccard_components(df, size, num, den).collect()), key=str)
    assert got == brute(rows, size, num, den)


def test_repeated_and_null_ids(spark):
    same = " ".join("v%d" % i for i in range(40))
    rows = [(4, same), (4, same), (None, same), (4, "other words here"), (None, "nothing like it at all"), (2, same + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(df, 3, 90, 100).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)


def test_empty_table_and_kept_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert jaccard.jaccard_components(df).count() == 0
    same = " ".join("v%d" % i for i in range(40))
    df = spark.createDataFrame([(3, same, "x"), (1, same + " y", None), (2, None, "z"), (None, "w", "q")], "doc_id long, text string, lang string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}
    assert kept.where(F.col("doc_id") == 1).first().text == same + " y"
