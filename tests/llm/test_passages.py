"""Removal of repeated passages against a comparison of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import zstandard

from readloom.llm import passages

N = passages.WINDOW


def plain(rows):
    """``(doc_id, n_words, n_removed, kept)`` of every row ``(doc_id, text)``."""
    words = [[w for w in (t or "").translate(dict.fromkeys((32, 9, 10, 11, 12, 13), " ")).split(" ") if w] for _, t in rows]
    rank = [passages.NO_ID if i is None else i for i, _ in rows]
    first = {}
    for r, ws in zip(rank, words, strict=True):
        for i in range(len(ws) - N + 1):
            key = tuple(ws[i : i + N])
            first[key] = min(r, first.get(key, r))
    out = []
    for (doc, _), r, ws in zip(rows, rank, words, strict=True):
        gone = set()
        for i in range(len(ws) - N + 1):
            if first[tuple(ws[i : i + N])] < r:
                gone |= set(range(i, i + N))
        out.append((doc, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Łódź", "a b", "the"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, near = [prose(n) for n in (49, 50, 51, 120, 400)], prose(300)
    rows = []
    for i in range(120):
        ws = prose(rng.randrange(0, 90))
        if i % 3 == 0:
            ws += rng.choice(shared) + prose(rng.randrange(30))
        if i % 7 == 0:
            copy = list(near)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(300)] = "changed"
            ws = copy
        rows.append((i, rng.choice([" ", "\n", "  \t "]).join(ws)))
    whole = " ".join(prose(200))
    rows += [(300 + i, whole) for i in range(10)] + [(None, whole), (None, whole), (301, whole), (301, " ".join(shared[4]))]
    rows += [(400, None), (401, ""), (402, " \n "), (403, " ".join(["again"] * 3000)), (404, " ".join(["again"] * 700)), (405, "again " * 49)]
    rows += [(500, "x" * 300_000), (None, " ".join(shared[3])), (-5, " ".join(shared[3][:60]))]
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, h string, t1 int, spans int").repartition(5)


def test_digests_equal_the_comparison_of_all_windows(spark, monkeypatch):
    rows = corpus()
    want = sorted(((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in plain(rows)), key=str)
    docs = docs_of(spark, rows)
    assert sorted(map(tuple, passages.passage_digests(docs).collect()), key=str) == want
    # all buckets full: windows go by digest
    every = docs.select("doc_id", "text").mapInArrow(passages._buckets, "h long").distinct().toArrow()["h"].to_numpy()
    for hot in (np.sort(every), np.sort(every)[::2]):
        monkeypatch.setattr(passages, "hot_buckets", lambda _, hot=hot: hot)
        assert sorted(map(tuple, passages.passage_digests(docs).collect()), key=str) == want
    assert passages.passage_digests(docs.limit(0)).count() == 0


def test_full_buckets_are_found(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of(spark, [(i, text) for i in range(50)] + [(100 + i, " ".join(f"v{i}w{j}" for j in range(80))) for i in range(20)])
    monkeypatch.setattr(passages, "HOT_ROWS", 40)
    low = passages.hot_buckets(docs)
    assert 1 <= len(low) <= 3
    got = {r.doc_id: r.n_removed for r in passages.passage_digests(docs).collect()}
    assert got == {i: 60 if 0 < i < 50 else 0 for i in [*range(50), *range(100, 120)]}


def test_texts_without_passages(spark):
    rows = corpus(2)
    kept = {}
    for (i, t), (_, _, m, k) in zip(rows, plain(rows), strict=True):
        kept.setdefault(i, []).append(k if m else t)
    out = passages.without_passages(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "h", "t1", "spans"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert {i: sorted(ts, key=str) for i, ts in got.items()} == {i: sorted(ts, key=str) for i, ts in kept.items()}


def test_super_kmers_hold_every_window_once():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)) for n in (49, 50, 700, 3, 1200)] + ["again " * 900]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    seen = {}
    for part in passages._super_kmers(np.zeros(0, np.int64))([batch]):
        for r in part.to_pylist():
            ws = passages._window_list(zstandard.decompress(r["packed"]))
            assert 1 <= len(ws) <= passages.LONGEST
            for i, w in enumerate(ws):
                key = (r["doc"], r["at"] + i)
                assert key not in seen
                seen[key] = (w.decode(), r["h"])
    want = {}
    for d, t in enumerate(texts):
        ws = t.split()
        want |= {(d, i): " ".join(ws[i : i + N]) for i in range(len(ws) - N + 1)}
    assert {k: w for k, (w, _) in seen.items()} == want
    # equal windows share their bucket
    buckets = {}
    for w, h in seen.values():
        assert buckets.setdefault(w, h) == h
