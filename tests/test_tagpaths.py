"""The blocked tag path against the fold it restates, edge by edge."""

from __future__ import annotations

import random

import numpy as np
import pytest

from readloom.operators import consensus, tagpaths
from readloom.operators.tagpaths import LETTERS


def plain_path(edges, coverage, min_cov):
    """``edges`` are ``(tag, tag before, count)`` in order; tags are (position, ordinal, letter)."""
    value, via = {}, {}
    top, best = 0.0, None
    for tag, prev, count in edges:
        worth = count - 0.5 * (coverage.get(tag[0], 0) - 1)
        if tag not in value:
            value[tag], via[tag] = worth, prev
        if prev[2] != "." and prev in value and worth + value[prev] > value[tag]:
            value[tag], via[tag] = worth + value[prev], prev
            if value[tag] > top:
                top, best = value[tag], tag
    letters = []
    while best is not None and best in via:
        if best[2] != "-":
            letters.append(best[2] if coverage.get(best[0], 0) > min_cov else best[2].lower())
        best = via[best]
    return "".join(reversed(letters))


def plain_window(ref, reads, min_cov):
    """``reads`` are lists of tags; the window's text is one more."""
    count = {}
    for tags in [[(i, 0, b) for i, b in enumerate(ref)], *reads]:
        if not tags:
            continue
        before = (tags[0][0] - 1, 0, ".")
        for tag in tags:
            count[tag, before] = count.get((tag, before), 0) + 1
            before = tag
    coverage = {}
    for (tag, _), n in count.items():
        if tag[1] == 0:
            coverage[tag[0]] = coverage.get(tag[0], 0) + n
    ordered = sorted(((t, p, n) for (t, p), n in count.items()), key=lambda e: (e[0], e[1][0] & 0xFFFFFFFF, e[1][1:]))
    return plain_path(ordered, coverage, min_cov)


def keys(tags):
    t = np.array([(p, d, LETTERS.index(b)) for p, d, b in tags], np.int64).reshape(-1, 3)
    return tagpaths.tag_keys(t[:, 0], t[:, 1], t[:, 2])


def edges_of(reads):
    tag, before = [], []
    for tags in reads:
        if tags:
            tag += tags
            before += [(tags[0][0] - 1, 0, "."), *tags[:-1]]
    return tagpaths.count_edges(keys(tag), keys(before), np.ones(len(tag), np.int64))


def aligned(rng, ref, rate):
    """Tags of a read with errors on a part of the reference."""
    a = rng.randrange(len(ref))
    b = rng.randrange(a, len(ref)) + 1
    tags = []
    for i in range(a, b):
        tags.append((i, 0, "-" if rng.random() < rate else rng.choice("ACGT") if rng.random() < rate else ref[i]))
        d = 0
        while rng.random() < rate:
            d += 1
            tags.append((i, d, rng.choice("ACGT")))
    return tags


@pytest.mark.parametrize("length, depth, rate", [(1, 2, 0.1), (40, 3, 0.3), (700, 9, 0.12), (700, 40, 0.2), (3000, 12, 0.05), (500, 60, 0.6)])
def test_blocked_paths_equal_the_fold(length, depth, rate):
    rng = random.Random(length + depth)
    for _ in range(4):
        ref = "".join(rng.choice("ACGT") for _ in range(length))
        reads = [aligned(rng, ref, rate) for _ in range(depth)]
        tag, before, times = edges_of(reads)
        assert consensus.window_text(ref.encode(), tag, before, times, 1) == plain_window(ref, reads, 1)
        assert consensus.window_text(ref.encode(), tag, before, times, 4) == plain_window(ref, reads, 4)


def test_the_majority_wins():
    reads = [[(i, 0, b) for i, b in enumerate(t)] for t in ("ACGT", "ACGT", "AC-T")]
    assert consensus.window_text(b"ACTT", *edges_of(reads), 1) == "ACGT"
    assert consensus.window_text(b"ACTT", *edges_of([]), 1) == plain_window("ACTT", [], 1)


def test_windows_in_spark(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows, texts, want = [], [], {}
    for ctg, win, depth in ((0, 0, 12), (0, 1, 1), (7, 3, 30), (8, 0, 0)):
        ref = "".join(rng.choice("ACGT") for _ in range(300))
        reads = [aligned(rng, ref, 0.1) for _ in range(depth)]
        texts.append((ctg, win, ref))
        for tags in reads:
            before = (tags[0][0] - 1, 0, ".")
            for k, tag in enumerate(tags):
                rows.append((ctg, win, *tag, *before, len({t[0] for t in tags}) if k == 0 else 0))
                before = tag
        covered = sum(len({t[0] for t in tags}) for tags in reads)
        want[ctg, win] = plain_window(ref, reads, 1) if covered / 300 >= 1.5 else ref.lower()
    tags = spark.createDataFrame(rows, "ctg long, win int, t_pos int, delta int, base string, p_t_pos int, p_delta int, p_base string, covered long")
    counted = tags.select(
        "ctg", "win", consensus.tag_key("t_pos", "delta", "base").alias("tag"), consensus.tag_key("p_t_pos", "p_delta", "p_base").alias("before"),
        F.lit(1).cast("long").alias("times"), "covered",
    )
    got = consensus.window_consensus(consensus.merged_tags(counted), spark.createDataFrame(texts, "ctg long, win int, ref string"), 1.5)
    assert {(r.ctg, r.win): r.seq for r in got.collect()} == want
