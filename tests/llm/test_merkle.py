"""Merkle manifests against a plain restatement of trees and proofs."""

from __future__ import annotations

import hashlib
import random
import zlib

from readloom.llm import merkle
from readloom.llm.queries import manifest_leaves


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fan_out):
    """Levels of nodes from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fan_out])) for i in range(0, len(last), fan_out)])
    return levels


def plain_path(levels, i, fan_out):
    for level in levels[:-1]:
        first = i - i % fan_out
        yield level[first:i], level[i + 1 : first + fan_out]
        i //= fan_out


def plain_proofs(rows, fan_out):
    """``{(doc_id, leaf): set of results}`` of rows (doc_id, grp, leaf, claim)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(plain_tree([r[2] for r in groups[g]], fan_out))
    top = plain_tree([t[-1][0] for t in trees], fan_out)
    out = []
    for k, g in enumerate(order):
        for i, (doc, _, leaf, claim) in enumerate(groups[g]):
            proof, value = "", claim
            for left, right in [*plain_path(trees[k], i, fan_out), *plain_path(top, k, fan_out)]:
                proof += "".join(left + right)
                value = sha("".join([*left, value, *right]))
            out.append((doc, leaf, trees[k][-1][0], top[-1][0], sha(proof), value, value == top[-1][0]))
    return out


def check(spark, rows, fan_out, per_partition):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, grp string, leaf string, claim string, n string").repartition(5)
    got = [tuple(r) for r in merkle.multiproofs(df, fan_out, per_partition).collect()]
    assert sorted(got, key=str) == sorted(plain_proofs(rows, fan_out), key=str)


def test_proofs_of_many_shapes(spark):
    rng = random.Random(1)

    def rows(sizes):
        out = []
        for g, n in sizes.items():
            for _ in range(n):
                i = rng.choice([None, *range(3 * n)])
                leaf = sha(str(rng.random()))
                out.append((i, g, leaf, leaf if rng.random() < 0.7 else sha("other")))
        return out

    # partitions cut trees anywhere, so nodes of every level are fetched
    check(spark, rows({"a": 70, None: 9, "b": 1, "é": 64, "": 8, "Z": 65}), 8, 10)
    check(spark, rows({"a": 30, "b": 5}), 2, 7)
    # more groups than one run of the upper tree, and a partition over many trees
    check(spark, rows({f"g{i}": 1 + i % 3 for i in range(75)}), 8, 50)
    lone = rows({"a": 1})
    check(spark, lone, 8, 4096)
    assert plain_proofs(lone, 8)[0][4] == sha("")
    # repeated rows are leaves of their own
    check(spark, rows({"a": 3}) * 4, 8, 5)


def test_manifest_of_documents(spark):
    texts = ["Plain Text", "no capitals", None, "", "Ünïcode É", "X" * 200_000]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src"][i % 2], len(t or "")) for i, t in enumerate(texts * 9)]
    rows += [rows[0], (None, "no id", "en", "s", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp int").repartition(3)
    got = {(r.doc_id, r.leaf): r for r in merkle.multiproofs(manifest_leaves(docs)).collect()}
    for i, t, lang, source, n in rows:
        r = got[i, plain_leaf((i, source, lang, n, t))]
        lower = t is not None and t.translate({k: k + 32 for k in range(65, 91)})
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None and lower != t
        assert r.verified == (not changed)
    assert merkle.multiproofs(manifest_leaves(docs.limit(0))).count() == 0


def test_a_partition_fetches_only_what_it_cannot_derive(spark):
    held = spark.createDataFrame([(0, 0, 16, 31, 100), (1, 0, 13, 13, 100), (2, 1, 0, 63, 64)], "part long, tree long, a long, b long, n long")
    got = {}
    for r in merkle.missing_nodes(held).collect():
        got.setdefault(r.part, set()).add((r.level, r.idx))
    # two whole runs: no leaf, the six other nodes of their run, one of the two above
    assert got[0] == {(1, i) for i in (0, 1, 4, 5, 6, 7)} | {(2, 1)}
    assert got[1] == {(0, i) for i in range(8, 16) if i != 13} | {(1, i) for i in range(8) if i != 1} | {(2, 1)}
    assert 2 not in got
