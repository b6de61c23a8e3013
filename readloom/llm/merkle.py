"""Merkle manifest of a dataset: hash trees by group, and proofs expanded from one multiproof a leaf partition."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import cut_lineage, global_index, join_bounded, scratch_scope

FAN_OUT = 8
LEAVES = 4096  # leaves of a partition that shares one multiproof
TOP = -1  # number of the tree whose leaves are the roots of all others
NODE = ["tree", "level", "idx"]


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def indexed_leaves(leaves: DataFrame) -> DataFrame:
    """``pos, tree, idx, n`` added to every row of ``leaves(doc_id, grp, leaf, claim)``.

    ``tree`` numbers the groups in order (null first), ``idx`` the leaves of a
    group by ``doc_id`` (null first) and then by hash, ``pos`` all leaves;
    ``n`` counts the leaves of the tree.  The order comes from a range sort, so
    a group of any size is spread over many tasks.
    """
    # the sort samples its input: hash once, sort narrow rows
    narrow = cut_lineage(leaves.select("doc_id", "grp", "leaf", "claim"))
    placed = global_index(narrow, [F.asc_nulls_first("grp"), F.asc_nulls_first("doc_id"), "leaf"], "pos")
    placed = cut_lineage(placed.withColumn("key", F.coalesce(F.concat(F.lit("="), "grp"), F.lit(""))))
    groups = placed.groupBy("key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = cut_lineage(global_index(groups, ["first"], "tree"))
    return cut_lineage(
        join_bounded(placed, trees, "key").select("doc_id", "leaf", "claim", "pos", "tree", (F.col("pos") - F.col("first")).alias("idx"), "n")
    )


def tree_nodes(leaves: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """All nodes of the trees over ``leaves(tree, idx, n, hash)``: ``tree, level, idx, hash, n``, ``n`` nodes in the level.

    A level is made from the one below while any tree has several nodes there.
    No group holds more than ``fan_out`` rows.
    """
    level = leaves.select("tree", F.lit(0).alias("level"), "idx", "hash", "n")
    out = level
    while True:
        run = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        level = cut_lineage(
            level.where("n > 1")
            .groupBy("tree", "level", "n", F.expr(f"idx div {fan_out}").alias("up"))
            .agg(F.sha2(F.array_join(F.transform(run, lambda r: r["hash"]), "").cast("binary"), 256).alias("hash"))
            .select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("idx"), "hash", F.expr(f"(n - 1) div {fan_out} + 1").alias("n"))
        )
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def missing_nodes(held: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Coordinates that a partition must fetch: ``part, tree, level, idx``.

    ``held(part, tree, a, b, n)`` are runs of leaves from ``a`` to ``b``, both
    held, of a tree of ``n``.  A run makes its parents once it has the rest of
    the two outermost sibling groups, so at each level only what is left of its
    first and right of its last node is missing, and nothing that the partition
    can derive itself.
    """
    levels = held.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(int(62 / math.log2(fan_out))))))
    width = F.expr(f"cast(pow({fan_out}, level) as long)")
    at = levels.withColumn("w", width).selectExpr("part", "tree", "level", "a div w AS lo", "b div w AS hi", "(n - 1) div w AS last").where("last > 0")
    ends = at.selectExpr("*", f"lo div {fan_out} * {fan_out} AS first", f"least(hi div {fan_out} * {fan_out} + {fan_out - 1}, last) AS final")
    nothing = F.array().cast("array<bigint>")
    left = F.when(F.col("first") < F.col("lo"), F.sequence("first", F.col("lo") - 1)).otherwise(nothing)
    right = F.when(F.col("hi") < F.col("final"), F.sequence(F.col("hi") + 1, "final")).otherwise(nothing)
    return ends.select("part", "tree", "level", F.explode(F.concat(left, right)).alias("idx"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Forest:
    """The nodes a partition knows, and what follows from them."""

    def __init__(self, known: dict[tuple[int, int, int], str], fan_out: int):
        self.hash, self.fan_out = known, fan_out
        self.beside: dict[tuple[int, int, int], tuple[str, str]] = {}
        self.tails: dict[tuple[int, int, int], str] = {}
        self.size: dict[int, int] = {}

    def derive(self, tree: int, lo: int, hi: int, n: int) -> str:
        """Adds all nodes above the leaves from ``lo`` to ``hi``; returns the root of the tree."""
        self.size[tree] = n
        level, f = 0, self.fan_out
        while n > 1:
            for up in range(lo // f, hi // f + 1):
                run = (self.hash[tree, level, i] for i in range(up * f, min(up * f + f, n)))
                self.hash[tree, level + 1, up] = _sha("".join(run))
            lo, hi, n, level = lo // f, hi // f, (n - 1) // f + 1, level + 1
        return self.hash[tree, level, 0]

    def siblings(self, tree: int, level: int, idx: int, n: int) -> tuple[str, str]:
        key = (tree, level, idx)
        if key not in self.beside:
            first = idx - idx % self.fan_out
            text = [self.hash[tree, level, i] for i in range(first, min(first + self.fan_out, n))]
            self.beside[key] = "".join(text[: idx - first]), "".join(text[idx - first + 1 :])
        return self.beside[key]

    def path(self, tree: int, idx: int):
        """Siblings left and right at every level from a leaf to the root of all trees."""
        for at, i in ((tree, idx), (TOP, tree)):
            level, n = 0, self.size[at]
            while n > 1:
                yield self.siblings(at, level, i, n)
                level, i, n = level + 1, i // self.fan_out, (n - 1) // self.fan_out + 1


def _expand(fan_out: int):
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        rows = [leaves.column(c).to_pylist() for c in ("tree", "idx", "n", "leaf", "claim")]
        coords = [fetched.column(c).to_pylist() for c in NODE]
        known = dict(zip(zip(*coords, strict=True), fetched.column("hash").to_pylist(), strict=True))
        held: dict[int, list[int]] = {}
        for tree, idx, n, leaf, _ in zip(*rows, strict=True):
            known[tree, 0, idx] = leaf
            held.setdefault(tree, [idx, idx, n])[1] = idx
        forest = Forest(known, fan_out)
        subroot = {}
        for tree, (lo, hi, n) in held.items():
            subroot[tree] = known[TOP, 0, tree] = forest.derive(tree, lo, hi, n)
        trees = leaves.column("trees")[0].as_py()
        root = forest.derive(TOP, min(held), max(held), trees)
        proofs, folded = [], []
        for tree, idx, _, _, value in zip(*rows, strict=True):
            proof = hashlib.sha256()
            for left, right in forest.path(tree, idx):
                proof.update(left.encode())
                proof.update(right.encode())
                value = _sha(left + value + right)
            proofs.append(proof.hexdigest())
            folded.append(value)
        return pa.table(
            {
                "doc_id": leaves.column("doc_id"),
                "leaf": leaves.column("leaf"),
                "subroot": pa.array([subroot[t] for t in rows[0]], pa.string()),
                "root": pa.array([root] * len(folded), pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
            }
        )

    return run


def multiproofs(leaves: DataFrame, fan_out: int = FAN_OUT, per_partition: int = LEAVES) -> DataFrame:
    """Inclusion proofs of every row of ``leaves(doc_id, grp, leaf, claim)``, checked with the claimed leaf.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``: the roots of the row's group and of all groups, the hash of the
    siblings on the way, and what the claim folds to with them.  Leaves are cut
    into partitions of ``per_partition`` neighbours; each fetches what its own
    leaves cannot give in one join, and derives what its leaves share once.

    Null groups are a group of their own, before all others.  Rows with equal
    or null ids are ordered by their hash; equal rows are leaves of their own.
    An empty table has no rows and no root.  Other columns are ignored.
    """
    spark = leaves.sparkSession
    with scratch_scope(spark) as scratch:
        placed = indexed_leaves(leaves)
        nodes = tree_nodes(placed.select("tree", "idx", F.col("leaf").alias("hash"), "n"), fan_out)
        tops = cut_lineage(nodes.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash"))
        trees = tops.count()
        store = nodes.unionByName(tree_nodes(tops.withColumn("n", F.lit(trees).cast("long")), fan_out)).drop("n")
        parted = placed.withColumn("part", F.expr(f"pos div {per_partition}"))
        held = parted.groupBy("part", "tree").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.max("n").alias("n"))
        above = held.groupBy("part").agg(F.min("tree").alias("a"), F.max("tree").alias("b"))
        above = above.select("part", F.lit(TOP).cast("long").alias("tree"), "a", "b", F.lit(trees).cast("long").alias("n"))
        wanted = cut_lineage(missing_nodes(held.unionByName(above), fan_out))
        fetched = join_bounded(wanted, store, NODE).select("part", *NODE, "hash")
        schema = f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        rows = parted.withColumn("trees", F.lit(trees).cast("long"))
        out = cut_lineage(rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_expand(fan_out), schema))
        scratch.keep(out)
    return out
