"""Co-linear chains of shared minimizers between two sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDES = ["id0", "id1"]

def shared_minimizers(
    left: DataFrame, right: DataFrame, direction: int = 0, max_repeat: int = 1
) -> DataFrame:
    """Minimizers two sequences have in common, on agreeing strands.

    ``direction`` 1 compares with the other strand of the right sequence.  A
    hash that repeats more than ``max_repeat`` times in the left sequence does
    not count.
    """
    times = F.count(F.lit(1)).over(Window.partitionBy("rid", "hash"))
    a = left.withColumn("times", times).where(F.col("times") <= max_repeat)
    a = a.select(
        F.col("rid").alias("id0"), F.col("idx").alias("idx0"), F.col("pos").alias("pos0"), F.col("strand").alias("st0"), "hash"
    )
    b = right.select(
        F.col("rid").alias("id1"), F.col("idx").alias("idx1"), F.col("pos").alias("pos1"), F.col("strand").alias("st1"), "hash"
    )
    agree = F.col("st0") == F.col("st1") if direction == 0 else F.col("st0") != F.col("st1")
    diagonal = F.col("pos0") - F.col("pos1") if direction == 0 else F.col("pos0") + F.col("pos1")
    return a.join(b, "hash").where(agree).select(*SIDES, "idx0", "idx1", "pos0", "pos1", F.abs(diagonal).alias("diag"))


def colinear_chains(
    anchors: DataFrame, direction: int = 0, max_diff: int = 100, max_dist: int = 1200
) -> DataFrame:
    """Assigns anchors to chains: ``id0, id1, chain, idx0, idx1, pos0, pos1``.

    Anchors come in order of the right sequence (from its end for
    ``direction`` 1).  Each joins the chain whose last anchor is not behind it,
    lies within ``max_dist`` and has the closest diagonal, closer than
    ``max_diff``; otherwise it opens a chain.  A group holds the anchors of one
    pair of sketches.
    """
    sign = 1 if direction == 0 else -1

    def link(pdf):
        import numpy as np

        pdf = pdf.sort_values(["idx1", "idx0"], key=lambda c: c * sign if c.name == "idx1" else c)
        idx0, pos0, diag = (pdf[c].to_numpy().astype(np.int64) for c in ("idx0", "pos0", "diag"))
        chain = np.zeros(len(pdf), dtype=np.int64)
        # the last anchor of every open chain
        last = np.zeros((3, 64), dtype=np.int64)
        open_ = 0
        for i in range(len(pdf)):
            end_idx, end_pos, end_diag = last[:, :open_]
            off = np.abs(end_diag - diag[i])
            near = (end_idx <= idx0[i]) & (np.abs(end_pos - pos0[i]) < max_dist) & (off < max_diff)
            if near.any():
                c = int(np.argmin(np.where(near, off, max_diff)))
            else:
                c = open_
                open_ += 1
                if c == last.shape[1]:
                    last = np.concatenate([last, np.zeros_like(last)], axis=1)
            last[:, c] = idx0[i], pos0[i], diag[i]
            chain[i] = c
        pdf["chain"] = chain
        return pdf[["id0", "id1", "chain", "idx0", "idx1", "pos0", "pos1"]]

    return anchors.groupBy(*SIDES).applyInPandas(
        link, "id0 long, id1 long, chain long, idx0 int, idx1 int, pos0 int, pos1 int"
    )


def chain_offsets(chains: DataFrame, direction: int = 0) -> DataFrame:
    """Size and largest, mean and smallest offset of every chain."""
    shift = F.col("pos0") - F.col("pos1") if direction == 0 else F.col("pos0") + F.col("pos1")
    return chains.groupBy(*SIDES, "chain").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(shift).alias("max_offset"),
        F.avg(shift).alias("mean_offset"),
        F.min(shift).alias("min_offset"),
        F.min(F.struct("idx1", shift.alias("d")))["d"].alias("first_offset"),
    )


def best_offset(chains: DataFrame) -> DataFrame:
    """Offset at the first anchor of the longest chain of each pair."""
    top = F.min(F.struct((-F.col("n")).alias("n"), "chain", "first_offset"))
    return chain_offsets(chains).groupBy(*SIDES).agg(top.alias("m")).select(*SIDES, F.col("m.first_offset").alias("offset"))
