"""Hierarchical minimizer sketches and their counts.

A sequence is sketched where it lies: the kernel maps Arrow batches of reads to
minimizer rows, so no base or k-mer is ever exploded into a shuffle.  Only the
sketches (a few per cent of the bases) travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators import kernels
from readloom.session import join_bounded

SKETCH_SCHEMA = (
    "rid long, level int, idx int, pos int, strand int, hash long, span int, len int"
)

# bases handed to the kernel at once; its arrays then stay in a core's own cache
KERNEL_BASES = 32_000
# rows of a batch that goes back to Spark
BATCH_ROWS = 10_000

# by pigeonhole a key outside the K most frequent ones holds at most 1/K of all rows
HEAVY_KEYS = 10_000


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sketch(
    reads: DataFrame,
    k: int = 16,
    w: int = 80,
    reduction: int = 6,
    levels: tuple[int, ...] = (2,),
    hpc: bool = False,
) -> DataFrame:
    """Minimizers of ``reads(rid, seq)`` at the requested levels.

    Level 0 holds the symmetric (w,k)-minimizers; levels 1 and 2 keep the
    smallest hash of every ``reduction`` neighbours of the level below.
    ``idx`` is the 0-based ordinal within read and level, ``pos`` the last base.
    """
    wanted = tuple(sorted(levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(sketched(batches))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, bounds = kernels.text_buffer(batch.column(1))
            for start, stop in kernels.slices(bounds, KERNEL_BASES):
                part = bounds[start : stop + 1]
                row, pos, strand, hashes, span = kernels.sketch_buffer(
                    raw[part[0] : part[-1]], part - part[0], w, k, hpc
                )
                lens = np.diff(part)
                pick = np.arange(row.size)
                for level in range(wanted[-1] + 1):
                    if level:
                        pick = pick[kernels.reduce_list(row[pick], hashes[pick], reduction)]
                    if level not in wanted:
                        continue
                    r = row[pick]
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if r.size else np.zeros(0, np.int64)
                    idx = np.arange(r.size) - np.repeat(first, np.diff(np.r_[first, r.size]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rids[start + r], pa.int64()),
                            pa.array(np.full(r.size, level), pa.int32()),
                            pa.array(idx, pa.int32()),
                            pa.array(pos[pick], pa.int32()),
                            pa.array(strand[pick], pa.int32()),
                            pa.array(hashes[pick].astype(np.int64), pa.int64()),
                            pa.array(span[pick], pa.int32()),
                            pa.array(lens[r], pa.int32()),
                        ],
                        names=["rid", "level", "idx", "pos", "strand", "hash", "span", "len"],
                    )

    return reads.select(F.col("rid").cast("long"), "seq").mapInArrow(run, SKETCH_SCHEMA)


def reduce_level(sketches: DataFrame, reduction: int, order: str = "idx") -> DataFrame:
    """One reduction step over any per-read minimizer list, as window functions.

    Same rule as the kernel: smallest hash of the last ``reduction`` rows, ties
    to the lowest ``idx % reduction``, consecutive repeats dropped.
    """
    by_read = Window.partitionBy("rid").orderBy(order)
    row = F.struct(*[F.col(c) for c in sketches.columns if c != "rid"])
    slot = F.struct("hash", (F.col(order) % reduction).alias("slot"), row.alias("row"))
    picked = (
        sketches.select(
            "rid",
            F.col(order).alias("at"),
            F.min(slot).over(by_read.rowsBetween(-(reduction - 1), 0)).alias("best"),
        )
        .where(F.col("at") >= reduction - 1)
        .select("rid", "at", "best.row.*")
    )
    again = Window.partitionBy("rid").orderBy("at")
    return (
        picked.withColumn("before", F.lag(order).over(again))
        .where(F.col("before").isNull() | (F.col("before") != F.col(order)))
        .withColumn(order, F.row_number().over(again) - 1)
        .select(*sketches.columns)
    )


def minimizer_counts(sketches: DataFrame) -> DataFrame:
    """Occurrences of each hash; partial counts merge map-side."""
    return sketches.groupBy("hash").agg(F.count(F.lit(1)).alias("mc"))


def merge_counts(parts: list[DataFrame]) -> DataFrame:
    """Sum count tables made from separate chunks of reads."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("hash").agg(F.sum("mc").alias("mc"))


def annotate_counts(sketches: DataFrame, counts: DataFrame) -> DataFrame:
    return join_bounded(sketches, counts, "hash")


def within_counts(sketches: DataFrame, counts: DataFrame, lower: int, upper: int) -> DataFrame:
    """Minimizers whose multiplicity lies in [lower, upper], with the count.

    Rows of the most frequent out-of-range hashes are discarded before the
    shuffle through a broadcast list of at most ``HEAVY_KEYS`` hashes, which
    leaves no join key with more than a small share of the rows.
    """
    heavy = (
        counts.where(F.col("mc") > upper)
        .orderBy(F.col("mc").desc(), "hash")
        .limit(HEAVY_KEYS)
        .select("hash")
    )
    light = sketches.join(F.broadcast(heavy), "hash", "left_anti")
    return light.join(counts.where(F.col("mc").between(lower, upper)), "hash")


def end_minimizers(sketches: DataFrame, end_length: int = 250) -> DataFrame:
    """Minimizers near either end of their read, one row per (minimizer, end)."""
    pos_end = F.col("pos") + 1
    r_pos_end = F.col("len") - pos_end + F.col("span")
    ends = F.array_compact(
        F.array(
            F.when(pos_end < end_length, F.lit(5)),
            F.when(r_pos_end < end_length, F.lit(3)),
        )
    )
    return (
        sketches.withColumn("pos_end", pos_end)
        .withColumn("r_pos_end", r_pos_end)
        .withColumn("end", F.explode(ends))
    )


def sketch_extent(sketches: DataFrame) -> DataFrame:
    """Range of ordinals and spacing statistics per read and level."""
    return (
        sketches.groupBy("rid", "level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("idx").alias("first_idx"),
            F.max("idx").alias("last_idx"),
            F.max("len").alias("len"),
        )
        .withColumn(
            "mean_distance",
            F.when(F.col("n") > 1, F.col("len") / (F.col("n") - 1)),
        )
    )


def minimizers_of_read(sketches: DataFrame, rid: int) -> DataFrame:
    return sketches.where(F.col("rid") == rid).orderBy("pos")


def count_of_minimizer(counts: DataFrame, hash_: int) -> DataFrame:
    """One row; a hash that never occurs counts 0."""
    return counts.where(F.col("hash") == hash_).agg(F.coalesce(F.sum("mc"), F.lit(0)).alias("mc"))


def hits_of_minimizer(pairs: DataFrame, hash_: int, span: int) -> DataFrame:
    """Pair occurrences that start with the given minimizer, last position first."""
    return pairs.where((F.col("h0") == hash_) & (F.col("span0") == span)).orderBy(
        F.col("pos0").desc(), "rid", "pos1", "direction"
    )
