"""Mapping reads onto reference sequences through shared minimizer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.pairs import BUCKET, adjacent_pairs
from readloom.operators.sketch import within_counts
from readloom.session import cut_lineage

MAP_COLUMNS = [
    "ref_id", "ref_bgn", "ref_end", "read_id", "read_bgn", "read_end", "direction", "mc0", "mc1",
]

# reference occurrences of one pair that go to a single task
SALT_ROWS = 10_000
# by pigeonhole a pair outside the K most frequent ones holds at most 1/K of the rows
HEAVY_PAIRS = 10_000


def reference_pairs(
    ref_sketch: DataFrame, read_counts: DataFrame, lower: int, upper: int, min_distance: int = 100
) -> DataFrame:
    """Adjacent reference minimizers whose multiplicity among the reads fits."""
    bounded = within_counts(ref_sketch, read_counts, lower, upper)
    pairs = adjacent_pairs(bounded, min_distance)
    return pairs.select(
        *BUCKET,
        F.col("rid").alias("ref_id"),
        F.col("pos0").alias("ref_bgn"),
        F.col("pos1").alias("ref_end"),
    )


def map_reads(ref_pairs: DataFrame, read_pairs: DataFrame, read_counts: DataFrame) -> DataFrame:
    """Every read occurrence of every reference pair, with both multiplicities.

    The read side holds at most ``mc_upper`` rows a key.  Reference pairs that
    occur very often are split over salts and the few read rows they meet are
    repeated per salt; the list of such pairs has a bounded length.
    """
    ref_pairs = cut_lineage(ref_pairs)
    busy = (
        ref_pairs.groupBy(*BUCKET)
        .agg(F.count(F.lit(1)).alias("c"))
        .where(F.col("c") > SALT_ROWS)
        .orderBy(F.col("c").desc(), *BUCKET)
        .limit(HEAVY_PAIRS)
        .select(*BUCKET, F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts"))
    )
    # a key's multiplicities are looked up once, for the keys that the references have
    keys = ref_pairs.select(*BUCKET).distinct()
    for h, mc in (("h0", "mc0"), ("h1", "mc1")):
        keys = keys.join(read_counts.select(F.col("hash").alias(h), F.col("mc").alias(mc)), h)
    counted = read_pairs.select(*BUCKET, "rid", "pos0", "pos1", "direction").join(keys, BUCKET)
    one = F.coalesce(F.col("salts"), F.lit(1))
    refs = (
        ref_pairs.join(F.broadcast(busy), BUCKET, "left")
        .withColumn("salt", F.pmod(F.hash("ref_id", "ref_bgn"), one))
        .drop("salts")
    )
    hits = (
        counted.join(F.broadcast(busy), BUCKET, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1)))
        .drop("salts")
    )
    return refs.join(hits, [*BUCKET, "salt"]).select(
        "ref_id",
        "ref_bgn",
        "ref_end",
        F.col("rid").alias("read_id"),
        F.col("pos0").alias("read_bgn"),
        F.col("pos1").alias("read_end"),
        "direction",
        "mc0",
        "mc1",
    )


def sort_map(rows: DataFrame) -> DataFrame:
    """Total order by reference position; a range-partitioned sort."""
    return rows.orderBy("ref_id", "ref_bgn", *[c for c in MAP_COLUMNS if c not in ("ref_id", "ref_bgn")])
