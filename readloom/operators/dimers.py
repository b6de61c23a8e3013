"""Read graph supported by shared minimizer pairs and dovetailing ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.sketch import end_minimizers

DIMER = ["h0", "strand0", "h1", "strand1"]


def dovetail_pairs(sketches: DataFrame, end_length: int = 250) -> DataFrame:
    """Read pairs that hold each other's end minimizers: ``rid0, end0, rid1, end1``.

    ``sketches`` should be limited to minimizers of bounded multiplicity.
    """
    ends = end_minimizers(sketches, end_length).groupBy("hash", F.col("rid").alias("r"))
    ends = ends.agg(F.bit_or(F.when(F.col("end") == 5, 1).otherwise(2)).alias("ends"))
    held = ends.join(sketches.select("hash", F.col("rid").alias("other")).distinct(), "hash").where(F.col("r") != F.col("other"))
    # both directions of a read pair meet in one number: two bits tell the ends of either read
    pairs = held.groupBy(F.least("r", "other").alias("lo"), F.greatest("r", "other").alias("hi")).agg(
        F.bit_or(F.col("ends") * F.when(F.col("r") < F.col("other"), 1).otherwise(4)).alias("bits")
    )
    rows = []
    for end0, bit0 in ((5, 1), (3, 2)):
        for end1, bit1 in ((5, 4), (3, 8)):
            both = F.col("bits").bitwiseAND(F.lit(bit0 + bit1)) == bit0 + bit1
            for a, x, b, y in (("lo", end0, "hi", end1), ("hi", end1, "lo", end0)):
                row = F.struct(F.col(a).alias("rid0"), F.lit(x).alias("end0"), F.col(b).alias("rid1"), F.lit(y).alias("end1"))
                rows.append(F.when(both, row))
    return pairs.select(F.explode(F.array_compact(F.array(*rows))).alias("d")).select("d.*")


def dimer_links(occurrences: DataFrame, counts: DataFrame, dovetails: DataFrame, lower: int = 1, upper: int = 30) -> DataFrame:
    """Neighbouring reads at each minimizer pair, by how far they reach left.

    ``occurrences`` are pairs on both strands.  A link goes from a read to the
    next one when that one reaches further right; it carries the number of
    minimizer pairs both reads have, the overlap length and whether their ends
    dovetail.
    """
    usable = counts.where((F.col("mc") > lower) & (F.col("mc") < upper))
    both = occurrences.join(usable.select(F.col("hash").alias("h0")), "h0", "left_semi").join(
        usable.select(F.col("hash").alias("h1")), "h1", "left_semi"
    )
    placed = both.select(
        *DIMER, "rid", "direction", "len",
        (-(F.col("pos0") + 1)).alias("left"),
        (F.col("len") - F.col("pos0") - 1).alias("right"),
    )
    order = Window.partitionBy(*DIMER).orderBy("left", "right", "rid", "direction")
    before = F.lag(F.struct("rid", "direction", "len", "left", "right")).over(order)
    steps = (
        placed.withColumn("p", before)
        .where(F.col("p.right") < F.col("right"))
        .select(
            *DIMER,
            F.col("p.rid").alias("rid0"),
            F.col("p.direction").alias("dir0"),
            F.col("rid").alias("rid1"),
            F.col("direction").alias("dir1"),
            (F.col("p.len") - F.abs(F.col("p.left") - F.col("left"))).alias("overlap_len"),
        )
    )
    own = occurrences.select("rid", *DIMER).distinct()
    asked = steps.select("rid0", "rid1").distinct()
    first = asked.join(own.withColumnRenamed("rid", "rid0"), "rid0")
    shared = (
        first.join(own.withColumnRenamed("rid", "rid1"), ["rid1", *DIMER])
        .groupBy("rid0", "rid1")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    met = dovetails.select("rid0", "rid1").distinct().withColumn("hit", F.lit(1))
    return (
        steps.join(shared, ["rid0", "rid1"], "left")
        .join(met, ["rid0", "rid1"], "left")
        .select(
            *DIMER, "rid0", "dir0", "rid1", "dir1",
            F.coalesce("shared", F.lit(0)).alias("shared"),
            "overlap_len",
            F.coalesce("hit", F.lit(0)).alias("dovetail"),
        )
    )


def dimer_graph(links: DataFrame) -> DataFrame:
    """Directed edges between oriented reads for the dovetailing links."""
    a = F.concat_ws("-", "rid0", "dir0")
    b = F.concat_ws("-", "rid1", "dir1")
    ra = F.concat_ws("-", "rid0", 1 - F.col("dir0"))
    rb = F.concat_ws("-", "rid1", 1 - F.col("dir1"))
    ways = F.array(F.struct(a.alias("v"), b.alias("w")), F.struct(rb.alias("v"), ra.alias("w")))
    return links.where("dovetail = 1").select(F.explode(ways).alias("e")).select("e.*").distinct()
