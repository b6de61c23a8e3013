"""Adjacent minimizer pairs and the buckets that share one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import mirrored_position
from readloom.operators.sketch import HEAVY_KEYS
from readloom.session import cut_lineage

ORIGINAL, REVERSED = 0, 1
BUCKET = ["h0", "h1"]


def adjacent_pairs(bounded: DataFrame, min_distance: int = 100) -> DataFrame:
    """Neighbouring minimizers of a read, at least ``min_distance`` apart.

    The multiplicity filter must come first: it decides who is adjacent.
    """
    by_read = Window.partitionBy("rid").orderBy("pos")
    before = F.lag(F.struct("hash", "span", "pos", "strand")).over(by_read)
    return (
        bounded.withColumn("before", before)
        .where(F.col("pos") - F.col("before.pos") >= min_distance)
        .select(
            F.col("before.hash").alias("h0"),
            F.col("before.span").alias("span0"),
            F.col("hash").alias("h1"),
            F.col("span").alias("span1"),
            "rid",
            "len",
            F.col("before.pos").alias("pos0"),
            F.col("before.strand").alias("strand0"),
            F.col("pos").alias("pos1"),
            F.col("strand").alias("strand1"),
            F.lit(ORIGINAL).alias("direction"),
        )
    )


def with_mirrors(pairs: DataFrame) -> DataFrame:
    """Every pair as read on either strand."""
    flipped = F.struct(
        F.col("h1").alias("h0"),
        F.col("span1").alias("span0"),
        F.col("h0").alias("h1"),
        F.col("span0").alias("span1"),
        "rid",
        "len",
        mirrored_position(F.col("len"), F.col("pos1"), F.col("span1")).alias("pos0"),
        (1 - F.col("strand1")).alias("strand0"),
        mirrored_position(F.col("len"), F.col("pos0"), F.col("span0")).alias("pos1"),
        (1 - F.col("strand0")).alias("strand1"),
        F.lit(REVERSED).alias("direction"),
    )
    both = F.explode(F.array(F.struct(*pairs.columns), flipped))
    return pairs.select(both.alias("p")).select("p.*")


def bucket_sizes(pairs: DataFrame, upper: int = 120) -> DataFrame:
    """Pair keys seen more than twice and at most ``upper`` times."""
    sizes = pairs.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where((F.col("n") > 2) & (F.col("n") <= upper))


def bucket_rows(pairs: DataFrame, upper: int = 120) -> DataFrame:
    """Rows of the usable buckets with their rank, last position first.

    Sizes come from a map-side combined count; rows of the most frequent
    oversized keys are dropped by a broadcast list of bounded length before
    anything is shuffled, so the ranking window only sees small groups.
    """
    # counted once for both uses
    sizes = cut_lineage(pairs.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where("n > 2"))
    heavy = (
        sizes.where(F.col("n") > upper).orderBy(F.col("n").desc(), *BUCKET).limit(HEAVY_KEYS).select(*BUCKET)
    )
    usable = sizes.where(F.col("n") <= upper)
    ranked = Window.partitionBy(*BUCKET).orderBy(F.col("pos0").desc(), "rid", "pos1", "direction")
    return (
        pairs.join(F.broadcast(heavy), BUCKET, "left_anti")
        .join(usable, BUCKET)
        .withColumn("ord", F.row_number().over(ranked))
    )


def partner_links(seeds: DataFrame, rows: DataFrame, first: int, last: int) -> DataFrame:
    """The ``first``..``last`` nearest following partners of each seed row.

    Linear in the number of seeds: partners are fetched by rank through an
    equi-join, never by pairing a bucket with itself.
    """
    wanted = seeds.withColumn(
        "off",
        F.explode(
            F.when(
                F.col("ord") + first <= F.col("n"),
                F.sequence(F.lit(first), F.least(F.lit(last), F.col("n") - F.col("ord"))),
            )
        ),
    ).withColumn("partner", F.col("ord") + F.col("off"))
    others = rows.select(
        *BUCKET,
        F.col("ord").alias("partner"),
        F.col("rid").alias("rid1"),
        F.col("pos0").alias("at1"),
        F.col("len").alias("len1"),
        F.col("direction").alias("dir1"),
    )
    return (
        wanted.join(others, [*BUCKET, "partner"])
        .where(F.col("rid") != F.col("rid1"))
        .select(
            *BUCKET,
            "ord",
            "off",
            F.col("rid").alias("rid0"),
            F.col("pos0").alias("at0"),
            F.col("len").alias("len0"),
            F.col("direction").alias("dir0"),
            "rid1",
            "at1",
            "len1",
            "dir1",
        )
    )


def placed(links: DataFrame) -> DataFrame:
    """Adds the unordered read pair, relative strand and placement.

    ``place`` is where the higher-numbered read starts on the forward strand of
    the lower-numbered one, so both strands of one overlap get the same value.
    """
    swapped = F.col("rid0") > F.col("rid1")
    shift = F.col("at0") - F.col("at1")
    lo_dir = F.when(swapped, F.col("dir1")).otherwise(F.col("dir0"))
    lo_len = F.when(swapped, F.col("len1")).otherwise(F.col("len0"))
    hi_len = F.when(swapped, F.col("len0")).otherwise(F.col("len1"))
    start = F.when(swapped, -shift).otherwise(shift)
    return links.select(
        "*",
        F.least("rid0", "rid1").alias("lo"),
        F.greatest("rid0", "rid1").alias("hi"),
        F.col("dir0").bitwiseXOR(F.col("dir1")).alias("rel"),
        F.when(lo_dir == 0, start).otherwise(lo_len - start - hi_len).alias("place"),
        lo_len.alias("lo_len"),
        hi_len.alias("hi_len"),
    )


def candidate_pairs(rows: DataFrame, bestn: int = 4) -> DataFrame:
    """Distinct read pairs among each bucket row's ``bestn`` nearest partners."""
    return placed(partner_links(rows, rows, 1, bestn)).select("lo", "hi").distinct()


def best_n_per_read(candidates: DataFrame, bestn: int) -> DataFrame:
    """Each read's ``bestn`` partners that share most buckets with it."""
    both = candidates.select(
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("rid"), F.col("hi").alias("partner"), "shared"),
                F.struct(F.col("hi").alias("rid"), F.col("lo").alias("partner"), "shared"),
            )
        ).alias("c")
    ).select("c.*")
    order = Window.partitionBy("rid").orderBy(F.col("shared").desc(), "partner")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bestn)


def first_per_pair(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of every key under an explicit order, as an aggregate.

    ``min`` of a struct combines map-side, so a pair that repeats very often
    never gathers in one place.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(*order, *rest)).alias("first"))
        .select(*keys, "first.*")
        .select(*rows.columns)
    )
