"""Read overlaps: candidate rounds, alignment, classification, text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.functions.sequence import normalised, oriented
from readloom.operators.align import MATCH_FIELDS, match_pairs, relative_strand
from readloom.operators.pairs import BUCKET, bucket_rows, partner_links, placed
from readloom.session import cut_lineage

OVERLAP, CONTAINS, CONTAINED = 0, 1, 2

# Names of the three overlap types, by code.
TYPE_NAMES = ["overlap", "contains", "contained"]

PAIR = ["lo", "hi"]
PLACEMENT = ["lo", "hi", "rel", "place"]
LINK = [*BUCKET, "ord", "off"]


def is_proper(cfg: AssemblyConfig, tail0: Column, tail1: Column) -> Column:
    """Both starts and at least one end of the match reach the sequence ends."""
    near = cfg.end_fuzz
    return (
        (F.col("q_bgn") < near)
        & (F.col("t_bgn") < near)
        & ((F.abs(tail0 - F.col("q_end")) < near) | (F.abs(tail1 - F.col("t_end")) < near))
        & (F.col("q_end") > cfg.min_aligned)
        & (F.col("t_end") > cfg.min_aligned)
    )


def overlap_type(cfg: AssemblyConfig) -> Column:
    """Containment when the match spans either read; the longer read contains."""
    slack = 2 * cfg.end_fuzz
    spans = (F.abs(F.col("len0") - (F.col("q_end") - F.col("q_bgn"))) < slack) | (
        F.abs(F.col("len1") - (F.col("t_end") - F.col("t_bgn"))) < slack
    )
    return (
        F.when(~spans, F.lit(OVERLAP))
        .when(F.col("len0") >= F.col("len1"), F.lit(CONTAINS))
        .otherwise(F.lit(CONTAINED))
    )


def align_links(links: DataFrame, reads: DataFrame, cfg: AssemblyConfig) -> DataFrame:
    """Aligns every link and keeps the proper overlaps with their type.

    Sequences join last, and the first read is cut to the part that can overlap
    before it is shuffled to the second one.
    """
    texts = reads.select(F.col("rid").cast("long").alias("rid"), normalised(F.col("seq")).alias("seq"))
    first = links.join(texts.withColumnRenamed("rid", "rid0"), "rid0").withColumn(
        "q", F.substring(oriented(F.col("seq"), F.col("dir0")), F.col("at0") - F.col("at1") + 1, F.col("len0"))
    )
    both = first.drop("seq").join(texts.withColumnRenamed("rid", "rid1"), "rid1").withColumn(
        "t", oriented(F.col("seq"), F.col("dir1"))
    )
    matched = match_pairs(both.drop("seq"), cfg.band)
    tail0 = F.col("len0") - (F.col("at0") - F.col("at1"))
    return matched.where(is_proper(cfg, tail0, F.col("len1"))).withColumn("type", overlap_type(cfg))


def _earliest(links: DataFrame, keys: list[str]) -> DataFrame:
    """One link per key, the smallest in (bucket, seed rank, partner rank) order."""
    rest = [c for c in links.columns if c not in keys and c not in LINK]
    return links.groupBy(*keys).agg(F.min(F.struct(*LINK, *rest)).alias("m")).select(*keys, "m.*")


def find_overlaps(reads: DataFrame, pairs: DataFrame, cfg: AssemblyConfig) -> DataFrame:
    """Overlaps between reads that share minimizer pairs.

    The rule, in rounds of growing reach (``bestn`` partners, then twice as
    many, and so on):

    * every unsatisfied bucket row looks at its next nearest partners;
    * each read pair not yet known to overlap is aligned once per placement
      (placements within ``end_fuzz`` first through one representative, the
      others only if that fails);
    * a row is satisfied once ``bestn`` of its partners are dovetail overlaps,
      or when its read turns out to be contained.

    At the end a dovetail overlap stays when it is among the first ``bestn`` of
    some row.  Buckets hold at most ``bucket_upper`` rows, so the reach, which
    doubles, is exhausted after a handful of rounds.
    """
    rows = cut_lineage(bucket_rows(pairs, cfg.bucket_upper))
    seeds = rows
    links = known = tried = None
    reach, step = 0, cfg.bestn

    while reach < cfg.bucket_upper - 1:
        fresh = placed(partner_links(seeds, rows, reach + 1, reach + step))
        if known is not None:
            gone = _contained_reads(known)
            fresh = fresh.join(gone.withColumnRenamed("rid", "rid1"), "rid1", "left_anti")
        fresh = cut_lineage(fresh)
        links = fresh if links is None else links.unionByName(fresh)

        todo = fresh
        if known is not None:
            todo = todo.join(known.select(*PAIR), PAIR, "left_anti").join(tried, PLACEMENT, "left_anti")
        todo = cut_lineage(_earliest(todo, PLACEMENT))
        cell = F.floor(F.col("place") / cfg.end_fuzz)
        heads = _earliest(todo.withColumn("cell", cell), ["lo", "hi", "rel", "cell"]).drop("cell")
        hit = cut_lineage(align_links(heads, reads, cfg))
        rest = todo.join(hit.select(*PAIR).distinct(), PAIR, "left_anti").join(
            heads.select(*PLACEMENT), PLACEMENT, "left_anti"
        )
        late = cut_lineage(align_links(rest, reads, cfg))
        found = _earliest(hit, PAIR).unionByName(_earliest(late, PAIR))
        known = cut_lineage(found if known is None else known.unionByName(found))
        done = todo.select(*PLACEMENT)
        tried = done if tried is None else tried.unionByName(done)

        reach += step
        step *= 2
        dovetails = known.where(F.col("type") == OVERLAP).select(*PAIR)
        full = (
            links.join(dovetails, PAIR, "left_semi")
            .groupBy(*BUCKET, "ord")
            .agg(F.count(F.lit(1)).alias("have"))
            .where(F.col("have") >= cfg.bestn)
        )
        seeds = (
            rows.where(F.col("ord") + reach < F.col("n"))
            .join(full, [*BUCKET, "ord"], "left_anti")
            .join(_contained_reads(known), "rid", "left_anti")
        )
        if seeds.isEmpty():
            break

    nearest = Window.partitionBy(*BUCKET, "ord").orderBy("off")
    dovetails = known.where(F.col("type") == OVERLAP)
    kept = (
        links.join(dovetails.select(*PAIR), PAIR, "left_semi")
        .withColumn("nth", F.row_number().over(nearest))
        .where(F.col("nth") <= cfg.bestn)
        .select(*PAIR)
        .distinct()
    )
    return known.where(F.col("type") != OVERLAP).unionByName(dovetails.join(kept, PAIR, "left_semi"))


def _contained_reads(known: DataFrame) -> DataFrame:
    inner = F.when(F.col("type") == CONTAINS, F.col("rid1")).when(F.col("type") == CONTAINED, F.col("rid0"))
    return known.where(F.col("type") != OVERLAP).select(inner.alias("rid")).distinct()


def overlap_records(overlaps: DataFrame, clamp: bool = True) -> DataFrame:
    """The 13 text columns of an overlap, in forward coordinates of both reads.

    The match is extended to the start of the second read; ``clamp`` keeps
    begins at 0 or more (without it a slightly negative begin shows through).
    """
    shift = F.col("at0") - F.col("at1")
    q0, q1 = F.col("q_bgn") - F.col("t_bgn"), F.col("q_end")
    t1 = F.col("t_end")
    floor0 = (lambda c: F.greatest(c, F.lit(0))) if clamp else (lambda c: c)

    def ends(direction, length, start, stop):
        begin = F.when(direction == 0, start).otherwise(length - stop)
        end = F.when(direction == 0, stop).otherwise(length - start)
        return floor0(begin), F.least(end, length)

    a_bgn, a_end = ends(F.col("dir0"), F.col("len0"), shift + q0, shift + q1)
    b_bgn, b_end = ends(F.col("dir1"), F.col("len1"), F.lit(0), t1)
    return overlaps.select(
        "rid0",
        "rid1",
        (-F.col("m_size")).alias("score"),
        F.round(100.0 - 100.0 * F.col("dist") / F.col("m_size"), 1).alias("identity"),
        F.lit(0).alias("strand0"),
        a_bgn.alias("a_bgn"),
        a_end.alias("a_end"),
        "len0",
        relative_strand(F.col("dir0"), F.col("dir1")).alias("strand1"),
        b_bgn.alias("b_bgn"),
        b_end.alias("b_end"),
        "len1",
        F.element_at(F.array(*[F.lit(t) for t in TYPE_NAMES]), F.col("type") + 1).alias("type"),
    )


def unique_pairs(records: DataFrame, order: list[str]) -> DataFrame:
    """One record per unordered read pair, the first under ``order``."""
    keyed = records.withColumn("lo", F.least("rid0", "rid1")).withColumn("hi", F.greatest("rid0", "rid1"))
    rest = [c for c in records.columns if c not in order]
    return (
        keyed.groupBy(*PAIR)
        .agg(F.min(F.struct(*order, *rest)).alias("m"))
        .select("m.*")
        .select(*records.columns)
    )


__all__ = ["MATCH_FIELDS", "align_links", "find_overlaps", "overlap_records", "unique_pairs"]
