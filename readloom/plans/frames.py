"""Frames the registered queries share, over the given text tables.

Documents stand for reads, benchmark passages for reference contigs.  The
parameters are smaller than the library defaults because the texts are short.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.operators import graph, mapping, pairs, sketch
from readloom.session import cut_lineage, keep
from readloom.sources.tables import benchmark_contigs, document_reads

K, W, REDUCTION = 16, 24, 3
MC_LOWER, MC_UPPER = 2, 240
MIN_DISTANCE = 30
BUCKET_UPPER = 120
BESTN = 4
FUZZ = 500
END_LENGTH = 250


class Frames:
    """Lazily built stages of one input folder.

    Sketches are persisted; what is derived from them is checkpointed, which
    also keeps the plans of later stages short.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._single: dict[int, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def reads(self) -> DataFrame:
        return keep(document_reads(self.spark, self.sf_dir))

    @cached_property
    def contigs(self) -> DataFrame:
        return keep(benchmark_contigs(self.spark, self.sf_dir))

    @cached_property
    def levels(self) -> DataFrame:
        return keep(sketch.sketch(self.reads, K, W, REDUCTION, levels=(0, 1, 2)))

    def level(self, n: int) -> DataFrame:
        """One level alone; lower ones are made on the way but not kept."""
        if n not in self._single:
            self._single[n] = keep(sketch.sketch(self.reads, K, W, REDUCTION, levels=(n,)))
        return self._single[n]

    @cached_property
    def counts(self) -> DataFrame:
        return keep(sketch.minimizer_counts(self.level(2)))

    @cached_property
    def bounded(self) -> DataFrame:
        return sketch.within_counts(self.level(2), self.counts, MC_LOWER, MC_UPPER)

    @cached_property
    def adjacent(self) -> DataFrame:
        return cut_lineage(pairs.adjacent_pairs(self.bounded, MIN_DISTANCE))

    @cached_property
    def mirrored(self) -> DataFrame:
        return pairs.with_mirrors(self.adjacent)

    @cached_property
    def rows(self) -> DataFrame:
        return cut_lineage(pairs.bucket_rows(self.mirrored, BUCKET_UPPER))

    @cached_property
    def links(self) -> DataFrame:
        return cut_lineage(pairs.placed(pairs.partner_links(self.rows, self.rows, 1, BESTN)))

    @cached_property
    def ref_pairs(self) -> DataFrame:
        refs = sketch.sketch(self.contigs, K, W, REDUCTION, levels=(2,))
        return mapping.reference_pairs(refs, self.counts, 1, MC_UPPER, MIN_DISTANCE)

    @cached_property
    def mapped(self) -> DataFrame:
        once = sketch.within_counts(self.level(2), self.counts, 1, MC_UPPER)
        read_pairs = pairs.with_mirrors(pairs.adjacent_pairs(once, MIN_DISTANCE))
        return cut_lineage(mapping.map_reads(self.ref_pairs, read_pairs, self.counts))

    @cached_property
    def projected(self) -> DataFrame:
        """Overlap records read off the placement of linked reads, without alignment.

        The smallest placement of a pair is taken; the shared part is what an
        ungapped overlap would cover.
        """
        first = self.links.groupBy("lo", "hi").agg(
            F.min(F.struct("rel", "place", "lo_len", "hi_len")).alias("m")
        ).select("lo", "hi", "m.*")
        a_bgn = F.greatest(F.col("place"), F.lit(0))
        skip = F.greatest(-F.col("place"), F.lit(0))
        size = F.least(F.col("lo_len") - a_bgn, F.col("hi_len") - skip)
        b_bgn = F.when(F.col("rel") == 0, skip).otherwise(F.col("hi_len") - skip - size)
        cover = first.select("lo", "hi", "rel", "lo_len", "hi_len", a_bgn.alias("a_bgn"), size.alias("size"), b_bgn.alias("b_bgn"))
        kind = (
            F.when(F.col("size") == F.col("hi_len"), "contains")
            .when(F.col("size") == F.col("lo_len"), "contained")
            .otherwise("overlap")
        )
        return cut_lineage(
            cover.where("size > 0").select(
                F.col("lo").alias("rid0"),
                F.col("hi").alias("rid1"),
                (-F.col("size")).alias("score"),
                F.lit(100.0).alias("identity"),
                F.lit(0).alias("strand0"),
                "a_bgn",
                (F.col("a_bgn") + F.col("size")).alias("a_end"),
                F.col("lo_len").alias("len0"),
                F.col("rel").alias("strand1"),
                "b_bgn",
                (F.col("b_bgn") + F.col("size")).alias("b_end"),
                F.col("hi_len").alias("len1"),
                kind.alias("type"),
            )
        )

    @cached_property
    def edges(self) -> DataFrame:
        return cut_lineage(graph.string_edges(self.projected.where("type = 'overlap'")))

    @cached_property
    def transitive(self) -> DataFrame:
        return cut_lineage(graph.transitive_edges(self.edges, FUZZ))

    @cached_property
    def live(self) -> DataFrame:
        """Edges left by the transitive reduction and the best-overlap rule."""
        tr = graph._minus(self.edges, self.transitive)
        return cut_lineage(graph._minus(tr, graph.not_best_edges(tr)))

    @cached_property
    def user_steps(self) -> DataFrame:
        """Events of each user in order, an event's type and rounded value as a k-mer."""
        e = self.table("events")
        by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return e.select(
            F.col("user_id").alias("rid"),
            (F.row_number().over(by_user) - 1).alias("ord"),
            "event_id",
            "value",
            F.concat_ws("-", "event_type", F.floor(F.col("value")).cast("string")).alias("kmer"),
        )


_shared: dict[tuple[str, str], Frames] = {}


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = Frames(spark, sf_dir)
    return _shared[key]


def forget() -> None:
    """Drops the shared frames so that the next query builds its own stages."""
    for f in _shared.values():
        f.spark.catalog.clearCache()
    _shared.clear()
