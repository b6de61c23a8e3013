"""The assembly as one chain of DataFrames: reads to polished contigs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.operators import bubbles, consensus, graph, layout, mapping, overlap, pairs, sketch, unitigs
from readloom.session import cut_lineage, global_index, keep


@dataclass
class SketchIndex:
    """What later stages need of a set of sequences."""

    sketches: DataFrame
    counts: DataFrame

    def pairs(self, cfg: AssemblyConfig, lower: int) -> DataFrame:
        bounded = sketch.within_counts(self.sketches, self.counts, lower, cfg.mc_upper)
        return pairs.with_mirrors(pairs.adjacent_pairs(bounded, cfg.min_pair_distance))


def build_index(reads: DataFrame, cfg: AssemblyConfig) -> SketchIndex:
    """Top-level sketch and its counts; the sketch is the one stage reused often."""
    level = keep(
        sketch.sketch(reads, cfg.k, cfg.w, cfg.reduction, levels=(cfg.levels,))
    )
    return SketchIndex(level, keep(sketch.minimizer_counts(level)))


def overlaps(reads: DataFrame, index: SketchIndex, cfg: AssemblyConfig) -> DataFrame:
    found = overlap.find_overlaps(reads, index.pairs(cfg, cfg.mc_lower), cfg)
    return cut_lineage(overlap.overlap_records(found))


@dataclass
class Layout:
    """Graph, unitig and contig tables of an assembly."""

    edges: DataFrame
    members: DataFrame
    unitigs: DataFrame
    bundles: bubbles.Bundles
    contigs: DataFrame
    primary: DataFrame
    alternate: DataFrame


def lay_out(records: DataFrame, cfg: AssemblyConfig) -> Layout:
    edges = graph.string_edges(graph.usable_overlaps(records, cfg.min_len, cfg.min_identity))
    typed = cut_lineage(graph.reduce_graph(edges, cfg))
    live = typed.where(F.col("type") == "G")
    members = cut_lineage(unitigs.unitig_members(live))
    table, comp = unitigs.clean_unitigs(members, cfg)
    best_in = live.select("w", "best_in").distinct()
    contigs = cut_lineage(unitigs.contig_paths(table, comp, best_in))
    paths = bubbles.bundle_paths(comp, table)
    primary = cut_lineage(layout.primary_tiling(contigs, paths, table, members))
    alternate = layout.alternate_tiling(contigs, paths, table, members)
    return Layout(typed, members, table, comp, contigs, primary, alternate)


def map_to_contigs(contigs: DataFrame, reads_index: SketchIndex, cfg: AssemblyConfig) -> DataFrame:
    """Read placements on sequences ``rid, seq``."""
    refs = sketch.sketch(contigs, cfg.k, cfg.w, cfg.reduction, levels=(cfg.levels,))
    ref_pairs = mapping.reference_pairs(
        refs, reads_index.counts, cfg.map_mc_lower, cfg.mc_upper, cfg.min_pair_distance
    )
    return mapping.map_reads(ref_pairs, reads_index.pairs(cfg, cfg.map_mc_lower), reads_index.counts)


@dataclass
class Assembly:
    records: DataFrame
    layout: Layout
    draft: DataFrame
    consensus: DataFrame
    alternate: DataFrame | None = None


def assemble(
    reads: DataFrame, cfg: AssemblyConfig | None = None, with_consensus: bool = True, with_alternates: bool = False
) -> Assembly:
    """Reads ``rid, seq`` to draft and polished primary contigs ``ctg, seq``.

    ``with_alternates`` also stitches the other paths through bundles, and
    polishes them like the primary contigs, however much there is of them.
    """
    cfg = cfg or AssemblyConfig()
    index = build_index(reads, cfg)
    records = overlaps(reads, index, cfg)
    lay = lay_out(records, cfg)
    draft = cut_lineage(layout.stitch_contigs(lay.primary, reads, cfg))
    polished = polish_contigs(draft, reads, index, cfg) if with_consensus else draft
    other = None
    if with_alternates:
        other = cut_lineage(layout.stitch_contigs(lay.alternate, reads, cfg))
        other = polish_contigs(other, reads, index, cfg) if with_consensus else other
    return Assembly(records, lay, draft, polished, other)


def polish_contigs(draft: DataFrame, reads: DataFrame, index: SketchIndex, cfg: AssemblyConfig) -> DataFrame:
    # contigs are numbered in the order of their names, so the polished text finds its way back
    named = cut_lineage(global_index(draft, ["ctg"], "rid"))
    mapped = map_to_contigs(named.select("rid", "seq"), index, cfg)
    done = consensus.polish(named.select("rid", "seq"), reads, cut_lineage(mapped), cfg)
    return named.select(F.col("rid").alias("id"), F.col("ctg").alias("name")).join(
        done.withColumnRenamed("ctg", "id"), "id"
    ).select(F.col("name").alias("ctg"), "seq")
