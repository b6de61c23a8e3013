"""Contig layout: paths through bundles, tiling rows and stitched sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.functions.sequence import normalised, oriented
from readloom.operators.align import match_pairs
from readloom.operators.unitigs import BUNDLE_VIA, KEY
from readloom.session import cut_lineage

TILING = ["ctg", "ord", "v", "w", "rid", "sp", "tp", "score", "identity", "offset", "length"]


def _tiled(unitig_rows: DataFrame, table: DataFrame, members: DataFrame) -> DataFrame:
    """Read-level rows of contigs given as unitig rows ``ctg, ord, sub, KEY``."""
    heads = table.where("head is not null").select(*KEY, "head")
    edges = unitig_rows.join(heads, KEY).join(
        members.select("head", "rank", "v", "w", "rid", "sp", "tp", F.col("score"), "identity", "length"), "head"
    )
    order = Window.partitionBy("ctg").orderBy("ord", "sub", "rank")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return edges.select(
        "ctg",
        (F.row_number().over(order) - 1).alias("ord"),
        "v",
        "w",
        "rid",
        "sp",
        "tp",
        "score",
        "identity",
        F.coalesce(before, F.lit(0)).alias("offset"),
        "length",
    )


def primary_tiling(contigs: DataFrame, paths: DataFrame, table: DataFrame, members: DataFrame) -> DataFrame:
    """Tiling rows of the primary contigs; bundles contribute their first path."""
    plain = contigs.where(F.col("via") != BUNDLE_VIA).select("ctg", "ord", F.lit(0).alias("sub"), *KEY)
    first = paths.where("alt = 0").select("s", "t", F.col("ord").alias("sub"), "es", "evia", "et")
    through = (
        contigs.where(F.col("via") == BUNDLE_VIA)
        .select("ctg", "ord", "s", "t")
        .join(first, ["s", "t"])
        .select("ctg", "ord", "sub", F.col("es").alias("s"), F.col("evia").alias("via"), F.col("et").alias("t"))
    )
    return _tiled(plain.unionByName(through), table, members)


def alternate_tiling(contigs: DataFrame, paths: DataFrame, table: DataFrame, members: DataFrame) -> DataFrame:
    """Tiling rows of the other paths, named ``<contig>-<bundle>-<path>``."""
    nth = F.row_number().over(Window.partitionBy("ctg").orderBy("ord"))
    used = contigs.where(F.col("via") == BUNDLE_VIA).withColumn("nth", nth).select("ctg", "nth", "s", "t")
    rest = paths.where("alt > 0").withColumnRenamed("ord", "sub")
    rows = used.join(rest, ["s", "t"]).select(
        F.format_string("%s-%03d-%02d", "ctg", "nth", "alt").alias("ctg"),
        F.lit(0).alias("ord"),
        "sub",
        F.col("es").alias("s"),
        F.col("evia").alias("via"),
        F.col("et").alias("t"),
    )
    return _tiled(rows, table, members)


def _end(node: str):
    return F.element_at(F.split(F.col(node), ":"), -1)


def _rid(node: str):
    return F.element_at(F.split(F.col(node), ":"), 1).cast("long")


def stitch_contigs(tiling: DataFrame, reads: DataFrame, cfg: AssemblyConfig) -> DataFrame:
    """Contig sequences ``ctg, seq`` from tiling rows.

    The first read is taken whole.  Every row aligns the last bases of its first
    read with the matching part of the second; the longest exact run decides
    where the second read takes over.  Alignments run in parallel over rows;
    placing them is a running sum and the text a sorted concatenation.
    """
    over = cfg.stitch_overhang
    texts = reads.select(F.col("rid").cast("long").alias("rid"), normalised(F.col("seq")).alias("seq"))
    rows = tiling.select("ctg", "ord", "length", "v", _rid("v").alias("rv"), _end("v").alias("ev"), _rid("w").alias("rw"), _end("w").alias("ew"))
    left = rows.join(texts.withColumnRenamed("rid", "rv"), "rv").withColumn(
        "whole", oriented(F.col("seq"), F.when(F.col("ev") == "E", 0).otherwise(1))
    )
    left = left.select(
        "ctg", "ord", "length", "rw", "ew",
        F.length("whole").alias("len_v"),
        F.substring(F.col("whole"), F.greatest(F.length("whole") - over + 1, F.lit(1)), F.lit(over)).alias("q"),
        F.when(F.col("ord") == 0, F.col("whole")).alias("first"),
    )
    both = left.join(texts.withColumnRenamed("rid", "rw"), "rw").withColumn(
        "whole", oriented(F.col("seq"), F.when(F.col("ew") == "E", 0).otherwise(1))
    )
    both = both.withColumn(
        "t", F.substring(F.col("whole"), F.greatest(F.length("whole") - F.col("length") - over + 1, F.lit(1)), F.length("whole"))
    ).withColumn("part", F.col("t")).drop("whole", "seq", "rw", "ew")
    m = cut_lineage(match_pairs(both, band=100))
    # places come from narrow rows: running sums forwards, and what is behind from rows in falling order
    order = Window.partitionBy("ctg").orderBy("ord")
    behind = Window.partitionBy("ctg").orderBy(F.col("ord").desc())
    gain = F.col("q_m_end") - F.col("t_m_end") + F.col("length")
    base = F.first("len_v").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = base + F.coalesce(F.sum(gain).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = m.select("ctg", "ord", "q_m_end", "t_m_end", "length", "len_v").select("ctg", "ord", (before - over + F.col("q_m_end")).alias("start"))
    # a later piece overwrites whatever it starts in front of
    later = F.min("start").over(behind.rowsBetween(Window.unboundedPreceding, -1))
    places = starts.select("ctg", "ord", "start", later.alias("later"))
    size = F.greatest(F.col("later") - F.col("start"), F.lit(0))
    piece = F.substring(F.col("part"), F.col("t_m_end") + 1, F.length("part"))
    pieces = m.select("ctg", "ord", "first", piece.alias("piece")).join(places, ["ctg", "ord"])
    pieces = pieces.select(
        "ctg",
        "ord",
        F.when(F.col("ord") == 0, F.substring(F.col("first"), F.lit(1), F.least(F.col("start"), "later", F.length("first")).cast("int"))).alias("head"),
        F.when(F.col("later").isNull(), F.col("piece")).otherwise(F.substring(F.col("piece"), F.lit(1), size.cast("int"))).alias("kept"),
    )
    texts_in_order = F.array_sort(F.collect_list(F.struct("ord", "head", "kept")))
    joined = F.array_join(
        F.transform(texts_in_order, lambda p: F.concat(F.coalesce(p["head"], F.lit("")), p["kept"])), ""
    )
    return pieces.groupBy("ctg").agg(joined.alias("seq"))
