"""Text and Parquet forms of the intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.operators.bubbles import Bundles

# Column order of the positional text formats.
INDEX_SCHEMA = "rid long, name string, len int, offset long"
OVERLAP_SCHEMA = (
    "rid0 long, rid1 long, score int, identity double, strand0 int, a_bgn int, a_end int, len0 int, "
    "strand1 int, b_bgn int, b_end int, len1 int, type string"
)
MAP_SCHEMA = (
    "ref_id long, ref_bgn int, ref_end int, read_id long, read_bgn int, read_end int, direction int, mc0 long, mc1 long"
)
GRAPH_SCHEMA = "v string, w string, rid string, sp int, tp int, score int, identity double, type string"
UNITIG_SCHEMA = "s string, via string, t string, type string, length long, score long, path string"
CONTIG_SCHEMA = "ctg string, ctg_type string, first string, end string, length long, score long, unitigs string"
TILING_SCHEMA = (
    "ctg string, v string, w string, rid string, sp int, tp int, score int, identity double, offset long, length int"
)
TRUTH_SCHEMA = "name string, s int, e int"

COUNT_SCHEMA = "hash long, mc long"

END_MARK = "-"


def read_rows(spark: SparkSession, path, schema: str, sep: str = " ", marked: bool = False) -> DataFrame:
    """Positional text rows; padding between columns and the end mark are skipped.

    With ``marked`` a table without its end mark, one that was cut short, is an error.
    """
    if marked and spark.read.text(path).where(F.trim("value") == END_MARK).isEmpty():
        raise ValueError(f"{path} has no end mark: it was not written to its end")
    names = [part.split()[0] for part in schema.split(", ")]
    types = [part.split()[1] for part in schema.split(", ")]
    lines = spark.read.text(path).where((F.trim("value") != END_MARK) & (F.trim("value") != ""))
    cols = F.split(F.trim("value"), r"\s+" if sep == " " else sep)
    return lines.select(*[cols.getItem(i).cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types))])


def read_truth(spark: SparkSession, path) -> DataFrame:
    return read_rows(spark, path, TRUTH_SCHEMA, "\t")


def read_overlaps(spark: SparkSession, path) -> DataFrame:
    """Overlap records of a table that was written to its end."""
    return read_rows(spark, path, OVERLAP_SCHEMA, marked=True)


def read_tiling(spark: SparkSession, path) -> DataFrame:
    """Tiling rows with their place ``ord``, which their running offsets tell."""
    rows = read_rows(spark, path, TILING_SCHEMA)
    order = Window.partitionBy("ctg").orderBy("offset", "v", "w")
    return rows.withColumn("ord", F.row_number().over(order) - 1)


def read_unitigs(spark: SparkSession, path) -> DataFrame:
    """Unitigs with the nodes of simple ones and the unitigs inside bundles, as arrays."""
    rows = read_rows(spark, path, UNITIG_SCHEMA)
    inner = F.transform(F.split("path", r"\|"), _edge)
    closed = F.col("via") == "NA"
    return rows.withColumn("nodes", F.when(~closed, F.split("path", "~"))).withColumn("edges", F.when(closed, inner))


def read_contigs(spark: SparkSession, path) -> DataFrame:
    """Contigs with their unitigs in order."""
    return read_rows(spark, path, CONTIG_SCHEMA).withColumn("steps", F.transform(F.split("unitigs", r"\|"), _edge))


def _edge(text: Column) -> Column:
    part = F.split(text, "~")
    return F.struct(part[0].alias("s"), part[1].alias("via"), part[2].alias("t"))


def read_index(reads: DataFrame) -> DataFrame:
    """Index rows: number, name and length of each read.

    The byte offset into a flat store has no meaning here and is left out.
    """
    return reads.select("rid", "name", F.length("seq").alias("len"))


def overlap_lines(records: DataFrame) -> DataFrame:
    cols = [c.split()[0] for c in OVERLAP_SCHEMA.split(", ")]
    return records.select(
        F.format_string("%09d %09d %d %.1f %d %d %d %d %d %d %d %d %s", *[F.col(c) for c in cols]).alias("value")
    )


def map_lines(rows: DataFrame) -> DataFrame:
    cols = [c.split()[0] for c in MAP_SCHEMA.split(", ")]
    return rows.select(F.concat_ws(" ", *[F.col(c) for c in cols]).alias("value"))


def graph_lines(edges: DataFrame) -> DataFrame:
    cols = ["v", "w", "rid", "sp", "tp", "score", "identity", "type"]
    return edges.select(F.format_string("%s %s %s %5d %5d %5d %5.2f %s", *cols).alias("value"))


def tiling_lines(tiling: DataFrame) -> DataFrame:
    cols = ["ctg", "v", "w", "rid", "sp", "tp", "score", "identity", "offset", "length"]
    return tiling.select("ctg", "ord", F.format_string("%s %s %s %s %d %d %d %.2f %d %d", *cols).alias("value")).orderBy(
        "ctg", "ord"
    ).select("value")


def unitig_lines(table: DataFrame, members: DataFrame, bundles: Bundles) -> DataFrame:
    """Unitigs with their node path (``~``) or, for bundles, their edges (``|``)."""
    nodes = members.groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("rank", "v", "w"))).alias("steps")
    ).select(
        "head",
        F.concat_ws("~", F.concat(F.array(F.col("steps")[0]["v"]), F.transform("steps", lambda x: x["w"]))).alias("nodes"),
    )
    inner = _inner_text(bundles).select(F.col("bs").alias("s"), F.lit("NA").alias("via"), F.col("bt").alias("t"), "inner")
    full = table.join(nodes, "head", "left").join(inner, ["s", "via", "t"], "left")
    return full.select(
        F.concat_ws(" ", "s", "via", "t", "type", "length", "score", F.coalesce("nodes", "inner")).alias("value")
    )


def _inner_text(bundles: Bundles) -> DataFrame:
    """The unitigs inside each bundle as one text: ``bs, bt, inner``."""
    edge = F.concat_ws("~", "s", "via", "t")
    return bundles.edges.groupBy("bs", "bt").agg(F.concat_ws("|", F.array_sort(F.collect_list(edge))).alias("inner"))


def bundle_lines(bundles: Bundles) -> DataFrame:
    """Bundles with length, score and the unitigs inside."""
    found = bundles.found.select(F.col("s").alias("bs"), F.col("t").alias("bt"), "length", "score")
    rows = found.join(_inner_text(bundles), ["bs", "bt"])
    return rows.select(F.concat_ws(" ", "bs", F.lit("NA"), "bt", F.lit("compound"), "length", "score", "inner").alias("value"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """A list of nodes, such as the chimeric ones."""
    return nodes.select(F.col("node").alias("value"))


def contig_lines(contigs: DataFrame) -> DataFrame:
    step = F.struct("ord", F.concat_ws("~", "s", "via", "t").alias("u"), "t")
    return (
        contigs.groupBy("ctg", "ctg_type")
        .agg(F.sum("length").alias("length"), F.sum("score").alias("score"), F.array_sort(F.collect_list(step)).alias("steps"))
        .select(
            F.concat_ws(
                " ", "ctg", "ctg_type", F.col("steps")[0]["u"], F.element_at("steps", -1)["t"], "length", "score",
                F.concat_ws("|", F.transform("steps", lambda x: x["u"])),
            ).alias("value")
        )
    )


def write_lines(lines: DataFrame, path: str, marked: bool = False) -> None:
    """Text lines; with ``marked`` the end mark stands in the last file, which is there only when all are."""
    rows = lines.select("value")
    if marked:
        end = rows.sparkSession.range(1, numPartitions=1).select(F.lit(END_MARK).alias("value"))
        # the parts of a union keep their order
        rows = rows.union(end)
    rows.write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """Minimizer counts as Parquet."""
    counts.select(*[F.col(p.split()[0]).cast(p.split()[1]) for p in COUNT_SCHEMA.split(", ")]).write.mode("overwrite").parquet(path)


def read_counts(spark: SparkSession, *paths: str) -> DataFrame:
    """Counts of one or several chunks; hashes that stand in several are added up."""
    parts = spark.read.schema(COUNT_SCHEMA).parquet(*paths)
    return parts if len(paths) == 1 else parts.groupBy("hash").agg(F.sum("mc").alias("mc"))


def write_sketch(sketches: DataFrame, path: str) -> None:
    """Sketches as Parquet, a folder per level."""
    sketches.write.mode("overwrite").partitionBy("level").parquet(path)


def read_sketch(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)
