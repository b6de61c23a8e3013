"""Unitigs, their clean-up, bundles and contig paths, on edge tables.

A unitig row is ``s, via, t`` with ``head`` (the name of its first edge), length,
score, ``pre_t`` (the node before ``t``) and a type.  ``via`` names parallel
unitigs so that the other strand of (s, via, t) is (t', via', s').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.functions.sequence import flip_end
from readloom.operators.bubbles import KEY, Bundles, compound_unitigs
from readloom.operators.chains import rank_chains, split_at_mirror
from readloom.operators.kmers import degrees
from readloom.session import cut_lineage, global_index

BUNDLE_VIA = "NA"


def edge_name(v: Column, w: Column) -> Column:
    return F.concat(v, F.lit(">"), w)


def mirror_name(v: Column, w: Column) -> Column:
    return edge_name(flip_end(w), flip_end(v))


def unitig_members(live: DataFrame) -> DataFrame:
    """Kept edges with the unitig they belong to (``head``) and their rank in it.

    An edge continues the one before it when the node between them has one edge
    on either side.
    """
    deg = degrees(live)
    simple = deg.where("in_degree = 1 and out_degree = 1").select(F.col("node").alias("v"))
    before = live.select(F.col("w").alias("v"), edge_name(F.col("v"), F.col("w")).alias("prev"))
    items = live.select("v", "w", edge_name(F.col("v"), F.col("w")).alias("item"), mirror_name(F.col("v"), F.col("w")).alias("mirror"))
    links = cut_lineage(items.join(simple.join(before, "v"), "v", "left").select("item", "prev", "mirror", "v", "w"))
    ranked = split_at_mirror(rank_chains(links.select("item", "prev", "mirror")), links)
    return ranked.join(links.select("item", "v", "w"), "item").join(
        live.select("v", "w", "rid", "sp", "tp", "length", "score", "identity", "best_in"), ["v", "w"]
    ).drop("item")


def unitigs(members: DataFrame) -> DataFrame:
    """One row per unitig from its member edges."""
    row = F.struct("rank", "v", "w")
    u = (
        members.groupBy("head")
        .agg(
            F.min(row).alias("a"),
            F.max(row).alias("z"),
            F.sum("length").alias("length"),
            F.sum("score").alias("score"),
            F.count(F.lit(1)).alias("n_edges"),
        )
        .select(
            "head",
            F.col("a.v").alias("s"),
            F.col("z.w").alias("t"),
            F.col("a.w").alias("post_s"),
            F.col("z.v").alias("pre_t"),
            "length",
            "score",
            "n_edges",
        )
    )
    # of two mirrored unitigs the one with the smaller first edge names both
    leads = F.col("head") <= mirror_name(F.col("pre_t"), F.col("t"))
    return u.withColumn("via", F.when(leads, F.col("post_s")).otherwise(F.col("pre_t"))).withColumn(
        "type", F.lit("simple")
    ).drop("post_s")


def mirrored_keys(keys: DataFrame) -> DataFrame:
    return keys.select(flip_end(F.col("t")).alias("s"), flip_end(F.col("via")).alias("via"), flip_end(F.col("s")).alias("t"))


def both_strands(keys: DataFrame) -> DataFrame:
    return keys.select(*KEY).unionByName(mirrored_keys(keys)).distinct()


def _typed(table: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    hit = keys.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, KEY, "left").withColumn(
        "type", F.when(F.col("_hit"), F.lit(kind)).otherwise(F.col("type"))
    ).drop("_hit")


def _graph(table: DataFrame) -> DataFrame:
    """Unitigs that still take part; closed ones stand for themselves."""
    return table.where(F.col("type").isin("simple", "compound") & (F.col("s") != F.col("t")))


def _vw(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("s").alias("v"), F.col("t").alias("w"))


def spur_unitigs(graph: DataFrame, cutoff: int, radius: int = 10) -> DataFrame:
    """Keys of the unitigs on short dead-end branches (both strands).

    From every node without in-edges walk up to ``radius`` steps; at the nearest
    node that also has an in-edge from outside the walk, the way there goes when
    it is shorter than ``cutoff``.  A joining node gives up one branch, the
    shortest, per round, and rounds repeat until nothing changes.
    """
    graph = cut_lineage(graph.select(*KEY, "length"))
    removed = None
    while True:
        hit = _spur_round(graph, cutoff, radius)
        if hit is None:
            return graph.select(*KEY).limit(0) if removed is None else removed
        removed = hit if removed is None else removed.unionByName(hit)
        graph = cut_lineage(graph.join(hit, KEY, "left_anti"))


def _walk(tips: DataFrame, hops: DataFrame, radius: int, cutoff: int | None) -> DataFrame:
    """Nodes within ``radius`` steps of each tip, with one shortest path.

    With a ``cutoff`` a walk does not continue past that much sequence.
    """
    wave = met = tips.select(
        "tip", F.col("tip").alias("node"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("total"), F.array("tip").alias("path")
    )
    for hop in range(1, radius + 1):
        step = wave.join(hops.withColumnRenamed("s", "node").withColumnRenamed("t", "next"), "node")
        fresh = (
            step.withColumn("total", F.col("total") + F.col("length"))
            .where(F.lit(True) if cutoff is None else F.col("total") < cutoff)
            .groupBy("tip", F.col("next").alias("node"))
            .agg(F.min(F.struct("path", "total")).alias("m"))
            .join(met.select("tip", "node"), ["tip", "node"], "left_anti")
            .select("tip", "node", F.lit(hop).alias("hop"), "m.total", F.concat("m.path", F.array("node")).alias("path"))
        )
        wave = cut_lineage(fresh)
        if wave.isEmpty():
            break
        met = met.unionByName(wave)
    return cut_lineage(met)


def _open_joins(met: DataFrame, joins: DataFrame, graph: DataFrame, cutoff: int) -> DataFrame:
    """Walked nodes with several in-edges, one of them from outside the walk."""
    inner = met.select("tip", F.col("node").alias("s"))
    return (
        met.join(joins, "node")
        .where((F.col("hop") > 0) & (F.col("total") < cutoff))
        .join(graph.select("s", F.col("t").alias("node")).distinct(), "node")
        .join(inner, ["tip", "s"], "left_anti")
        .select("tip", "node", "hop", "total", "path")
        .distinct()
    )


def _spur_round(graph: DataFrame, cutoff: int, radius: int):
    deg = cut_lineage(degrees(_vw(graph)))
    joins = deg.where("in_degree > 1").select("node")
    hops = graph.groupBy("s", "t").agg(F.sum("length").alias("length"))
    tips = deg.where("in_degree = 0").select(F.col("node").alias("tip"))
    if tips.isEmpty() or joins.isEmpty():
        return None
    # short walks tell which tips can matter at all; only those walk in full
    hopeful = _open_joins(_walk(tips, hops, radius, cutoff), joins, graph, cutoff)
    tips = cut_lineage(hopeful.select("tip").distinct())
    if tips.isEmpty():
        return None
    outside = _open_joins(_walk(tips, hops, radius, None), joins, graph, cutoff)
    nearest = outside.groupBy("tip").agg(F.min(F.struct("hop", "node", "total", "path")).alias("m")).select("tip", "m.*")
    chosen = nearest.groupBy("node").agg(F.min(F.struct("total", "tip", "path")).alias("m")).select("m.path")
    steps = chosen.select(F.explode(F.arrays_zip(F.col("path"), F.slice("path", 2, radius + 1).alias("after"))).alias("p"))
    pairs = steps.select(F.col("p.path").alias("s"), F.col("p.after").alias("t")).where("t is not null").distinct()
    hit = cut_lineage(both_strands(graph.join(pairs, ["s", "t"], "left_semi")).join(graph.select(*KEY), KEY, "left_semi"))
    return None if hit.isEmpty() else hit


def duplicate_unitigs(table: DataFrame) -> DataFrame:
    """Short parallel unitigs (at most three nodes) but the first by name."""
    short = table.where((F.col("type") == "simple") & (F.col("n_edges") <= 2))
    first = short.groupBy("s", "t").agg(F.min("via").alias("via"))
    return short.select(*KEY).join(first, KEY, "left_anti")


def repeat_bridges(graph: DataFrame, cutoff: int) -> DataFrame:
    """Short unitigs between a 1-in/2-out and a 2-in/1-out node, both strands."""
    deg = degrees(_vw(graph))
    fork = deg.where("in_degree = 1 and out_degree = 2").select(F.col("node").alias("s"))
    join = deg.where("in_degree = 2 and out_degree = 1").select(F.col("node").alias("t"))
    short = graph.where(F.col("length") < cutoff)
    return both_strands(short.join(fork, "s", "left_semi").join(join, "t", "left_semi"))


def clean_unitigs(members: DataFrame, cfg: AssemblyConfig) -> tuple[DataFrame, Bundles]:
    """The whole unitig phase: returns the typed unitig table and the bundles."""
    table = cut_lineage(unitigs(members))
    table = cut_lineage(_typed(table, spur_unitigs(_graph(table), cfg.spur_first), "spur:2"))
    table = cut_lineage(_typed(table, duplicate_unitigs(_graph(table)), "simple_dup"))
    comp = compound_unitigs(_graph(table), cfg.bundle_longest)
    inside = comp.edges.select(*KEY).distinct()
    table = _typed(table, inside, "contained")
    as_rows = comp.found.select(
        *[
            F.col(c) if c in ("s", "t", "length", "score") else F.lit(v).cast(ty).alias(c)
            for c, v, ty in (
                ("head", None, "string"), ("s", None, ""), ("t", None, ""), ("pre_t", None, "string"),
                ("length", None, ""), ("score", None, ""), ("n_edges", None, "long"),
                ("via", BUNDLE_VIA, "string"), ("type", "compound", "string"),
            )
        ]
    )
    table = cut_lineage(table.unionByName(as_rows))
    table = cut_lineage(_typed(table, repeat_bridges(_graph(table), cfg.repeat_bridge), "repeat_bridge"))
    table = cut_lineage(_typed(table, spur_unitigs(_graph(table), cfg.spur_second), "spur:2"))
    return table, comp


def contig_paths(table: DataFrame, comp: Bundles, best_in: DataFrame) -> DataFrame:
    """Contigs as ordered unitigs: ``ctg, type, ord, s, via, t, length, score``.

    A unitig is followed by the only out-edge of its end node when that node has
    no other in-edge, or when the unitig brings the node's best overlap
    (``best_in`` has ``w, best_in``).  Lists of such steps are contigs; where two
    lists want the same unitig, on either strand, the longer one gets it and the
    other one is cut there.
    """
    graph = cut_lineage(_graph(table))
    name = F.concat_ws("~", "s", "via", "t")
    other = F.concat_ws("~", flip_end(F.col("t")), flip_end(F.col("via")), flip_end(F.col("s")))
    g = graph.withColumn("item", name).withColumn("mirror", other)
    deg = degrees(_vw(graph)).withColumnRenamed("node", "t")
    arrives = graph.select(*KEY, "pre_t").where("pre_t is not null")
    inner = (
        comp.edges.where(F.col("t") == F.col("bt"))
        .select("bs", *KEY)
        .join(table.where("pre_t is not null").select(*KEY, "pre_t"), KEY)
        .select(F.col("bs").alias("s"), F.lit(BUNDLE_VIA).alias("via"), "t", "pre_t")
    )
    best = (
        arrives.unionByName(inner)
        .join(best_in.select(F.col("w").alias("t"), "best_in"), "t")
        .where(F.col("pre_t") == F.col("best_in"))
        .select(*KEY)
        .distinct()
        .withColumn("brings_best", F.lit(True))
    )
    follows = (
        g.join(deg, "t")
        .where("out_degree = 1")
        .join(best, KEY, "left")
        .where((F.col("in_degree") == 1) | F.col("brings_best"))
        .groupBy(F.col("t").alias("s"))
        .agg(F.min("item").alias("prev"))
    )
    links = cut_lineage(g.join(follows, "s", "left").select("item", "prev", "mirror"))
    ranked = split_at_mirror(rank_chains(links), links)
    pieces = ranked.join(g.select("item", "mirror", *KEY, "length", "score"), "item").withColumnRenamed("head", "owner")
    won = cut_lineage(_claim_in_order(pieces))
    return _numbered(won, table)


def _claim_in_order(pieces: DataFrame) -> DataFrame:
    """Longest list first; a list is cut where an earlier one took a unitig."""
    active = cut_lineage(pieces.withColumn("canon", F.least("item", "mirror")))
    won = None
    while not active.isEmpty():
        size = active.groupBy("owner").agg((-F.sum("length")).alias("size"))
        keyed = active.join(size, "owner").withColumn("key", F.struct("size", "owner"))
        best = keyed.groupBy("canon").agg(F.min("key").alias("best"))
        judged = keyed.join(best, "canon")
        blocked = judged.where(F.col("key") != F.col("best")).select("owner").distinct()
        settled = cut_lineage(active.join(blocked, "owner", "left_anti"))
        won = settled if won is None else won.unionByName(settled)
        taken = settled.select("canon").distinct().withColumn("gone", F.lit(1))
        marked = active.join(settled.select("owner").distinct(), "owner", "left_anti").join(taken, "canon", "left")
        # the number of lost unitigs before a place tells the piece it falls into
        part = F.sum(F.coalesce("gone", F.lit(0))).over(
            _window("owner", "rank")
        )
        left = marked.withColumn("part", part).where("gone is null")
        active = cut_lineage(
            left.withColumn("owner", F.when(F.col("part") == 0, F.col("owner")).otherwise(F.concat_ws("#", "owner", "part")))
            .drop("part", "gone")
        )
    return pieces.withColumn("canon", F.col("item")).limit(0) if won is None else won


def _window(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _numbered(won: DataFrame, table: DataFrame) -> DataFrame:
    ends = won.groupBy("owner").agg(
        F.sum("length").alias("total"),
        F.min(F.struct("rank", "s")).alias("a"),
        F.max(F.struct("rank", "t")).alias("z"),
    )
    open_ = ends.select(
        "owner", "total", F.when(F.col("a.s") == F.col("z.t"), "ctg_circular").otherwise("ctg_linear").alias("ctg_type"), F.lit(0).alias("closed")
    )
    rings = table.where((F.col("s") == F.col("t")) & (F.col("type") == "simple"))
    ring_rows = rings.select(
        F.concat_ws("~", *KEY).alias("owner"), *KEY, "length", "score", F.lit(0).cast("long").alias("rank")
    )
    ring_ends = ring_rows.select("owner", F.col("length").alias("total"), F.lit("ctg_circular").alias("ctg_type"), F.lit(1).alias("closed"))
    order = global_index(open_.unionByName(ring_ends), ["closed", F.col("total").desc(), "owner"], "nth")
    label = F.when(F.col("closed") == 0, F.concat(F.lpad(F.col("nth").cast("string"), 6, "0"), F.lit("F"))).otherwise(
        F.lpad(F.col("nth").cast("string"), 6, "0")
    )
    rows = won.select("owner", *KEY, "length", "score", "rank").unionByName(ring_rows.select("owner", *KEY, "length", "score", "rank"))
    return rows.join(order.select("owner", "ctg_type", label.alias("ctg")), "owner").select(
        "ctg", "ctg_type", F.col("rank").alias("ord"), *KEY, "length", "score"
    )
