"""String graph: edges from overlaps, reductions and edge types.

Nodes are read ends, ``"<rid>:B"`` and ``"<rid>:E"``.  The reverse complement of
edge v->w is flip(w)->flip(v); reductions always mark both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.functions.sequence import flip_end
from readloom.session import cut_lineage

EDGE = ["v", "w"]


def contained_reads(records: DataFrame) -> DataFrame:
    inner = F.when(F.col("type") == "contained", F.col("rid0")).when(F.col("type") == "contains", F.col("rid1"))
    return records.where(F.col("rid0") != F.col("rid1")).select(inner.alias("rid")).where("rid is not null").distinct()


def usable_overlaps(records: DataFrame, min_len: int = 4000, min_identity: float = 96.0) -> DataFrame:
    """Dovetail records good enough for the graph, contained reads taken out."""
    inner = contained_reads(records)
    good = records.where(
        (F.col("rid0") != F.col("rid1"))
        & (F.col("type") == "overlap")
        & (F.col("identity") >= min_identity)
        & (F.col("len0") >= min_len)
        & (F.col("len1") >= min_len)
    )
    for side in ("rid0", "rid1"):
        good = good.join(inner.select(F.col("rid").alias(side)), side, "left_anti")
    return good


def string_edges(overlaps: DataFrame) -> DataFrame:
    """Two complementary edges for every dovetail with an overhang on each read.

    ``rid, sp, tp`` label the part of the target read the edge adds.
    """
    f, g = F.col("rid0").cast("string"), F.col("rid1").cast("string")
    same = F.col("strand1") == 0
    g_first = F.when(same, F.col("b_bgn")).otherwise(F.col("b_end"))
    g_last = F.when(same, F.col("b_end")).otherwise(F.col("b_bgn"))
    ahead = F.col("a_bgn") > 0

    def node(rid: Column, end: Column | str) -> Column:
        return F.concat(rid, F.lit(":"), F.lit(end) if isinstance(end, str) else end)

    # end of g that lies beyond f, and where g's overhang starts and stops
    outer = F.when(ahead == same, F.lit("E")).otherwise(F.lit("B"))
    from_g = F.when(ahead, g_last).otherwise(g_first)
    to_g = F.when(outer == "E", F.col("len1")).otherwise(F.lit(0))
    from_f = F.when(ahead, F.col("a_bgn")).otherwise(F.col("a_end"))
    to_f = F.when(ahead, F.lit(0)).otherwise(F.col("len0"))
    f_out = F.when(ahead, F.lit("B")).otherwise(F.lit("E"))

    def edge(src, dst, rid, sp, tp) -> Column:
        return F.struct(
            src.alias("v"),
            dst.alias("w"),
            rid.alias("rid"),
            sp.cast("int").alias("sp"),
            tp.cast("int").alias("tp"),
            F.abs(sp - tp).cast("int").alias("length"),
            (-F.col("score")).alias("score"),
            F.col("identity").alias("identity"),
        )

    def other(end: Column) -> Column:
        return F.translate(end, "BE", "EB")

    into_f = edge(node(g, other(outer)), node(f, f_out), F.col("rid0"), from_f, to_f)
    into_g = edge(node(f, other(f_out)), node(g, outer), F.col("rid1"), from_g, to_g)
    return (
        overlaps.where((from_f != to_f) & (from_g != to_g))
        .select(F.explode(F.array(into_f, into_g)).alias("e"))
        .select("e.*")
    )


def complemented(keys: DataFrame) -> DataFrame:
    """The edge keys together with their reverse complements."""
    mirror = keys.select(flip_end(F.col("w")).alias("v"), flip_end(F.col("v")).alias("w"))
    return keys.select(*EDGE).unionByName(mirror).distinct()


def _minus(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys, EDGE, "left_anti")


def _out_in(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy("w").agg(F.count(F.lit(1)).alias("n_in"))
    return out, into


def transitive_edges(edges: DataFrame, fuzz: int = 500) -> DataFrame:
    """Keys of the transitively reducible edges.

    Of the out-edges of v, v->x goes when some v->w, w->x is no longer than the
    longest out-edge of v plus ``fuzz`` and w has not itself been eliminated by
    a shorter edge, or when w->x is the shortest out-edge of w or shorter than
    ``fuzz``.  Two hops are one equi-join; only the elimination order inside a
    node is a fold, over the triangles of that node.
    """
    e = edges.select("v", "w", "length")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("length", "w"))
    longest = e.groupBy("v").agg((F.max("length") + fuzz).alias("limit"))
    out = e.withColumn("nth", nth)
    first_hop = out.join(longest, "v").select("v", F.col("w").alias("mid"), "length", "nth", "limit")
    second_hop = out.select(
        F.col("v").alias("mid"), F.col("w").alias("x"), F.col("length").alias("length2"), (F.col("nth") == 1).alias("nearest")
    )
    closing = out.select("v", F.col("w").alias("x"), F.col("nth").alias("x_nth"))
    triangles = first_hop.join(second_hop, "mid").join(closing, ["v", "x"])
    near = triangles.where(F.col("nearest") | (F.col("length2") < fuzz)).select("v", F.col("x").alias("w"))
    short = triangles.where(F.col("length2") + F.col("length") < F.col("limit"))
    steps = F.array_sort(F.collect_list(F.struct("nth", "x_nth")))
    fold = F.aggregate(
        steps,
        F.array().cast("array<int>"),
        lambda gone, t: F.when(F.array_contains(gone, t["nth"]), gone).otherwise(
            F.array_union(gone, F.array(t["x_nth"]))
        ),
    )
    chained = (
        short.groupBy("v")
        .agg(fold.alias("gone"))
        .select("v", F.explode("gone").alias("nth"))
        .join(out, ["v", "nth"])
        .select(*EDGE)
    )
    return complemented(near.unionByName(chained))


def chimer_candidates(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Targets of a fan-out that are also sources of a fan-in (live edges)."""
    out, into = _out_in(live)
    fan_out = live.join(out.where("n_out >= 2"), "v").select(F.col("w").alias("node"))
    fan_in = live.join(into.where("n_in >= 2"), "w").select(F.col("v").alias("node"))
    return fan_out.intersect(fan_in)


def bounded_walks(starts: DataFrame, edges: DataFrame, pops: int = 4) -> DataFrame:
    """Nodes met by a breadth-limited walk from each start.

    ``starts`` has ``node`` (never entered), ``side`` and ``start``.  A walk
    takes the smallest open node ``pops`` times and adds its successors.
    """
    has_out = edges.select("v").distinct().select(F.col("v").alias("w"), F.lit(True).alias("open"))
    steps = (
        edges.select("v", "w")
        .join(has_out, "w", "left")
        .groupBy("v")
        .agg(
            F.collect_set("w").alias("next"),
            F.collect_set(F.when(F.col("open"), F.col("w"))).alias("next_open"),
        )
        .withColumnRenamed("v", "at")
    )
    steps = cut_lineage(steps)
    state = starts.withColumn("seen", F.array("start")).withColumn("open", F.array("start"))
    for _ in range(pops):
        state = (
            state.withColumn("at", F.array_min("open"))
            .join(steps, "at", "left")
            .withColumn("fresh", F.array_except(F.coalesce("next", F.array().cast("array<string>")), F.concat("seen", F.array("node"))))
            .withColumn(
                "open",
                F.array_union(
                    F.array_except("open", F.array("at")),
                    F.array_intersect("fresh", F.coalesce("next_open", F.array().cast("array<string>"))),
                ),
            )
            .withColumn("open", F.filter("open", lambda c: c.isNotNull()))
            .withColumn("seen", F.concat("seen", "fresh"))
            .select("node", "side", "start", "seen", "open")
        )
    return state.select("node", "side", F.explode("seen").alias("met"))


def chimer_nodes(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Candidates whose two flows never meet within a short walk.

    One flow starts at the successors, the other at the other successors of the
    predecessors (all edges count, reduced or not).
    """
    cand = cut_lineage(chimer_candidates(edges, live))
    if cand.isEmpty():
        return cand
    e = edges.select(*EDGE)
    ahead = cand.join(e.select(F.col("v").alias("node"), F.col("w").alias("start")), "node")
    before = cand.join(e.select(F.col("w").alias("node"), F.col("v").alias("p")), "node")
    beside = (
        before.join(e.select(F.col("v").alias("p"), F.col("w").alias("start")), "p")
        .where(F.col("start") != F.col("node"))
        .select("node", "start")
        .distinct()
    )
    starts = cut_lineage(ahead.withColumn("side", F.lit("a")).unionByName(beside.withColumn("side", F.lit("b"))))
    met = bounded_walks(starts, e).distinct()
    # a shared neighbour is a shared start, hence also met by both flows
    shared = met.groupBy("node", "met").agg(F.countDistinct("side").alias("sides")).where("sides = 2")
    return cand.join(shared.select("node"), "node", "left_anti")


def chimer_edges(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Live edges at chimeric nodes, with complements."""
    bad = chimer_nodes(edges, live)
    at_v = live.join(bad.select(F.col("node").alias("v")), "v", "left_semi").select(*EDGE)
    at_w = live.join(bad.select(F.col("node").alias("w")), "w", "left_semi").select(*EDGE)
    return complemented(at_v.unionByName(at_w))


def spur_edges(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Live edges of a branching node that lead to, or come from, a dead end.

    All nodes are judged on the same state of the graph.
    """
    out_all, in_all = _out_in(edges)
    out, into = _out_in(live)
    leaves = (
        live.join(out.where("n_out > 1"), "v", "left_semi")
        .join(out_all.select(F.col("v").alias("w")), "w", "left_anti")
        .select(*EDGE)
    )
    roots = (
        live.join(into.where("n_in > 1"), "w", "left_semi")
        .join(in_all.select(F.col("w").alias("v")), "v", "left_anti")
        .select(*EDGE)
    )
    return complemented(leaves.unionByName(roots))


def best_edges(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best out-edge and best in-edge of every node, by score.

    Ties go to the shorter edge, then to the smaller node name.
    """
    order = [(-F.col("score")).alias("s"), F.col("length").alias("l")]
    out = live.groupBy("v").agg(F.min(F.struct(*order, "w")).alias("m")).select("v", "m.w")
    into = live.groupBy("w").agg(F.min(F.struct(*order, "v")).alias("m")).select("m.v", "w")
    return out, into


def not_best_edges(live: DataFrame) -> DataFrame:
    """Live edges that are best for neither of their nodes, with complements."""
    out, into = best_edges(live)
    return complemented(_minus(live, out.unionByName(into).distinct()))


def local_flow_edges(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges that compete with a plain node and share no neighbour with it.

    For a node v with one live edge on each side: another live edge from v's
    predecessor to ww goes when ww has several live in-edges, is not itself
    plain and has no successor in common with v; mirrored on the other side.
    """
    out, into = _out_in(live)
    plain = (
        out.where("n_out = 1")
        .select(F.col("v").alias("node"))
        .join(into.where("n_in = 1").select(F.col("w").alias("node")), "node")
    )

    def one_side(src: str, dst: str, many: DataFrame, counted: str) -> DataFrame:
        step = live.select(F.col(src).alias("p"), F.col(dst).alias("n"))
        beside = (
            plain.withColumnRenamed("node", "n")
            .join(step, "n")
            .select(F.col("n").alias("node"), "p")
            .join(step.withColumnRenamed("n", "rival"), "p")
            .where(F.col("rival") != F.col("node"))
            .join(many.where(f"{counted} > 1").select(F.col(dst).alias("rival")), "rival", "left_semi")
            .join(plain.select(F.col("node").alias("rival")), "rival", "left_anti")
        )
        beyond = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
        common = (
            beside.join(beyond.select(F.col("a").alias("node"), "b"), "node")
            .join(beyond.select(F.col("a").alias("rival"), "b"), ["rival", "b"])
            .select("node", "rival")
            .distinct()
        )
        kept = beside.join(common, ["node", "rival"], "left_anti")
        return kept.select(F.col("p").alias(src), F.col("rival").alias(dst)).select(*EDGE)

    forward = one_side("v", "w", into, "n_in")
    backward = one_side("w", "v", out, "n_out")
    return forward.unionByName(backward).distinct()


def reduce_graph(edges: DataFrame, cfg: AssemblyConfig) -> DataFrame:
    """All reductions in order; returns the edges with their type.

    G kept, C chimeric, R not best, S spur, TR transitive.  A kept edge also
    carries ``best_in``, the best predecessor of its target before R applied.
    """
    edges = cut_lineage(edges)
    tr = cut_lineage(transitive_edges(edges, cfg.fuzz))
    live = _minus(edges, tr)
    marks = []
    if cfg.chimer_removal:
        chimer = cut_lineage(chimer_edges(edges, live))
        marks.append((chimer, "C", 1))
        live = _minus(live, chimer)
    spurs = cut_lineage(spur_edges(edges, live))
    live = cut_lineage(_minus(live, spurs))
    if cfg.local_flow:
        repeats, best_in = local_flow_edges(edges, live), None
    else:
        repeats, best_in = not_best_edges(live), best_edges(live)[1]
    repeats = cut_lineage(repeats)
    live = _minus(live, repeats)
    late = spur_edges(edges, live)
    marks += [(repeats, "R", 2), (spurs.unionByName(late), "S", 3), (tr, "TR", 4)]

    marked = reduce(
        DataFrame.unionByName, [keys.select(*EDGE, F.lit(rank).alias("rank")) for keys, _, rank in marks]
    )
    rank = marked.groupBy(*EDGE).agg(F.min("rank").alias("rank"))
    name = F.lit("G")
    for _, kind, r in marks:
        name = F.when(F.col("rank") == r, F.lit(kind)).otherwise(name)
    typed = edges.join(rank, EDGE, "left").withColumn("type", name).drop("rank")
    if best_in is None:
        return typed.withColumn("best_in", F.lit(None).cast("string"))
    return typed.join(best_in.select("w", F.col("v").alias("best_in")), "w", "left").select(*typed.columns, "best_in")
