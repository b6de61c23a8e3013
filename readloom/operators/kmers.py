"""k-mer tables, seed matches and the k-mer graph, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import XOR_K, XOR_KEY
from readloom.operators import kernels
from readloom.session import cut_lineage, join_bounded

# bases whose k-mers are made at once; bounds the memory of a task whatever the batch size
BASES_AT_ONCE = 250_000


def kmer_rows(reads: DataFrame, k: int, step: int = 1) -> DataFrame:
    """``rid, pos, code, rcode`` of every k-mer without ambiguous bases.

    ``pos`` is the 0-based first base; codes use two bits a base, first base
    highest.  Only every ``step``-th start is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, bounds = kernels.text_buffer(batch.column(1))
            for start in range(0, raw.size, BASES_AT_ONCE):
                stop = min(start + BASES_AT_ONCE, raw.size)
                # k-mers that end in this stretch begin up to k - 1 bases before it
                lead = min(start, k - 1)
                codes = kernels._CODES[raw[start - lead : stop]]
                bad = np.cumsum(np.r_[0, codes > 3], dtype=np.int32)
                last = np.arange(start, stop)
                row = np.searchsorted(bounds, last, side="right") - 1
                pos = last - bounds[row]
                ok = np.flatnonzero((pos >= k - 1) & ((pos - (k - 1)) % step == 0))
                here = ok + lead + 1
                at = ok[bad[here] == bad[here - k]]
                fwd, rev = kernels.kmer_codes(np.minimum(codes, 3), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rids[row[at]], pa.int64()),
                        pa.array(pos[at] - (k - 1), pa.int32()),
                        pa.array(fwd[at + lead].astype(np.int64)),
                        pa.array(rev[at + lead].astype(np.int64)),
                    ],
                    names=["rid", "pos", "code", "rcode"],
                )

    return reads.select(F.col("rid").cast("long"), "seq").mapInArrow(
        run, "rid long, pos int, code long, rcode long"
    )


def xor_minimizers(reads: DataFrame, window: int = 64) -> DataFrame:
    """First-occurrence minimizers of xor-hashed 16-mers on both strands.

    Case is ignored and other letters count as A.  The smallest hash of the
    first ``window`` k-mers is reported, then every strictly smaller one, and
    after ``window`` places without one the earliest smallest of the k-mers that
    follow the expired minimizer.  The k-mer ending the sequence is not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, bounds = kernels.text_buffer(batch.column(1))
            for start, stop in kernels.slices(bounds, BASES_AT_ONCE):
                part = bounds[start : stop + 1]
                text, part = raw[part[0] : part[-1]], part - part[0]
                codes = kernels._CODES[text]
                codes = np.where((codes > 3) | (text == ord("U")) | (text == ord("u")), 0, codes)
                for strand, one, first in ((0, codes, part[:-1]), (1, 3 - codes[::-1], part[-1] - part[1:])):
                    fwd, _ = kernels.kmer_codes(one, XOR_K)
                    h = (fwd ^ np.uint64(XOR_KEY)).astype(np.uint32)
                    row, pos = _record_minima(h, first + XOR_K - 1, np.diff(part) - XOR_K, window)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rids[start + row], pa.int64()),
                            pa.array(np.full(row.size, strand), pa.int32()),
                            pa.array(pos, pa.int32()),
                            pa.array(h[(first + XOR_K - 1)[row] + pos].astype(np.int64)),
                        ],
                        names=["rid", "strand", "pos", "hash"],
                    )

    return reads.select(F.col("rid").cast("long"), "seq").mapInArrow(
        run, "rid long, strand int, pos int, hash long"
    )


def _record_minima(h: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """List and place of the minimizers of lists that lie in ``h`` from ``first`` on, ``size`` long.

    All lists jump together from one reported minimizer to the next.  The next
    one is the first strictly smaller value within ``window - 1`` places, else
    the earliest minimum of the ``window`` places after it.
    """
    h = np.r_[h, np.full(window + 1, np.iinfo(h.dtype).max, h.dtype)]
    ahead, none = np.arange(window), np.zeros(0, np.int64)
    row = np.flatnonzero(size >= window)
    at = h[first[row][:, None] + ahead].argmin(axis=1) if row.size else none
    rows, places = [none], [none]
    while row.size:
        rows.append(row)
        places.append(at)
        begin, end = first[row], size[row]
        full = at + 1 + window <= end
        place = at[:, None] + 1 + ahead
        values = h[np.minimum(begin[:, None] + place, h.size - 1)]
        # places up to the end of the first window were already considered
        smaller = (values < h[begin + at][:, None]) & (place >= window) & (place < end[:, None])
        smaller[full, -1] = False
        found = smaller.any(axis=1)
        on = found | full
        step = np.where(found, smaller.argmax(axis=1), values.argmin(axis=1))
        row, at = row[on], (at + 1 + step)[on]
    return np.concatenate(rows), np.concatenate(places)


def seed_matches(queries: DataFrame, targets: DataFrame, k: int, mask_count: int | None = None) -> DataFrame:
    """Exact k-mer matches; queries are sampled every k/2 bases.

    ``mask_count`` leaves out target k-mers that occur more often.
    """
    t = kmer_rows(targets, k).select(F.col("rid").alias("t_id"), F.col("pos").alias("t_pos"), "code")
    if mask_count is not None:
        common = t.groupBy("code").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > mask_count)
        t = t.join(common.select("code"), "code", "left_anti")
    q = kmer_rows(queries, k, max(k // 2, 1)).select(F.col("rid").alias("q_id"), F.col("pos").alias("q_pos"), "code")
    # with a mask every code has few targets, so a code that is hot among the queries is harmless
    met = q.join(t, "code") if mask_count is None else join_bounded(q, t, "code")
    return met.select("q_id", "t_id", "q_pos", "t_pos")


PAIR_ID = ["q_id", "t_id"]


def diagonal_mode(matches: DataFrame, bin_size: int) -> DataFrame:
    """Fullest diagonal bin of each sequence pair, the first on a tie."""
    low = matches.groupBy(*PAIR_ID).agg(F.min(F.col("q_pos") - F.col("t_pos")).alias("d_min"))
    bins = (
        matches.join(low, PAIR_ID)
        .groupBy(*PAIR_ID, F.floor((F.col("q_pos") - F.col("t_pos") - F.col("d_min")) / bin_size).alias("bin"))
        .agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("q_pos", "t_pos")).alias("first"))
    )
    top = F.min(F.struct((-F.col("hits")).alias("n"), "first", "bin"))
    return bins.groupBy(*PAIR_ID).agg(top.alias("m")).select(*PAIR_ID, "m.bin", (-F.col("m.n")).alias("hits"))


def densest_diagonal(matches: DataFrame, share: float = 0.05) -> DataFrame:
    """Start of the diagonal window holding most matches, the lowest on a tie.

    The window spans ``share`` of the summed largest positions.  Equal diagonals
    are counted first, so the running frame sees distinct diagonals only.  They
    are written once: widths and both ends of the windows read them, and without
    that each would look for the matches again.
    """
    per = cut_lineage(
        matches.groupBy(*PAIR_ID, (F.col("q_pos") - F.col("t_pos")).alias("d")).agg(
            F.count(F.lit(1)).alias("c"), F.max("q_pos").alias("mq"), F.max("t_pos").alias("mt")
        )
    )
    size = per.groupBy(*PAIR_ID).agg(F.floor(share * (F.max("mq") + F.max("mt"))).cast("int").alias("width"))
    per = per.join(size, PAIR_ID)
    # running counts over the diagonals and over the ends of their windows
    points = per.select(*PAIR_ID, "d", "width", F.col("d").alias("at"), "c", F.lit(0).alias("kind"))
    stops = per.select(
        *PAIR_ID, "d", "width", (F.col("d") + F.col("width")).alias("at"), F.lit(0).cast("long").alias("c"), F.lit(1).alias("kind")
    )
    order = Window.partitionBy(*PAIR_ID).orderBy("at", "kind", "d").rowsBetween(Window.unboundedPreceding, 0)
    run = points.unionByName(stops).withColumn("run", F.sum("c").over(order))
    hits = run.groupBy(*PAIR_ID, "d", "width").agg(
        (F.max(F.when(F.col("kind") == 1, F.col("run"))) - F.max(F.when(F.col("kind") == 0, F.col("run") - F.col("c")))).alias("hits")
    )
    best = F.min(F.struct((-F.col("hits")).alias("n"), "d", "width"))
    return hits.groupBy(*PAIR_ID).agg(best.alias("m")).select(
        *PAIR_ID, F.col("m.d").alias("d"), "m.width", (-F.col("m.n")).alias("hits")
    )


def alignment_range(matches: DataFrame, bin_size: int, min_hits: int, near: int = 5, gain: int = 32) -> DataFrame:
    """Best-scoring run of matches near the modal diagonal of each pair.

    A match scores ``gain`` minus the distance to the one before it; the score
    restarts at 0 when it would turn negative.  With running sums S the best run
    is the largest S minus its running minimum, so no fold over rows is needed.
    Matches are written once; bins, their modes and the runs all read them.
    """
    matches = cut_lineage(matches)
    low = matches.groupBy(*PAIR_ID).agg(F.min(F.col("q_pos") - F.col("t_pos")).alias("d_min"))
    binned = matches.join(low, PAIR_ID).withColumn(
        "bin", F.floor((F.col("q_pos") - F.col("t_pos") - F.col("d_min")) / bin_size)
    )
    full = binned.groupBy(*PAIR_ID, "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    full = full.where(F.col("in_bin") > min_hits)
    mode = diagonal_mode(matches, bin_size).select(*PAIR_ID, F.col("bin").alias("mode"))
    usable = (
        binned.join(full, [*PAIR_ID, "bin"])
        .join(mode, PAIR_ID)
        .where(F.abs(F.col("bin") - F.col("mode")) <= near)
    )
    order = Window.partitionBy(*PAIR_ID).orderBy("q_pos", "t_pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    score = F.coalesce(gain - (F.col("q_pos") - F.lag("q_pos").over(order)), F.lit(0))
    summed = usable.withColumn("s", score).withColumn("total", F.sum("s").over(upto))
    # the run restarts at the earliest place whose sum is the smallest so far
    base = F.min(F.struct(F.col("total").alias("t"), F.struct(F.col("q_pos"), F.col("t_pos")).alias("at"))).over(upto)
    runs = summed.withColumn("base", base).withColumn("score", F.col("total") - F.col("base.t"))
    best = F.min(
        F.struct(
            (-F.col("score")).alias("n"),
            F.col("q_pos").alias("e1"),
            F.col("t_pos").alias("e2"),
            F.col("base.at.q_pos").alias("s1"),
            F.col("base.at.t_pos").alias("s2"),
        )
    )
    return (
        runs.groupBy(*PAIR_ID)
        .agg(best.alias("m"), F.count(F.lit(1)).alias("used"))
        .where(F.col("used") > 1)
        .select(*PAIR_ID, "m.s1", "m.e1", "m.s2", "m.e2", (-F.col("m.n")).alias("score"))
    )


# ---------------------------------------------------------------------------
# k-mer graph


def kmer_edges(ordered: DataFrame, lower: int = 5, upper: int = 60) -> DataFrame:
    """Consecutive k-mers of each record with multiplicity, counts in (lower, upper).

    ``ordered`` has ``rid, ord, kmer``.
    """
    counts = ordered.groupBy("kmer").agg(F.count(F.lit(1)).alias("c"))
    usable = counts.where((F.col("c") > lower) & (F.col("c") < upper)).select("kmer")
    by_record = Window.partitionBy("rid").orderBy("ord")
    steps = ordered.withColumn("v", F.lag("kmer").over(by_record)).where(F.col("v").isNotNull())
    steps = steps.select("v", F.col("kmer").alias("w"))
    return (
        steps.groupBy("v", "w")
        .agg(F.count(F.lit(1)).alias("multiplicity"))
        .join(usable.withColumnRenamed("kmer", "v"), "v", "left_semi")
        .join(usable.withColumnRenamed("kmer", "w"), "w", "left_semi")
        .select("v", "w", "multiplicity")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every node of ``edges(v, w)``."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("v").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("w").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _touching(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    out = edges
    for end in ("v", "w"):
        out = out.join(nodes.select(F.col("node").alias(end)), end, how)
    return out.select(*edges.columns)


def pruned_kmer_graph(edges: DataFrame) -> DataFrame:
    """Drops nodes left alone without the branching ones, then dead ends once."""
    deg = degrees(edges)
    branching = deg.where((F.col("in_degree") > 1) | (F.col("out_degree") > 1))
    plain = _touching(edges.where(F.col("v") != F.col("w")), branching, "left_anti")
    linked = plain.select(F.explode(F.array("v", "w")).alias("node")).distinct()
    kept_nodes = branching.select("node").unionByName(linked).distinct()
    kept = _touching(edges, kept_nodes, "left_semi")
    live = degrees(kept).where((F.col("in_degree") > 0) & (F.col("out_degree") > 0)).select("node")
    return _touching(kept, live, "left_semi")


def weak_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of the weakly connected component of every node.

    Alternating large-star and small-star contraction: the number of rounds
    grows with the logarithm of the graph, and edges only ever get rewired, so
    no component is gathered in one place.
    """
    links = cut_lineage(
        edges.select(F.greatest("v", "w").alias("a"), F.least("v", "w").alias("b")).where("a <> b").distinct()
    )
    nodes = edges.select(F.explode(F.array("v", "w")).alias("node")).distinct()
    before = None
    for _ in range(max_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    label = links.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(label.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Connects each node's larger neighbours to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        join_bounded(both.where(F.col("b") > F.col("a")), low, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Connects each node's smaller neighbours and itself to the smallest one."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = low.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def component_report(edges: DataFrame) -> DataFrame:
    """Component size and degrees of every node."""
    label = weak_components(edges)
    size = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return label.join(degrees(edges), "node").join(size, "component")
