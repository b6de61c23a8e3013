"""Near-equal vectors through an inverted multi-index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kernel
from readloom.llm.components import components
from readloom.session import cut_lineage, scratch_scope

SAMPLE = 20_000  # vectors that codebooks and traversal depth are fitted on, those of the smallest id hashes
RECALL = 0.9995  # of pairs at the threshold itself, the hardest; closer ones are found more often
BLOCK = 512  # members or queries of a task
CODES = (4, 256)  # fewest and most codes of a half


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column) -> np.ndarray:
    """Unit rows of a list column; a single component is split in two halves."""
    x = np.stack(kernel.list_parts(column)).astype(np.float64)
    return _unit(np.concatenate([x, x], 1) if x.shape[1] == 1 else x)


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each code."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None], 0)


def codebook(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """``size`` codes by k-means; a code that lost all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    codes = x[rng.permutation(len(x))[:size]].copy()
    for _ in range(12):
        near = _nearest(x, codes).argmin(1)
        n = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes[n > 0] = total[n > 0] / n[n > 0, None]
    return codes


class Grid:
    """Two codebooks on the halves of unit vectors; a cell is a pair of codes."""

    def __init__(self, sample: np.ndarray, rows: int, least: float):
        half = sample.shape[1] // 2
        size = int(np.clip(round(1.5 * rows**0.25), *CODES))
        self.half, self.depth = half, 1
        self.left, self.right = codebook(sample[:, :half], size, 1), codebook(sample[:, half:], size, 2)
        # partners at the threshold, in all directions
        rng = np.random.default_rng(3)
        x = np.tile(sample[: min(len(sample), 2_000)], (8, 1))
        away = rng.normal(size=x.shape)
        away = _unit(away - (away * x).sum(1, keepdims=True) * x)
        y = least * x + np.sqrt(1 - least * least) * away
        most = len(self.left) * len(self.right)
        cx, cy = self.cells(x, most), self.cells(y, most)
        # a pair is found once either cell list reaches the other's own cell
        rank = np.minimum((cx == cy[:, :1]).argmax(1), (cy == cx[:, :1]).argmax(1))
        self.depth = int(np.quantile(rank, RECALL, method="higher")) + 1

    def cells(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The nearest cells of each vector, nearest first.

        The sequences of codes of the two halves, each by distance, are merged:
        among the first ``depth`` cells no pair (i, j) with (i + 1) * (j + 1) above
        ``depth`` can occur, since all cells nearer on both sides come before it.
        """
        depth = depth or self.depth
        a, b = _nearest(x[:, : self.half], self.left), _nearest(x[:, self.half :], self.right)
        oa, ob = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        front = (i + 1) * (j + 1) <= depth
        i, j = i[front], j[front]
        out = np.empty((len(x), min(depth, len(i))), np.int64)
        for base in range(0, len(x), 1024):
            s = slice(base, base + 1024)
            total = np.take_along_axis(a[s], oa[s], 1)[:, i] + np.take_along_axis(b[s], ob[s], 1)[:, j]
            first = np.argsort(total, 1, kind="stable")[:, : out.shape[1]]
            out[s] = np.take_along_axis(oa[s], i[first], 1) * b.shape[1] + np.take_along_axis(ob[s], j[first], 1)
        return out


def _place(grid):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("vector"))
            cells = grid.value.cells(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "weight", "label", "vector")] + [kernel.list_array(list(cells), pa.int64())],
                names=["node", "weight", "label", "vector", "cells"],
            )

    return run


LINKED = "node long, links long, other long"


def _verify(least: float):
    """Links of one block of a cell's members with one block of the vectors that visit the cell.

    Each row says how many vectors a node gained here, or, with 0 ``links``, names
    the first node of its connected part.  A visitor is credited
    with what it finds; the member found is credited here too unless it visits
    the visitor's own cell and finds it there.
    """

    def run(table: pa.Table) -> pa.Table:
        mark = table["visit"].to_numpy(zero_copy_only=False)
        members, visitors = np.flatnonzero(~mark), np.flatnonzero(mark)
        node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
        out_node, out_links, out_other = [], [], []
        if len(members) and len(visitors):
            x = np.stack(kernel.list_parts(table["vector"])).astype(np.float64)
            cells = kernel.list_parts(table["cells"])
            norm = np.sqrt((x * x).sum(1))
            home = np.array([c[0] for c in cells])
            lists = np.stack(cells)
            for at in range(0, len(visitors), BLOCK):
                v = visitors[at : at + BLOCK]
                for base in range(0, len(members), BLOCK):
                    m = members[base : base + BLOCK]
                    near = (x[v] @ x[m].T) / (norm[v][:, None] * norm[m][None]) >= least
                    near &= node[v][:, None] != node[m][None]
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    gain = np.bincount(i, weight[m][j], len(v))
                    alone = ~(lists[m[j]] == home[v[i]][:, None]).any(1)
                    back = np.bincount(j[alone], weight[v][i[alone]], len(m))
                    for who, g in ((v, gain), (m, back)):
                        hit = np.flatnonzero(g)
                        out_node.append(node[who[hit]]), out_links.append(g[hit].astype(np.int64)), out_other.append(np.zeros(len(hit), np.int64))
                    both = np.concatenate([node[v], node[m]])
                    names, where = np.unique(both, return_inverse=True)
                    label = kernel.local_labels(len(names), where[i], where[len(v) + j])
                    moved = np.flatnonzero(label != np.arange(len(names)))
                    out_node.append(names[moved]), out_links.append(np.zeros(len(moved), np.int64)), out_other.append(names[label[moved]])
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"node": cat(out_node), "links": cat(out_links), "other": cat(out_other)})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Rows of one label link when the cosine of their embeddings is ``least`` or
    more, computed in double precision.  A null label, a null, empty or zero
    vector, or one with null or non-finite components, links with nothing; so do
    vectors of different lengths.  Equal vectors of a label are one node that
    counts as many; a repeated or null id is a row of its own, and a component is
    named by its smallest id that is not null.  Other columns are ignored.

    The grid is fitted on at most ``SAMPLE`` vectors; every vector is indexed.
    How many cells are visited follows from the target recall for pairs at the
    threshold.
    """
    with scratch_scope(vectors.sparkSession) as scratch:
        return _near(vectors.select("vec_id", "embedding", "label"), least, scratch)


def _near(rows: DataFrame, least: float, scratch) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("key", F.when(F.col("valid"), F.xxhash64("label", F.size(x), F.transform(x, lambda v: v + 0.0))))
    rows = cut_lineage(rows)
    good = rows.where("valid")
    nodes = good.groupBy("key").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"), F.any_value("label").cast("string").alias("label"), F.any_value("embedding").cast("array<double>").alias("vector")
    )
    nodes = cut_lineage(nodes.withColumnRenamed("key", "node"))
    sizes = [r[0] for r in nodes.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = None
    for size in sizes:
        # written one by one: the plan does not grow with the number of lengths
        part = cut_lineage(_linked(nodes.where(F.size("vector") == size), least))
        found = part if found is None else found.unionByName(part)
    scratch.keep(rows)
    plain = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        found = cut_lineage(found)
        gained = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
        label = components(found.where("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
        named = cut_lineage(
            nodes.select("node", "least_id", "weight").join(label, "node", "left").join(gained, "node", "left").withColumn("component", F.coalesce("component", "node"))
        )
        least_id = cut_lineage(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
        named = named.join(least_id, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
        named = cut_lineage(named)
        scratch.keep(named)
        full = good.select("vec_id", F.col("key").alias("node")).join(named, "node").select("vec_id", "n_links", "component_id")
        plain = full.unionByName(plain)
    return plain.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _linked(nodes: DataFrame, least: float) -> DataFrame:
    sc = nodes.sparkSession.sparkContext
    sample = nodes.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()
    x = _rows(sample["vector"])
    grid = sc.broadcast(Grid(x, nodes.count(), least))
    placed = nodes.select("node", "weight", "label", "vector").mapInArrow(
        _place(grid), "node long, weight long, label string, vector array<double>, cells array<long>"
    )
    placed = cut_lineage(placed)
    visits = placed.select("node", "label", F.explode("cells").alias("cell"))
    homes = placed.select("node", "label", F.col("cells")[0].alias("cell"))
    held = homes.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("members"))
    asked = visits.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("visitors"))
    shape = held.join(asked, ["label", "cell"]).select(
        "label", "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("vb")
    )
    # a cell is cut into blocks of members times blocks of visitors
    shape = cut_lineage(shape)
    here = F.pmod(F.xxhash64("node"), F.col("mb")).cast("int")
    there = F.pmod(F.xxhash64("node", F.lit(1)), F.col("vb")).cast("int")
    member = homes.join(shape, ["label", "cell"]).select(
        "label", "cell", here.alias("m"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("v"), "node", F.lit(False).alias("visit")
    )
    visitor = visits.join(shape, ["label", "cell"]).select(
        "label", "cell", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), there.alias("v"), "node", F.lit(True).alias("visit")
    )
    work = member.unionByName(visitor).join(placed.select("node", "weight", "vector", "cells"), "node")
    return work.groupBy("label", "cell", "m", "v").applyInArrow(_verify(least), LINKED)
