"""Jaccard join of documents on word shingles through a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kernel
from readloom.llm.components import components
from readloom.session import cut_lineage, scratch_scope

GROUP = 96  # documents of a group
ORDERS = 4  # hash orders whose smallest tokens may name a document's group
LATE_COUNT = 4  # a token of this many documents is put behind all rarer ones
WINDOW = 4  # tokens that are counted beyond as many as a prefix
MAP_BITS = 26  # of a map that tells tokens apart: 8 MB; tokens that it mistakes cost time, not results
HOT_TOKENS = 50_000  # the most frequent come last, in the order of their counts: 800 kB
NEAR_IDS = 200_000  # a list of so many ids at most is broadcast: 3 MB
SHARED = 6  # prefix tokens that large near copies are asked to share; small ones share fewer
COLUMNS = 8_192  # tokens of a union that are multiplied at a time


def _common(n, num: int, den: int):
    """Prefix tokens that two sets at the threshold share; ``n`` is the size of the smaller (an int or an array)."""
    return 1 + np.minimum(SHARED - 1, (n + (-n * num) // den) // 2)


def _prefix(n: int, num: int, den: int) -> int:
    """Two sets at the threshold share ``_common`` of so many first tokens of each, in any common order.

    Of their common tokens, at least ``ceil(n * num / den)``, all but the first
    ``_common`` must fit behind the prefix.
    """
    return min(n, n + (-n * num) // den + int(_common(n, num, den)))


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """One number per token set, equal for equal sets."""
    each = [s.sum(dtype=np.uint64) ^ kernel.mix(kernel.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))[None]) for s in sets]
    return kernel.mix(np.array([int(x[0]) for x in each], np.uint64)).view(np.int64)


def _sketch(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kernel.slices(batches):
            sets = kernel.shingles(*kernel.words(part.column("text")), size)
            n = np.array([len(s) for s in sets], np.int64)
            low = [s[: _prefix(len(s), num, den) + WINDOW] for s in sets]
            turns = [np.uint64(2 * (k * 0x51A2C3E7B5D4F691 % (1 << 62)) + 1) for k in range(ORDERS)]
            least = [np.array([(s * f).min() for f in turns], np.uint64) if len(s) else s for s in sets]
            lists = [kernel.list_array(x, pa.int64()) for x in (low, least)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(_nodes(sets)), *lists], names=["doc_id", "n", "node", "low", "least"]
            )

    return run


class Bitmap:
    """Tells the tokens of a frame from most others, in ``2 ** MAP_BITS`` bits whatever their number."""

    def __init__(self, tokens: DataFrame):
        place = F.shiftrightunsigned("token", 64 - MAP_BITS)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
        words = tokens.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
        self.bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def has(self, tokens: np.ndarray) -> np.ndarray:
        place = tokens >> np.uint64(64 - MAP_BITS)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class Order:
    """A total order of all tokens that puts frequent ones behind; the same for every document."""

    def __init__(self, counted: DataFrame):
        frequent = cut_lineage(counted.where(F.col("count") >= LATE_COUNT))
        hot = frequent.orderBy(F.col("count").desc(), "token").limit(HOT_TOKENS).toArrow()
        token = hot["token"].to_numpy().view(np.uint64)
        at = np.argsort(token)
        self.hot, self.level = token[at], hot["count"].to_numpy()[at]
        self.late = Bitmap(frequent)

    def first(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` first of sorted tokens: rare ones, frequent ones, the most frequent by count."""
        late = self.late.has(tokens)
        out = tokens[~late][:n]
        if len(out) < n and late.any():
            rest = tokens[late]
            at = np.minimum(np.searchsorted(self.hot, rest), len(self.hot) - 1)
            level = np.where(self.hot[at] == rest, self.level[at], 0)
            out = np.concatenate([out, rest[np.argsort(level, kind="stable")][: n - len(out)]])
        return out


def _prefixes(size: int, num: int, den: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kernel.slices(batches):
            sets = kernel.shingles(*kernel.words(part.column("text")), size)
            out = [order.value.first(s, _prefix(len(s), num, den)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(_nodes(sets)), kernel.list_array(out, pa.int64())],
                names=["doc_id", "node", "tokens"],
            )

    return run


def _meeting(num: int, den: int, shared):
    """Prefix tokens that other components hold too, of documents with enough of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t[shared.value.has(t.view(np.uint64))] for t in kernel.list_parts(batch.column("tokens"))]
            n = batch.column("n").to_numpy()
            own = np.flatnonzero(np.array([len(k) for k in kept]) >= _common(n * num // den, num, den))
            rest = [batch.column(c).take(pa.array(own)) for c in ("gid", "comp", "n")]
            yield pa.RecordBatch.from_arrays(
                [*rest, kernel.list_array([kept[i] for i in own], pa.int64())], names=["gid", "comp", "n", "tokens"]
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kernel.slices(batches):
            sets = kernel.shingles(*kernel.words(part.column("text")), size)
            node = _nodes(sets)
            # a repeated id may have brought another text along
            own = np.flatnonzero(node == part.column("node").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [part.column("gid").take(pa.array(own)), pa.array(node[own]), kernel.list_array([sets[i] for i in own], pa.int64())],
                names=["gid", "node", "tokens"],
            )

    return run


def overlaps(queries: list[np.ndarray], members: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) at or above the threshold.

    The union of the members' tokens bounds every query's overlap first; only
    queries that reach the threshold against the union are multiplied with the
    members' token matrix.
    """
    union = np.unique(np.concatenate(members))
    nq, nm = np.array([len(q) for q in queries]), np.array([len(m) for m in members])
    token = np.concatenate(queries)
    owner = np.repeat(np.arange(len(queries)), nq)
    at = np.minimum(np.searchsorted(union, token), len(union) - 1)
    hit = union[at] == token
    shared = np.bincount(owner[hit], minlength=len(queries))
    opened = np.flatnonzero((shared * den >= nq * num) & (shared * den >= nm.min() * num))
    if not len(opened):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.full(len(queries), -1)
    row[opened] = np.arange(len(opened))
    hit &= row[owner] >= 0
    q_row, q_col = row[owner[hit]], at[hit]
    m_row, m_col = np.repeat(np.arange(len(members)), nm), np.searchsorted(union, np.concatenate(members))
    q_sort, m_sort = np.argsort(q_col, kind="stable"), np.argsort(m_col, kind="stable")
    q_row, q_col, m_row, m_col = q_row[q_sort], q_col[q_sort], m_row[m_sort], m_col[m_sort]
    both = np.zeros((len(opened), len(members)))
    for base in range(0, len(union), COLUMNS):
        qa, qb = np.searchsorted(q_col, [base, base + COLUMNS])
        ma, mb = np.searchsorted(m_col, [base, base + COLUMNS])
        width = min(COLUMNS, len(union) - base)
        left, right = np.zeros((len(opened), width), np.float32), np.zeros((len(members), width), np.float32)
        left[q_row[qa:qb], q_col[qa:qb] - base] = 1
        right[m_row[ma:mb], m_col[ma:mb] - base] = 1
        both += left @ right.T
    both = np.rint(both).astype(np.int64)
    q, m = np.nonzero(den * both >= num * (nq[opened][:, None] + nm[None, :] - both))
    return opened[q], m


def _links(num: int, den: int):
    """Links inside a group, or between the groups of a pair: every row is a group's nodes and their sets."""

    def run(table: pa.Table) -> pa.Table:
        groups = []
        for row in range(table.num_rows):
            part = table["tokens"].combine_chunks()[row].values
            sets = [t.view(np.uint64) for t in kernel.list_parts(part)]
            nodes, first = np.unique(table["nodes"][row].values.to_numpy(), return_index=True)
            groups.append((nodes, [sets[i] for i in first]))
        (asked, queries), (node, members) = groups[0], groups[-1]
        every = np.concatenate([asked, node])
        out = np.zeros((0, 2), np.int64)
        for i in range(0, len(queries), GROUP):
            for j in range(0, len(members), GROUP):
                q, m = overlaps(queries[i : i + GROUP], members[j : j + GROUP], num, den)
                label = kernel.local_labels(len(every), i + q, len(asked) + j + m)
                moved = np.flatnonzero(label != np.arange(len(every)))
                out = np.concatenate([out, np.stack([every[label[moved]], every[moved]], 1)])
        out = np.unique(out[out[:, 0] != out[:, 1]], axis=0)
        return pa.table({"a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64())})

    return run


def _group_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``gid, nodes, tokens``: the groups of ``nodes(doc_id, node, gid)`` with their sets, read again from the texts.

    Where rows repeat an id and its text, a node stands there more than once.
    """
    wanted = nodes.select(F.col("doc_id").alias("rep"), "node", "gid")
    few = wanted.count() <= NEAR_IDS
    rows = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("gid", "node", "text")
    sets = rows.mapInArrow(_sets(size), "gid long, node long, tokens array<long>")
    groups = sets.groupBy("gid").agg(F.collect_list(F.struct("node", "tokens")).alias("rows"))
    return cut_lineage(groups.select("gid", F.col("rows.node").alias("nodes"), F.col("rows.tokens").alias("tokens")))


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Two documents link when ``den * intersection >= num * union`` of their sets
    of ``size``-word shingles; all links are found.  ``component_id`` is the
    smallest id reachable.  Rows with a null id take part, but give no name to
    a component: one of null ids only has a null one.  Null, empty and blank
    texts have an empty set and stay alone.  Rows of equal sets count as one
    node, also when an id is repeated.  Other columns are ignored.

    Groups: documents of similar size with the same smallest token in one of
    ``ORDERS`` hash orders, cut into about ``GROUP``.  A group is compared
    with itself first.  Then two groups meet if parts of them that are not yet
    one component share enough prefix tokens; the union of one group's tokens
    bounds the overlap of each document of the other before sets are compared.
    A family of near copies thus costs pairs of groups, not of documents.
    """
    with scratch_scope(docs.sparkSession) as scratch:
        return _components(docs.select("doc_id", "text"), size, num, den, scratch)


def _components(docs: DataFrame, size: int, num: int, den: int, scratch) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    sig = cut_lineage(docs.mapInArrow(_sketch(size, num, den), "doc_id long, n long, node long, low array<long>, least array<long>"))
    counted = sig.select(F.explode("low").alias("token")).groupBy("token").count()
    order = sc.broadcast(Order(counted))
    wide = sig

    nodes = sig.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), *[F.min(F.col("least")[k]).alias(f"least{k}") for k in range(ORDERS)]
    )
    nodes = cut_lineage(nodes)
    sig = cut_lineage(wide.select("doc_id", "n", "node"))
    scratch.drop(wide)
    step = F.floor(F.log(F.col("n")) / float(np.log(den / num))) if num < den else F.col("n")
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col(f"least{k}"), step) for k in range(ORDERS)]))
    keyed = cut_lineage(nodes.select("node", keys.alias("key")))
    many = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    # the most popular of its keys names a document's group
    best = keyed.join(many, "key").groupBy("node").agg(F.max(F.struct("size", "key")).alias("best"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("best.size") / GROUP))
    gid = F.when(F.col("best").isNull(), F.xxhash64("node")).otherwise(F.xxhash64("best.key", part)).alias("gid")
    nodes = cut_lineage(nodes.join(best, "node", "left").select("node", "doc_id", "n", gid))
    scratch.drop(keyed, many)

    # inside the groups
    schema = "a long, b long"
    shared = nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("gid")
    mates = cut_lineage(nodes.join(cut_lineage(shared), "gid").select("doc_id", "node", "gid"))
    sets = _group_sets(docs, mates, size)
    inner = cut_lineage(sets.groupBy("gid").applyInArrow(_links(num, den), schema))
    scratch.drop(sets, mates)
    label = components(inner)
    comp = F.coalesce("component", "node").alias("comp")
    nodes = cut_lineage(nodes.join(label, "node", "left").select("node", "doc_id", "n", "gid", comp))

    # across: two groups that share prefix tokens in parts of different components
    prefix = docs.mapInArrow(_prefixes(size, num, den, order), "doc_id long, node long, tokens array<long>")
    own = nodes.withColumnRenamed("doc_id", "rep")
    prefix = cut_lineage(prefix.join(own, "node").where(F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep", "node"))
    held = prefix.select(F.explode("tokens").alias("token"), "comp").groupBy("token")
    bridges = held.agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    meeting = prefix.select("gid", "comp", "n", "tokens").mapInArrow(
        _meeting(num, den, sc.broadcast(Bitmap(bridges))), "gid long, comp long, n long, tokens array<long>"
    )
    held = meeting.select("gid", "comp", "n", F.explode("tokens").alias("token")).groupBy("token", "gid")
    held = cut_lineage(held.agg(*[f(c).alias(f"{k}_{c}") for c in ("n", "comp") for k, f in (("low", F.min), ("top", F.max))]))
    other = held.select("token", *[F.col(c).alias(f"to_{c}") for c in held.columns if c != "token"])
    one = (F.col("low_comp") == F.col("top_comp")) & (F.col("to_low_comp") == F.col("to_top_comp")) & (F.col("low_comp") == F.col("to_low_comp"))
    fits = (F.col("top_n") * den >= F.col("to_low_n") * num) & (F.col("to_top_n") * den >= F.col("low_n") * num)
    met = held.join(other, (held["token"] == other["token"]) & (F.col("gid") < F.col("to_gid")) & ~one & fits).groupBy("gid", "to_gid")
    smaller = F.least(F.min("low_n"), F.min("to_low_n"))
    enough = 1 + F.least(F.lit(SHARED - 1), F.floor((smaller - F.ceil(smaller * num / den)) / 2))
    pairs = cut_lineage(met.agg(F.count(F.lit(1)).alias("shared"), enough.alias("enough")).where("shared >= enough").select("gid", "to_gid"))

    scratch.drop(prefix, held)

    opened = pairs.select("gid").unionByName(pairs.select(F.col("to_gid").alias("gid"))).distinct()
    sets = _group_sets(docs, cut_lineage(nodes.join(cut_lineage(opened), "gid").select("doc_id", "node", "gid")), size)
    sides = [pairs.join(sets.withColumnRenamed("gid", c), c).select("gid", "to_gid", "nodes", "tokens") for c in ("gid", "to_gid")]
    outer = sides[0].unionByName(sides[1]).groupBy("gid", "to_gid").applyInArrow(_links(num, den), schema)
    outer = cut_lineage(outer)
    scratch.drop(sets, pairs)

    label = components(inner.unionByName(outer))
    nodes = nodes.join(label, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("comp"))
    nodes = cut_lineage(nodes)
    least = cut_lineage(nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    named = cut_lineage(nodes.join(least, "comp").select("node", "component_id"))
    scratch.keep(sig, named)
    full = sig.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(sig.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    found = jaccard_components(docs.select("doc_id", "text"), size, num, den)
    gone = cut_lineage(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti")
