"""Best-fit packing with certified bin counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kernel
from readloom.llm.tokens import encoder
from readloom.session import cut_lineage

ENCODED = 500_000  # bytes of text whose pieces a task holds at a time
ITEMS = 50_000  # documents that one task packs
ROUNDS = 5  # exchanges at most
RELEASED = 8  # bins with the most room that a partition gives up in the first exchange
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for part in kernel.slices(batches, size=ENCODED):
            ids, off = coder.encode(part.column("text").to_pylist())
            # each document's ids and the end id behind them, in one run of bytes
            at = off[1:] + np.arange(part.num_rows)
            raw = np.empty(len(ids) + part.num_rows, "<u4")
            inner = np.ones(len(raw), bool)
            inner[at] = False
            raw[inner], raw[at] = ids, end_id
            size = np.diff(off) + 1
            count = -(-size // capacity)
            doc = np.repeat(np.arange(part.num_rows), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = (size - capacity * (count - 1))[doc]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            base = (at + 1 - size)[doc] + start
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(base.tolist(), (base + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            # buffers of the texts are not held for later
            pa.default_memory_pool().release_unused()

    return run


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Bins that items of the given sizes need at least; ``count[s]`` items have size ``s``.

    The maximum over two families of dual feasible functions: one rounds items
    above ``capacity - x`` up to a whole bin and those below ``x`` down to
    nothing, the other rounds sizes to multiples of ``1 / k``.
    """
    size = np.arange(len(count))
    weight = count * size
    best = -(-int(weight.sum()) // capacity)
    above, below = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(weight)])
    for x in range(1, capacity // 2 + 1):
        whole = int(above[capacity - x + 1]) if capacity - x + 1 < len(count) else 0
        kept = int(below[min(capacity - x + 1, len(count))] - below[min(x, len(count))])
        best = max(best, whole + -(-kept // capacity))
    for k in range(1, 33):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item by best fit in falling order of size, and the room left in each bin."""
    room_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    order = np.argsort(-size, kind="stable").tolist()
    for i, s in zip(order, size[order].tolist(), strict=True):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = room_bins[room].pop()
            if not room_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(0)
        bins[i], offset[i] = b, capacity - room
        room -= s
        left[b] = room
        if room:
            room_bins[room].append(b)
            rooms |= 1 << room
    return bins, offset, np.array(left, np.int64)


PLACED = "part long, pid long, length long, bin long, offset long, bins long, bound long, spare long"


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        # equal input order whatever the shuffle brought first
        table = table.sort_by("pid")
        size = table["length"].to_numpy()
        bins, offset, left = best_fit(size, capacity)
        rank = np.empty(len(left), np.int64)
        rank[np.argsort(-left, kind="stable")] = np.arange(len(left))
        bound = lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
        n = len(size)
        return pa.table(
            {
                "part": table["part"].cast(pa.int64()),
                "pid": table["pid"],
                "length": size,
                "bin": bins,
                "offset": offset,
                "bins": np.full(n, len(left)),
                "bound": np.full(n, bound),
                "spare": rank[bins],
            }
        )

    return run


def _dealt(items: DataFrame, turn: int, capacity: int) -> DataFrame:
    """One best-fit run over ``items(pid, length)``, in parts of about ``ITEMS`` documents."""
    parts = max(1, -(-items.count() // ITEMS))
    part = F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(parts)) + F.lit(turn << 32)
    return cut_lineage(items.select(part.alias("part"), "pid", "length").groupBy("part").applyInArrow(_pack(capacity), PLACED))


def pack_items(items: DataFrame, capacity: int) -> DataFrame:
    """``pid, part, bin, offset`` for every row of ``items(pid, length)`` with lengths below ``capacity``.

    Each part is packed best fit decreasing and compared with its lower bound.
    While the sum of bins exceeds the bound of all items, every part gives up
    its bins with the most room (parts whose own gap is larger give up more);
    their documents are dealt anew and packed again.  An exchange that saves no
    bin is not taken and ends the search once it has released every fourth bin.
    """
    sizes = items.groupBy("length").count().collect()  # at most one row a size
    count = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        count[r[0]] = r[1]
    bound = lower_bound(count, capacity)
    placed = _dealt(items, 0, capacity)
    n_bins = lambda df: df.select("part", "bins").distinct().agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
    held: list[DataFrame] = []
    total = n_bins(placed)
    free = RELEASED
    for turn in range(1, ROUNDS + 1):
        if total <= bound:
            break
        gap = F.col("bins") - F.col("bound")
        out = F.col("spare") < F.least(free + 4 * gap, F.col("bins"))
        given = cut_lineage(placed.where(out))
        if given.select("part").distinct().count() < 2 and turn > 1:
            break
        before = given.select("part", "bin").distinct().count()
        again = _dealt(given.select("pid", "length"), turn, capacity)
        after = n_bins(again)
        if after < before:
            rest = placed.where(~out)
            held.append(rest)
            placed, total = again, total - before + after
        free *= 4
    for rest in held:
        placed = placed.unionByName(rest)
    return placed.select("pid", "part", "bin", "offset")


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)`` with their sequence and place there.

    A document's ids and ``end_id`` are cut only if longer than ``capacity``:
    the first piece takes what is over a multiple of it.  Null and empty texts
    are one piece with the end id.  Rows with a null or repeated id are packed
    like any other; other columns are ignored.  A piece of full length is a
    sequence of its own; all others are packed by ``pack_items``.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end_id), PIECES)
    pieces = cut_lineage(pieces.withColumn("pid", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity)
    place = pack_items(short.select("pid", "length"), capacity)
    number = (F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    part = short.join(place, "pid").select(*names, number, "offset")
    full = pieces.where(F.col("length") >= capacity)
    return part.unionByName(full.select(*names, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
