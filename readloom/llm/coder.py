"""Token ids in a compressed file format, and back.

An adaptive context-mixing range coder over ids.  A block of ``BLOCK`` ids is
coded with nothing known from outside: two tables predict the id that followed
the last two ids (order 2) and the last id (order 1), a table of the ids seen so
far gives order-0 frequencies, and a falling prior covers ids not seen yet.  How
far each predictor is trusted is learned inside the block, by the run of hits a
table slot has had.  Many blocks are coded side by side, one numpy lane each.

The file format is a table of frames: a frame holds whole documents in order,
their numbers of ids, and the blocks of their joined ids, each with its number of
ids, a CRC-32 of its ids and its bytes.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import kernel
from readloom.llm.tokens import encoder

BLOCK = 2048  # ids of a block
FRAME = 4_000_000  # ids of a frame at least, unless its partition ends
LANES = 2048  # blocks that are coded side by side

SLOT_BITS = 11  # slots of an order-1 or order-2 table
RUNS = 16  # hit runs told apart
TURN = 64  # ids after which a block looks at its hits anew
TABLES = (64, 256, 1024)  # ids after which the order-0 table is built anew
CHOICE_BITS = 12
LOW_BITS, WORD_BITS = 30, 32  # the range stays above 2^30; 32 bits leave at a time
IDS = 1 << 16  # ids are below this
PRIOR_TOTAL = 1 << 18  # with the choice bits, no more than LOW_BITS


def _prior() -> np.ndarray:
    """Cumulative frequencies of unseen ids: at least 2 each, the rest falling with the id."""
    share = 1.0 / (np.arange(IDS) + 64.0)
    freq = 2 + np.floor(share / share.sum() * (PRIOR_TOTAL - 2 * IDS)).astype(np.int64)
    freq[0] += PRIOR_TOTAL - freq.sum()
    return np.concatenate([[0], np.cumsum(freq)])


PRIOR = _prior()


class _Lanes:
    """The model of many blocks, ahead of the next id of each."""

    def __init__(self, lanes: int):
        self.lanes, self.t = lanes, 0
        self.base = np.arange(lanes, dtype=np.int64) << SLOT_BITS
        self.one, self.two = (np.zeros(lanes << SLOT_BITS, np.int64) for _ in range(2))
        ids = np.arange(IDS, dtype=np.uint64)
        shift = np.uint64(64 - SLOT_BITS)
        self.h1 = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        self.h2 = ((ids * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.last2 = np.zeros(lanes, np.int64)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.run_base = self.lane * RUNS
        self.bounds = np.zeros((5, lanes), np.int64)
        self.bounds[4] = 1 << CHOICE_BITS
        self.flat_bounds = self.bounds.ravel()
        # hits and trials per block and run of hits, and the trust that follows from them
        self.hits = [np.tile(np.arange(RUNS) * 0.5 + 0.05, (lanes, 1)) for _ in range(2)]
        self.tries = [np.tile(np.arange(RUNS) * 0.6 + 1.0, (lanes, 1)) for _ in range(2)]
        self.seen_hits, self.seen_tries = np.ones(lanes), np.full(lanes, 4.0)
        self.past: list[tuple[np.ndarray, ...]] = []
        self.ids = np.zeros((BLOCK, lanes), np.int64)
        self.size = np.zeros(lanes, np.int64)
        self._table()
        self._trust()

    def _trust(self) -> None:
        if self.past:
            run2, run1, choice = (np.stack(x) for x in zip(*self.past, strict=True))
            lane = np.arange(self.lanes) * RUNS
            asked1, asked0 = choice > 0, choice > 1
            n = self.lanes * RUNS
            for k, run, asked, hit in ((1, run2, None, choice == 0), (0, run1, asked1, choice == 1)):
                at = (run + lane).ravel()
                keep = slice(None) if asked is None else asked.ravel()
                self.tries[k] += np.bincount(at[keep], minlength=n).reshape(-1, RUNS)
                self.hits[k] += np.bincount(at[keep], hit.ravel()[keep], minlength=n).reshape(-1, RUNS)
            self.seen_tries += asked0.sum(0)
            self.seen_hits += (choice == 2).sum(0)
            self.past = []
        top = 1 << CHOICE_BITS
        share = lambda h, t: np.clip(h / t * top, 1, top - 64).astype(np.int64)
        self.trust1, self.trust2 = (share(h, t).ravel() for h, t in zip(self.hits, self.tries, strict=True))
        self.trust0 = share(self.seen_hits, self.seen_tries) if self.t >= TABLES[0] else np.zeros(self.lanes, np.int64)

    def _table(self) -> None:
        """Order-0 frequencies of the ids so far, all blocks in one sorted array behind the prior."""
        self.starts, self.symbols = [PRIOR[:-1]], [np.arange(IDS, dtype=np.int64)]
        self.totals = np.ones(self.lanes, np.int64)
        keys = np.zeros(0, np.int64)
        if self.t:
            flat = np.sort((self.ids[: self.t].T + (np.arange(self.lanes, dtype=np.int64) << 16)[:, None]), axis=1).ravel()
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            keys = flat[first]
            # each block has the same number of ids here, so a position is a cumulative frequency
            self.starts.append(first % self.t + ((keys >> 16) + 1 << 24))
            self.symbols.append(keys & (IDS - 1))
            self.totals[:] = self.t
        self.keys = keys
        self.starts, self.symbols = np.concatenate(self.starts), np.concatenate(self.symbols)
        self.ends = np.empty_like(self.starts)
        self.ends[:-1] = self.starts[1:]
        lane_last = np.flatnonzero(np.concatenate([self.starts[1:] >> 24 != self.starts[:-1] >> 24, [True]]))
        self.ends[lane_last] = (self.starts[lane_last] >> 24 << 24) + np.concatenate([[PRIOR_TOTAL], np.full(len(lane_last) - 1, self.t)])
        self.lane_at = (np.arange(self.lanes, dtype=np.int64) + 1) << 24

    def predict(self) -> None:
        own = self.h1.take(self.last)
        self.slot1 = own + self.base
        self.slot2 = (self.h2.take(self.last2) ^ own) + self.base
        e1, e2 = self.one.take(self.slot1), self.two.take(self.slot2)
        self.p1, self.run1 = e1 >> 4, e1 & 15
        self.p2, self.run2 = e2 >> 4, e2 & 15
        top = 1 << CHOICE_BITS
        a, b, c = self.bounds[1], self.bounds[2], self.bounds[3]
        self.trust2.take(self.run2 + self.run_base, out=a, mode="clip")
        # every choice keeps a width of one at least
        np.add(a, 1 + ((top - 8 - a) * self.trust1.take(self.run1 + self.run_base) >> CHOICE_BITS), out=b)
        np.add(b, 1 + ((top - 2 - b) * self.trust0 >> CHOICE_BITS), out=c)

    def span(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of what was chosen."""
        at = choice * self.lanes + self.lane
        return self.flat_bounds.take(at), self.flat_bounds.take(at + self.lanes)

    def update(self, x: np.ndarray, choice: np.ndarray) -> None:
        moved = x << 4
        for table, slot, p, run in ((self.one, self.slot1, self.p1, self.run1), (self.two, self.slot2, self.p2, self.run2)):
            table[slot] = moved + np.minimum(run + 1, RUNS - 1) * (x == p)
        self.past.append((self.run2, self.run1, choice))
        self.ids[self.t] = x
        self.last2, self.last = self.last, x
        self.t += 1
        if self.t % TURN == 0:
            if self.t in TABLES:
                self._table()
            self._trust()


def _encode(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """``ids`` is (steps, lanes), lanes falling in size."""
    lanes = len(sizes)
    model = _Lanes(lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 62, np.int64)
    words = np.zeros((int(sizes[0]) + 4, lanes), np.int64)
    count = np.zeros(lanes, np.int64)
    lane, shortest = np.arange(lanes), int(sizes[-1])
    for t in range(int(sizes[0])):
        x = ids[t]
        model.predict()
        hit1, hit2 = x == model.p1, x == model.p2
        choice = 3 - 2 * hit1
        choice[hit2] = 0
        rest = np.flatnonzero(choice == 3)
        row = x.take(rest)
        if len(model.keys):
            key = row + (rest << 16)
            at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
            seen = model.keys.take(at) == key
            choice[rest[seen]] = 2
            row = np.where(seen, at + IDS, row)
        start, stop = model.span(choice)
        unit = span >> CHOICE_BITS
        if t < shortest:
            low += unit * start
            span = unit * (stop - start)
        else:
            live = t < sizes
            low += np.where(live, unit * start, 0)
            span = np.where(live, unit * (stop - start), span)
            ok = live[rest]
            rest, row = rest[ok], row[ok]
        total = np.where(row < IDS, PRIOR_TOTAL, model.totals.take(rest))
        unit = span.take(rest) // total
        start = model.starts.take(row)
        low[rest] += unit * (start & 0xFFFFFF)
        span[rest] = unit * (model.ends.take(row) - start)
        over = low >> 62
        if over.any():
            at = np.flatnonzero(over)
            words[count[at] - 1, at] += 1
            low[at] &= (1 << 62) - 1
        out = np.flatnonzero(span < 1 << LOW_BITS)
        words[count[out], out] = low[out] >> LOW_BITS
        count[out] += 1
        low[out] = (low[out] & (1 << LOW_BITS) - 1) << WORD_BITS
        span[out] <<= WORD_BITS
        model.update(x, choice)
    for _ in range(2):
        words[count, lane] = low >> LOW_BITS
        count += 1
        low = (low & (1 << LOW_BITS) - 1) << WORD_BITS
    while (high := np.argwhere(words >> WORD_BITS)).size:
        words[high[:, 0] - 1, high[:, 1]] += 1
        words[high[:, 0], high[:, 1]] &= (1 << WORD_BITS) - 1
    return [words[: count[k], k].astype("<u4").tobytes() for k in range(lanes)]


def _decode(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """(steps, lanes) of ids, lanes falling in size."""
    lanes = len(sizes)
    model = _Lanes(lanes)
    length = np.array([len(p) // 4 for p in payloads])
    # a damaged block may read on: at most two words an id
    words = np.zeros((lanes, max(int(length.max()), 2 * int(sizes[0])) + 4), np.int64)
    for k, p in enumerate(payloads):
        words[k, : length[k]] = np.frombuffer(p, "<u4")
    code, span, at = (words[:, 0] << LOW_BITS) + (words[:, 1] >> 2), np.full(lanes, 1 << 62, np.int64), np.ones(lanes, np.int64)
    top, shortest = (1 << CHOICE_BITS) - 1, int(sizes[-1])
    for t in range(int(sizes[0])):
        model.predict()
        unit = span >> CHOICE_BITS
        value = np.minimum(code // unit, top)
        choice = (value >= model.bounds[1]).astype(np.int64)
        choice += value >= model.bounds[2]
        choice += value >= model.bounds[3]
        start, stop = model.span(choice)
        code = code - unit * start
        span = unit * (stop - start)
        x = np.where(choice == 0, model.p2, model.p1)
        far = choice > 1
        if t >= shortest:
            far &= t < sizes
        rest = np.flatnonzero(far)
        seen = choice.take(rest) == 2
        total = np.where(seen, model.totals.take(rest), PRIOR_TOTAL)
        unit = span.take(rest) // total
        value = np.minimum(code.take(rest) // unit, total - 1)
        row = np.searchsorted(model.starts, value + model.lane_at.take(rest) * seen, "right") - 1
        x[rest] = model.symbols.take(row)
        start = model.starts.take(row)
        code[rest] -= unit * (start & 0xFFFFFF)
        span[rest] = unit * (model.ends.take(row) - start)
        if t >= shortest:
            done = t >= sizes
            x[done], span[done], code[done] = 0, 1 << 61, 0
        low = np.flatnonzero(span < 1 << LOW_BITS)
        # two bits of the word behind the read position are still to come
        word, behind = words[low, at[low]], words[low, at[low] + 1]
        code[low] = (code[low] << WORD_BITS) + ((word & 3) << LOW_BITS) + (behind >> 2)
        at[low] += 1
        span[low] <<= WORD_BITS
        model.update(x, choice)
    return model.ids[: int(sizes[0])]


def compress(ids: np.ndarray) -> list[dict]:
    """Blocks of ``BLOCK`` ids: their number, checksum and bytes."""
    out = []
    for base in range(0, len(ids), BLOCK * LANES):
        part = ids[base : base + BLOCK * LANES]
        sizes = np.minimum(BLOCK, len(part) - np.arange(0, len(part), BLOCK))
        grid = np.zeros((len(sizes), BLOCK), np.int64)
        grid.ravel()[: len(part)] = part
        raw = np.ascontiguousarray(part, "<u4")
        for k, data in enumerate(_encode(np.ascontiguousarray(grid.T), sizes)):
            out.append({"n": int(sizes[k]), "crc": zlib.crc32(raw[k * BLOCK : k * BLOCK + int(sizes[k])]), "data": data})
    return out


def expand(blocks: list[dict]) -> np.ndarray:
    """The ids of blocks, each checked against its checksum."""
    out = []
    for base in range(0, len(blocks), LANES):
        part = blocks[base : base + LANES]
        order = sorted(range(len(part)), key=lambda k: -part[k]["n"])
        sizes = np.array([part[k]["n"] for k in order])
        grid = _decode([part[k]["data"] for k in order], sizes)
        for k in range(len(part)):
            own = np.ascontiguousarray(grid[: part[k]["n"], order.index(k)], "<u4")
            if zlib.crc32(own) != part[k]["crc"]:
                raise ValueError("a block of token ids is damaged")
            out.append(own)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


FRAMES = (
    "file int, frame int, first long, doc_ids array<long>, sizes array<long>, "
    "blocks array<struct<n:int,crc:long,data:binary>>"
)
BLOCKS = pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("data", pa.binary())]))


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, coder = TaskContext.get().partitionId(), encoder(path)
        docs, sizes, parts = [], [], []
        number, first, held = itertools.count(), 0, 0

        def frame():
            nonlocal docs, sizes, parts, first, held
            data = pa.array([compress(np.concatenate(parts))], BLOCKS)
            row = [pa.array([file], pa.int32()), pa.array([next(number)], pa.int32()), pa.array([first], pa.int64())]
            row += [pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), data]
            first += held
            docs, sizes, parts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(row, names=["file", "frame", "first", "doc_ids", "sizes", "blocks"])

        for part in kernel.slices(batches):
            ids, off = coder.encode(part.column("text").to_pylist())
            ids = np.insert(ids, off[1:], end_id)
            docs += part.column("doc_id").to_pylist()
            sizes += (np.diff(off) + 1).tolist()
            parts.append(ids)
            held += len(ids)
            if held >= FRAME:
                yield frame()
        if docs:
            yield frame()

    return run


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Writes the ids of all rows of ``docs(doc_id, text)`` in ascending order of ``doc_id``.

    ``path`` names the tokenizer file; ``end_id`` ends every document.  Null
    texts count as empty.  Rows with a null id come first; rows of one id follow
    each other in the order of their text.  Other columns are ignored.  A
    partition of the order becomes one file of frames.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_frames(path, end_id), FRAMES).write.parquet(folder)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                sizes = np.array(row["sizes"].as_py(), np.int64)
                ids = expand(row["blocks"].as_py())
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                n = len(sizes)
                out = [
                    pa.array([row["file"].as_py()] * n, pa.int32()),
                    pa.array(row["doc_ids"].as_py(), pa.int64()),
                    pa.array(row["first"].as_py() + ends - sizes),
                    pa.array(sizes),
                    pa.array(crc, pa.int64()),
                ]
                names = ["file", "doc_id", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(kernel.list_array(np.split(ids.astype(np.int64), ends[:-1]), pa.int64()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of ``folder``, and on request its ``ids``.

    ``start`` counts the ids of all documents before it.  A damaged block raises.
    """
    frames = spark.read.schema(FRAMES).parquet(folder)
    schema = "file int, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    found = frames.mapInArrow(_read(with_ids), schema)
    # one row a file
    totals = frames.groupBy("file").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before = itertools.accumulate([0] + [r["n"] for r in sorted(totals)])
    starts = spark.createDataFrame([(r["file"], s) for r, s in zip(sorted(totals), before, strict=False)], "file int, before long")
    extra = ["ids"] if with_ids else []
    return found.join(F.broadcast(starts), "file").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *extra
    )
