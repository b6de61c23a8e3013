"""Fuzzy line deduplication: shared segments or grams, SimHash of letters, edit similarity, one line a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kernel, slots
from readloom.llm.components import components
from readloom.llm.edits import near_pairs
from readloom.session import cut_lineage, scratch_scope

SHORT = 40  # near lines below this length always share a segment; longer ones are known by grams
GRAMS = ((SHORT - SHORT // 10, 100, 9), (90, 1 << 40, 12))  # bytes of a gram by length; ranges overlap by a tenth
BINS = 16  # a line keeps the gram of the smallest hash in each of so many bins
VOTER = 6  # bytes of the grams that vote for the bits of a SimHash
DISTANCE = 25  # bits in which the SimHashes of near lines may differ: 95 % of lines with a tenth of their letters edited at random
PARTS = 4  # of the slots, of which one at a time is shuffled
PAIRS_AT_ONCE = 500_000  # whose texts are joined, at least
NEAR_LINES = 200_000  # places of so many lines at most are broadcast: 5 MB
SIMILAR = 0.9  # share of the longer line that edits leave


def _fold() -> np.ndarray:
    """Bytes as a normalised line has them: a-z, digits and everything beyond ASCII; the rest parts words."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        table[b] = b if b >= 128 or c.isdigit() or "a" <= c <= "z" else ord(c.lower()) if "A" <= c <= "Z" else 0
    return table


FOLD = _fold()
COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()  # a byte's bits, each in a byte of its own
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # what ``FOLD`` keeps


def _runs(value: np.ndarray, width: int) -> np.ndarray:
    """Sum of every run of ``width`` values, each times a power by its place; longer runs are put together from shorter ones."""
    if width == 1:
        return value * kernel.MULTIPLIER
    half = _runs(value, width // 2)
    out = half[width // 2 :] * kernel.powers(width + 2)[width // 2]
    out += half[: len(out)]
    if width % 2:
        out = (out[1:] + value[: len(out) - 1]) * kernel.MULTIPLIER
    return out


class _Parsed:
    """Words, lines and normalised bytes of a slice of texts."""

    def __init__(self, part: pa.RecordBatch):
        data, off = kernel.flat(part.column("text"))
        self.data, self.off = data, off
        self.breaks = np.flatnonzero(data == 10)
        self.cuts = np.unique(np.concatenate([off, self.breaks + 1]))
        self.folded = FOLD[data]
        self.starts, self.ends = kernel.spans(self.folded > 0, self.cuts)
        if not len(self.starts):
            return
        word = kernel.hash_spans(self.folded, self.starts, self.ends)
        line = np.searchsorted(self.cuts, self.starts, "right") - 1
        self.first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        self.count = np.diff(np.concatenate([self.first, [len(word)]]))
        place = np.arange(len(word)) - np.repeat(self.first, self.count)
        key = np.add.reduceat(word * kernel.powers(int(place.max()) + 2)[place + 1], self.first)
        self.key = kernel.mix(key).view(np.int64)
        self.number = line[self.first]
        # code points of the normalised line
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.size = np.add.reduceat(points[self.ends] - points[self.starts], self.first) + self.count - 1
        # normalised bytes: every word with a blank behind it
        long_ = self.ends - self.starts + 1
        stop = np.cumsum(long_)
        self.bytes = self.folded[np.minimum(np.arange(stop[-1]) + np.repeat(self.starts - stop + long_, long_), len(data) - 1)]
        self.bytes[stop - 1] = 32
        self.begin = (stop - long_)[self.first]
        self.line = np.repeat(np.arange(len(self.first)), np.diff(np.concatenate([self.begin, stop[-1:]])))

    def grams(self, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line and hash of every run of ``width`` normalised bytes of the wanted lines."""
        return self.grams_at(width, wanted)[:2]

    def grams_at(self, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, hash and first byte of every such run."""
        n = len(self.bytes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = _runs(self.bytes.astype(np.uint64) + np.uint64(1), width)
        own = np.flatnonzero((self.line[:n] == self.line[width - 1 :]) & wanted[self.line[:n]])
        return self.line[own], kernel.mix(total[own]), own

    def simhash(self, wanted: np.ndarray) -> np.ndarray:
        """SimHashes of the wanted lines: each gram votes for or against each of 64 bits."""
        sim = np.zeros(len(self.first), np.uint64)
        line, gram = self.grams(VOTER, wanted)
        if not len(line):
            return sim.view(np.int64)
        head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        ends = np.concatenate([head[1:], [len(line)]])
        at = 0
        while at < len(head):
            # the bits of about 64 k grams at a time
            to = max(at + 1, int(np.searchsorted(ends, head[at] + 65536, "right")))
            lo, hi = head[at], ends[to - 1]
            votes = gram[lo:hi].view(np.uint8).reshape(-1, 8)
            # eight counters of a byte in a word hold 255 grams
            runs = -(-(ends - head)[at:to] // 255)
            first = np.cumsum(runs) - runs
            start = np.repeat(head[at:to] - lo, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
            ones = np.stack([np.add.reduceat(COUNTERS[votes[:, j]], start) for j in range(8)], axis=1).view(np.uint8)
            ones = np.add.reduceat(ones, first, axis=0, dtype=np.int32)
            sim[line[head[at:to]]] = np.packbits(2 * ones > (ends - head)[at:to, None], axis=1).view(np.uint64).ravel()
            at = to
        return sim.view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row, line number, content key, length and SimHash of every line that has words."""
    for part in kernel.slices(batches):
        x = _Parsed(part)
        if not len(x.starts):
            continue
        row, at = _stands(x)
        voting = x.size >= SHORT
        yield pa.RecordBatch.from_arrays(
            [part.column("uid").take(pa.array(row)), part.column("doc_id").take(pa.array(row)), pa.array(at, pa.int64()), pa.array(x.key), pa.array(x.simhash(voting), mask=~voting), pa.array(x.size)],
            names=["uid", "doc_id", "line", "key", "sim", "size"],
        )


def _stands(x: _Parsed) -> tuple[np.ndarray, np.ndarray]:
    """Row of every line and its number there."""
    begin = x.cuts[x.number]
    row = np.searchsorted(x.off, begin, "right") - 1
    # empty texts share an offset with the next one; the last such row owns the line
    before = np.searchsorted(x.breaks, begin)
    return row, before - np.searchsorted(x.breaks, x.off[row])


def _allowed(size: int) -> int:
    return size // 10


def _segments(text: str) -> set[tuple]:
    """What a short line shares with every near one at least once.

    Of the K + 1 segments of the shorter line, K edits leave one as it is; the
    longer line holds it at a place that K edits can move it to.
    """
    n, out = len(text), set()
    for k in {_allowed(m) for m in range(n, SHORT) if m - _allowed(m) <= n} - {0}:
        for i in range(k + 1):
            out.add((k, n, i, text[n * i // (k + 1) : n * (i + 1) // (k + 1)]))
    k = _allowed(n)
    for m in range(n - k, n + 1) if k else ():
        for i in range(k + 1):
            a, b = m * i // (k + 1), m * (i + 1) // (k + 1)
            for d in range(-k, k + 1):
                if abs(d) + abs(n - m - d) <= k and 0 <= a + d and b + d <= n:
                    out.add((k, m, i, text[a + d : b + d]))
    return out


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content key and slot of every line: near lines share one of their slots."""
    for part in kernel.slices(batches):
        x = _Parsed(part)
        if not len(x.starts):
            continue
        owner, slot, _ = _line_slots(x)
        yield pa.RecordBatch.from_arrays([pa.array(x.key[owner]), pa.array(slot.view(np.int64))], names=["key", "slot"])


def _line_slots(x: _Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, slot and place of the gram in the line, -1 where it is none or stands at several places.

    A short line has a slot for each of its segments, others for the smallest
    gram in each bin, each for lengths of about its own.
    """
    owner, slot, place = [], [], []
    ends = np.concatenate([x.begin[1:], [len(x.bytes)]]) - 1
    for k in np.flatnonzero(x.size < SHORT).tolist():
        own = _segments(x.bytes[x.begin[k] : ends[k]].tobytes().decode("utf-8", "replace"))
        owner.append(np.full(len(own), k))
        slot.append(np.array([int.from_bytes(hashlib.blake2b(repr(s).encode(), digest_size=8).digest(), "little") for s in own], np.uint64))
        place.append(np.full(len(own), -1))
    points = np.concatenate([[0], np.cumsum((x.bytes & 0xC0) != 0x80)])
    for least, most, width in GRAMS:
        line, gram, at = x.grams_at(width, (x.size >= least) & (x.size < most))
        cell = line * BINS + (gram % np.uint64(BINS)).astype(np.int64)
        best = np.full(len(x.first) * BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(best, cell, gram)
        held = np.flatnonzero(best != np.iinfo(np.uint64).max)
        smallest = np.flatnonzero(gram == best[cell])
        times, stands = np.bincount(cell[smallest], minlength=len(best)), np.zeros(len(best), np.int64)
        stands[cell[smallest]] = points[at[smallest]] - points[x.begin[line[smallest]]]
        stands = np.where(times == 1, stands, -1)[held]
        size, best = x.size[held // BINS], best[held]
        # lengths in steps of a half; one that a near longer line can pass counts for the next step too
        step, after = (np.floor(np.log(v + 1e-6) / np.log(1.5)).astype(np.uint64) for v in (size, size / SIMILAR + 1))
        both = after != step
        owner.append(np.concatenate([held, held[both]]) // BINS)
        slot.append(kernel.mix(np.concatenate([best, best[both]]) + np.concatenate([step, after[both]]) * kernel.MULTIPLIER + np.uint64(width)))
        place.append(np.concatenate([stands, stands[both]]))
    return np.concatenate(owner), np.concatenate(slot), np.concatenate(place)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines and slots, see ``slots.pack``."""
    held, count = [], 0
    for part in kernel.slices(batches):
        x = _Parsed(part)
        if not len(x.starts):
            continue
        row, at = _stands(x)
        uid, ids = (part.column(c).take(pa.array(row)) for c in ("uid", "doc_id"))
        own = _line_slots(x)
        held.append((x.key, x.simhash(x.size >= SHORT), x.size, uid.to_numpy(), ids, at, *own))
        count += len(own[0])
        if count >= slots.FLUSH:
            yield slots.pack(held)
            held, count = [], 0
    if held:
        yield slots.pack(held)


def _verified(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """The pairs of line keys ``(a, b)`` whose normalised lines, ``key, line_text`` of ``text``, are similar enough.

    Texts join about as many pairs at a time as there are lines, so that they do
    not fill the disks when pairs are many.
    """
    with scratch_scope(text.sparkSession) as scratch:
        pairs = cut_lineage(pairs)
        pieces = max(1, -(-pairs.count() // max(text.count(), PAIRS_AT_ONCE)))
        found = [_alike(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(pieces)) == p), text) for p in range(pieces)]
        scratch.keep(*found)
    return reduce(DataFrame.unionByName, found)


def _alike(pairs: DataFrame, text: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(text.select(F.col("key").alias(end), F.col("line_text").alias(f"text_{end}")), end)
    long_, short = F.greatest(F.length("text_a"), F.length("text_b")), F.least(F.length("text_a"), F.length("text_b"))
    pairs = pairs.withColumn("allowed", F.floor(long_ * (1 - SIMILAR) + 1e-9)).where(long_ - short <= F.col("allowed"))
    return cut_lineage(pairs.select("a", "b", "text_a", "text_b", "allowed").mapInArrow(near_pairs, "a long, b long"))


def _found(packed: DataFrame, scratch) -> tuple[DataFrame, list[DataFrame]]:
    """``kind, a, b`` of ``slots.near_lines`` for all slots, and the tables they lie in; one part of the slots is shuffled at a time."""
    spark = packed.sparkSession
    total = packed.agg(F.sum("n")).first()[0] or 0
    bits = max(slots.PARTS.bit_length() - 1, (total // slots.BUCKET_ROWS).bit_length())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = []
    names = [f"p{p}" for p in range(slots.PARTS)]
    at_once = 1 if total > slots.FLUSH else slots.PARTS
    for part in range(0, slots.PARTS, at_once):
        rows = packed.select("lines", *names[part : part + at_once]).mapInArrow(slots.dealt(bits), "bucket int, data binary")
        rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket")
        parts.append(cut_lineage(rows.mapInArrow(slots.near_lines(SHORT, SIMILAR, DISTANCE), slots.FOUND)))
    return reduce(DataFrame.unionByName, parts), parts


def _shared_slots(rows: DataFrame, scratch) -> tuple[DataFrame, list[DataFrame]]:
    """``key, slot, leader`` of the slots that hold several lines, the leader being the smallest of them; and the tables they lie in.

    The plain form of what ``_found`` does on packed columns; tests compare with it.  Slots are told apart a part
    of them after the other.
    """
    listed = cut_lineage(rows.mapInArrow(_slots, "key long, slot long"))
    parts = []
    for part in range(PARTS):
        own = cut_lineage(listed.where(F.pmod(F.col("slot"), F.lit(PARTS)) == part).distinct())
        many = own.groupBy("slot").agg(F.min("key").alias("leader"), F.max("key").alias("other")).where("leader <> other")
        many = cut_lineage(many.select("slot", "leader"))
        parts.append(cut_lineage(own.join(many, "slot").select("key", "slot", "leader")))
        scratch.drop(own, many)
    scratch.drop(listed)
    return reduce(DataFrame.unionByName, parts), parts


def _normal(text):
    """A line as it is compared: folded words, one blank between them."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``uid, line`` of the lines to keep, and the rows of ``docs(doc_id, text)`` with their ``uid``.

    Lines are equal if their folded words are, and linked if edits
    change no more than a tenth of the longer one.  Links between lines below ``SHORT`` are all found; of longer lines
    a pair needs a common slot (see ``_slots``) and SimHashes within ``DISTANCE``
    bits, which edits of a tenth leave to nearly all.  Of each connected group the first occurrence stays, in the
    order of id, row and line; null ids come first.  Rows of the same id and text
    are one document.  Lines without words are not listed.

    Lines of a slot are compared by length, SimHash and place of their gram before any
    pair leaves it.  Where a slot holds many lines that are near, each of them is linked with the
    first one; pairs across what is then one component are left out.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    with scratch_scope(docs.sparkSession) as scratch:
        kept = cut_lineage(_first_of_groups(rows, scratch))
        scratch.keep(kept)
    return kept, rows


def _first_of_groups(rows: DataFrame, scratch) -> DataFrame:
    packed = cut_lineage(rows.mapInArrow(_packed, slots.PACKED))
    lines = packed.select("lines", "first").mapInArrow(slots.unpacked_lines(SHORT), "uid long, doc_id long, line long, key long, sim long, size long")
    first = F.min(F.struct("doc_id", "uid", "line")).alias("first")
    distinct = cut_lineage(lines.groupBy("key").agg(first, F.min("sim").alias("sim"), F.min("size").alias("size")))
    met, parts = _found(packed, scratch)
    scratch.drop(packed)
    stars = cut_lineage(met.where(F.col("kind") == slots.PAIR).select("a", "b").distinct())
    members = cut_lineage(met.where(F.col("kind") == slots.MEMBER).select(F.col("a").alias("key"), F.col("b").alias("slot")))
    scratch.drop(*parts)
    # members of a group have a pair with its head, so these are the texts of all pairs
    text = _texts(rows, distinct, stars.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    linked = _verified(stars, text)
    label = components(linked).withColumnRenamed("node", "key")

    placed = cut_lineage(members.join(label, "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component"))
    scratch.drop(members)
    mixed = placed.groupBy("slot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("slot")
    told = distinct.select("key", "sim", "size")
    rest = cut_lineage(placed.join(cut_lineage(mixed), "slot").join(told, "key"))
    scratch.drop(placed)
    mate = rest.select("slot", F.col("key").alias("b"), F.col("sim").alias("other_sim"), F.col("size").alias("other_size"), F.col("comp").alias("b_comp"))
    # lines of too different lengths need more edits than are allowed
    gap = F.abs(F.col("size") - F.col("other_size")) <= F.floor(F.greatest("size", "other_size") * (1 - SIMILAR) + 1e-9)
    near = F.coalesce(F.bit_count(F.col("sim").bitwiseXOR(F.col("other_sim"))) <= DISTANCE, F.lit(True)) & gap
    across = (F.col("key") < F.col("b")) & (F.col("comp") != F.col("b_comp")) & near
    found = rest.join(mate, (rest["slot"] == mate["slot"]) & across).select(F.col("key").alias("a"), "b").distinct()
    linked = linked.unionByName(_verified(found.join(stars, ["a", "b"], "left_anti"), text))
    scratch.drop(rest)
    label = components(linked).withColumnRenamed("node", "key")
    grouped = distinct.select("key", "first").join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    kept = grouped.groupBy("component").agg(F.min("first").alias("first"))
    return kept.select("first.uid", "first.line")


def _texts(rows: DataFrame, distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, line_text``: the normalised text of each wanted line, from where it occurs first."""
    place = distinct.join(cut_lineage(wanted), "key").select("key", "first.uid", "first.line")
    lists = cut_lineage(place.groupBy("uid").agg(F.collect_list(F.struct("line", "key")).alias("wanted")))
    if place.count() <= NEAR_LINES:
        lists = F.broadcast(lists)
    taken = F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), F.get(F.col("lines"), w["line"].cast("int")).alias("raw")))
    found = rows.join(lists, "uid").withColumn("lines", F.split("text", "\n")).select(F.explode(taken).alias("x"))
    return cut_lineage(found.select("x.key", _normal(F.col("x.raw")).alias("line_text")).dropDuplicates(["key"]))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without repeated lines, with ``n_lines`` and ``n_removed``.

    Lines without words stay.  A null text stays null with no lines; a text whose
    lines all stand elsewhere first becomes empty.  Rows with null ids are rows
    like any other; rows that repeat an id and its text keep the same lines.
    Other columns pass through (those of the two new names are replaced).
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    with scratch_scope(docs.sparkSession) as scratch:
        kept, _ = line_groups(docs)
        lists = cut_lineage(kept.groupBy(F.col("uid").alias("_uid")).agg(F.collect_set("line").alias("_kept")))
        scratch.keep(lists)
    rows = docs.select(*names, F.xxhash64("doc_id", "text").alias("_uid")).join(lists, "_uid", "left")
    keep = F.coalesce("_kept", F.array().cast("array<bigint>"))
    held = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))),
        lambda s: F.array_contains(keep, s["i"]) | ~F.rlike(s["x"], F.lit(WORDS)),
    )
    rows = rows.withColumn("_held", held).withColumn("_n", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    text = F.array_join(F.transform("_held", lambda s: s["x"]), "\n").alias("text")
    return rows.select(
        *[text if c == "text" else F.col(c) for c in names],
        F.col("_n").alias("n_lines"),
        (F.col("_n") - F.coalesce(F.size("_held"), F.lit(0))).alias("n_removed"),
    )
