"""Removal of passages that repeat across documents: windows of words meet in minimiser buckets as packed super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kernel
from readloom.llm.jaccard import Bitmap
from readloom.session import cut_lineage, join_bounded, scratch_scope

WINDOW = 50  # words
GRAM = 6  # words whose smallest hash in a window names the window's bucket
LONGEST = 256  # windows of one packed string; a longer run travels as several
HOT_ROWS = 20_000  # packed strings that a bucket takes; a fuller one gets its windows one by one, combined on the way
HOT_KEYS = 10_000  # buckets at most that are told to all tasks: 80 kB
TRACKED = 100_000  # keys of the sketch that finds them
SLICE = 500_000  # bytes of text that are parsed at a time
SEEN = 200_000  # texts that a task remembers
NO_ID = (1 << 63) - 1  # rank of a row without id: behind all others

TEXT = ["t1", "t2"]


class Parsed:
    """Words of a slice of texts, as spans and as bytes with one blank behind each word."""

    def __init__(self, part: pa.RecordBatch):
        self.data, off = kernel.flat(part.column("text"))
        self.starts, self.ends = kernel.spans(~kernel.SPACE[self.data], off)
        self.off = np.searchsorted(self.starts, off)
        long_ = self.ends - self.starts + 1
        self.stop = np.cumsum(long_)
        self.begin = self.stop - long_
        if len(long_):
            at = np.arange(self.stop[-1]) + np.repeat(self.starts - self.begin, long_)
            joined = self.data[np.minimum(at, len(self.data) - 1)]
            joined[self.stop - 1] = 32
            self.joined = joined.tobytes()
        else:
            self.joined = b""
        raw = [self.data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        digest = b"".join(hashlib.md5(r).digest() for r in raw)
        self.text = np.frombuffer(digest, "<i8").reshape(-1, 2)

    def packed(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last`` (included), joined by one blank."""
        return self.joined[self.begin[first] : self.stop[last] - 1]

    def minima(self) -> np.ndarray:
        """The smallest gram hash of the window that starts at each word, whatever the text ends."""
        n = len(self.starts)
        if n < WINDOW:
            return np.zeros(0, np.uint64)
        word = kernel.hash_spans(self.data, self.starts, self.ends)
        low = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            low += word[j : n - GRAM + 1 + j] * kernel.powers(GRAM + 2)[j + 1]
        low, width, need = kernel.mix(low), 1, WINDOW - GRAM + 1
        while 2 * width <= need:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        return np.minimum(low[: len(low) - (need - width)], low[need - width :])

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and bucket of every whole window of the wanted texts."""
        low = self.minima()
        doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))[: len(low)]
        at = np.flatnonzero((np.arange(len(low)) + WINDOW <= self.off[doc + 1]) & wanted[doc])
        return doc[at], at, low[at].view(np.int64)


def _packer():
    """Packs strings of words; equal strings have equal packages."""
    return zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False).compress


class _Fresh:
    """Tells the rows of a task whose text it has not met under as small an id."""

    def __init__(self):
        self.least: dict[tuple[int, int], int] = {}

    def __call__(self, text: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(self.least) > SEEN:
            self.least.clear()
        out = np.zeros(len(ids), bool)
        for i, (key, doc) in enumerate(zip(map(tuple, text.tolist()), ids.tolist(), strict=True)):
            if doc < self.least.get(key, NO_ID + 1):
                self.least[key] = doc
                out[i] = True
        return out


def _ranks(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").fill_null(NO_ID).to_numpy()


def _text_columns(text: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(text[:, k])) for k in (0, 1)]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of a task's runs of windows, with their numbers."""
    for part in kernel.slices(batches, size=SLICE):
        doc, at, low = Parsed(part).windows(np.ones(part.num_rows, bool))
        head = np.ones(len(low), bool)
        head[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(low[head])], names=["h"])


def _super_kmers(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, pack = _Fresh(), _packer()
        for part in kernel.slices(batches, size=SLICE):
            x, ids = Parsed(part), _ranks(part)
            doc, at, low = x.windows(fresh(x.text, ids))
            keep = ~np.isin(low, hot)
            doc, at, low = doc[keep], at[keep], low[keep]
            if not len(at):
                continue
            head = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)]))
            size = np.diff(np.concatenate([head, [len(at)]]))
            pieces = -(-size // LONGEST)
            run_of = np.repeat(np.arange(len(head)), pieces)
            nth = np.arange(len(run_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = at[head[run_of]] + nth * LONGEST
            count = np.minimum(size[run_of] - nth * LONGEST, LONGEST)
            owner = doc[head[run_of]]
            last = first + count + WINDOW - 2
            packed = [pack(x.joined[a:b]) for a, b in zip(x.begin[first].tolist(), (x.stop[last] - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(low[head[run_of]]), *_text_columns(x.text[owner]), pa.array(ids[owner]), pa.array(first - x.off[owner], pa.int64()), pa.array(packed, pa.binary())],
                names=["h", *TEXT, "doc", "at", "packed"],
            )

    return run


def _hot_windows(hot: np.ndarray):
    """Every window of the hot buckets by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for part in kernel.slices(batches, size=SLICE):
            x, ids = Parsed(part), _ranks(part)
            doc, at, low = x.windows(fresh(x.text, ids))
            keep = np.isin(low, hot)
            doc, at = doc[keep], at[keep]
            digest = [hashlib.md5(x.packed(a, a + WINDOW - 1)).digest() for a in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), *_text_columns(x.text[doc]), pa.array(ids[doc]), pa.array(at - x.off[doc], pa.int64())],
                names=["w", *TEXT, "doc", "at"],
            )

    return run


def _window_list(packed: bytes) -> list[bytes]:
    cuts = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist(), len(packed)]
    return [packed[cuts[i] + 1 : cuts[i + WINDOW]] for i in range(len(cuts) - WINDOW)]


def _stretches(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last window of every run of hits."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def earlier_windows(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """``t1, t2, a, b``: words of a text in windows that also start in a document before it.

    ``rows`` are the packed strings ``(t1, t2, doc, at, packed)`` of one bucket,
    which holds every occurrence of its windows.
    """
    least: dict[tuple, tuple[int, bytes]] = {}
    for t1, t2, doc, at, packed in rows:
        key = (t1, t2, at)
        if key not in least or doc < least[key][0]:
            least[key] = (doc, packed)
    texts = {k[:2] for k in least}
    if len(texts) < 2:
        return []
    unpack = zstandard.ZstdDecompressor().decompress
    by_string: dict[bytes, int] = {}
    for doc, packed in least.values():
        by_string[packed] = min(doc, by_string.get(packed, doc))
    low = min(by_string.values())
    out = []
    if len(by_string) == 1:
        words = unpack(packed).count(b" ") + 1
        return [(t1, t2, at, at + words) for (t1, t2, at), (doc, _) in least.items() if doc > low]
    windows = {p: _window_list(unpack(p)) for p in by_string}
    first: dict[bytes, int] = {}
    for p, ws in windows.items():
        doc = by_string[p]
        for w in ws:
            if first.get(w, NO_ID + 1) > doc:
                first[w] = doc
    firsts = {p: np.array([first[w] for w in ws], np.int64) for p, ws in windows.items()}
    for (t1, t2, at), (doc, p) in least.items():
        for i, j in _stretches(firsts[p] < doc):
            out.append((t1, t2, at + i, at + j + WINDOW))
    return out


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by bucket; holds one bucket at a time."""
    held: list[tuple] = []
    bucket, out = None, []

    def answer() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*TEXT, "a", "b"])
        out.clear()
        return batch

    for batch in batches:
        h = batch.column(0).to_numpy()
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(h))
        for a, b in zip(head.tolist(), tail.tolist(), strict=True):
            edge = a == 0 or b == len(h)
            if b - a == 1 and not edge:
                continue  # alone in its bucket
            rows = list(zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(1, 6)), strict=True))
            if not edge:
                out += earlier_windows(rows)
            else:
                if h[a] != bucket:
                    out += earlier_windows(held)
                    held, bucket = [], h[a]
                held += rows
        if len(out) > 20_000:
            yield answer()
    out += earlier_windows(held)
    if out:
        yield answer()


def hot_buckets(docs: DataFrame) -> np.ndarray:
    """Minimisers of more than ``HOT_ROWS`` runs of windows, found by a sketch of bounded size."""
    found = docs.mapInArrow(_buckets, "h long").agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {TRACKED})").alias("top")).first()[0] or []
    return np.array(sorted(r["item"] for r in found if r["count"] > HOT_ROWS), np.int64)


def repeated_passages(docs: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """Words to remove by text: ``t1, t2, spans``, the two halves of the text's MD5 and ``array<struct<a, b>>``.

    The spans hold for the row with the smallest id among those of equal text;
    all windows of the others start in it.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    hot = hot_buckets(texts) if hot is None else hot
    spread_out = texts.mapInArrow(_super_kmers(hot), "h long, t1 long, t2 long, doc long, at long, packed binary")
    found = spread_out.repartition("h").sortWithinPartitions("h").mapInArrow(_in_buckets, "t1 long, t2 long, a long, b long")
    if len(hot):
        windows = cut_lineage(texts.mapInArrow(_hot_windows(hot), "w binary, t1 long, t2 long, doc long, at long"))
        first = windows.groupBy("w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
        # a text met by several tasks stands here under several ids; the smallest is the one that counts
        least = windows.groupBy(*TEXT, "at", "w").agg(F.min("doc").alias("doc"))
        hits = join_bounded(least, cut_lineage(first), "w").where("first < doc")
        found = found.unionByName(hits.select(*TEXT, F.col("at").alias("a"), (F.col("at") + WINDOW).alias("b")))
    return cut_lineage(found.groupBy(*TEXT).agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text, number of words and hash of the joined words of every row."""
    for part in kernel.slices(batches, size=SLICE):
        x = Parsed(part)
        sha = [hashlib.sha256(x.packed(a, b - 1) if b > a else b"").hexdigest() for a, b in zip(x.off[:-1].tolist(), x.off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *_text_columns(x.text), pa.array(np.diff(x.off), pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", *TEXT, "n_words", "sha"],
        )


def _chosen(marked):
    """One row of each text that may have spans, as far as a task knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for part in kernel.slices(batches, size=SLICE):
            x = Parsed(part)
            keep = marked.value.has(x.text[:, 0].astype("<i8").view(np.uint64))
            keep[keep] = fresh(x.text[keep], np.zeros(int(keep.sum()), np.int64))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([*_text_columns(x.text[at]), part.column("text").take(pa.array(at)).cast(pa.string())], names=[*TEXT, "text"])

    return run


def keep_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """How many words the spans cover, and the others joined by one blank."""
    words = [w for w in text.translate(_TO_BLANK).split(b" ") if w]
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


_TO_BLANK = bytes.maketrans(bytes(np.flatnonzero(kernel.SPACE).tolist()), b" " * int(kernel.SPACE.sum()))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        cut = [keep_words(t.encode(), [(s["a"], s["b"]) for s in ss]) for t, ss in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in TEXT), pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1].decode() for c in cut], pa.string())],
            names=[*TEXT, "n_removed", "kept"],
        )


def _edited(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``t1, t2, n_removed, kept`` of every text with spans; only texts that may have some are shuffled."""
    marked = docs.sparkSession.sparkContext.broadcast(Bitmap(spans.select(F.col("t1").alias("token"))))
    texts = docs.select("text").mapInArrow(_chosen(marked), "t1 long, t2 long, text string")
    return texts.join(spans, TEXT).mapInArrow(_kept, "t1 long, t2 long, n_removed long, kept string")


def passage_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs(doc_id, text)``.

    A word goes when a window of 50 consecutive words around it also starts in a
    row with a smaller id; windows are judged before anything is removed.  Null
    texts have no words.  Rows without id come after all others and are not
    before each other; rows with equal ids are not before each other either.
    Equal rows have equal results.  Other columns are ignored.

    Runs of windows with the same minimiser travel as one string of words to
    the minimiser's bucket and are compared there word for word.  A task sends
    equal texts once.  Buckets that would be too full get their windows by
    digest, combined before the shuffle.
    """
    with scratch_scope(docs.sparkSession) as scratch:
        spans = repeated_passages(docs)
        each = cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests, "doc_id long, t1 long, t2 long, n_words long, sha string"))
        rank = F.coalesce("doc_id", F.lit(NO_ID))
        edits = _edited(docs, spans).select(*TEXT, "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept")).dropDuplicates(TEXT)
        first = cut_lineage(each.groupBy(*TEXT).agg(F.min(rank).alias("first")).join(edits, TEXT, "left"))
        rows = join_bounded(each, first, TEXT)
        later = (rank > F.col("first")) & (F.col("n_words") >= WINDOW)
        out = cut_lineage(
            rows.select(
                "doc_id",
                "n_words",
                F.when(later, F.col("n_words")).when(rank > F.col("first"), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                F.when(later, hashlib.sha256(b"").hexdigest()).when(rank > F.col("first"), F.col("sha")).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
            )
        )
        scratch.keep(out)
    return out


def without_passages(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated words taken out of ``text``.

    Texts that lose nothing stay as they are; others are their kept words
    joined by one blank.  The rules are those of ``passage_digests``.
    """
    with scratch_scope(docs.sparkSession) as scratch:
        spans = repeated_passages(docs)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        each = docs.select(row.alias("row"), "doc_id", "text", F.coalesce(F.md5("text"), F.lit("")).alias("half"))
        rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
        edits = _edited(docs, spans).select(F.concat(*[_hex(c) for c in TEXT]).alias("half"), "kept").dropDuplicates(["half"])
        first = cut_lineage(each.groupBy("half").agg(F.min(rank).alias("first")).join(edits, "half", "left"))
        rows = join_bounded(each, first, "half")
        long_ = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")) >= WINDOW
        text = F.when((rank > F.col("first")) & long_, "").when(rank > F.col("first"), F.col("text")).otherwise(F.coalesce("kept", "text"))
        out = cut_lineage(rows.select(*[F.col(f"row.`{c}`") if c != "text" else text.alias("text") for c in docs.columns]))
        scratch.keep(out)
    return out


def _hex(name: str):
    """The 16 hex digits of a little-endian half of a digest."""
    digits = F.lpad(F.hex(F.col(name)), 16, "0")
    return F.lower(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))
