"""Languages of mixed texts: scripts, word scores, and a Viterbi path over the words."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kernel

BITS = 16  # buckets of letter triples, and as many of whole words
SWITCH = 12.0  # what a change of language between two words costs, in nats
ADMITTED = 0.005  # share of a language's letters that a script needs to count as its own
FOREIGN = -30.0  # score of a word in a script that the language does not use
LANGUAGES = 1_000  # languages at most; more raise an error
UNKNOWN = "und"

# First code points of script ranges; what no range names is Latin-like by default
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xAC00, "hangul"), (0xD7B0, "latin"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "latin"), (0x20000, "han"),
]
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([start for start, _ in SCRIPTS])
NUMBERS = np.array([NAMES.index(name) for _, name in SCRIPTS])


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Words:
    """The words (runs of letters) of many texts: place, script and feature buckets."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(map(_lower, texts)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.start, self.end = kernel.spans(_letters()[points], off)
        self.size = self.end - self.start
        self.off = np.searchsorted(self.start, off)
        self.text_off = off
        n = self.size.sum()
        self.first = np.cumsum(self.size) - self.size
        at = np.arange(n) - np.repeat(self.first - self.start, self.size)
        own = points[at].astype(np.uint64)
        before, behind = np.zeros_like(own), np.zeros_like(own)
        before[1:], behind[:-1] = own[:-1], own[1:]
        before[self.first], behind[self.first + self.size - 1] = 0, 0
        triple = kernel.mix(before * np.uint64(0x1F123BB5) + own * np.uint64(0x5851F42D4C957F2D) + behind * np.uint64(0x14057B7EF767814F))
        self.triple = (triple >> np.uint64(64 - BITS)).astype(np.int64)
        whole = np.zeros(0, np.uint64)
        self.script = np.zeros(0, np.int64)
        if n:
            within = np.arange(n) - np.repeat(self.first, self.size)
            whole = kernel.mix(np.add.reduceat((own + np.uint64(1)) * kernel.powers(int(self.size.max()) + 1)[within], self.first))
            self.script = NUMBERS[np.searchsorted(STARTS, own[self.first].astype(np.int64), "right") - 1]
        self.whole = (whole >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)


SLOTS = (2 << BITS) + len(NAMES)  # triples, words, letters by script


def _learn(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(langs), SLOTS), np.int64)
        number = {lang: k for k, lang in enumerate(langs)}
        for part in kernel.slices(batches):
            words = Words(part.column("text").to_pylist())
            lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
            each = np.repeat(lang, np.diff(words.off))
            for k in np.unique(lang).tolist():
                own = each == k
                count[k] += np.bincount(words.triple[np.repeat(own, words.size)], minlength=SLOTS)
                count[k] += np.bincount(words.whole[own], minlength=SLOTS)
                count[k] += np.bincount(words.script[own] + (2 << BITS), words.size[own], minlength=SLOTS).astype(np.int64)
        row, slot = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(count[row, slot])], names=["lang", "slot", "n"]
        )

    return run


class Model:
    def __init__(self, langs: list[str], count: np.ndarray):
        self.langs = langs
        grams = count[:, : 1 << BITS] + 0.5
        whole = count[:, 1 << BITS : 2 << BITS] + 0.5
        self.score = np.concatenate([np.log(grams / grams.sum(1, keepdims=True)), np.log(whole / whole.sum(1, keepdims=True))], 1).T.copy()
        letters = count[:, 2 << BITS :]
        self.admits = letters >= ADMITTED * np.maximum(letters.sum(1, keepdims=True), 1)

    def path(self, words: Words) -> np.ndarray:
        """The language number of every word on the best path through its text."""
        n, width = len(words.size), len(self.langs)
        if not n:
            return np.zeros(0, np.int64)
        gain = np.add.reduceat(self.score[words.triple], words.first, axis=0) + self.score[words.whole]
        # a script narrows the candidates unless no language uses it
        admitted = self.admits.T[words.script]
        gain = np.where(admitted | ~admitted.any(1, keepdims=True), gain, FOREIGN * words.size[:, None])
        back = np.zeros((n, width), np.uint16)
        count = np.diff(words.off)
        order = np.argsort(-count, kind="stable")
        order = order[count[order] > 0]
        start, length = words.off[:-1][order], count[order]
        alive = np.searchsorted(-length, -np.arange(length[0]), "left")
        best = gain[start]
        stay = np.arange(width)
        for t in range(1, int(length[0])):
            m = alive[t]
            held = best[:m]
            top = held.argmax(1)
            jump = held[np.arange(m), top] - SWITCH
            moved = held < jump[:, None]
            at = start[:m] + t
            back[at] = np.where(moved, top[:, None], stay)
            best[:m] = np.where(moved, jump[:, None], held) + gain[at]
        lang = np.zeros(n, np.int64)
        state = best.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            m = alive[t]
            at = start[:m] + t
            lang[at] = state[:m]
            state[:m] = back[at, state[:m]]
        return lang


def train(rows: DataFrame) -> Model | None:
    """Counts over all ``rows(text, lang)``; None where no row has a language.

    Every task adds up its own texts, so that at most ``SLOTS`` sums a language
    and task are shuffled; the summed table has a fixed size for each language.
    """
    rows = rows.where(F.col("lang").isNotNull()).select("text", "lang")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not langs:
        return None
    sums = rows.mapInArrow(_learn(langs), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((len(langs), SLOTS), np.int64)
    count[sums["lang"].to_numpy(), sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return Model(langs, count)


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in kernel.slices(batches):
            texts = part.column("text").to_pylist()
            words = Words(texts)
            lang = m.path(words) if m else np.zeros(len(words.size), np.int64)
            spans, preds, scores = [], [], []
            for i, (a, b) in enumerate(zip(words.off[:-1].tolist(), words.off[1:].tolist(), strict=True)):
                if a == b or not m:
                    spans.append([]), preds.append(UNKNOWN), scores.append(0.0)
                    continue
                own = lang[a:b]
                letters = np.bincount(own, words.size[a:b], minlength=len(m.langs))
                k = int(letters.argmax())
                preds.append(m.langs[k])
                scores.append(float(letters[k] / letters.sum()))
                cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [b - a]])
                first, last = words.start[a + cut[:-1]] - words.text_off[i], words.end[a + cut[1:] - 1] - words.text_off[i]
                spans.append([{"lang": m.langs[k], "start": x, "stop": y} for k, x, y in zip(own[cut[:-1]].tolist(), first.tolist(), last.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, SPANS)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return run


def label_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row of ``docs(doc_id, text)``.

    Spans are runs of words of one language, with code point offsets.
    ``lang_pred`` has most letters (the first by name among equals), ``score`` is
    its share of all letters.  Texts without letters, nulls, and all texts of an
    untrained model are ``und`` with score 0.  Null and repeated ids are passed
    on; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,stop:long>>"
    return docs.select("doc_id", "text").mapInArrow(_label(shared), schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learns from two thirds of ``docs(doc_id, text, lang)`` and labels all: ``doc_id, held_out, lang_pred, score``.

    Held out is a row whose CRC-32 of the id as text leaves 1 when divided by 3.
    Rows with a null id are neither learned from nor held out.
    """
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.where(third != 1))
    found = label_languages(docs, model)
    return found.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
