"""Benchmark decontamination: training passages query a BM25 index of test items with block-max WAND."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import kernel
from readloom.llm.lines import FOLD

SHARD = 20_000  # test items of one index; more items make more indexes, each asked by every passage
SHARD_CHARS = 20_000_000  # characters of their texts, checked: a longer shard is cut further
K1, B = 1.2, 0.75  # BM25
LEAST = 0.5  # a passage retrieves an item from this share of the score of the item's own text
HALF = 48  # words of half a passage at least; half a passage holds the longest item of the index
BLOCK = 2  # items that share a posting block and its maximum
OVERLAP = 0.5  # of the word triples of the question, and of the answer, that a passage must hold
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

MATCH = "array<struct<item_id:long,score:double,question:double,answer:double,word:long>>"
MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("word", pa.int64())]))


def hashed_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = kernel.flat(text)
    folded = FOLD[data]
    starts, ends = kernel.spans(folded > 0, off)
    return kernel.hash_spans(folded, starts, ends), np.searchsorted(starts, off)


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence or line, of four words at least; what stands before it is the question.

    A question of fewer than three words takes the answer in.
    """
    parts = [p for p in SENTENCE.split(text.strip()) if p.strip()]
    last = len(parts[-1].split()) if len(parts) > 1 else 0
    words = text.split()
    cut = len(words) - min(max(last, 4), len(words))
    return " ".join(words[:cut] if cut >= 3 else words), " ".join(words[cut:])


def triples(word: np.ndarray) -> np.ndarray:
    """Distinct hashes of three words in a row; of fewer words, their sequence."""
    return kernel.shingles(word, np.array([0, len(word)]), 3)[0]


class Index:
    """Postings of test items in blocks, with the largest weight of a term in each block."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        texts = [t or "" for _, t in rows]
        word, off = hashed_words(pa.array(texts, pa.large_string()))
        size = np.diff(off)
        own = np.flatnonzero(size >= 3)
        self.ids = [rows[i][0] for i in own]
        self.half = max(HALF, int(size.max(initial=0)))
        parts = [question_and_answer(texts[i]) for i in own]
        split = [hashed_words(pa.array([p[k] for p in parts], pa.large_string())) for k in (0, 1)]
        self.question, self.answer = ([triples(w[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)] for w, o in split)
        n = len(own)
        item = np.repeat(np.arange(n), size[own])
        word = np.concatenate([word[off[i] : off[i + 1]] for i in own]) if n else word[:0]
        self.vocabulary, term = np.unique(word, return_inverse=True)
        pair, tf = np.unique(term * max(n, 1) + item, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size[own] / max(size[own].mean() if n else 1, 1))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[item])
        self.full = np.bincount(item, weight, n)
        self.least = LEAST * self.full
        order = np.argsort(item, kind="stable")
        cut = np.searchsorted(item[order], np.arange(n + 1))
        self.items = [(term[order[a:b]], weight[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        # block postings: term, block, largest weight
        blocks = max(-(-n // BLOCK), 1)
        key, where = np.unique(term * blocks + item // BLOCK, return_inverse=True)
        top, block = np.zeros(len(key)), key % blocks
        np.maximum.at(top, where, weight)
        self.block_least = np.array([self.least[k * BLOCK : (k + 1) * BLOCK].min() for k in range(blocks)]) if n else np.zeros(blocks)
        # a block's lightest terms, up to half of its threshold together, never start a candidate
        rising = np.lexsort((top, block))
        total = np.cumsum(top[rising])
        before = np.concatenate([[0], total])[np.searchsorted(block[rising], np.arange(blocks))]
        light = np.zeros(len(key), bool)
        light[rising] = total - before[block[rising]] <= self.block_least[block[rising]] / 2
        self.light = np.bincount(block[light], top[light], blocks)
        self.top, self.block = top[~light], block[~light]
        self.begin = np.searchsorted(key[~light] // blocks, np.arange(len(self.vocabulary) + 1))

    def retrieve(self, word: np.ndarray, off: np.ndarray) -> list[list[dict]]:
        """Matches of each text: items above their threshold in some passage, with question and answer found there."""
        n = len(off) - 1
        out: list[list[dict]] = [[] for _ in range(n)]
        if not len(self.ids) or not len(word):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == word)
        # half passages, numbered through; a passage is one and the next
        halves = -(-np.diff(off) // self.half)
        base = np.concatenate([[0], np.cumsum(halves)])
        owner = np.searchsorted(off, known, "right") - 1
        half = base[owner] + (known - off[owner]) // self.half
        half_owner = np.repeat(np.arange(n), halves)
        paired = np.zeros(base[-1], bool)
        paired[1:] = half_owner[1:] == half_owner[:-1]
        terms = len(self.vocabulary)
        cell = np.unique(np.concatenate([half * terms + at[known], (half - 1)[paired[half]] * terms + at[known][paired[half]]]))
        passage, term = cell // terms, cell % terms
        count = self.begin[term + 1] - self.begin[term]
        slot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.begin[term], count)
        key, where = np.unique(np.repeat(passage, count) * len(self.block_least) + self.block[slot], return_inverse=True)
        bound = np.bincount(where, self.top[slot], len(key)) + self.light[key % len(self.block_least)]
        open_ = key[bound >= self.block_least[key % len(self.block_least)] - 1e-9]
        cuts = np.searchsorted(passage, np.arange(base[-1] + 1))
        best: dict[tuple[int, int], dict] = {}
        for p, b in zip((open_ // len(self.block_least)).tolist(), (open_ % len(self.block_least)).tolist(), strict=True):
            own = term[cuts[p] : cuts[p + 1]]
            for item in range(b * BLOCK, min((b + 1) * BLOCK, len(self.ids))):
                terms_, weight = self.items[item]
                place = np.minimum(np.searchsorted(own, terms_), len(own) - 1)
                score = float(weight[own[place] == terms_].sum())
                if score < self.least[item] - 1e-9:
                    continue
                doc = int(half_owner[p])
                first = off[doc] + (p - base[doc]) * self.half
                held = triples(word[first : min(first + 2 * self.half, off[doc + 1])])
                share = [float(np.isin(x, held).mean()) if len(x) else 1.0 for x in (self.question[item], self.answer[item])]
                if min(share) < OVERLAP:
                    continue
                found = {"item_id": self.ids[item], "score": score / self.full[item], "question": share[0], "answer": share[1], "word": int(first - off[doc])}
                old = best.get((doc, item))
                if old is None or (found["question"] + found["answer"], found["score"]) > (old["question"] + old["answer"], old["score"]):
                    best[doc, item] = found
        for (doc, item), found in sorted(best.items()):
            out[doc].append(found)
        return out


def _match(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kernel.slices(batches):
            found = index.value.retrieve(*hashed_words(part.column("text")))
            before = part.column("matches").to_pylist()
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            columns["matches"] = pa.array([a + b for a, b in zip(before, found, strict=True)], MATCH_ARROW)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _shards(items: DataFrame) -> Iterator[list[tuple]]:
    """Bounded lists of the items in the order of their ids; the driver holds one at a time."""
    items = items.select("item_id", "text")
    total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-total[0] // SHARD), -(-total[1] // SHARD_CHARS))
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield sorted(map(tuple, own.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def benchmark_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``matches``: the test items of ``items(item_id, text)`` they hold.

    A passage is two neighbouring halves, so that every run of words as long as
    the longest item lies in one.  It retrieves every item that it gives at least
    ``LEAST`` of the item's own BM25 score; a match also holds ``OVERLAP`` of the
    word triples of both question and answer.  ``score`` is the share of the own
    score, ``word`` the passage's first word.  Items of fewer than three words match nothing.
    Null and empty texts match nothing; null and repeated ids are rows like any
    other, other columns pass through (one named ``matches`` is replaced).
    """
    sc = docs.sparkSession.sparkContext
    names = [c for c in docs.columns if c != "matches"]
    out = docs.select("text", *[c for c in names if c != "text"], F.col("text").isNull().alias("_null"), F.array().cast(MATCH).alias("matches"))
    schema = T.StructType(out.schema.fields)
    for rows in _shards(items):
        out = out.mapInArrow(_match(sc.broadcast(Index(rows))), schema)
    return out.withColumn("text", F.when(~F.col("_null"), F.col("text"))).select(*names, "matches")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    return benchmark_matches(docs, items).where(F.size("matches") == 0).select(*docs.columns)
