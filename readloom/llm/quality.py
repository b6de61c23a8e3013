"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import kernel

GOOD, BAD, ABSTAIN = 1, 0, 2
TURNS = 100  # EM turns at most
BITS = 18  # hashed features
SAMPLE = 12_000  # documents that the scorer is fitted on, those of the smallest id hashes
TERMS = 60_000  # labelled documents that the list of toxic terms is fitted on, chosen the same way
TERM_SHARE, TERM_DOCS = 0.97, 5  # a toxic term: this share of at least so many documents with it is labelled toxic
TERM_LIST = 5_000  # terms kept at most, the most frequent

# Frequent function words of some languages
STOP = (
    "the of and to in a is that it for on with as was be by at are this from or an not have you he they "
    "de la le et les des en un une du que est pour dans qui sur pas au par il "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als "
    "el los y del se las por con no una su para al lo como"
).split()
MARKS = np.frombuffer(b"#$%&*@~^|<>{}[]=+_\\", np.uint8)
ENDS = np.frombuffer(b".,;:!?\"')%", np.uint8)

# Labellers as (statistic, bad at or above, good at or below); a rate between the two abstains
RULES = [
    ("caps", 0.5, 0.2),
    ("shout", 0.2, 0.05),
    ("marks", 0.04, 0.01),
    ("marked", 0.3, 0.05),
    ("stutter", 0.2, 0.03),
    ("again", 0.4, 0.15),
    ("loose", 0.15, 0.02),
    ("long", 12.0, 9.0),
    ("strange", 0.98, 0.85),
    ("toxic", 1.0, 0.0),
    ("rude", 0.004, 0.0),
]
STATS = [name for name, _, _ in RULES]


@functools.cache
def _upper() -> np.ndarray:
    return np.array([chr(c).isupper() for c in range(0x3000)])


@functools.cache
def _alpha() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x3000)])


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words as ``_Text`` makes them."""
    return _Text([w + " " for w in words]).core


class _Text:
    """Words of many texts with the statistics that the labellers look at."""

    def __init__(self, texts: list[str]):
        array = pa.array([t.lower() for t in texts], pa.large_string())
        data, off = kernel.flat(array)
        starts, ends = kernel.spans(~kernel.SPACE[data], off)
        self.off = np.searchsorted(starts, off)
        self.whole = kernel.hash_spans(data, starts, ends)
        # the word without marks at its ends: what is hashed as a feature
        solid = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
        core_start, core_end = kernel.spans(solid, off)
        self.core_off = np.searchsorted(core_start, off)
        self.core = kernel.hash_spans(data, core_start, core_end)
        n, count = len(texts), np.diff(self.off)
        one = np.maximum(count, 1)
        owner = np.repeat(np.arange(n), count)
        per = lambda x: np.bincount(owner, x, minlength=n)
        size = ends - starts
        last = data[ends - 1] if len(ends) else data[:0]
        marked = ~((last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57) | np.isin(last, ENDS))
        inside = np.concatenate([[0], np.cumsum(solid)])
        same = np.zeros(len(starts), bool)
        same[1:] = (self.whole[1:] == self.whole[:-1]) & (owner[1:] == owner[:-1])
        chars = np.maximum(np.diff(off), 1)
        span = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[off])
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        cut = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        low = np.minimum(raw, 0x2FFF)
        point = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[cut])
        stop = np.isin(self.whole, _stop_hashes()) if texts != STOP else np.zeros(len(starts), bool)
        again = np.zeros(n)
        quads = kernel.shingles(self.whole, self.off, 4)
        again = 1 - np.array([len(q) for q in quads]) / np.maximum(count - 3, 1)
        self.stat = {
            "caps": point(_upper()[low]) / np.maximum(point(_alpha()[low]), 1),
            "shout": span(data == 33) / one,
            "marks": span(np.isin(data, MARKS)) / chars,
            "marked": per(marked) / one,
            "stutter": per(same) / one,
            "again": np.maximum(again, 0.0),
            "loose": per(inside[ends] == inside[starts]) / one,
            "long": per(size) / one,
            "strange": np.where(count >= 10, 1 - per(stop) / one, 0.9),
        }
        self.count = count

    def toxic(self, terms: np.ndarray | None) -> None:
        """Words on the list of toxic terms: their number, and their share."""
        n = len(self.count)
        if terms is None or not len(terms):
            self.stat["toxic"] = self.stat["rude"] = np.full(n, np.nan)
            return
        hit = terms[np.minimum(np.searchsorted(terms, self.core), len(terms) - 1)] == self.core
        found = np.diff(np.concatenate([[0], np.cumsum(hit)])[self.core_off])
        self.stat["toxic"], self.stat["rude"] = found.astype(float), found / np.maximum(self.count, 1)

    def votes(self) -> np.ndarray:
        """(texts, labellers); a text without words gets only abstentions."""
        out = []
        for name, bad, good in RULES:
            x = self.stat[name]
            with np.errstate(invalid="ignore"):
                vote = np.where(x >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN))
            out.append(np.where(np.isnan(x) | (self.count == 0), ABSTAIN, vote))
        return np.stack(out, 1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of the distinct hashed features: words, and the binned statistics."""
        owner = np.repeat(np.arange(len(self.count)), np.diff(self.core_off))
        bucket = (self.core >> np.uint64(64 - BITS)).astype(np.int64)
        rows, cols = [owner], [bucket]
        for k, (name, bad, good) in enumerate(RULES):
            x = np.nan_to_num(self.stat[name])
            place = np.clip(np.floor((x - good) / (bad - good) * 4), -1, 8).astype(np.int64) + 1
            rows.append(np.arange(len(self.count)))
            cols.append((kernel.mix(np.array(place + 16 * (k + 1), np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64))
        key = np.unique(np.concatenate(rows) << BITS | np.concatenate(cols))
        return key >> BITS, key & (1 << BITS) - 1


@functools.cache
def _stop_hashes() -> np.ndarray:
    data, off = kernel.flat(pa.array(STOP, pa.large_string()))
    return np.unique(kernel.hash_spans(data, off[:-1], off[1:]))


def _votes(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kernel.slices(batches):
            text = _Text(part.column("text").to_pylist())
            text.toxic(terms.value)
            code = text.votes() @ 3 ** np.arange(len(RULES))
            pattern, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])

    return run


def estimate(pattern: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vote probabilities of each labeller for bad and good documents, and the two class shares.

    Expectation-maximisation over the counts of vote patterns.  It starts from
    the belief that one vote against a document outweighs the votes for it.
    """
    votes = pattern[:, None] // 3 ** np.arange(len(RULES)) % 3
    against = (votes == BAD).any(1)
    good = np.where(against, 0.1, 0.9)
    for _ in range(TURNS):
        weight = np.stack([n * (1 - good), n * good])
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        p = np.stack([[np.bincount(votes[:, k], w, minlength=3) for k in range(len(RULES))] for w in weight]) + 0.1
        p /= p.sum(2, keepdims=True)
        after = posterior(votes, p, prior)
        if np.abs(after - good).max(initial=0) < 1e-6:
            break
        good = after
    return p, prior


def posterior(votes: np.ndarray, p: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Probability that a document is good, by its votes."""
    log = np.log(prior)[None] + np.log(p[:, np.arange(len(RULES)), votes]).sum(2).T
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in kernel.slices(batches):
        text = _Text(part.column("text").to_pylist())
        owner = np.repeat(np.arange(part.num_rows), np.diff(text.core_off))
        own = np.lexsort((text.core, owner))
        word, owner = text.core[own], owner[own]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
        toxic = part.column("toxic").to_numpy(zero_copy_only=False)[owner[new]] > 0
        term, at = np.unique(word[new], return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(term.view(np.int64)), pa.array(np.bincount(at, minlength=len(term))), pa.array(np.bincount(at, toxic, len(term)).astype(np.int64))],
            names=["term", "n", "toxic"],
        )


def toxic_terms(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Sorted hashes of words that almost only documents labelled toxic use."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TERMS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sums = rows.mapInArrow(_term_counts, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    kept = sums.where((F.col("n") >= TERM_DOCS) & (F.col("toxic") >= TERM_SHARE * F.col("n"))).orderBy(F.col("n").desc(), "term").limit(TERM_LIST)
    terms = kept.select("term").toArrow()["term"].to_numpy().view(np.uint64)
    return np.sort(terms)


def _sample_features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, p, prior = model.value
        for part in kernel.slices(batches):
            text = _Text(part.column("text").to_pylist())
            text.toxic(terms)
            row, bucket = text.features()
            parts = np.split(bucket, np.searchsorted(row, np.arange(1, part.num_rows)))
            good = posterior(text.votes(), p, prior)
            yield pa.RecordBatch.from_arrays([pa.array(good), kernel.list_array(parts, pa.int64())], names=["good", "features"])

    return run


def fit(good: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights of the hashed features and a bias: logistic regression on posterior labels."""
    weight = np.zeros(1 << BITS)
    if not len(good):
        return weight, 0.0
    row, col = np.repeat(np.arange(len(good)), [len(f) for f in features]), np.concatenate(features)
    share = np.bincount(col, good[row], minlength=1 << BITS)
    used = np.bincount(col, minlength=1 << BITS)
    base = good.mean()
    spread = np.sqrt(np.maximum(used * base * (1 - base), 1e-9))
    # so many standard errors are what the largest of as many chance differences reaches
    z = np.sqrt(2 * np.log(max((used >= 3).sum(), 2)))
    kept = np.flatnonzero((used >= 3) & (np.abs(share - used * base) >= z * spread))
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    own = number[col] >= 0
    row, col = row[own], number[col[own]]
    w, b = np.zeros(len(kept)), float(np.log((base + 1e-3) / (1 - base + 1e-3)))
    seen_w, seen_b = np.full(len(kept), 1e-8), 1e-8
    for _ in range(300):
        gap = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(good)) + b, -30, 30))) - good
        g = np.bincount(col, gap[row], len(kept)) / len(good) + 1e-6 * w
        seen_w += g * g
        seen_b += gap.mean() ** 2
        w -= 0.5 * g / np.sqrt(seen_w)
        b -= 0.5 * gap.mean() / np.sqrt(seen_b)
    weight[kept] = w
    return weight, float(b)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, p, prior, weight, bias = model.value
        for part in kernel.slices(batches):
            text = _Text(part.column("text").to_pylist())
            text.toxic(terms)
            row, bucket = text.features()
            total = np.bincount(row, weight[bucket], part.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            columns |= {"weak_label": pa.array(posterior(text.votes(), p, prior)), "quality_score": pa.array(score)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``weak_label`` and ``quality_score``, both from 0 (bad) to 1 (good).

    Labellers vote on every text; the counts of their vote patterns over all
    documents fit the accuracies.  A list of toxic terms is fitted on at most
    ``TERMS`` rows of ``labels(doc_id, toxic)``; without labels its labellers
    abstain.  The scorer is fitted on at most ``SAMPLE`` documents.  Null texts
    count as empty; texts without words are scored by their statistics alone.
    Null and repeated ids are scored row by row; other columns pass through.
    """
    sc = docs.sparkSession.sparkContext
    terms = toxic_terms(docs, labels)
    texts = docs.select("text")
    found = texts.mapInArrow(_votes(sc.broadcast(terms)), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    p, prior = estimate(found["pattern"].to_numpy(), found["n"].to_numpy())
    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text")
    sample = rows.mapInArrow(_sample_features(sc.broadcast((terms, p, prior))), "good double, features array<long>").toArrow()
    weight, bias = fit(sample["good"].to_numpy(), kernel.list_parts(sample["features"]))
    names = [c for c in docs.columns if c not in ("weak_label", "quality_score")]
    # the text comes back as it went in: nulls are read as empty only inside
    kept = docs.select("text", *[c for c in names if c != "text"], F.col("text").isNull().alias("_null"))
    added = [T.StructField(c, T.DoubleType()) for c in ("weak_label", "quality_score")]
    model = sc.broadcast((terms, p, prior, weight, bias))
    out = kept.mapInArrow(_score(model), T.StructType([*kept.schema.fields, *added]))
    out = out.withColumn("text", F.when(~F.col("_null"), F.col("text")))
    return out.select(*names, "weak_label", "quality_score")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of one half or more."""
    return quality_scores(docs, labels).where(F.col("quality_score") >= 0.5).select(*docs.columns)
