"""Numpy helpers over Arrow batches of texts: words, hashes, shingles.

Everything works on the flat UTF-8 buffer of many texts at once.  Hashes are
64 bits wide; two different words or shingles share one with a chance of about
pairs / 2^64, which all users of this module accept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# bytes of text that one vector pass takes; a single longer text is taken whole
PASS_BYTES = 2_000_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * MULTIPLIER
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, MULTIPLIER, np.uint64)]))
    return _powers[:n]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice hold about ``size`` bytes; nulls become empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = batch.column(at)
        if text.null_count or not pa.types.is_large_string(text.type):
            text = text.cast(pa.large_string()).fill_null("")
            columns = [text if i == at else batch.column(i) for i in range(batch.num_columns)]
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        ends = np.cumsum(lengths(text))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(text: pa.Array) -> np.ndarray:
    return np.diff(_offsets(text))


def _offsets(text: pa.Array) -> np.ndarray:
    raw = np.frombuffer(text.buffers()[1], np.int64)
    return raw[text.offset : text.offset + len(text) + 1]


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them."""
    off = _offsets(text)
    data = text.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


# The white space bytes of the word rule, and A-Z to a-z
SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; a run never crosses a text's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans follow each other and none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(size.sum()) - np.repeat(first, size)
    value = data[within + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    total = np.add.reduceat(value * powers(int(size.max()) + 1)[within], first)
    return mix(total + size.astype(np.uint64))


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the n + 1 word offsets of the texts."""
    data, off = flat(text)
    low = LOWER[data]
    starts, ends = spans(~SPACE[low], off)
    return hash_spans(low, starts, ends), np.searchsorted(starts, off)


def shingles(word: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer words than ``size`` is one shingle; one without words has none.
    """
    n = len(word)
    if n >= size:
        joined = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            joined += word[j : n - size + 1 + j] * powers(size + 2)[j + 1]
        joined = mix(joined)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(joined[a : b - size + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            short = (word[a:b] * powers(size + 2)[1 : b - a + 1]).sum(dtype=np.uint64)
            out.append(mix(np.array([short + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of the given arrays."""
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


def list_parts(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            return [p for chunk in column.chunks for p in list_parts(chunk)]
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked with each of ``n`` indexes by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
