"""Banded alignment of sequence pairs as an Arrow map over a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import kernels

MATCH_FIELDS = ["m_size", "dist", "q_bgn", "q_end", "t_bgn", "t_end", "q_m_end", "t_m_end"]
TAG_FIELDS = ["t_pos", "delta", "base", "p_t_pos", "p_delta", "p_base"]

# pairs and bases aligned together; bounds the memory of a task
PAIRS_AT_ONCE = 256
BASES_AT_ONCE = 2_000_000
# with a trace, every edit level of every pair is held until its columns are read off
TRACED_AT_ONCE = 500_000


def _chunks(queries: pa.Array, targets: pa.Array, bases: int = BASES_AT_ONCE) -> Iterator[tuple[int, int]]:
    sizes = pc.add(pc.binary_length(queries), pc.binary_length(targets)).to_pylist()
    start, size = 0, 0
    for i, here in enumerate(sizes):
        if i > start and (i - start >= PAIRS_AT_ONCE or size + here > bases):
            yield start, i
            start, size = i, 0
        size += here
    if start < len(sizes):
        yield start, len(sizes)


def _texts(column) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def match_pairs(pairs: DataFrame, band: int = 100, query: str = "q", target: str = "t") -> DataFrame:
    """Replaces the two text columns by the match of each pair.

    A pair that does not align has ``dist`` and all begins and ends 0.
    """
    passed = [c for c in pairs.columns if c not in (query, target)]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*passed).schema]
        + [f"{c} int" for c in MATCH_FIELDS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _chunks(batch.column(len(passed)), batch.column(len(passed) + 1)):
                part = batch.slice(start, stop - start)
                qs, ts = _texts(part.column(len(passed))), _texts(part.column(len(passed) + 1))
                found = kernels.align_batch(qs, ts, band)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(passed))]
                    + [pa.array(found[c], pa.int32()) for c in MATCH_FIELDS],
                    names=passed + MATCH_FIELDS,
                )

    return pairs.select(*passed, query, target).mapInArrow(run, schema)


def align_pairs(pairs: DataFrame, band: int, query: str = "q", target: str = "t") -> DataFrame:
    """Full alignment with gapped texts; unaligned pairs have ``aligned`` false.

    ``q_end``/``t_end`` are where the alignment stops; it always starts at 0.
    """
    passed = [c for c in pairs.columns if c not in (query, target)]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*passed).schema]
        + ["aligned boolean, dist int, q_end int, t_end int, q_aln string, t_aln string"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _chunks(batch.column(len(passed)), batch.column(len(passed) + 1), TRACED_AT_ONCE):
                part = batch.slice(start, stop - start)
                qs, ts = _texts(part.column(len(passed))), _texts(part.column(len(passed) + 1))
                found = kernels.align_batch(qs, ts, band, trace=True)
                gapped = [(_gapped(q, ops, 2), _gapped(t, ops, 1)) for q, t, ops in zip(qs, ts, found["columns"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(passed))]
                    + [pa.array(found["matched"])]
                    + [pa.array(found[c], pa.int32()) for c in ("dist", "q_end", "t_end")]
                    + [pa.array([g[0] for g in gapped]), pa.array([g[1] for g in gapped])],
                    names=passed + ["aligned", "dist", "q_end", "t_end", "q_aln", "t_aln"],
                )

    return pairs.select(*passed, query, target).mapInArrow(run, schema)


def _gapped(text: bytes, ops: np.ndarray, gap_op: int) -> str:
    """Text spread over the alignment columns, '-' where it does not advance."""
    moves = ops != gap_op
    out = np.full(ops.size, ord("-"), dtype=np.uint8)
    out[moves] = np.frombuffer(text, dtype=np.uint8)[: int(moves.sum())]
    return out.tobytes().decode("ascii")


def tag_arrays(query: bytes, ops: np.ndarray, offset: int):
    """Position, insertion ordinal and base of each column and of the one before.

    Tagging stops at a column in front of position 0.
    """
    on_query, on_target = ops != 2, ops != 1
    t_pos = np.cumsum(on_target) - 1
    step = np.cumsum(on_query)
    anchor = np.maximum.accumulate(np.where(on_target, step, 0))
    delta = np.where(on_target, 0, step - anchor)
    base = np.full(ops.size, ord("-"), dtype=np.uint8)
    base[on_query] = np.frombuffer(query, dtype=np.uint8)[: int(on_query.sum())]
    bad = np.flatnonzero(t_pos + offset < 0)
    size = int(bad[0]) if bad.size else ops.size
    t_pos, delta, base = t_pos[:size] + offset, delta[:size], base[:size]
    return (
        t_pos,
        delta,
        base,
        np.r_[offset - 1, t_pos[:-1]][:size],
        np.r_[0, delta[:-1]][:size],
        np.r_[np.uint8(ord(".")), base[:-1]][:size],
    )


def relative_strand(strand0, strand1):
    return F.when(strand0 == 0, strand1).otherwise(1 - strand1)
