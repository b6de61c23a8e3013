"""Array kernels that run on whole Arrow batches inside Spark tasks.

Everything here works on flat numpy buffers holding many sequences at once,
so a task spends its time in vector code and not in a loop over rows or bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)

_CODES = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODES[ord(_b)] = _i
    _CODES[ord(_b.lower())] = _i
_CODES[ord("U")] = _CODES[ord("u")] = 3


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row boundaries of an Arrow string column, without copying rows."""
    import pyarrow as pa

    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int32 if column.type == pa.string() else np.int64
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, bases: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows that hold at most so many bases, or one longer row."""
    start, rows = 0, bounds.size - 1
    while start < rows:
        stop = int(np.searchsorted(bounds, bounds[start] + bases, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def mix(key: np.ndarray, bits: int) -> np.ndarray:
    """The integer mix of :func:`readloom.functions.sequence.mix_hash` on uint64."""
    mask = np.uint64((1 << bits) - 1)

    def u(n: int) -> np.uint64:
        return np.uint64(n)

    key = ((key ^ NOTHING) + (key << u(21))) & mask
    key = key ^ (key >> u(24))
    key = (key * u(265)) & mask
    key = key ^ (key >> u(14))
    key = (key * u(21)) & mask
    key = key ^ (key >> u(28))
    return (key + (key << u(31))) & mask


def _back(a: np.ndarray, by: int) -> np.ndarray:
    """``a`` moved ``by`` places to the right, zero filled."""
    out = np.zeros_like(a)
    if by < a.size:
        out[by:] = a[: a.size - by]
    return out


def kmer_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse-complement codes of the k bases ending at each place.

    Blocks double in length, so the work is log2(k) passes over the buffer.
    """
    fwd1 = codes.astype(np.uint64)
    rev1 = np.uint64(3) - fwd1
    total, fwd, rev = 0, None, None
    size, bf, br = 1, fwd1, rev1
    want = k
    while want:
        if want & 1:
            if fwd is None:
                total, fwd, rev = size, bf, br
            else:
                # newest `total` bases stay, an older block of `size` goes before them
                old_f, old_r = _back(bf, total), _back(br, total)
                fwd = (old_f << np.uint64(2 * total)) | fwd
                rev = (rev << np.uint64(2 * size)) | old_r
                total += size
        want >>= 1
        if want:
            bf, br = (_back(bf, size) << np.uint64(2 * size)) | bf, (br << np.uint64(2 * size)) | _back(br, size)
            size *= 2
    return fwd, rev


def trailing_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the last ``width`` entries at each place."""
    block, size = values.copy(), 1
    while size < width:
        by = min(size, width - size)
        block[by:] = np.minimum(block[by:], block[:-by])
        size += by
    return block


def trailing_argmin(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of the last ``width`` entries at each place and its rightmost index.

    The index means nothing where the minimum is ``NOTHING``.  Value and place
    travel as one number where both fit, as two arrays where they do not.
    """
    places, bits = values.size, np.uint64(max(values.size - 1, 1).bit_length())
    known = values != NOTHING
    if not known.any() or int(values[known].max()) >> (64 - int(bits)) == 0:
        # a later place is a smaller number, so that the rightmost of equal values wins
        late = np.arange(places - 1, -1, -1, dtype=np.uint64)
        low = trailing_min(np.where(known, (values << bits) | late, NOTHING), width)
        at = places - 1 - (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        return np.where(low == NOTHING, NOTHING, low >> bits), at
    where = np.arange(places, dtype=np.int64)

    def merge(older, newer):
        take = newer[0] <= older[0]
        return np.where(take, newer[0], older[0]), np.where(take, newer[1], older[1])

    def earlier(block, by):
        v, p = block
        ov = np.full_like(v, NOTHING)
        op = np.full_like(p, -1)
        if by < v.size:
            ov[by:] = v[: v.size - by]
            op[by:] = p[: p.size - by]
        return ov, op

    block, size = (values, where), 1
    while size * 2 <= width:
        block = merge(earlier(block, size), block)
        size *= 2
    if size < width:
        block = merge(earlier(block, width - size), block)
    return block


def _since_reset(flag: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Running count of ``flag`` that restarts wherever ``reset`` is set."""
    run = np.cumsum(flag, dtype=np.int32)
    base = np.where(reset, run - flag, np.int32(0))
    return run - np.maximum.accumulate(base)


def sketch_buffer(raw, bounds, w: int, k: int, hpc: bool = False):
    """Symmetric (w,k)-minimizers of every sequence in the buffer.

    Returns ``row, pos, strand, hash, span`` arrays ordered by (row, pos) where
    ``pos`` is the 0-based last base of the k-mer.

    A slot is a base (a homopolymer run in ``hpc`` mode) whose k-mer is not its
    own reverse complement.  ``depth`` counts usable bases since the last
    ambiguous one.  A slot's window is the ``w`` slots ending there; what gets
    reported follows from how the rightmost window minimum moves:

    * a new minimum or the expiry of the old one reports the old one,
    * an expiry also reports further copies of the new minimum,
    * the first complete window reports further copies of the minimum so far,
    * the last minimum of a sequence is always reported.
    """
    none = np.zeros(0, dtype=np.int64)
    lens = np.diff(bounds)
    rows = lens.size
    if raw.size == 0 or rows == 0:
        return none, none, none, none.astype(np.uint64), none

    codes = _CODES[raw]
    usable = codes < 4
    starts, source = bounds[:-1], None
    if hpc:
        first = np.zeros(raw.size + 1, dtype=bool)
        first[starts] = True
        last = np.ones(raw.size, dtype=bool)
        last[:-1] = (codes[1:] != codes[:-1]) | first[1:-1] | ~usable[:-1]
        source = np.flatnonzero(last)
        runlen = np.diff(np.concatenate(([-1], source)))
        codes, usable = codes[source], usable[source]
        starts = np.searchsorted(source, starts)
    size = codes.size
    counts = np.diff(np.append(starts, size))
    first = np.zeros(size + 1, dtype=bool)
    first[starts] = True
    first = first[:-1]

    # k-mers run over the usable bases only; ambiguous ones merely reset the depth
    good = np.flatnonzero(usable)
    fwd, rev = kmer_codes(codes[good], k)
    keep = np.ones(size, dtype=bool)
    same = np.flatnonzero(fwd == rev)
    if same.size:
        own = starts[np.searchsorted(starts, good[same], side="right") - 1]
        # a palindrome counts from the k-th usable base of its sequence on
        keep[good[same[same - np.searchsorted(good, own) + 1 >= k]]] = False

    key = np.full(size, NOTHING, dtype=np.uint64)
    strand = np.zeros(size, dtype=bool)
    key[good] = mix(np.minimum(fwd, rev), 2 * k) << np.uint64(8)
    strand[good] = fwd > rev
    depth_all = _since_reset(usable & keep, first | ~usable)
    ready = usable & (depth_all >= k)
    if hpc:
        span = np.full(size, k, dtype=np.int64)
        total = np.cumsum(runlen[good])
        span_good = total.copy()
        span_good[k:] = total[k:] - total[:-k]
        span[good] = span_good
        ready &= span < 256
        key |= np.minimum(span, 255).astype(np.uint64)
    else:
        key |= np.uint64(min(k, 255))
        ready &= k < 256
    key[~ready] = NOTHING

    # lay the slots out with w empty places in front of every sequence
    kept = np.flatnonzero(keep)
    held = np.add.reduceat(keep, starts[counts > 0], dtype=np.int64) if kept.size else none
    per_row = np.zeros(rows, dtype=np.int64)
    per_row[counts > 0] = held if kept.size else 0
    place = np.arange(kept.size) + np.repeat(np.arange(1, rows + 1) * w, per_row)
    x = np.full(kept.size + (rows + 1) * w, NOTHING, dtype=np.uint64)
    depth = np.zeros(x.size, dtype=depth_all.dtype)
    x[place], depth[place] = key[kept], depth_all[kept]

    low, at = trailing_argmin(x, w)
    # what is reported depends on how the rightmost minimum moves, so other slots need no look
    moved = np.flatnonzero((at[1:] != at[:-1]) | (low[1:] != low[:-1])) + 1
    low0, at0 = low[moved - 1], at[moved - 1]
    known0 = low0 != NOTHING
    newer = x[moved] <= low0
    expired = ~newer & (at0 == moved - w) & (depth[moved] >= w + k - 1)

    out = [at0[newer & known0 & (depth[moved] >= w + k)], at0[expired & known0]]

    def copies(centres, value, skip, reach):
        """Slots within ``reach`` before each centre that hold ``value``."""
        if centres.size:
            grid = centres[:, None] - np.asarray(reach)[None, :]
            hit = (x[grid] == value[:, None]) & (grid != skip[:, None])
            out.append(grid[hit])

    whole = np.flatnonzero(depth == w + k - 1)
    whole = whole[low[whole - 1] != NOTHING]
    copies(whole, low[whole - 1], at[whole - 1], range(1, w))
    again = moved[expired & (low[moved] != NOTHING)]
    copies(again, low[again], at[again], range(w))

    ends = np.cumsum(per_row) + np.arange(1, rows + 1) * w - 1
    tail = ends[per_row > 0]
    out.append(at[tail][low[tail] != NOTHING])

    found = np.sort(np.concatenate(out))
    if found.size:
        found = found[np.r_[True, found[1:] != found[:-1]]]
    row = np.searchsorted(ends, found)
    slot = kept[found - (row + 1) * w]
    base = slot if source is None else source[slot]
    return row, base - bounds[row], strand[slot].astype(np.int64), x[found] >> np.uint64(8), (x[found] & np.uint64(255)).astype(np.int64)


def reduce_list(row: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Indices kept by one reduction step over lists stored back to back.

    Each full window of ``size`` entries yields its smallest hash; equal hashes
    go to the lowest ``ordinal % size``; repeats of the previous pick are dropped.
    """
    n = row.size
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ordinal = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    full = np.flatnonzero(ordinal >= size - 1)
    best = full.copy()
    for back in range(1, size):
        other = full - back
        less = (hashes[other] < hashes[best]) | (
            (hashes[other] == hashes[best]) & (ordinal[other] % size < ordinal[best] % size)
        )
        best = np.where(less, other, best)
    fresh = np.ones(best.size, dtype=bool)
    fresh[1:] = best[1:] != best[:-1]
    return best[fresh]


# ---------------------------------------------------------------------------
# banded greedy alignment of many pairs at once


class PairBatch:
    """Query and target texts of a batch, packed for eight-base comparisons."""

    def __init__(self, queries: list[bytes], targets: list[bytes]):
        self.qlen = np.array([len(s) for s in queries], dtype=np.int64)
        self.tlen = np.array([len(s) for s in targets], dtype=np.int64)
        self.q, self.qoff = self._pack(queries, self.qlen)
        self.t, self.toff = self._pack(targets, self.tlen)

    @staticmethod
    def _pack(texts, lens):
        flat = np.frombuffer(b"".join(texts) + b"\0" * 16, dtype=np.uint8).astype(np.uint64)
        for width in (1, 2, 4):
            nxt = np.zeros_like(flat)
            nxt[:-width] = flat[width:]
            flat = flat | (nxt << np.uint64(8 * width))
        return flat, np.r_[0, np.cumsum(lens)[:-1]] if lens.size else np.zeros(0, np.int64)

    def run(self, pair, x, y):
        """Length of the exact match starting at (x, y) of each listed pair."""
        room = np.minimum(self.qlen[pair] - x, self.tlen[pair] - y)
        done = np.zeros(x.size, dtype=np.int64)
        live = np.flatnonzero(room > 0)
        qi, ti = self.qoff[pair] + x, self.toff[pair] + y
        while live.size:
            diff = self.q[qi[live] + done[live]] ^ self.t[ti[live] + done[live]]
            low = diff & (~diff + np.uint64(1))
            # index of the first differing byte; eight when all agree
            step = np.where(diff == 0, 8, np.frexp(low.astype(np.float64))[1] - 1 >> 3)
            done[live] += step
            live = live[(diff == 0) & (done[live] < room[live])]
        return np.minimum(done, np.maximum(room, 0))


def align_batch(queries: list[bytes], targets: list[bytes], band: int, trace: bool = False, rooms: np.ndarray | None = None):
    """Furthest-reaching banded alignment of all pairs, one edit level at a time.

    All pairs advance together: level ``d`` updates a (pairs x diagonals) grid.
    A pair ends when a diagonal reaches the end of either text and fails when
    its live band gets wider than twice ``band`` or ``d`` exceeds 30 % of the
    summed lengths (``rooms`` tells target lengths where only their beginnings
    are given).  Returns a dict of arrays; with ``trace`` also one
    column-operation array per pair (0 match, 1 query only, 2 target only).
    """
    batch = PairBatch(queries, targets)
    n = len(queries)
    out = {
        name: np.zeros(n, dtype=np.int64)
        for name in ("m_size", "dist", "q_bgn", "q_end", "t_bgn", "t_end", "q_m_end", "t_m_end")
    }
    out["matched"] = np.zeros(n, dtype=bool)
    steps: list[tuple] = []
    final_k = np.zeros(n, dtype=np.int64)

    limit = (0.3 * (batch.qlen + (batch.tlen if rooms is None else rooms))).astype(np.int64)
    ring = 1 << (2 * band + 8).bit_length()
    reach = np.zeros((n, ring), dtype=np.int64)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = np.full(n, -1, dtype=np.int64)
    longest = np.zeros(n, dtype=np.int64)
    started = np.zeros(n, dtype=bool)
    live = np.arange(n)
    d = 0
    while True:
        live = live[(d < limit[live]) & (hi[live] - lo[live] <= 2 * band)]
        if live.size == 0:
            break
        cols = int((hi[live] - lo[live]).max()) // 2 + 1
        col = np.arange(cols)
        diag = lo[live][:, None] + 2 * col[None, :]
        inside = diag <= hi[live][:, None]
        own = live[:, None]
        left = reach[own, (diag - 1) % ring]
        right = reach[own, (diag + 1) % ring]
        down = (diag == lo[live][:, None]) | ((diag != hi[live][:, None]) & (left < right))
        x = np.where(down, right, left + 1)
        y = x - diag

        run = np.zeros_like(x)
        flat = np.nonzero(inside)
        run[flat] = batch.run(live[flat[0]], x[flat], y[flat])
        x2, y2 = x + run, y + run

        ended = inside & ((x2 >= batch.qlen[live][:, None]) | (y2 >= batch.tlen[live][:, None]))
        over = ended.any(axis=1)
        last = np.where(over, ended.argmax(axis=1), cols)
        seen = inside & (col[None, :] <= last[:, None])

        opening = seen & (run > 16)
        fresh = np.flatnonzero(opening.any(axis=1) & ~started[live])
        if fresh.size:
            c = opening[fresh].argmax(axis=1)
            out["q_bgn"][live[fresh]] = x[fresh, c]
            out["t_bgn"][live[fresh]] = y[fresh, c]
            started[live[fresh]] = True
        masked = np.where(seen, run, -1)
        top = masked.max(axis=1)
        better = np.flatnonzero(top > longest[live])
        if better.size:
            c = masked[better].argmax(axis=1)
            who = live[better]
            longest[who] = top[better]
            out["q_m_end"][who] = x2[better, c]
            out["t_m_end"][who] = y2[better, c]

        reach[np.broadcast_to(own, diag.shape)[inside], (diag % ring)[inside]] = x2[inside]
        if trace:
            steps.append((live, lo[live].copy(), x.astype(np.int32), run.astype(np.int32), down))

        who = live[over]
        if who.size:
            r = np.flatnonzero(over)
            c = last[r]
            out["q_end"][who] = x2[r, c]
            out["t_end"][who] = y2[r, c]
            out["dist"][who] = d
            out["matched"][who] = True
            final_k[who] = diag[r, c]

        sums = np.where(seen, x2 + y2, -1)
        best[live] = np.maximum(best[live], sums.max(axis=1))
        near = seen & (sums >= (best[live] - band)[:, None])
        lo[live], hi[live] = (
            lo[live] + 2 * near.argmax(axis=1) - 1,
            lo[live] + 2 * (cols - 1 - near[:, ::-1].argmax(axis=1)) + 1,
        )
        live = live[~over]
        d += 1

    ok = out["matched"]
    out["m_size"] = np.where(
        ok, (out["q_end"] - out["q_bgn"] + out["t_end"] - out["t_bgn"] + 2 * out["dist"]) // 2, 0
    )
    out["q_bgn"] = np.where(ok, out["q_bgn"], 0)
    out["t_bgn"] = np.where(ok, out["t_bgn"], 0)
    if trace:
        out["columns"] = _columns(steps, out, final_k, n)
    return out


def _columns(steps, out, final_k, n):
    """Alignment columns of each finished pair, walking its edit levels back."""
    where = []
    for live, *_ in steps:
        index = np.full(n, -1, dtype=np.int64)
        index[live] = np.arange(live.size)
        where.append(index)
    columns = []
    for p in range(n):
        if not out["matched"][p]:
            columns.append(np.zeros(0, dtype=np.uint8))
            continue
        k = int(final_k[p])
        ops, runs = [], []
        for d in range(int(out["dist"][p]), -1, -1):
            _, lo, x, run, down = steps[d]
            r = where[d][p]
            c = (k - lo[r]) // 2
            runs.append(int(run[r, c]))
            # level 0 has no edit in front of its run
            ops.append(2 if down[r, c] else 1)
            k += 1 if down[r, c] else -1
        ops, runs = ops[::-1], runs[::-1]
        kinds = np.zeros(2 * len(runs) - 1, dtype=np.uint8)
        sizes = np.ones(2 * len(runs) - 1, dtype=np.int64)
        kinds[1::2], sizes[0::2] = ops[1:], runs
        columns.append(np.repeat(kinds, sizes))
    return columns
