"""Array kernels against plain restatements of their rules."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
import pytest

from readloom.operators import align, kernels
from tests.genome import random_seq, rc, with_errors

CODE = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}


def mix_int(key: int, bits: int) -> int:
    mask = (1 << bits) - 1
    key = (~key + (key << 21)) & mask
    key ^= key >> 24
    key = key * 265 & mask
    key ^= key >> 14
    key = key * 21 & mask
    key ^= key >> 28
    return (key + (key << 31)) & mask


def slots_of(seq: str, k: int, hpc: bool):
    """(position, value or None, depth, strand) of every slot, one base at a time."""
    items = []
    i = 0
    while i < len(seq):
        c = CODE.get(seq[i].upper())
        j = i
        while hpc and c is not None and j + 1 < len(seq) and CODE.get(seq[j + 1].upper()) == c:
            j += 1
        items.append((j, c, j - i + 1))
        i = j + 1
    seen, runs, depth = [], [], 0
    for pos, c, run in items:
        if c is None:
            depth, runs = 0, []
            yield pos, None, 0, 0
            continue
        seen.append(c)
        runs.append(run)
        last = seen[-k:]
        fwd = rev = 0
        for b in last:
            fwd = fwd << 2 | b
        for b in reversed(last):
            rev = rev << 2 | (3 - b)
        if len(seen) >= k and fwd == rev:
            continue
        depth += 1
        span = sum(runs[-k:])
        ok = depth >= k and span < 256
        yield pos, (mix_int(min(fwd, rev), 2 * k) << 8 | span) if ok else None, depth, int(fwd > rev)


def minimizers(seq: str, w: int, k: int, hpc: bool = False):
    """Replays the window slot by slot and reports as the rule says."""
    window: deque = deque(maxlen=w)
    slots = list(slots_of(seq, k, hpc))
    out = set()

    def low(win):
        known = [s for s in win if s[1] is not None]
        value = min((s[1] for s in known), default=None)
        return max((s for s in known if s[1] == value), default=None)

    for slot in slots:
        full = w + k - 1
        before, expired = low(window), None
        if len(window) == w and before is not None and before == window[0]:
            expired = before
        rest = list(window)[1:] if len(window) == w else list(window)
        window.append(slot)
        if before is not None and slot[2] == full:
            out |= {s for s in rest if s[1] == before[1] and s != before}
        if slot[1] is not None and before is not None and slot[1] <= before[1]:
            if slot[2] > full:
                out.add(before)
        elif expired is not None and slot[2] >= full:
            now = low(window)
            out.add(expired)
            if now is not None:
                out |= {s for s in window if s[1] == now[1] and s != now}
    if slots and low(window) is not None:
        out.add(low(window))
    return [(p, st, v >> 8, v & 255) for p, v, _, st in sorted(out, key=lambda s: s[0])]


def kernel_minimizers(seqs, w, k, hpc=False):
    raw = np.frombuffer("".join(seqs).encode(), dtype=np.uint8)
    bounds = np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)
    row, pos, strand, h, span = kernels.sketch_buffer(raw, bounds, w, k, hpc)
    return [[(int(pos[i]), int(strand[i]), int(h[i]), int(span[i])) for i in np.flatnonzero(row == r)] for r in range(len(seqs))]


def texts(rng):
    yield "A" * 90
    yield "AC" * 60
    yield "ACGT" * 40
    yield "ACGTTGCATT" * 12
    yield "ACG"
    yield "N" * 30
    yield random_seq(rng, 60).lower()
    yield random_seq(rng, 40).replace("T", "U")
    for _ in range(25):
        s = list(random_seq(rng, rng.randrange(1, 400)))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = "N"
        yield "".join(s)
    for _ in range(25):
        yield "".join(rng.choice("AC") for _ in range(rng.randrange(20, 200)))


@pytest.mark.parametrize("w,k", [(5, 4), (6, 5), (24, 12), (10, 3), (1, 4), (16, 16)])
@pytest.mark.parametrize("hpc", [False, True])
def test_sketch_follows_the_window_rule(w, k, hpc):
    seqs = list(texts(random.Random(w * 100 + k)))
    got = kernel_minimizers(seqs, w, k, hpc)
    for seq, rows in zip(seqs, got):
        assert rows == minimizers(seq, w, k, hpc), seq


def test_sketch_of_the_other_strand_mirrors():
    rng = random.Random(3)
    for _ in range(10):
        s = random_seq(rng, 800)
        fwd, rev = kernel_minimizers([s, rc(s)], 24, 11)
        flipped = sorted((len(s) - 1 - p + 10, 1 - st, h, span) for p, st, h, span in rev)
        # the first window may report further copies, which mirror to the last one
        assert set(fwd) ^ set(flipped) <= set(fwd[:2] + fwd[-2:] + flipped[:2] + flipped[-2:])


@pytest.mark.parametrize("size", [2, 3, 6])
def test_reduction_step(size):
    rng = random.Random(size)
    rows, hashes, want, base = [], [], [], 0
    for r in range(60):
        h = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        picks = []
        for i in range(size - 1, len(h)):
            best = min(range(i - size + 1, i + 1), key=lambda j: (h[j], j % size))
            if not picks or picks[-1] != best:
                picks.append(best)
        want += [base + p for p in picks]
        base += len(h)
        rows += [r] * len(h)
        hashes += h
    got = kernels.reduce_list(np.array(rows, dtype=np.int64), np.array(hashes, dtype=np.uint64), size)
    assert got.tolist() == want


def test_mix_is_one_to_one():
    codes = np.arange(4**6, dtype=np.uint64)
    mixed = kernels.mix(codes, 12)
    assert len(set(mixed.tolist())) == codes.size
    assert [mix_int(int(c), 12) for c in codes[:200]] == mixed[:200].tolist()


def greedy_match(q: bytes, t: bytes, band: int):
    """Furthest reaching points of one pair with dictionaries."""
    limit = int(0.3 * (len(q) + len(t)))
    reach, lo, hi, best, longest = {1: 0}, 0, 0, -1, 0
    res = dict(m_size=0, dist=0, q_bgn=0, q_end=0, t_bgn=0, t_end=0, q_m_end=0, t_m_end=0)
    begun = False
    for d in range(limit):
        if hi - lo > 2 * band:
            break
        now = {}
        for k in range(lo, hi + 1, 2):
            step_down = k == lo or (k != hi and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if step_down else reach[k - 1] + 1
            x0, y0 = x, x - k
            while x < len(q) and x - k < len(t) and q[x] == t[x - k]:
                x += 1
            if x - x0 > 16 and not begun:
                begun, res["q_bgn"], res["t_bgn"] = True, x0, y0
            if x - x0 > longest:
                longest, res["q_m_end"], res["t_m_end"] = x - x0, x, x - k
            now[k] = x
            if x >= len(q) or x - k >= len(t):
                res.update(q_end=x, t_end=x - k, dist=d)
                res["m_size"] = (x - res["q_bgn"] + x - k - res["t_bgn"] + 2 * d) // 2
                return res, True
        reach.update(now)
        best = max([best] + [2 * x - k for k, x in now.items()])
        near = [k for k, x in now.items() if 2 * x - k >= best - band]
        lo, hi = min(near) - 1, max(near) + 1
    res["q_bgn"] = res["t_bgn"] = 0
    return res, False


def pair_cases(rng):
    for _ in range(60):
        a = random_seq(rng, rng.randrange(1, 300))
        b = with_errors(rng, a, rng.choice([0, 0.02, 0.1, 0.3])) if rng.random() < 0.8 else random_seq(rng, rng.randrange(1, 200))
        b = b[rng.randrange(3) :] or "A"
        yield a.encode(), b.encode()
    yield b"A", b"A"
    yield b"A" * 60, b"A" * 55
    yield b"ACGT" * 20, b"TGCA" * 20


@pytest.mark.parametrize("band", [3, 10, 100])
def test_match_equals_one_pair_at_a_time(band):
    qs, ts = zip(*pair_cases(random.Random(band)))
    got = kernels.align_batch(list(qs), list(ts), band)
    for i, (q, t) in enumerate(zip(qs, ts)):
        want, matched = greedy_match(q, t, band)
        assert {c: int(got[c][i]) for c in want} == want, (q, t)
        assert bool(got["matched"][i]) == matched


def test_alignment_columns_spell_both_texts():
    qs, ts = zip(*pair_cases(random.Random(5)))
    got = kernels.align_batch(list(qs), list(ts), 50, trace=True)
    for i, (q, t) in enumerate(zip(qs, ts)):
        if not got["matched"][i]:
            continue
        ops = got["columns"][i]
        qa, ta = align._gapped(q, ops, 2), align._gapped(t, ops, 1)
        assert qa.replace("-", "").encode() == q[: got["q_end"][i]]
        assert ta.replace("-", "").encode() == t[: got["t_end"][i]]
        assert sum(a != b for a, b in zip(qa, ta)) == got["dist"][i]


def test_tags_walk_the_columns():
    ops = np.array([1, 0, 0, 1, 1, 2, 0], dtype=np.uint8)
    tags = align.tag_arrays(b"GACGTT", ops, 5)
    rows = list(zip(*[x.tolist() for x in tags]))
    letters = [(t, d, chr(b), pt, pd, chr(pb)) for t, d, b, pt, pd, pb in rows]
    assert letters == [
        (4, 1, "G", 4, 0, "."),
        (5, 0, "A", 4, 1, "G"),
        (6, 0, "C", 5, 0, "A"),
        (6, 1, "G", 6, 0, "C"),
        (6, 2, "T", 6, 1, "G"),
        (7, 0, "-", 6, 2, "T"),
        (8, 0, "T", 7, 0, "-"),
    ]
    # an insertion in front of position 0 ends the tags at once
    assert align.tag_arrays(b"GA", np.array([1, 0], dtype=np.uint8), 0)[0].size == 0
    # a long insertion is tagged to its end
    long = np.array([0] + [1] * 300 + [0], dtype=np.uint8)
    assert align.tag_arrays(b"A" * 302, long, 0)[0].size == 302


def test_identical_and_unrelated_pairs():
    rng = random.Random(1)
    s = random_seq(rng, 3000).encode()
    same = kernels.align_batch([s], [s], 100)
    assert same["dist"][0] == 0 and same["q_end"][0] == 3000
    other = kernels.align_batch([s], [random_seq(rng, 3000).encode()], 100)
    assert not other["matched"][0] and other["q_end"][0] == 0
