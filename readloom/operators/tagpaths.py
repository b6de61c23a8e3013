"""Best path through the tag graph of a consensus window, by a max-plus scan over blocks of columns.

A tag is a place (template position and insertion ordinal) with a base; an edge
leads to it from the tag before it in some reads.  The value of a tag is

    max(worth of its first edge, max over its edges of worth + value of the tag before)

which is linear in max-plus algebra.  The positions are cut into blocks; inside
a block every value is kept as a function of the values at the block's border,
all blocks side by side, column by column.  One pass over the borders then fixes
all values.
"""

from __future__ import annotations

import numpy as np

# Letters of alignment columns; '.' stands in front of a read's first column
LETTERS = "-.ACGNT"
GAP, BEFORE = 0, 1
_CODE = np.full(256, 5, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i

BLOCK = 96  # positions of a block at least
SLOTS = 6  # tags that a border may have
LOW = -1e18

PLACE_BITS, DELTA_BITS, BASE_BITS = 28, 20, 3


def codes(letters) -> np.ndarray:
    """Letter codes of an array of byte values."""
    return _CODE[letters]


def tag_keys(t_pos: np.ndarray, delta: np.ndarray, base: np.ndarray) -> np.ndarray:
    """One number per tag, in the order of position, ordinal and base."""
    return (t_pos.astype(np.int64) << (DELTA_BITS + BASE_BITS)) | (delta.astype(np.int64) << BASE_BITS) | base


def count_edges(tag: np.ndarray, before: np.ndarray, times: np.ndarray, covered: np.ndarray | None = None):
    """Equal edges merged: sorted tags, tags before, summed times (and ``covered``)."""
    order = np.lexsort((before, tag))
    tag, before = tag[order], before[order]
    head = np.flatnonzero(np.r_[True, (tag[1:] != tag[:-1]) | (before[1:] != before[:-1])]) if tag.size else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x[order], head) if head.size else x[:0] for x in ([times] if covered is None else [times, covered])]
    return (tag[head], before[head], *sums)


def _borders(pos: np.ndarray) -> np.ndarray:
    """First positions of the blocks behind the first one; the position before each has few tags."""
    places, size = np.unique(pos, return_counts=True)
    fit = places[size <= SLOTS] + 1
    out, at = [], int(pos[0]) + BLOCK
    while True:
        i = int(np.searchsorted(fit, at))
        # a block starts where the position before it is a border
        if i >= fit.size or fit[i] > places[-1]:
            return np.array(out, np.int64)
        out.append(int(fit[i]))
        at = out[-1] + BLOCK


def best_path(tag: np.ndarray, before: np.ndarray, times: np.ndarray, coverage: np.ndarray) -> np.ndarray:
    """Tags of the best path of a window, in order.

    Edges come merged and sorted (``count_edges``); ``coverage`` holds the reads
    on each position.  An edge is worth its count less half of what exceeds one
    read of coverage.  The path ends at the tag of the largest value among those
    that a tag before improves, and goes back along the first best edges.
    """
    if not tag.size:
        return tag
    pos = tag >> (DELTA_BITS + BASE_BITS)
    worth = times - 0.5 * (coverage[pos] - 1)
    head = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
    tags, owner = tag[head], np.repeat(np.arange(head.size), np.diff(np.r_[head, tag.size]))
    prev = np.minimum(np.searchsorted(tags, before), tags.size - 1)
    known = (tags[prev] == before) & ((before & 7) != BEFORE)
    floor = worth[head]
    value = _values(tags, owner, prev, known, worth, floor)
    offer = np.where(known, worth + value[prev], LOW)
    top = np.maximum.reduceat(offer, head)
    improved = top > floor
    # the first edge that reaches the value, or the first of all
    reach = np.flatnonzero(offer == value[owner])
    via = head.copy()
    first = reach[np.r_[True, owner[reach][1:] != owner[reach][:-1]]] if reach.size else reach
    via[owner[first]] = np.where(improved[owner[first]], first, head[owner[first]])
    good = np.flatnonzero(improved & (value > 0))
    if not good.size:
        return tags[:0]
    at = int(good[np.argmax(value[good])])
    step = np.where(tags[prev[via]] == before[via], prev[via], -1).tolist()
    path = []
    while at >= 0:
        path.append(at)
        at = step[at]
    return tags[np.array(path[::-1])]


def _values(tags, owner, prev, known, worth, floor) -> np.ndarray:
    """Values of all tags."""
    pos = tags >> (DELTA_BITS + BASE_BITS)
    borders = _borders(pos)
    block = np.searchsorted(borders, pos, side="right")
    n, blocks = tags.size, borders.size + 1
    # rows n.. stand for the tags of the position before each block
    table = np.full((n + blocks * SLOTS, SLOTS + 1), LOW)
    for s in range(SLOTS):
        table[n + s :: SLOTS, s + 1][:blocks] = 0.0
    edge = known & (block[prev] == block[owner])
    first_of = np.searchsorted(pos, borders - 1)  # first tag of each border position
    cross = known & ~edge
    source = np.where(edge, prev, n)
    slot = prev[cross] - first_of[block[owner[cross]] - 1]
    source[cross] = n + block[owner[cross]] * SLOTS + slot
    # columns of a block in order, the same column of all blocks at once
    column = tags >> BASE_BITS
    new = np.r_[True, column[1:] != column[:-1]]
    nth = np.cumsum(new)
    start = np.searchsorted(block, np.arange(blocks))
    nth -= nth[start][block]
    use = np.flatnonzero(known)
    order = use[np.argsort(nth[owner[use]], kind="stable")]
    rank = nth[owner[order]]
    cuts = np.searchsorted(rank, np.arange(int(nth.max()) + 2))
    by_rank = np.argsort(nth, kind="stable")
    tag_cuts = np.searchsorted(nth[by_rank], np.arange(int(nth.max()) + 2))
    for c in range(int(nth.max()) + 1):
        own = by_rank[tag_cuts[c] : tag_cuts[c + 1]]
        es = order[cuts[c] : cuts[c + 1]]
        if es.size:
            to = owner[es]
            runs = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            table[to[runs]] = np.maximum.reduceat(worth[es][:, None] + table[source[es]], runs, axis=0)
        table[own, 0] = np.maximum(table[own, 0], floor[own])
    border = np.full((blocks, SLOTS), LOW)
    for b in range(1, blocks):
        a = first_of[b - 1]
        z = start[b]
        border[b, : z - a] = np.maximum(table[a:z, 0], (table[a:z, 1:] + border[b - 1]).max(axis=1))
    return np.maximum(table[:n, 0], (table[:n, 1:] + border[block]).max(axis=1))
