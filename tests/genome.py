"""A seeded toy genome with reads whose placements are known."""

from __future__ import annotations

import random

BASES = "ACGT"
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(seq: str) -> str:
    return seq.translate(COMPLEMENT)[::-1]


def random_seq(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(BASES) for _ in range(n))


def with_errors(rng: random.Random, seq: str, rate: float) -> str:
    """Nine equally likely errors a base: three substitutions, five inserts, one loss."""
    out = []
    for base in seq:
        if rng.random() >= rate:
            out.append(base)
            continue
        kind = rng.randrange(9)
        if kind < 3:
            out.append(rng.choice(BASES.replace(base, "")))
        elif kind < 8:
            out.append(base + rng.choice(BASES))
    return "".join(out)


def sample_reads(genome: str, coverage: float, mean: int, sd: int, rate: float = 0.01, seed: int = 42):
    """``(rid, seq, start, end)`` of reads from both strands."""
    rng = random.Random(seed)
    reads = []
    for rid in range(int(coverage * len(genome) / mean)):
        size = max(int(rng.gauss(mean, sd)), 500)
        start = rng.randrange(max(len(genome) - size, 1))
        seq = with_errors(rng, genome[start : start + size], rate)
        reads.append((rid, rc(seq) if rng.random() < 0.5 else seq, start, start + size))
    return reads
