"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random

import pytest

from readloom.llm import conversations as cv

NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def plain_repair(rows):
    """Facts and cheapest edits of one conversation, by best-first search over (cost, audit)."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    )
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(cv.BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]
    done = set()
    while True:
        cost, audit, i, form, lines = heapq.heappop(heap)
        if (i, form) in done:
            continue
        done.add((i, form))
        if i == len(rows) and form in ("", "a"):
            break
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[form]
        chat = "a" if form == "u" else "u"
        name = {"a": "assistant", "u": "user"}[chat]
        heapq.heappush(heap, (cost + 5, audit + "I", i, chat, (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, form, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role[:1] and role[:1] in legal:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, chat, (*lines, f"{name}:{text}")))
    known = [t for t, _, _ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def talk(rng, n):
    out = []
    for k in range(n):
        role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "u", "User"])
        text = rng.choice(["Yes.", "no", "", " \t\n", None, "Why? ", "tail ", "É!", f"text {k}.", f"text {k}"])
        out.append((rng.choice([None, k, k, k, 3 * k]), role, text))
    return out


def rows_of(talks):
    rows = [(i, *t, False, "x", 1) for i, ts in talks.items() for t in ts]
    # repeated rows, a conversation of which nothing is left, one partly gone
    return rows + [(900, 1, "user", "lost.", True, "x", 1), (0, 99, "user", "lost.", True, "x", 1)]


SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, seg string, end int"


@pytest.mark.parametrize("held, segment", [(4096, 16384), (5, 3)])
def test_audits_are_the_cheapest(spark, held, segment):
    rng = random.Random(held)
    talks = {i: talk(rng, rng.choice([0, 1, 2, 3, 5, 8, 12])) for i in [None, *range(80)]}
    talks[200] = [(k, "user" if k % 3 else "assistant", f"line {k // 7}.") for k in range(700)]
    talks[201] = [(1, "user", "again.")] * 60
    talks[202] = [(None, "assistant", "x" * 50_000 + "."), (None, "system", "first.")]
    rows = rows_of(talks)
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in cv.conversation_audits(turns, held, segment).collect()}
    want = {i: plain_repair(ts) for i, ts in talks.items() if ts} | {900: plain_repair([]), 0: plain_repair(talks[0])}
    assert got == want

    # the turns themselves hash to the audit's digest
    edits = {}
    for r in sorted(cv.repaired_turns(turns, held, segment).collect(), key=lambda r: r.place):
        edits.setdefault(r.conv_id, []).append(r)
    for i, ts in edits.items():
        assert "".join(t.edit for t in ts) == want[i][6] and [t.place for t in ts] == list(range(len(ts)))
        body = "\n".join(f"{t.role}:{t.text}" for t in ts if t.edit != "D")
        assert hashlib.sha256(body.encode()).hexdigest() == want[i][7]
    assert cv.conversation_audits(turns.limit(0)).count() == 0


def test_runs_by_powers_equal_single_steps():
    rng = random.Random(7)
    for _ in range(300):
        symbols = bytes(s for _ in range(rng.randrange(6)) for s in [rng.randrange(4) * 4 + rng.randrange(3)] * rng.choice([1, 2, 3, 40]))
        slow, m = cv.END, cv.UNIT
        for s in reversed(symbols):
            slow = cv.applied(cv.transition(s), slow)
        for s in symbols:
            m = cv.times(m, cv.transition(s))
        assert cv.applied(cv.segment_matrix(symbols), cv.END) == slow == cv.applied(m, cv.END)
        audit = cv.solved(symbols)
        assert sum(c != "I" for c in audit) == len(symbols)
    # a run of a million rows takes twenty products
    assert cv.applied(cv.segment_matrix(bytes([4]) * 1_000_000), cv.END)[0] == 500_000


def test_damage_follows_the_hash(spark):
    import zlib

    rows = [(i, t, ["user", None][t % 2], ["Yes! No. ", None][i % 2]) for i in range(12) for t in range(10)] + [(None, None, "assistant", "a.b")]
    out = {}
    for r in cv.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        out.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for i, t, role, text in rows:
        key = f"{' ' if i is None else i}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        got = out[i, t]
        assert got == [("user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
