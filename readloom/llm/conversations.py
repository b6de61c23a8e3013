"""Repair of conversations: cheapest edits that give a regular order of roles, by dynamic programming over runs."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import cut_lineage, join_bounded, scratch_scope

# Costs of the edits, and white space of the texts
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"

# states: nothing yet, behind a system turn, behind a user turn, behind an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
OPEN = 1 << 40  # cost of what cannot be
NEXT = (USER, USER, ASSISTANT, USER)  # where a user or assistant turn leads
ROLE = {USER: "user", ASSISTANT: "assistant"}
# a symbol is four times the class of the role (system, user, assistant, other) plus the fault
CLEAN, CUT, BAD = range(3)
GONE = -1  # a row that only stands for its conversation

HELD_ROWS, HELD_CHARS = 4096, 8_000_000  # a conversation beyond either is solved in segments
SEGMENT_ROWS, SEGMENT_CHARS = 16_384, 32_000_000

Matrix = tuple[tuple[int, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(r[0] + v[0], r[1] + v[1], r[2] + v[2], r[3] + v[3]) for r in a)


UNIT: Matrix = tuple(tuple(0 if i == j else OPEN for j in range(4)) for i in range(4))
_ONE_INSERT: Matrix = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else OPEN for j in range(4)) for i in range(4))
INSERTS = times(_ONE_INSERT, _ONE_INSERT)
# cost to finish from each state: an order of roles is whole when empty or behind an assistant
END = applied(INSERTS, (0, OPEN, OPEN, 0))


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row in ASCII order: letter, cost, state behind it."""
    role, fault = symbol >> 2, symbol & 3
    out = [("D", DELETE, state)]
    if fault != BAD:
        extra = TRUNCATED if fault == CUT else 0
        legal = {0: state == START, 1: state != USER, 2: state == USER}.get(role, False)
        if legal:
            out.append(("K", extra, (SYSTEM, USER, ASSISTANT)[role]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


@functools.cache
def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """The edits that may come next, in ASCII order of their letters."""
    return sorted([*options(symbol, state), ("I", INSERT, NEXT[state])])


@functools.cache
def transition(symbol: int) -> Matrix:
    """Costs between states over the inserts before a row and the row."""
    row = [[OPEN] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in options(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return times(INSERTS, tuple(map(tuple, row)))


@functools.cache
def power(symbol: int, k: int) -> Matrix:
    """The transition of ``2 ** k`` rows of one symbol."""
    return transition(symbol) if k == 0 else times(power(symbol, k - 1), power(symbol, k - 1))


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """Symbols with the lengths of their runs."""
    if not symbols:
        return []
    raw = np.frombuffer(symbols, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]]))
    return list(zip(raw[first].tolist(), np.diff(np.concatenate([first, [len(raw)]])).tolist(), strict=True))


def segment_matrix(symbols: bytes) -> Matrix:
    """Costs between states over a whole segment."""
    out = UNIT
    for symbol, n in runs(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = times(out, power(symbol, k))
    return out


def run_ends(found: list[tuple[int, int]], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to finish from each state behind every run, by binary powers from the last run back."""
    out = [end]
    for symbol, n in reversed(found[1:]):
        for k in range(n.bit_length()):
            if n >> k & 1:
                end = applied(power(symbol, k), end)
        out.append(end)
    return out[::-1] if found else []


def unroll(symbols: bytes, end: tuple[int, ...], state: int) -> tuple[str, int]:
    """The cheapest edits of a segment, the ASCII-least of equal ones, and the state behind it.

    ``end`` holds the cost to finish from each state behind the segment.  Each
    letter says where it leads, so taking the least letter that still reaches
    the cheapest cost gives the least string.
    """
    found = runs(symbols)
    letters: list[str] = []
    for (symbol, n), behind in zip(found, run_ends(found, end), strict=True):
        step, costs = transition(symbol), [behind]
        for _ in range(n):
            costs.append(applied(step, costs[-1]))
        for left in range(n, 0, -1):
            here, after = costs[left], costs[left - 1]
            letter = "I"
            while letter == "I":
                for letter, cost, to in moves(symbol, state):
                    if cost + (here if letter == "I" else after)[to] == here[state]:
                        break
                letters.append(letter)
                state = to
    return "".join(letters), state


def closing(state: int) -> str:
    """Inserts that finish from a state."""
    out = 0
    while END[state]:
        out, state = out + 1, NEXT[state]
    return "I" * out


@functools.lru_cache(1 << 16)
def solved(symbols: bytes) -> str:
    """The audit of a whole conversation."""
    edits, state = unroll(symbols, END, START)
    return edits + closing(state)


class Conversation:
    """One conversation on its way through a task; rows come in order, in one or several segments."""

    def __init__(self, conv_id, whole: bool):
        self.conv_id, self.whole = conv_id, whole  # whole: the repaired turns are wanted, not only their digest
        self.sha, self.any, self.turns = hashlib.sha256(), False, []
        self.audit: list[str] = []
        self.state, self.cost, self.illegal, self.before = START, 0, 0, None
        self.faults = [0, 0, 0]  # blank, duplicate, truncated
        self.low = self.high = None
        self.distinct = 0

    def facts(self, turn, code: int, fault: int) -> None:
        """Takes note of a row: its turn, its role next to the one before, its first fault."""
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.high, self.distinct = turn, self.distinct + 1
        role = code >> 2
        if self.before is not None and (self.before, role) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.before = role
        if fault >= 0:
            self.faults[fault] += 1

    def edit(self, letters: str, rows: list[tuple], codes: bytes) -> None:
        """Applies edits to rows ``(turn, role, text)``."""
        at = 0
        self.audit.append(letters)
        for letter in letters:
            if letter == "I":
                turn, role, text = None, ROLE[NEXT[self.state]], ""
                self.state, self.cost = NEXT[self.state], self.cost + INSERT
            else:
                (turn, role, text), code = rows[at], codes[at]
                at += 1
                if letter == "D":
                    self.cost += DELETE
                    if self.whole:
                        self.turns.append((letter, turn, role, text))
                    continue
                self.cost += TRUNCATED if code & 3 == CUT else 0
                if letter == "R":
                    self.state, self.cost = NEXT[self.state], self.cost + REROLE
                    role = ROLE[self.state]
                else:
                    self.state = (SYSTEM, USER, ASSISTANT)[code >> 2]
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True
            if self.whole:
                self.turns.append((letter, turn, role, text))

    def digest(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, turn long, role string, text string"
ROWS = "seg long, pos long, turn long, role string, text string, code int, chars long"


def _arrow(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _schema(spec: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    parts = [p.split() for p in spec.split(", ")]
    return [p[0] for p in parts], [kinds[p[1]] for p in parts]


class _Out:
    """Collects result rows and open rows and hands them on in batches of bounded size."""

    def __init__(self, whole: bool, id_type: pa.DataType):
        self.whole = whole
        spec = _schema(TURNS if whole else DIGEST)
        own = _schema(ROWS)
        self.result = len(spec[0])
        self.names = ["conv_id", "done", *spec[0], *[f"open_{n}" for n in own[0]]]
        self.kinds = [id_type, pa.bool_(), *spec[1], *own[1]]
        self.rows: list[tuple] = []
        self.size = 0

    def finished(self, c: Conversation, base: int = 0) -> None:
        gap = (None,) * 7
        if self.whole:
            for k, t in enumerate(c.turns):
                self.rows.append((c.conv_id, True, base + k, *t, *gap))
                self.size += len(t[3])
            c.turns = []
        else:
            conv_id, *facts = c.digest()
            self.rows.append((conv_id, True, *facts, *gap))
            self.size += 200

    def opened(self, conv_id, row: tuple) -> None:
        self.rows.append((conv_id, False, *(None,) * self.result, *row))
        self.size += len(row[4] or "") + 60

    def take(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_ or self.size > 4_000_000):
            yield _arrow(self.names, self.kinds, self.rows)
            self.rows, self.size = [], 0


def _judged(rows: list[tuple]) -> tuple[bytes, list[int]]:
    """Symbols and first faults (0 blank, 1 duplicate, 2 truncated, -1 none) of ``(turn, role, text, code)``."""
    seen, symbols, faults = set(), bytearray(), []
    for _, role, text, code in rows:
        again = (role, text) in seen
        seen.add((role, text))
        fault = code & 3
        faults.append(0 if fault == BAD else 1 if again else 2 if fault == CUT else -1)
        symbols.append(code & ~3 | BAD if again else code)
    return bytes(symbols), faults


def _solve_whole(conv_id, rows: list[tuple], whole: bool) -> Conversation:
    c = Conversation(conv_id, whole)
    live = [r for r in rows if r[3] != GONE]
    symbols, faults = _judged(live)
    for (turn, _, _, code), fault in zip(live, faults, strict=True):
        c.facts(turn, code, fault)
    c.edit(solved(symbols), [r[:3] for r in live], symbols)
    return c


def _first_pass(whole: bool, held_rows: int, segment_rows: int):
    """Solves conversations that lie inside a task; the first and last of a task and long ones stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, rows, chars = None, [], 0
        state = {"id": None, "begun": False, "open": True, "seg": -1, "pos": 0, "chars": 0}

        def spill():
            """Hands the held rows on as rows of an open conversation."""
            for turn, role, text, code in rows:
                if state["seg"] < 0 or state["pos"] >= segment_rows or state["chars"] > SEGMENT_CHARS:
                    state["next"] = state.get("next", 0) + 1
                    state.update(seg=(part << 32) + state["next"], pos=0, chars=0)
                out.opened(state["id"], (state["seg"], state["pos"], turn, role, text, code, len(text or "")))
                state["pos"] += 1
                state["chars"] += len(text or "")
            rows.clear()

        for batch in batches:
            if out is None:
                out = _Out(whole, batch.column(0).type)
            for conv_id, turn, role, text, code in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not state["begun"] or conv_id != state["id"]:
                    if state["begun"]:
                        if state["open"]:
                            spill()
                        else:
                            out.finished(_solve_whole(state["id"], rows, whole))
                            rows.clear()
                        yield from out.take()
                    # what the task sees first may have begun in the task before
                    state.update(id=conv_id, open=not state["begun"], begun=True, seg=-1)
                    chars = 0
                rows.append((turn, role, text, code))
                chars += len(text or "")
                if state["open"] or len(rows) > held_rows or chars > HELD_CHARS:
                    state["open"] = True
                    spill()
                    yield from out.take()
        if out is not None:
            spill()
            yield from out.take(True)

    return run


def _matrices(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    codes = table.column("symbol").to_numpy()
    m = segment_matrix(codes[codes >= 0].astype(np.uint8).tobytes())
    return pa.table(
        {
            "ck": table.column("ck").slice(0, 1).combine_chunks(),
            "seg": table.column("seg").slice(0, 1).combine_chunks(),
            "m": pa.array([[x for r in m for x in r]], pa.list_(pa.int64())),
        }
    )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost to finish behind every segment of a conversation."""
    for batch in batches:
        segs, ends = [], []
        for parts in batch.column(0).to_pylist():
            end = END
            for p in reversed(parts):
                segs.append(p["seg"])
                ends.append(list(end))
                m = p["m"]
                end = applied(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), end)
        yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["end_seg", "end"])


def _second_pass(whole: bool):
    """Unrolls open conversations segment by segment; a task holds one segment at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, c, seg, end, rows, placed = None, None, None, None, [], 0

        def settle():
            """Edits the segment that has been read."""
            nonlocal placed
            live = [r for r in rows if r[3] != GONE]
            symbols = bytes(r[4] for r in live)
            for turn, _, _, code, symbol in live:
                blank = code & 3 == BAD
                again = not blank and symbol & 3 == BAD
                c.facts(turn, code, 0 if blank else 1 if again else 2 if code & 3 == CUT else -1)
            letters, _ = unroll(symbols, tuple(end), c.state)
            c.edit(letters, [r[:3] for r in live], symbols)
            rows.clear()
            if whole:
                n = len(c.turns)
                out.finished(c, placed)
                placed += n

        def finish():
            nonlocal placed
            if c is None:
                return
            settle()
            c.edit(closing(c.state), [], b"")
            out.finished(c, placed)
            placed = 0

        for batch in batches:
            if out is None:
                out = _Out(whole, batch.column(0).type)
            for conv_id, at, _, turn, role, text, code, symbol, vector in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if c is None or conv_id != c.conv_id:
                    finish()
                    c, seg, end = Conversation(conv_id, whole), at, vector
                elif at != seg:
                    settle()
                    seg, end = at, vector
                yield from out.take()
                rows.append((turn, role, text, code, symbol))
        if out is not None:
            finish()
            yield from out.take(True)

    return run


def _repeats(opened: DataFrame) -> DataFrame:
    """``seg, pos`` of open rows whose role and text stand in an earlier row of their conversation."""
    keyed = opened.where(F.col("code") != GONE).select("ck", "role", F.md5("text").alias("digest"), "seg", "pos")
    first = cut_lineage(
        keyed.groupBy("ck", "role", "digest").agg(F.min(F.struct("seg", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    return join_bounded(keyed, first, ["ck", "role", "digest"]).where(F.struct("seg", "pos") > F.col("first")).select("seg", "pos")


def _coded(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    body = F.rtrim(text, F.lit(BLANKS))
    fault = F.when(body == "", BAD).when(F.right(body, F.lit(1)).isin(".", "!", "?"), CLEAN).otherwise(CUT)
    first = F.substring(role, 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(gone, F.lit(None)).otherwise(role).alias("role"),
        F.when(gone, F.lit(None)).otherwise(text).alias("text"),
        F.when(gone, GONE).otherwise(kind * 4 + fault).cast("int").alias("code"),
    )


def _repair(turns: DataFrame, whole: bool, held_rows: int, segment_rows: int) -> DataFrame:
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    result = TURNS if whole else DIGEST
    open_spec = ", ".join(f"open_{p}" for p in ROWS.split(", "))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role")]
    sorted_ = (
        _coded(turns)
        .repartitionByRange(*order, F.substring("text", 1, 64))
        .sortWithinPartitions(*order, F.asc_nulls_first("text"))
    )
    names = ["conv_id", *[p.split()[0] for p in result.split(", ")]]
    with scratch_scope(spark) as scratch:
        first = cut_lineage(
            sorted_.mapInArrow(_first_pass(whole, held_rows, segment_rows), f"conv_id {kind}, done boolean, {result}, {open_spec}")
        )
        scratch.keep(first)
        key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("ck")
        opened = first.where("not done").select("conv_id", key, *[F.col(f"open_{p.split()[0]}").alias(p.split()[0]) for p in ROWS.split(", ")])
        again = _repeats(opened).withColumn("again", F.lit(True))
        bad = F.col("code").bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(BAD))
        narrow = cut_lineage(
            opened.select("ck", "seg", "pos", "code")
            .join(again, ["seg", "pos"], "left")
            .select("ck", "seg", "pos", F.when(F.col("again") & (F.col("code") != GONE), bad).otherwise(F.col("code")).alias("symbol"))
        )
        matrices = narrow.groupBy("seg").applyInArrow(_matrices, "ck string, seg long, m array<long>")
        parts = matrices.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("seg", "m"))).alias("parts")).select("parts")
        ends = cut_lineage(parts.mapInArrow(_ends, "end_seg long, end array<long>"))
        ready = (
            opened.join(narrow.select("seg", "pos", "symbol"), ["seg", "pos"])
            .join(ends, (F.col("seg") == F.col("end_seg")) & (F.col("pos") == 0), "left")
            .repartition("ck")
            .sortWithinPartitions("ck", "seg", "pos")
            .select("conv_id", "seg", "pos", "turn", "role", "text", "code", "symbol", "end")
        )
        rest = cut_lineage(ready.mapInArrow(_second_pass(whole), f"conv_id {kind}, done boolean, {result}, {open_spec}"))
        scratch.keep(rest)
    return first.where("done").select(*names).unionByName(rest.select(*names))


def conversation_audits(turns: DataFrame, held_rows: int = HELD_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``turns(conv_id, turn, role, text)``.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.  Rows are ordered by turn, null first, then role and
    text.  A null role or text is one space; rows with a null id are a
    conversation of their own.  Where a column ``gone`` is true, a row only
    says that its conversation exists; one without other rows has zeros, an
    empty audit and the hash of an empty string.  Other columns are ignored,
    an empty table gives no rows.

    Rows are range-sorted, so a long conversation lies in many tasks.  What
    lies inside one task and is not long is solved there.  The others are
    solved in segments of bounded size: a segment's min-plus matrix comes from
    its runs, the costs behind each segment from the matrices, and edits are
    unrolled segment by segment.  Only the hash of a conversation's text and
    its audit, which are sequential, pass through one task, as a stream.
    """
    return _repair(turns, False, held_rows, segment_rows)


def repaired_turns(turns: DataFrame, held_rows: int = HELD_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The edited rows of every conversation: ``conv_id, place, edit, turn, role, text``.

    ``edit`` is K (kept), R (other role), D (deleted, not part of the repaired
    conversation) or I (inserted, without turn and text); ``place`` orders them.
    The rules are those of ``conversation_audits``.
    """
    return _repair(turns, True, held_rows, segment_rows)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults planted by the hash of their id and turn; dropped rows stay as ``gone``.

    Of every twenty, 0 drops the row, 1 empties its text, 2 takes its stops,
    3 repeats it, 4 makes its role user.
    """
    filled: Column = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(filled.cast("binary")) % 20).alias("fault"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"),
    )
