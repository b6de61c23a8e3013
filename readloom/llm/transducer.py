"""Token counts by a byte-level BPE tokenizer compiled to finite-state machines.

Two deterministic machines do what the tokenizer does.

* The *splitter* reads classes of code points and marks where pieces begin.  It
  has ``STATES`` states, so a chunk of text is a map from states to states; the
  maps of all chunks are composed by a parallel prefix scan, which gives each
  chunk its true start state.
* The *counter* reads the bytes of a piece.  Its transitions carry the change
  that the byte makes to the number of tokens of the piece so far (merges can
  make it negative).  A state is what later tokens can depend on: the bytes
  since the earliest place where a vocabulary entry may still begin, and at each
  such place the last token and the count of the text before it.  States are made when
  a text first needs them; a worker that made too many starts anew.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm import kernel

CHUNK = 256  # code points of a splitter chunk
LANE = 384  # bytes of a counter lane, to the next piece
MOST_MOVES = 1 << 20  # transitions kept by a worker

# The suffixes that the tokenizer's pattern splits off after an apostrophe
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

STATES = ("start", "letter", "number", "other", "blank", "space", "quote", "done", "quote_r", "quote_v", "quote_l")
CLASSES = ("letter", "number", "blank", "space", "other", "quote", "single", "r", "v", "e", "l")
LETTERS = ("letter", "single", "r", "v", "e", "l")
HERE, BEFORE = 1, 2  # a piece begins at this code point, at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for every state and class; a second set of classes is for a text's first code point."""
    state, cls = {s: i for i, s in enumerate(STATES)}, {c: i for i, c in enumerate(CLASSES)}
    opened = {c: "letter" for c in LETTERS} | {"number": "number", "blank": "blank", "space": "space", "other": "other", "quote": "quote"}
    pairs = {f"quote_{s[0]}": s[1] for s in SUFFIXES if len(s) == 2}
    move, mark = np.zeros((len(STATES), 2 * len(CLASSES) + 1), np.int64), np.zeros((len(STATES), 2 * len(CLASSES) + 1), np.int64)
    for s in STATES:
        for c in CLASSES:
            to, m = opened[c], HERE
            if s in ("letter", "number") and opened[c] == s or s == "other" and c in ("other", "quote"):
                to, m = s, 0
            elif s in ("blank", "space") and c in ("blank", "space"):
                m = 0
            elif s == "blank":
                # the last blank of a run leads the piece behind it
                to, m = ("other" if c == "quote" else to), BEFORE
            elif s == "space":
                m = HERE | BEFORE
            elif s == "quote":
                if c == "single":
                    to, m = "done", 0
                elif f"quote_{c}" in pairs:
                    to, m = f"quote_{c}", 0
                elif c in ("other", "quote"):
                    to, m = "other", 0
            elif s in pairs:
                if c == pairs[s]:
                    to, m = "done", 0
                else:
                    m = BEFORE if opened[c] == "letter" else HERE | BEFORE
            move[state[s], cls[c]], mark[state[s], cls[c]] = state[to], m
            move[:, len(CLASSES) + cls[c]], mark[:, len(CLASSES) + cls[c]] = state[opened[c]], HERE
        move[state[s], -1] = state[s]  # padding
    return move, mark


def _classes() -> np.ndarray:
    """Class of every code point, asked from the tokenizer library's own pattern engine."""
    from tokenizers import Regex, pre_tokenizers

    out = np.full(0x110000, CLASSES.index("other"), np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, points = "".join(map(chr, points)), np.array(points)
    for name, pattern in (("letter", r"\p{L}+"), ("number", r"\p{N}+"), ("space", r"\s+")):
        kept = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        for _, (a, b) in kept:
            out[points[a:b]] = CLASSES.index(name)
    out[ord(" ")], out[ord("'")] = CLASSES.index("blank"), CLASSES.index("quote")
    for s in SUFFIXES:
        out[ord(s[0])] = CLASSES.index("single" if len(s) == 1 else s[0])
        if len(s) == 2 and s[1] != s[0]:
            out[ord(s[1])] = CLASSES.index(s[1])
    return out


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str, most_moves: int = MOST_MOVES):
        self.most_moves = most_moves
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer is compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = _byte_letters()
        raw = lambda text: bytes(letters[c] for c in text)
        self.tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.text = {i: t for t, i in self.tokens.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.begins = {t[:k] for t in self.tokens for k in range(len(t))}
        self.move, self.mark = _splitter()
        self.classes = _classes()
        self.fits: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self, lanes: int = 0) -> None:
        """Forgets all moves; a step of so many lanes leaves the emptied table at most half full."""
        root = (b"", (0,), (-1,), (0,))
        self.states, self.number = [root], {root: 0}
        self.bits = (2 * (self.most_moves + lanes) - 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to, self.gain = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int8)
        self.moves = 0
        self.fits.clear()

    def _renew(self, states: np.ndarray) -> np.ndarray:
        """Empties the table in the middle of texts: only the states that the lanes stand in stay."""
        live = [self.states[s] for s in states.tolist()]
        self._clear(len(live))
        return np.array([self._numbered(s) for s in live], np.int64)

    def _numbered(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def _merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when their texts meet."""
        if (a, b) not in self.fits:
            self.fits[a, b] = self._merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return self.fits[a, b]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The state behind a byte and the change of the count.

        The last token of the longer text is the one vocabulary entry that ends
        it and may stand behind the last token of the text before.
        """
        held, places, last, count = self.states[state]
        held += bytes([byte])
        for place, before, n in zip(places, last, count, strict=True):
            token = self.tokens.get(held[place:])
            if token is not None and (before < 0 or self._adjacent(before, token)):
                gain = n + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        rows = [(p, b, n) for p, b, n in zip(places, last, count, strict=True) if held[p:] in self.begins] + [(len(held), token, gain)]
        cut = rows[0][0]
        new = (held[cut:], tuple(p - cut for p, _, _ in rows), tuple(b for _, b, _ in rows), tuple(n - gain for _, _, n in rows))
        return self._numbered(new), gain

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Place of each transition in the open table; those missing are made."""
        spread = np.uint64(0x9E3779B97F4A7C15)
        slot = ((key.astype(np.uint64) * spread) >> np.uint64(64 - self.bits)).astype(np.int64)
        wrong = np.flatnonzero(self.keys[slot] != key)
        while len(wrong):
            free = self.keys[slot[wrong]] < 0
            if free.any():
                at = wrong[free]
                new, first = np.unique(key[at], return_index=True)
                for k, s in zip(new.tolist(), slot[at[first]].tolist(), strict=True):
                    while self.keys[s] >= 0 and self.keys[s] != k:
                        s = (s + 1) % len(self.keys)
                    if self.keys[s] < 0:
                        self.to[s], self.gain[s] = self._step(k >> 8, k & 255)
                        self.keys[s] = k
                        self.moves += 1
            wrong = wrong[self.keys[slot[wrong]] != key[wrong]]
            slot[wrong] = (slot[wrong] + 1) % len(self.keys)
            wrong = wrong[self.keys[slot[wrong]] != key[wrong]]
        return slot

    def pieces(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces begin; ``first`` are the indexes of the texts' first code points."""
        n = len(points)
        chunks = -(-n // CHUNK)
        cls = np.full(chunks * CHUNK, 2 * len(CLASSES), np.int64)
        cls[:n] = self.classes[points]
        cls[first] += len(CLASSES)
        cls = np.ascontiguousarray(cls.reshape(chunks, CHUNK).T)
        wide, flat, marks = self.move.shape[1], self.move.ravel(), self.mark.ravel()
        maps = np.tile(np.arange(len(STATES)), (chunks, 1))
        for row in cls:
            maps = flat[maps * wide + row[:, None]]
        gap = 1
        while gap < chunks:
            # the map of twice as many chunks: what the earlier ones end in goes through the later ones
            maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].copy(), 1)
            gap *= 2
        state = np.zeros(chunks, np.int64)
        state[1:] = maps[:-1, 0]
        found, states = np.empty((CHUNK, chunks), np.int64), np.empty((CHUNK, chunks), np.int64)
        for i, row in enumerate(cls):
            at = state * wide + row
            found[i], state = marks[at], flat[at]
            states[i] = state
        found, states = found.T.ravel()[:n], states.T.ravel()[:n]
        begin = (found & HERE) > 0
        begin[:-1] |= (found[1:] & BEFORE) > 0
        # an apostrophe and half a suffix at a text's end
        last = np.concatenate([first[1:], [n]]) - 1
        half = last[states[last] >= STATES.index("quote_r")]
        begin[half] = True
        return begin

    def gains(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Change of the count at every byte; ``begin`` are the bytes that open pieces."""
        out = np.zeros(len(data), np.int8)
        opens = np.zeros(len(data), bool)
        opens[begin] = True
        cut = begin[np.unique(np.searchsorted(begin, np.arange(0, len(data), LANE)).clip(0, len(begin) - 1))]
        end = np.concatenate([cut[1:], [len(data)]])
        order = np.argsort(cut - end, kind="stable")
        cut, end = cut[order], end[order]
        state, longest = np.zeros(len(cut), np.int64), int((end - cut)[0])
        alive = np.searchsorted(-(end - cut), -np.arange(longest), "left")
        for t, n in enumerate(alive.tolist()):
            # a step makes a move a lane at most
            if self.moves + n > len(self.keys) // 4 * 3 or self.moves > self.most_moves:
                state[:n] = self._renew(state[:n])
            at = cut[:n] + t
            slot = self._slots(np.where(opens[at], 0, state[:n]) << 8 | data[at])
            state[:n] = self.to[slot]
            out[at] = self.gain[slot]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, special strings counted as one."""
        total = np.zeros(len(texts), np.int64)
        owner, parts = [], []
        cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        for i, text in enumerate(texts):
            if cut and cut.search(text):
                segments = cut.split(text)
                total[i] = len(segments) - 1
            else:
                segments = [text]
            for s in segments:
                if s:
                    owner.append(i)
                    parts.append(s)
        if not parts:
            return total
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        size = np.array([len(p) for p in parts])
        first = np.cumsum(size) - size
        byte = np.flatnonzero((data & 0xC0) != 0x80)
        gains = self.gains(data, byte[self.pieces(points, first)])
        np.add.at(total, np.array(owner), np.add.reduceat(gains, byte[first], dtype=np.int64))
        return total


@functools.lru_cache(1)
def transducer(path: str) -> Transducer:
    """The machines of a worker process; they stay for the tasks to come."""
    return Transducer(path)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part in kernel.slices(batches):
            text = part.column("text")
            n = machine.counts(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(kernel.lengths(text)), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs(doc_id, text)``.

    ``path`` names a byte-level BPE tokenizer file.  Null texts count as empty:
    no bytes, no tokens.  Null and repeated ids are passed on row by row; other
    columns are ignored.  A map without shuffle.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(_count(path, limit), schema)
