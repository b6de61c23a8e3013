"""Token ids of whole texts by a public tokenizer, with pieces encoded once per worker.

A text is cut where the tokenizer's own pre-tokenizer always cuts (white space),
and the library encodes each different piece once.  Texts in which that cut
could change the ids (special strings, separators that Python alone counts as
white space) go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from itertools import chain, repeat

import numpy as np

CACHED = 800_000  # pieces a worker remembers before it starts anew
LEARNED = 4096  # new pieces that go to the library at once
# a word of plain letters parts from the marks behind it, which no pattern joins with letters
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]++(?=[.,!?;:])|[.,!?;:]++(?=\\s|\\Z)"
# one blank belongs to the word behind it; of a longer run the last character stands alone or leads the word
BYTE_PIECES = re.compile(f" ?{LETTERS}| ?\\S+|\\s+(?!\\S)|\\s+")
WORD_PIECES = re.compile(f"{LETTERS}|\\S+")
ODD = re.compile("[\x1c-\x1f]")


class Encoder:
    """``ids`` of many texts at once; equal to the library's ``encode`` without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a byte-level vocabulary keeps white space, the other kind drops it
        self.pieces = BYTE_PIECES if self._encode(" ") else WORD_PIECES
        self._clear()

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < n + m:
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(size) - size
        self.size[n : n + m] = size
        self.known.update(zip(pieces, range(n, n + m), strict=True))
        self.used += len(ids)

    def _learn(self, pieces: list[str]) -> None:
        # what the library returns for a piece takes far more memory than its ids
        for at in range(0, len(pieces), LEARNED):
            part = pieces[at : at + LEARNED]
            lists = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            self._add(part, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 offsets between the texts."""
        if len(self.known) > CACHED:
            self._clear()
        whole = [i for i, t in enumerate(texts) if ODD.search(t) or any(s in t for s in self.special)]
        lists = [self.pieces.findall(t) for t in texts]
        for i in whole:
            lists[i] = []
        count = np.array([len(x) for x in lists], np.int64)
        flat = [p for x in lists for p in x]
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._learn(list(dict.fromkeys([flat[i] for i in missing.tolist()])))
            at[missing] = np.fromiter((self.known[flat[i]] for i in missing.tolist()), np.int64, len(missing))
        size = self.size[at]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)
        ids = self.ids[place]
        off = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        if whole:
            parts = np.split(ids, off[1:-1])
            for i in whole:
                parts[i] = np.array(self._encode(texts[i]), np.uint32)
            ids = np.concatenate(parts).astype(np.uint32)
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, off


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process; it stays for the tasks to come."""
    # one task, one core
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
