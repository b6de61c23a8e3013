"""Token ids, counts, files and packing against the tokenizer library and plain restatements."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readloom.llm import coder, packing
from readloom.llm.tokens import Encoder
from readloom.llm.transducer import Transducer, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
EDGE = [
    "", " ", "a  b\n\n c\t\td", "<|endoftext|> x  <|endoftext|>", "it's  'll ''s ,'re x'", "\x1c a\x1d", "é é ́x", "x" * 3000,
    "  \n ", "a b  c", "İ Σς 123 4５", "don't 'r", "'r'v'l'll'l", " 's", "\n's", "'d'm't", "漢字 かな", "😀😀 👍🏽", "<|startoftext|>a",
]


def mixed(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["'", "s", "re", "l", "v", " ", ",", ".", "...", "ß", "\u0301", "  ", "\n", "\t", "a", "T", "1", "é", "!", "漢", "😀", " ", "ing", "the", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_ids_of_the_library(path):
    texts = EDGE + mixed(1, 800)
    ids, off = Encoder(path).encode(texts)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want


def test_long_random_texts_empty_the_table_on_the_way():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (40_000, 3, 700)] + ["plain words after it, again and again " * 40]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for most in (8, 2000):
        machine = Transducer(path, most)
        assert machine.counts(texts).tolist() == want
        assert machine.moves <= most + 2 * 40_000 // 300 and len(machine.keys) < 1 << 16


def test_transducer_counts_like_the_library():
    texts = EDGE + mixed(2, 3000)
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    machine = Transducer(BYTE)
    assert machine.counts(texts).tolist() == want
    machine._clear()
    assert machine.counts(texts[::-1]).tolist() == want[::-1]


def test_counts_query(spark):
    rows = [(1, "Hello world", 5), (1, "Hello world", 6), (None, "x", 7), (2, None, 8), (3, "", 9), (4, "word " * 20000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(df, BYTE).collect()), key=str)
    one = len(Tokenizer.from_file(BYTE).encode("word " * 20000, add_special_tokens=False).ids)
    assert got == sorted([(1, 11, 2, False)] * 2 + [(None, 1, 1, False), (2, 0, 0, False), (3, 0, 0, False), (4, 100000, one, True)], key=str)
    assert token_counts(df.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, coder.BLOCK, coder.BLOCK + 1, 3 * coder.BLOCK + 7])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    repeated = np.tile(rng.integers(0, 49408, 37), n // 37 + 1)[:n]
    for ids in (rng.integers(0, 65536, n), np.full(n, 65535), rng.zipf(1.3, n) % 49408, repeated):
        blocks = coder.compress(ids)
        assert np.array_equal(coder.expand(blocks), ids)
        assert len(blocks) == -(-n // coder.BLOCK)
    if n > coder.BLOCK:
        # what repeats costs little, a block stands for itself, damage is noticed
        assert sum(len(b["data"]) for b in blocks) < n
        assert np.array_equal(coder.expand(blocks[1:2]), repeated[coder.BLOCK : 2 * coder.BLOCK])
        bad = bytearray(blocks[0]["data"])
        bad[len(bad) // 2] ^= 16
        with pytest.raises(ValueError):
            coder.expand([blocks[0] | {"data": bytes(bad)}])


def reference(rows, path, end_id):
    out, start = [], 0
    library = Tokenizer.from_file(path)
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_hold_the_ids_in_order(spark, tmp_path, monkeypatch):
    rows = [(i * 7 % 101, t) for i, t in enumerate((EDGE + mixed(3, 80))[:101])] + [(200, None), (None, "no id"), (300, "long text " * 6000)]
    df = spark.createDataFrame([(a, b, b) for a, b in rows], "doc_id long, text string, file string").repartition(7)
    folder = str(tmp_path / "ids")
    coder.write_ids(df, folder, WORD)
    got = sorted(map(tuple, coder.read_ids(spark, folder, with_ids=True).collect()), key=lambda r: r[1])
    assert got == reference(rows, WORD, 2)


def test_files_of_repeated_ids_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(5, "same"), (5, "same"), (4, "a b")], "doc_id long, text string")
    coder.write_ids(df, str(tmp_path / "a"), WORD)
    got = sorted(map(tuple, coder.read_ids(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == [r[:4] for r in reference([(5, "same"), (5, "same"), (4, "a b")], WORD, 2)]
    coder.write_ids(df.limit(0), str(tmp_path / "b"), WORD)
    assert coder.read_ids(spark, str(tmp_path / "b")).count() == 0


def fewest(sizes, capacity):
    """Fewest bins by trying all placements."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best


def test_bounds_never_exceed_the_fewest_bins():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 16, 30])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        bins, _, left = packing.best_fit(np.array(sizes), capacity)
        few = fewest(sizes, capacity)
        assert bound <= few <= len(left)
        assert all(sum(s for s, b in zip(sizes, bins, strict=True) if b == k) == capacity - left[k] for k in range(len(left)))
    assert packing.lower_bound(np.bincount([6, 6, 6, 5, 5], minlength=11), 10) == 4


def test_packing_keeps_every_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "an", "x9", "zebra"]) for _ in range(rng.choice([1, 5, 20, 90, 300])))) for i in range(220)]
    rows += [(500, None), (501, ""), (None, "no id"), (7, "again"), (7, "again"), (502, "long " * 700)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, pid int").repartition(6)
    capacity = 128
    got = packing.packed(df, BYTE, capacity).collect()
    want = []
    for doc_id, _, n, _, ids in reference(rows, BYTE, 2):
        first = n - (n - 1) // capacity * capacity
        cuts = [0, *range(first, n + 1, capacity)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in by.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end
            end += length
        assert end <= capacity
    sizes = np.bincount([r.length for r in got], minlength=capacity + 1)
    # parts of 40 documents here; an exchange leaves about one open sequence a part
    assert len(by) <= packing.lower_bound(sizes, capacity) + 6
    monkeypatch.setattr(packing, "ITEMS", 50_000)
    assert packing.packed(df, BYTE, capacity).select("sequence_id").distinct().count() == packing.lower_bound(sizes, capacity)
    assert packing.packed(df.limit(0), BYTE).count() == 0
