"""What a worker holds while it encodes and packs does not grow with the text of a batch."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from readloom.llm import packing, tokens


class Recorded:
    """A tokenizer that notes how many pieces it was given at once."""

    def __init__(self, library):
        self.library, self.given = library, []

    def encode_batch_fast(self, pieces, **options):
        self.given.append(len(pieces))
        return self.library.encode_batch_fast(pieces, **options)

    def __getattr__(self, name):
        return getattr(self.library, name)


def test_pieces_reach_the_library_in_bounded_lists():
    text = " ".join(f"w{i * i}x{i}" for i in range(12_000))
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = coder.library.encode(text, add_special_tokens=False).ids
    coder.library = Recorded(coder.library)
    ids, off = coder.encode([text, "", text])
    assert ids.tolist() == want + want and off.tolist() == [0, len(want), len(want), 2 * len(want)]
    assert sum(coder.library.given) >= 12_000 and max(coder.library.given) <= tokens.LEARNED


def test_packing_takes_a_batch_in_small_slices():
    rows = 60
    text = ["some words and numbers 12 34 " * 700] * rows  # 20 kB each
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.array(text, pa.large_string())], names=["doc_id", "text"])
    out = list(packing._pieces(public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)(iter([batch])))
    assert len(out) >= 2
    table = pa.Table.from_batches(out)
    assert set(table["doc_id"].to_pylist()) == set(range(rows))
    assert max(table["length"].to_pylist()) <= 1024
