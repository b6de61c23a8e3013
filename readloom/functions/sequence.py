"""Column expressions on sequences, k-mer codes and graph node names."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.operators import kernels

# Base order of the 2-bit code, and the complement table.
BASES = "ACGT"
COMPLEMENT_FROM = "ACGTacgt"
COMPLEMENT_TO = "TGCAtgca"

# Xor key and size of the xor-hashed k-mer.
XOR_KEY = 0x7ED55D16
XOR_K = 16


def reverse_complement(seq: Column | str) -> Column:
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.reverse(F.translate(col, COMPLEMENT_FROM, COMPLEMENT_TO))


def oriented(seq: Column, strand: Column) -> Column:
    """The sequence as read on the given strand (0 forward, 1 reversed)."""
    return F.when(strand == 0, seq).otherwise(reverse_complement(seq))


def normalised(seq: Column) -> Column:
    """Upper-cased bases; whatever is not A, C, G or T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def base_code(base: Column) -> Column:
    """0..3 for A, C, G, T/U and 4 for an ambiguous base."""
    at = F.instr(F.lit(BASES), F.translate(F.upper(base), "U", "T"))
    return F.when(at > 0, at - 1).otherwise(F.lit(4))


def _masked_shift(key: Column, by: int, bits: int) -> Column:
    """(key << by) restricted to ``bits`` bits, without overflowing a long."""
    keep = (1 << max(bits - by, 0)) - 1
    return F.shiftleft(key.bitwiseAND(F.lit(keep)), by)


def mix_hash(key: Column, k: int) -> Column:
    """Invertible integer mix of a 2k-bit code, on signed longs under ANSI.

    The steps are fixed values: multiply-by-shift terms 21, 3+8, 2+4, 31 and
    xor-shifts 24, 14, 28, each reduced to 2k bits.
    """
    bits = 2 * k
    mask = F.lit((1 << bits) - 1).cast("long")

    def add_shifted(c: Column, *shifts: int) -> Column:
        terms = [c] + [_masked_shift(c, s, bits) for s in shifts]
        return functools.reduce(lambda a, b: (a + b).bitwiseAND(mask), terms)

    def xor_right(c: Column, by: int) -> Column:
        return c.bitwiseXOR(F.shiftrightunsigned(c, by))

    c = key.cast("long")
    c = (mask - c + _masked_shift(c, 21, bits)).bitwiseAND(mask)
    c = xor_right(c, 24)
    c = add_shifted(c, 3, 8)
    c = xor_right(c, 14)
    c = add_shifted(c, 2, 4)
    c = xor_right(c, 28)
    return add_shifted(c, 31)


def xor_hash(code: Column) -> Column:
    """Hash of a 2-bit packed 16-mer code: xor with a fixed key."""
    return code.bitwiseXOR(F.lit(XOR_KEY).cast("long"))


def decode_code(code: Column, k: int) -> Column:
    """Text of a 2-bit packed k-mer, first base in the high bits."""
    parts = [
        F.substring(F.lit(BASES), F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
        for i in range(k)
    ]
    return functools.reduce(lambda a, b: F.concat(a, b), parts)


def decode_xor_hash(h: Column) -> Column:
    return decode_code(xor_hash(h), XOR_K)


def hash_label(h: Column) -> Column:
    """Fourteen upper-case hex digits."""
    return F.lpad(F.hex(h), 14, "0")


def minimizer_text(seq: Column, pos: Column, span: Column) -> Column:
    """The k-mer ending at 0-based ``pos``."""
    return F.substring(seq, pos - span + 2, span)


def mirrored_position(length: Column, pos: Column, span: Column) -> Column:
    """Last position of the same k-mer counted on the other strand."""
    return length - (pos + 1) + span - 1


def header_id(header: Column) -> Column:
    return F.split(header, r"\s", 2).getItem(0)


def header_metadata(header: Column) -> Column:
    parts = F.split(header, r"\s", 2)
    return F.when(F.size(parts) > 1, parts.getItem(1))


def flip_end(node: Column) -> Column:
    """Other end of the same read; the placeholder ``NA`` maps to itself."""
    return (
        F.when(node == "NA", node)
        .when(node.endswith(":B"), F.regexp_replace(node, ":B$", ":E"))
        .when(node.endswith(":E"), F.regexp_replace(node, ":E$", ":B"))
    )


def flip_path(path: Column) -> Column:
    return F.transform(F.reverse(path), flip_end)


def wrap_sequence(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def packed_tag(t_pos: Column, delta: Column, base: Column) -> Column:
    """One long that sorts as (t_pos, delta, base)."""
    return F.shiftleft(t_pos.cast("long"), 32) + F.shiftleft(delta.cast("long"), 8) + F.ascii(base).cast("long")


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


# One-hot nibble of each base in the two-strand byte.
NIBBLES = {"A": 1, "C": 2, "G": 4, "T": 8}

_LOW, _HIGH = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
for _base, _other in zip(COMPLEMENT_FROM, COMPLEMENT_TO, strict=True):
    _LOW[ord(_base)] = NIBBLES[_base.upper()]
    _HIGH[ord(_base)] = NIBBLES[_other.upper()] * 16
_LETTERS = np.full(256, ord("N"), np.uint8)
for _base, _value in NIBBLES.items():
    _LETTERS[_value] = ord(_base)


def _rebuilt(kind: pa.DataType, like: pa.Array, data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A column of texts or bytes with the nulls of ``like``."""
    offsets = pa.py_buffer(bounds.astype(np.int64 if pa.types.is_large_unicode(kind) or pa.types.is_large_binary(kind) else np.int32))
    column = pa.Array.from_buffers(kind, len(like), [None, offsets, pa.py_buffer(data)])
    return pc.if_else(like.is_valid(), column, pa.scalar(None, kind))


@F.arrow_udf(T.BinaryType())
def _two_strand(seq: pa.Array) -> pa.Array:
    # a letter of several bytes is one base
    ascii_only = pc.replace_substring_regex(seq, pattern=r"[^\x00-\x7F]", replacement="N")
    raw, bounds = kernels.text_buffer(ascii_only)
    codes, high = _LOW[raw], _HIGH[raw]
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        codes[start:stop] |= high[start:stop][::-1]
    return _rebuilt(pa.binary(), seq, codes, bounds)


@F.arrow_udf(T.StringType())
def _one_strand(codes: pa.Array, strand: pa.Array) -> pa.Array:
    raw, bounds = kernels.text_buffer(codes.cast(pa.large_binary()).view(pa.large_string()))
    forward = np.repeat(pc.equal(strand, 0).fill_null(False).to_numpy(zero_copy_only=False), np.diff(bounds))
    return _rebuilt(pa.string(), codes, _LETTERS[np.where(forward, raw & 15, raw >> 4)], bounds)


def two_strand_codes(seq: Column) -> Column:
    """Bytes, one a base: forward nibble low, reversed strand high."""
    return _two_strand(seq)


def decode_two_strand(codes: Column, strand: Column) -> Column:
    """Text of one strand; a nibble that is not one-hot reads as N."""
    return _one_strand(codes, strand)
