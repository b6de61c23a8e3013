"""Sequence views over text tables.

Every byte of a text becomes one base, by its last hexadecimal digit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.session import spread

# Hexadecimal digits and the base each stands for
DIGITS = "0123456789ABCDEF"
DIGIT_BASES = "ACGT" * 4

# the last digit repeats every sixteen bytes
BYTES = "".join(map(chr, range(256)))
BYTE_BASES = DIGIT_BASES * 16
LETTER_BASES = np.frombuffer(BYTE_BASES.encode(), np.uint8)


def as_bases(text):
    # in this charset a byte is a character
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), BYTES, BYTE_BASES)


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``as_bases`` for whole batches: bytes are swapped where they lie, bounds and nulls stay."""
    for batch in batches:
        texts = batch.column(1)
        wide = np.int64 if texts.type == pa.large_string() else np.int32
        _, offsets, data = texts.buffers()
        if data is not None and len(texts):
            bounds = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
            own = texts.is_null().to_numpy(zero_copy_only=False)
            mask = None if not texts.null_count else pa.array(~own).buffers()[1]
            buffers = [mask, pa.py_buffer((bounds - bounds[0]).astype(wide)), pa.py_buffer(LETTER_BASES[raw])]
            texts = pa.Array.from_buffers(texts.type, len(texts), buffers, texts.null_count)
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["rid", "seq"])


def _sequences(rows: DataFrame) -> DataFrame:
    rid, text = rows.schema.fields
    return rows.mapInArrow(_bases, T.StructType([T.StructField("rid", rid.dataType), T.StructField("seq", text.dataType)]))


def document_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spread(_load(spark, sf_dir, "documents").select("doc_id", "text")))


def benchmark_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spread(_load(spark, sf_dir, "benchmark").select("item_id", "text")))
