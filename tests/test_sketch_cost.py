"""Steps before the candidates: minima by place, texts as bases, buckets counted once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.operators import kernels, pairs, sketch
from readloom.sources import tables
from tests.genome import random_seq


@pytest.mark.parametrize("top", [5, 1 << 40, (1 << 63) + 9])
@pytest.mark.parametrize("width", [1, 2, 3, 7, 24])
def test_minimum_and_its_last_place(top, width):
    rng = np.random.default_rng(width)
    values = np.where(rng.random(300) < 0.2, kernels.NOTHING, rng.integers(0, 6, 300).astype(np.uint64) * np.uint64(top // 5))
    low, at = kernels.trailing_argmin(values, width)
    assert (kernels.trailing_min(values, width) == low).all()
    for i in range(300):
        part = values[max(0, i + 1 - width) : i + 1]
        assert low[i] == part.min()
        if low[i] != kernels.NOTHING:
            assert at[i] == i - np.flatnonzero(part[::-1] == low[i])[0]


def test_texts_as_bases(spark, tmp_path):
    texts = ["", None, "Plain words, 0-9.", "Grüße — 漢字 🙂", "\x00\x7f\n\t", "é" * 300, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = tables.document_reads(spark, str(tmp_path))
    assert got.dtypes == [("rid", "bigint"), ("seq", "string")]
    want = docs.select("doc_id", tables.as_bases("text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sketch_does_not_depend_on_the_slices(spark, monkeypatch):
    import random

    rng = random.Random(3)
    reads = spark.createDataFrame([(i, random_seq(rng, rng.choice([0, 20, 400, 3000]))) for i in range(60)], "rid long, seq string").coalesce(1)

    def rows(bases, batch):
        monkeypatch.setattr(sketch, "KERNEL_BASES", bases)
        monkeypatch.setattr(sketch, "BATCH_ROWS", batch)
        return sorted(map(tuple, sketch.sketch(reads, 16, 24, 3, (0, 1, 2)).collect()))

    assert rows(1, 1) == rows(5_000, 100) == rows(10_000_000, 10_000)


def test_buckets_are_counted_once(spark):
    i = F.col("id")
    occ = spark.range(300).select(
        (i % 30).alias("h0"), (i % 30 + 90).alias("h1"), i.alias("rid"), F.lit(900).alias("len"),
        (i % 97).cast("int").alias("pos0"), F.lit(500).alias("pos1"), F.lit(0).alias("direction"),
    )
    got = pairs.bucket_rows(occ)
    assert got.count() == 300
    assert got._jdf.queryExecution().analyzed().toString().count("Range (") == 1
