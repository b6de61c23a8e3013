"""Vectors of very many different lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.llm import multiindex


def test_no_length_is_left_out(spark, monkeypatch):
    def linked(nodes, least):
        # stands for the grid, which would take a minute for so many
        sizes.append(nodes.select(F.size("vector")).first()[0])
        return nodes.limit(0).select("node", F.lit(1).cast("long").alias("links"), F.col("node").alias("other"))

    sizes = []
    monkeypatch.setattr(multiindex, "_linked", linked)
    rows = [(i, 0, [1.0] * (i + 2)) for i in range(104)]
    spark_rows = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").coalesce(1)
    assert multiindex.near_vectors(spark_rows).count() == 104
    assert sorted(sizes) == list(range(2, 106))
