"""One key holding a third of all rows changes nothing in the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import kmers, pairs, sketch
from readloom.session import join_bounded


def hot_sketch(spark, n=6000):
    """Reads of 30 minimizers; every third minimizer is the same one."""
    i = F.col("id")
    return spark.range(n).select(
        F.floor(i / 30).alias("rid"),
        F.lit(2).alias("level"),
        (i % 30).cast("int").alias("idx"),
        (i % 30 * 150 + 20).cast("int").alias("pos"),
        (i % 2).cast("int").alias("strand"),
        F.when(i % 3 == 0, F.lit(7)).otherwise(1000 + i % 700).alias("hash"),
        F.lit(16).alias("span"),
        F.lit(5000).alias("len"),
    )


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_count_filter_with_a_hot_hash(spark):
    sk = hot_sketch(spark)
    counts = sketch.minimizer_counts(sk)
    plain = sk.join(counts, "hash")
    assert rows_of(sketch.annotate_counts(sk, counts)) == rows_of(plain)
    assert rows_of(sketch.within_counts(sk, counts, 2, 240)) == rows_of(plain.where("mc between 2 and 240"))


def test_buckets_with_a_hot_pair(spark):
    i = F.col("id")
    occ = spark.range(3000).select(
        F.when(i % 3 == 0, 1).otherwise(i % 50 + 10).alias("h0"),
        F.when(i % 3 == 0, 2).otherwise(i % 50 + 90).alias("h1"),
        i.alias("rid"), F.lit(900).alias("len"), (i % 97).cast("int").alias("pos0"), F.lit(500).alias("pos1"), F.lit(0).alias("direction"),
    )
    got = pairs.bucket_rows(occ)
    sizes = {(r.h0, r.h1): r.n for r in got.select("h0", "h1", "n").distinct().collect()}
    assert (1, 2) not in sizes and sum(sizes.values()) == got.count() == 2000


def test_bounded_join_keeps_everything(spark):
    i = F.col("id")
    rows = spark.range(5000).select(F.when(i % 3 == 0, 5).otherwise(i % 400).alias("k"), i.alias("x"))
    lookup = spark.range(350).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    assert rows_of(join_bounded(rows, lookup, "k", 3)) == rows_of(rows.join(lookup, "k"))


def test_components_of_a_star(spark):
    star = spark.range(1, 2000).select(F.lit(0).cast("long").alias("v"), F.col("id").alias("w"))
    tail = spark.range(5000, 5050).select(F.col("id").alias("v"), (F.col("id") + 1).alias("w"))
    got = kmers.weak_components(star.unionByName(tail)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, 2000), (5000, 51)}
