"""What a step leaves on the disks."""

from __future__ import annotations

import time
from collections import defaultdict

from pyspark.sql import functions as F

from readloom.llm import jaccard, lines
from readloom.session import SHUFFLE_CLEANUP, cut_lineage, scratch_scope


def shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in blocks.split("/") if name.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle(spark):
    before, setting = shuffled(spark), spark.conf.get(SHUFFLE_CLEANUP)
    out = cut_lineage(spark.range(50_000).withColumn("x", F.xxhash64("id")).repartition(4, "x").groupBy("x").agg(F.min("id").alias("m")))
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert out.count() == out.distinct().count() == 50_000


def exists(spark, frame):
    path = spark._jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_only_shared_slots_stay(spark):
    texts = [f"the quick brown fox number {i % 40} jumps over the lazy dog\nshort {i % 7} line\nalone {i * 7919}" for i in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    held = defaultdict(set)
    for r in rows.mapInArrow(lines._slots, "key long, slot long").collect():
        held[r.slot].add(r.key)
    want = sorted((key, slot, min(keys)) for slot, keys in held.items() if len(keys) > 1 for key in keys)
    with scratch_scope(spark) as scratch:
        shared, parts = lines._shared_slots(rows, scratch)
        assert sorted(map(tuple, shared.collect())) == want
        assert sorted(scratch.paths) == sorted(p._scratch_path for p in parts)


def test_sets_of_groups_go_before_the_next_step(spark, monkeypatch):
    made, plain, components = [], jaccard._group_sets, jaccard.components

    def group_sets(*args):
        made.append(plain(*args))
        return made[-1]

    def labelled(edges):
        assert made and not any(exists(spark, m) for m in made)
        return components(edges)

    monkeypatch.setattr(jaccard, "_group_sets", group_sets)
    monkeypatch.setattr(jaccard, "components", labelled)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:-1], f"x{i % 3}"]) for i in range(6)] + [f"other text number {i}" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: 0 if i < 6 else i for i in range(10)}
