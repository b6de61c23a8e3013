"""What a task holds and what a round moves, however large the input is."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import sequence as sq
from readloom.operators import align, bubbles, chains, dimers, kmers, mapping, sketch


class Caught:
    """Stands for a frame; keeps the function that ``mapInArrow`` is given."""

    columns = ["rid", "q", "t"]
    schema = ()

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def texts(rows: int, size: int, letters: str = "ACGT") -> pa.Array:
    rng = np.random.default_rng(rows)
    flat = np.frombuffer(letters.encode(), np.uint8)[rng.integers(0, len(letters), rows * size)]
    return pa.array([flat[i * size : (i + 1) * size].tobytes().decode() for i in range(rows)])


def batch(seqs: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(seqs))), seqs], names=["rid", "seq"])


def peak(run, rows: pa.RecordBatch) -> float:
    tracemalloc.start()
    for _ in run(iter([rows])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


@pytest.mark.parametrize("make", [lambda: kmers.kmer_rows(Caught(), 16), lambda: sketch.sketch(Caught(), 16, 24, 3, (0, 1, 2))])
def test_a_large_batch_is_cut(spark, make):
    assert peak(make(), batch(texts(3000, 1000))) < 120


def test_stretches_give_the_same_kmers(spark, monkeypatch):
    rows = batch(texts(40, 30, "ACGTACGTN"))

    def got():
        return sorted(r for b in kmers.kmer_rows(Caught(), 5, 2)(iter([rows])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

    whole = got()
    monkeypatch.setattr(kmers, "BASES_AT_ONCE", 7)
    assert got() == whole and whole


def test_texts_jump_to_their_minimizers_together(spark, monkeypatch):
    calls = []
    plain = kmers._record_minima
    monkeypatch.setattr(kmers, "_record_minima", lambda *a: calls.append(1) or plain(*a))
    for _ in kmers.xor_minimizers(Caught())(iter([batch(texts(300, 200))])):
        pass
    assert len(calls) == 2


def test_traced_pairs_are_few_bases():
    pairs = texts(200, 4000)
    assert max(b - a for a, b in align._chunks(pairs, pairs, align.TRACED_AT_ONCE)) * 8000 <= 500_000


def test_two_strands_as_bytes(spark):
    rows = [(0, "ACGTNacgu"), (1, None), (2, ""), (3, "GATTACA"), (4, "é1ACC")]
    df = spark.createDataFrame(rows, "rid long, seq string").select("rid", sq.two_strand_codes(F.col("seq")).alias("c"))
    assert df.schema["c"].dataType.simpleString() == "binary"
    got = df.select("rid", sq.decode_two_strand(F.col("c"), F.lit(0)), sq.decode_two_strand(F.col("c"), F.lit(1)), F.length("c")).collect()
    assert {tuple(r) for r in got} == {
        (0, "ACGTNACGN", "NCGTNACGT", 9), (1, None, None, None), (2, "", "", 0), (3, "GATTACA", "TGTAATC", 7), (4, "NNACC", "GGTNN", 5),
    }


GRAPH = "s string, via string, t string, length long, score long"


def test_a_round_of_bubbles_is_one_shuffle(spark):
    edges = [("F:E", f"{x}:E", f"{x}:E", 1, 1) for x in "AB"] + [(f"{x}:E", "Z:E", "Z:E", 1, 1) for x in "AB"]
    steps = bubbles._steps(spark.createDataFrame(edges, GRAPH)).cache()
    state = spark.createDataFrame([("F:E", "F:E", "front", 0, None, 0, 0)], f"fork string, node string, kind string, got long, best {bubbles.BEST}, need long, outs long")
    out = steps.where("node = 'F:E'").select(F.col("node").alias("fork"), *bubbles._offer(F.lit(0), F.lit(0))).localCheckpoint()
    wave = bubbles._wave(state.localCheckpoint(), out, None)
    assert wave._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r.node, r.kind) for r in wave.collect()} == {("F:E", "settled"), ("A:E", "front"), ("B:E", "front")}


def test_a_front_that_only_turns_back_closes_no_bubble(spark):
    edges = [("F:E", "A:E", "A:E", 1, 1), ("F:E", "B:E", "B:E", 1, 1), ("A:E", "F:B", "F:B", 1, 1), ("B:E", "X:E", "X:E", 1, 1)]
    assert bubbles.bundles(spark.createDataFrame(edges, GRAPH)).found.collect() == []
    edges[2] = ("A:E", "X:E", "X:E", 1, 1)
    assert [tuple(r) for r in bubbles.bundles(spark.createDataFrame(edges, GRAPH)).found.collect()] == [("F:E", "X:E", 2, 2, 4)]
    # a length that is not known counts as none
    edges[1] = ("F:E", "B:E", "B:E", None, 1)
    assert [tuple(r) for r in bubbles.bundles(spark.createDataFrame(edges, GRAPH)).found.collect()] == [("F:E", "X:E", 1, 2, 4)]


def test_claims_move_without_names(spark, monkeypatch):
    seen = []
    plain = chains.cut_lineage
    monkeypatch.setattr(chains, "cut_lineage", lambda df: seen.append(set(df.columns)) or plain(df))
    rows = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (4, "d"), (4, "a")]
    won = chains.greedy_claims(spark.createDataFrame(rows, "owner long, resource string"), [])
    assert sorted(r.owner for r in won.collect()) == [1, 3]
    assert all(c <= {"resource", "key", "best"} for c in seen)


def test_dovetails_are_one_number_a_pair(spark):
    rows = [(1, 0, 7, 4, 1000), (1, 900, 8, 4, 1000), (2, 0, 8, 4, 1000), (2, 950, 7, 4, 1000), (3, 500, 7, 4, 1000)]
    df = spark.createDataFrame(rows, "rid long, pos int, hash long, span int, len int")
    got = dimers.dovetail_pairs(df, 250)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    # read 1 has hash 7 at its front and 8 at its back, read 2 the other way round; read 3 has no end
    want = {(a, x, b, y) for a, b in ((1, 2), (2, 1)) for x in (3, 5) for y in (3, 5)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_reads_are_mapped_without_a_look_up_of_every_pair(spark):
    pair = "h0 long, h1 long, rid long, pos0 int, pos1 int, direction int"
    reads = spark.createDataFrame([(1, 2, 5, 10, 60, 0), (2, 1, 5, 30, 80, 1), (3, 4, 6, 1, 2, 0)], pair)
    refs = spark.createDataFrame([(1, 2, 9, 100, 150), (1, 2, 9, 300, 350)], "h0 long, h1 long, ref_id long, ref_bgn int, ref_end int")
    counts = spark.createDataFrame([(1, 3), (2, 4), (3, 5), (4, 6)], "hash long, mc long")
    got = mapping.map_reads(refs, reads, counts)
    assert sorted(tuple(r) for r in got.collect()) == [(9, 100, 150, 5, 10, 60, 0, 3, 4), (9, 300, 350, 5, 10, 60, 0, 3, 4)]
    # the reads meet the keys, the salts and the references
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "LogicalRDD" in x and "pos1" in x)
    deep, joins = lines[at].index("LogicalRDD"), 0
    for x in reversed(lines[:at]):
        here = len(x) - len(x.lstrip(" :+-"))
        if here < deep:
            deep, joins = here, joins + (" Join " in f" {x.lstrip(' :+-')}")
    assert joins == 3
