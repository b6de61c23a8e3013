"""Intermediate tables written and read back."""

from __future__ import annotations

import pytest

from readloom.operators.bubbles import Bundles
from readloom.sources import records


def test_overlaps_end_with_a_mark(spark, tmp_path):
    rows = [(k, k + 1, -900, 99.5, 0, 10, 910, 1000, 1, 0, 900, 950, "overlap") for k in range(40)]
    df = spark.createDataFrame(rows, records.OVERLAP_SCHEMA).repartition(3)
    path = str(tmp_path / "overlaps")
    records.write_lines(records.overlap_lines(df), path, marked=True)
    assert sorted(map(tuple, records.read_overlaps(spark, path).collect())) == rows
    records.write_lines(records.overlap_lines(df), path)
    with pytest.raises(ValueError, match="end mark"):
        records.read_overlaps(spark, path)
    # a table without rows still ends
    records.write_lines(records.overlap_lines(df.limit(0)), path, marked=True)
    assert records.read_overlaps(spark, path).count() == 0


def test_counts_of_chunks(spark, tmp_path):
    a, b = (spark.createDataFrame(r, "hash long, mc long") for r in ([(1, 2), (5, 1)], [(1, 3), (9, 4)]))
    records.write_counts(a, str(tmp_path / "a"))
    records.write_counts(b, str(tmp_path / "b"))
    assert sorted(map(tuple, records.read_counts(spark, str(tmp_path / "a")).collect())) == [(1, 2), (5, 1)]
    both = records.read_counts(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(map(tuple, both.collect())) == [(1, 5), (5, 1), (9, 4)]


def test_unitigs_bundles_and_contigs(spark, tmp_path):
    table = spark.createDataFrame(
        [("h", "1:E", "2:E", "3:E", "simple", 700, 70), (None, "3:E", "NA", "6:E", "compound", 500, 50)],
        "head string, s string, via string, t string, type string, length long, score long",
    )
    members = spark.createDataFrame([("h", 1, "2:E", "3:E"), ("h", 0, "1:E", "2:E")], "head string, rank long, v string, w string")
    edges = [("3:E", "6:E", "3:E", "4:E", "6:E"), ("3:E", "6:E", "3:E", "5:E", "6:E")]
    found = spark.createDataFrame([("3:E", "6:E", 500, 50, 2)], "s string, t string, length long, score long, n_edges long")
    comp = Bundles(found, spark.createDataFrame(edges, "bs string, bt string, s string, via string, t string"))
    path = str(tmp_path / "unitigs")
    records.write_lines(records.unitig_lines(table, members, comp), path)
    got = {r.via: r for r in records.read_unitigs(spark, path).collect()}
    assert got["2:E"].nodes == ["1:E", "2:E", "3:E"] and got["2:E"].edges is None and got["2:E"].length == 700
    assert [tuple(e) for e in got["NA"].edges] == [e[2:] for e in edges] and got["NA"].nodes is None
    records.write_lines(records.bundle_lines(comp), path)
    assert [[tuple(e) for e in r.edges] for r in records.read_unitigs(spark, path).collect()] == [[e[2:] for e in edges]]

    contigs = spark.createDataFrame(
        [("000000F", "ctg_linear", 1, "3:E", "NA", "6:E", 500, 50), ("000000F", "ctg_linear", 0, "1:E", "2:E", "3:E", 700, 70)],
        "ctg string, ctg_type string, ord long, s string, via string, t string, length long, score long",
    )
    records.write_lines(records.contig_lines(contigs), path)
    r = records.read_contigs(spark, path).first()
    assert (r.ctg, r.first, r.end, r.length, r.score) == ("000000F", "1:E~2:E~3:E", "6:E", 1200, 120)
    assert [tuple(s) for s in r.steps] == [("1:E", "2:E", "3:E"), ("3:E", "NA", "6:E")]
    records.write_lines(records.node_lines(spark.createDataFrame([("7:B",)], "node string")), path)
    assert spark.read.text(path).first()[0] == "7:B"


def test_tilings_keep_their_order(spark, tmp_path):
    rows = [("c", k, f"{k}:E", f"{k + 1}:E", str(k + 1), 0, 100, 90, 99.5, 100 * k, 100) for k in range(30)]
    names = "ctg string, ord int, v string, w string, rid string, sp int, tp int, score int, identity double, offset long, length int"
    path = str(tmp_path / "tiling")
    records.write_lines(records.tiling_lines(spark.createDataFrame(rows, names).repartition(4)), path)
    got = {r.ord: (r.v, r.offset) for r in records.read_tiling(spark, path).collect()}
    assert got == {r[1]: (r[2], r[9]) for r in rows}
