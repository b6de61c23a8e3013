"""Overlap, mapping, consensus, input and output on small fixtures."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.operators import colinear, consensus, kernels, kmers, mapping, overlap, pairs, sketch, truth
from readloom.plans import assemble
from readloom.sources import fasta, records
from tests.genome import random_seq, rc, sample_reads, with_errors

CFG = AssemblyConfig(
    k=16, w=24, reduction=3, min_pair_distance=40, min_len=1000, spur_first=1500, spur_second=2500, repeat_bridge=1500, window=8000, window_limit=16000
)


@pytest.fixture(scope="module")
def toy(spark):
    genome = random_seq(random.Random(7), 16_000)
    reads = sample_reads(genome, 10, 4000, 400)
    df = spark.createDataFrame([(r[0], r[1]) for r in reads], "rid long, seq string").repartition(4).cache()
    index = assemble.build_index(df, CFG)
    return genome, reads, df, index


@pytest.fixture(scope="module")
def found(spark, toy):
    _, _, df, index = toy
    from readloom.session import cut_lineage

    return cut_lineage(overlap.find_overlaps(df, index.pairs(CFG, CFG.mc_lower), CFG))


def brute_overlaps(rows, seqs, cfg):
    """The round rule in memory: growing reach, one alignment per placement."""
    buckets = {}
    for r in rows:
        buckets.setdefault((r.h0, r.h1), []).append(r)
    buckets = {
        k: sorted(v, key=lambda r: (-r.pos0, r.rid, r.pos1, r.direction))
        for k, v in buckets.items()
        if 2 < len(v) <= cfg.bucket_upper
    }
    text = lambda r: seqs[r.rid] if r.direction == 0 else rc(seqs[r.rid])
    known, tried, links, inner = {}, set(), {}, set()
    active = {(k, i) for k, v in buckets.items() for i in range(len(v))}
    reach, step = 0, cfg.bestn

    def judge(a, b):
        q, t = text(a)[a.pos0 - b.pos0 :], text(b)
        m = kernels.align_batch([q.encode()], [t.encode()], cfg.band)
        qb, qe, tb, te = (int(m[c][0]) for c in ("q_bgn", "q_end", "t_bgn", "t_end"))
        near = cfg.end_fuzz
        ends = abs(len(q) - qe) < near or abs(len(t) - te) < near
        if not (qb < near and tb < near and ends and qe > cfg.min_aligned and te > cfg.min_aligned):
            return None
        if abs(a.len - (qe - qb)) < 2 * near or abs(b.len - (te - tb)) < 2 * near:
            return ("contains", b.rid) if a.len >= b.len else ("contained", a.rid)
        return ("overlap", None)

    while active and reach < cfg.bucket_upper - 1:
        todo = {}
        for k, i in sorted(active):
            for off in range(reach + 1, reach + step + 1):
                if i + off >= len(buckets[k]):
                    break
                a, b = buckets[k][i], buckets[k][i + off]
                if a.rid == b.rid or b.rid in inner:
                    continue
                lo, hi = min(a.rid, b.rid), max(a.rid, b.rid)
                links.setdefault((k, i), []).append((off, (lo, hi)))
                x, y = (a, b) if a.rid < b.rid else (b, a)
                start = x.pos0 - y.pos0
                place = start if x.direction == 0 else x.len - start - y.len
                spot = (lo, hi, a.direction ^ b.direction, place)
                if (lo, hi) in known or spot in tried:
                    continue
                todo.setdefault(spot, (k, i, off, a, b))
        heads = {}
        for spot, link in todo.items():
            cell = (*spot[:3], spot[3] // cfg.end_fuzz)
            heads[cell] = min(heads.get(cell, (link[:3], spot)), (link[:3], spot))
        tried |= set(todo)
        for _, spot in sorted(heads.values()):
            kind = judge(*todo[spot][3:])
            if kind and spot[:2] not in known:
                known[spot[:2]] = kind
        early = {s for _, s in heads.values()}
        for spot, link in sorted(todo.items(), key=lambda x: x[1][:3]):
            if spot[:2] not in known and spot not in early:
                kind = judge(*link[3:])
                if kind:
                    known[spot[:2]] = kind
        inner = {r for _, r in known.values() if r is not None}
        reach, step = reach + step, step * 2
        active = {
            (k, i)
            for k, v in buckets.items()
            for i in range(len(v))
            if i + reach < len(v)
            and v[i].rid not in inner
            and sum(known.get(p, ("",))[0] == "overlap" for _, p in links.get((k, i), [])) < cfg.bestn
        }
    keep = set()
    for seen in links.values():
        good = [p for _, p in sorted(seen) if known.get(p, ("",))[0] == "overlap"]
        keep |= set(good[: cfg.bestn])
    return {p: kind for p, (kind, _) in known.items() if kind != "overlap" or p in keep}


def test_overlaps_follow_the_round_rule(toy, found):
    _, reads, _, index = toy
    rows = index.pairs(CFG, CFG.mc_lower).collect()
    want = brute_overlaps(rows, {r[0]: r[1] for r in reads}, CFG)
    got = {(r.lo, r.hi): overlap.TYPE_NAMES[r.type] for r in found.collect()}
    assert got == want and len(got) > 50


def test_overlaps_are_true_and_complete(spark, toy, found):
    _, reads, _, _ = toy
    placed = spark.createDataFrame([(r[0], r[2], r[3]) for r in reads], "rid long, s long, e long")
    real = truth.true_pairs(placed)
    marked = truth.mark_true(overlap.overlap_records(found), real).agg(F.avg("is_true")).first()[0]
    assert marked == 1.0
    # only the nearest partners of a read are looked for, but every read has some
    flags = truth.mark_found(real, overlap.overlap_records(found)).where("olen > 2000").collect()
    seen = {x for r in flags if r.found for x in (r.lo, r.hi)}
    assert seen == {r[0] for r in reads}
    assert sum(r.found for r in flags) > 0.3 * len(flags)


def test_assembly_recovers_the_genome(toy, found):
    genome, _, df, index = toy
    lay = assemble.lay_out(overlap.overlap_records(found), CFG)
    contigs = lay.primary
    from readloom.operators.layout import stitch_contigs
    from readloom.session import cut_lineage

    draft = cut_lineage(stitch_contigs(contigs, df, CFG))
    rows = {r.ctg: r.seq for r in draft.collect()}
    longest = max(rows.values(), key=len)
    assert len(longest) > 0.85 * len(genome)
    polished = {r.ctg: r.seq for r in assemble.polish_contigs(draft, df, index, CFG).collect()}
    assert polished.keys() == rows.keys()
    # alternates go the same way, also when there are none
    other = stitch_contigs(lay.alternate, df, CFG)
    assert assemble.polish_contigs(other, df, index, CFG).count() == other.count()
    best = max(polished.values(), key=len).upper()

    def distance(seq):
        for s in (seq, rc(seq)):
            for o in range(300, 2000, 50):
                at = genome.find(s[o : o + 40])
                if at >= 0:
                    m = kernels.align_batch([s[o:].encode()], [genome[at:].encode()], 300)
                    return int(m["dist"][0]) / max(int(m["q_end"][0]), 1), int(m["q_end"][0])
        return 1.0, 0

    rate, size = distance(best)
    raw, _ = distance(longest.upper())
    assert size > 0.75 * len(genome)
    assert rate < 0.003 < raw


def test_mapping_places_reads(spark, toy):
    genome, reads, _, index = toy
    ref = spark.createDataFrame([(5, genome)], "rid long, seq string")
    rows = assemble.map_to_contigs(ref, index, CFG).collect()
    where = {r[0]: (r[2], r[3]) for r in reads}
    assert len(rows) > 500
    good = sum(where[r.read_id][0] - 60 <= r.ref_bgn <= where[r.read_id][1] + 60 for r in rows)
    assert good == len(rows)
    ordered = [(r.ref_id, r.ref_bgn) for r in mapping.sort_map(spark.createDataFrame(rows)).collect()]
    assert ordered == sorted(ordered)


def test_mapping_splits_hot_pairs(spark, monkeypatch):
    monkeypatch.setattr(mapping, "SALT_ROWS", 5)
    refs = spark.createDataFrame([(1, 2, i % 3, i * 100, i * 100 + 50) for i in range(40)] + [(3, 4, 1, 5, 9)], "h0 long, h1 long, ref_id long, ref_bgn int, ref_end int")
    hits = spark.createDataFrame([(1, 2, r, 10, 90, 0) for r in range(3)] + [(3, 4, 8, 1, 2, 1)], "h0 long, h1 long, rid long, pos0 int, pos1 int, direction int")
    counts = spark.createDataFrame([(h, h * 10) for h in (1, 2, 3, 4)], "hash long, mc long")
    got = mapping.map_reads(refs, hits, counts)
    assert got.count() == 40 * 3 + 1 and got.distinct().count() == 121


def brute_windows(spots, length, cfg):
    """Bounds and spots of every window; long ones are cut every ``window`` bases."""
    bounds, anchor = [], cfg.window_lead
    for s in spots:
        if s - anchor >= cfg.window:
            bounds.append((anchor, s))
            anchor = s
    if length - anchor > cfg.window_lead or not bounds:
        bounds.append((anchor, length))
    cuts = []
    for a, stop in bounds:
        marks = [a]
        if stop - a >= cfg.window_limit:
            marks += [m for m in range(a + cfg.window, stop, cfg.window) if stop - m > cfg.window_lead]
        cuts += [[x, y, []] for x, y in zip(marks, [*marks[1:], stop])]
    cuts[-1][1] = length
    for s in spots:
        cuts[max((i for i, c in enumerate(cuts) if c[0] <= s), default=0)][2].append(s)
    return cuts


def test_windows_follow_the_anchor_rule(spark):
    cfg = AssemblyConfig(window=500, window_limit=1000, window_lead=50)
    rng = random.Random(8)
    spots, lens = [], {}
    for ctg in range(12):
        lens[ctg] = rng.choice([40, 700, 3000, 5100])
        spots += [(ctg, rng.randrange(max(lens[ctg] - 20, 1)), i) for i in range(rng.choice([1, 4, 60]))]
    mapped = spark.createDataFrame([(c, s, i, 0, 0, 0) for c, s, i in spots], "ref_id long, ref_bgn int, read_id long, read_bgn int, read_end int, direction int").withColumn("ref_end", F.col("ref_bgn"))
    contigs = spark.createDataFrame([(c, "A" * n) for c, n in lens.items()], "rid long, seq string")
    windows, rows = consensus.tile_windows(mapped, contigs, cfg)
    got = sorted((r.ctg, r.win, r.left + cfg.window_lead, r.right) for r in windows.collect())
    in_window = sorted((r.ctg, r.win, r.ref_bgn) for r in rows.collect())
    want, want_rows = [], []
    for ctg, n in lens.items():
        for w, (a, b, group) in enumerate(brute_windows(sorted(s for c, s, _ in spots if c == ctg), n, cfg)):
            want.append((ctg, w, a, b))
            want_rows += [(ctg, w, s) for s in group]
    assert got == sorted(want)
    assert in_window == sorted(want_rows)


def test_offset_groups_are_anchored(spark):
    rows = spark.createDataFrame([(1, 0, 0, 7, 0, b, 0) for b in (100, 140, 151, 160, 230)], "ctg long, win int, left int, read_id long, direction int, ref_bgn int, read_bgn int")
    assert sorted(r["shift"] for r in consensus.read_offsets(rows).collect()) == [100, 151, 230]


def test_consensus_of_a_read_set(spark):
    rng = random.Random(21)
    g = random_seq(rng, 3000)
    copies = [with_errors(rng, g, 0.01) for _ in range(9)]
    reads = [(i, c if i % 2 else rc(c)) for i, c in enumerate(copies)]
    seed = with_errors(rng, g, 0.02)
    out = consensus.read_set_consensus(
        spark.createDataFrame([(0, seed)], "rid long, seq string"), spark.createDataFrame(reads, "rid long, seq string"), 16, 24, 3
    ).first()

    def errors(s):
        return int(kernels.align_batch([s.encode()], [g.encode()], 100)["dist"][0])

    assert errors(out.seq.upper()) < 0.2 * errors(seed)


def test_window_stitching(spark):
    g = random_seq(random.Random(1), 6000)
    df = spark.createDataFrame([(1, 0, g[:2500]), (1, 1, g[1500:4500]), (1, 2, g[3500:])], "ctg long, win int, seq string")
    assert consensus.stitch_windows(df).first().seq == g
    # another lead, and texts shorter than it
    df = spark.createDataFrame([(1, 0, g[:2100]), (1, 1, g[2000:4000]), (2, 0, g[:80]), (2, 1, g[30:2000])], "ctg long, win int, seq string")
    got = {r.ctg: r.seq for r in consensus.stitch_windows(df, tail=100, lead=150).collect()}
    assert got == {1: g[:4000], 2: g[:2000]}


def test_intervals_of_every_length(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), i, s, s + rng.choice([0, 1, 2, 3, 8, 9, 1000, 70_000])) for i, s in enumerate(rng.randrange(-500, 5000) for _ in range(400))]
    # one interval across the whole range and beyond
    rows += [(0, 900, -(1 << 50), 1 << 50), (1, 901, 0, 1 << 40), (0, 902, 7, 8), (0, 902, 7, 8)]
    df = spark.createDataFrame(rows, "key long, id long, s long, e long")
    want = sorted(
        (k, i, s, e, j, x, y) for k, i, s, e in rows for q, j, x, y in rows if k == q and i != j and s < y and x < e and s < e and x < y
    )
    assert sorted(map(tuple, truth.interval_overlaps(df, df).collect())) == want


def test_colinear_chains(spark):
    rng = random.Random(4)
    g = random_seq(rng, 4000)
    df = spark.createDataFrame([(0, g), (1, g[500:3500]), (2, rc(g))], "rid long, seq string")
    sk = sketch.sketch(df, 16, 24, 3, levels=(1,)).cache()
    left = sk.where("rid = 0")
    same = colinear.chain_offsets(colinear.colinear_chains(colinear.shared_minimizers(left, sk.where("rid = 1")))).collect()
    assert len(same) == 1 and same[0].max_offset == same[0].min_offset == 500
    anchors = colinear.shared_minimizers(left, sk.where("rid = 2"), direction=1)
    chains = colinear.chain_offsets(colinear.colinear_chains(anchors, direction=1), direction=1).collect()
    assert max(c.n for c in chains) > 20


def test_xor_minimizers(spark):
    rng = random.Random(12)
    seqs = [random_seq(rng, n) for n in (15, 79, 80, 81, 200, 700)] + ["ACAC" * 60, "A" * 200]
    df = spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string")
    got = sorted((r.rid, r.strand, r.pos, r.hash) for r in kmers.xor_minimizers(df, 64).collect())
    want = []
    for rid, seq in enumerate(seqs):
        for strand, s in ((0, seq), (1, rc(seq))):
            h = []
            for i in range(len(s) - 16):
                code = 0
                for b in s[i : i + 16]:
                    code = code << 2 | "ACGT".index(b)
                h.append(code ^ 0x7ED55D16)
            if len(h) < 64:
                continue
            at = h.index(min(h[:64]))
            want.append((rid, strand, at, h[at]))
            for i in range(64, len(h)):
                if h[i] < h[at]:
                    at = i
                elif i - at >= 64:
                    block = h[at + 1 : at + 65]
                    at = at + 1 + block.index(min(block))
                else:
                    continue
                want.append((rid, strand, at, h[at]))
    assert got == sorted(want)


def test_fasta_and_fastq_in(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first read\nACGT\nAC\n>r2\nTTTT\n")
    (tmp_path / "b.fa").write_text(">r3 x\nGG\n\nCC\n")
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write("@q1 c\nACGT\nACG\n+\n@III\nIII\n@q2\nGGG\n+q2\nII")
    paths = [str(tmp_path / n) for n in ("a.fa", "b.fa", "c.fq.gz")]
    (tmp_path / "all.lst").write_text("\n".join(paths))
    got = [tuple(r) for r in fasta.read_fastx(spark, list_file=str(tmp_path / "all.lst")).orderBy("rid").collect()]
    assert got == [(0, "r1", "first read", "ACGTAC"), (1, "r2", None, "TTTT"), (2, "r3", "x", "GGCC"), (3, "q1", "c", "ACGTACG")]
    plain = [tuple(r) for r in fasta.number_reads(fasta.read_fasta_text(spark, paths[:2])).orderBy("rid").collect()]
    assert plain == got[:3]
    with pytest.raises(Exception, match="quality"):
        spark.read.format("fastx").option("path", paths[2]).option("strict", "true").load().collect()


def test_text_round_trips(spark, tmp_path):
    row = [(1, 2, -500, 99.5, 0, 10, 500, 500, 1, 0, 490, 700, "overlap")]
    df = spark.createDataFrame(row, records.OVERLAP_SCHEMA)
    lines = records.overlap_lines(df)
    assert lines.first().value == "000000001 000000002 -500 99.5 0 10 500 500 1 0 490 700 overlap"
    records.write_lines(lines.unionByName(spark.createDataFrame([("-",)], "value string")), str(tmp_path / "o"))
    assert [tuple(r) for r in records.read_rows(spark, str(tmp_path / "o"), records.OVERLAP_SCHEMA).collect()] == row
    fasta.write_fasta(spark.createDataFrame([("c1", "ACGT" * 20)], "name string, seq string"), str(tmp_path / "f"), width=60)
    assert spark.read.text(str(tmp_path / "f")).count() == 3


def test_best_n_keeps_ties_in_order(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (1, 4, 9)], "lo long, hi long, shared long")
    got = {(r.rid, r.partner): r["rank"] for r in pairs.best_n_per_read(df, 2).collect()}
    assert got[(1, 4)] == 1 and got[(1, 2)] == 2 and (1, 3) not in got
