"""Graph operators against small in-memory restatements."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.operators import bubbles, chains, graph, kmers, unitigs


def flip(n):
    return n[:-1] + ("B" if n[-1] == "E" else "E")


def random_edges(rng, reads, n):
    """Edges closed under reverse complement, both with the same numbers."""
    out = {}
    while len(out) < n:
        a, b = rng.sample(range(reads), 2)
        v, w = f"{a}:{rng.choice('BE')}", f"{b}:{rng.choice('BE')}"
        length, score = rng.randrange(1, 3000), rng.randrange(1000, 9000)
        out[(v, w)] = (length, score)
        out[(flip(w), flip(v))] = (rng.randrange(1, 3000), score)
    return out


def edge_frame(spark, edges):
    rows = [(v, w, w.split(":")[0], length, 0, length, score, 99.0) for (v, w), (length, score) in edges.items()]
    return spark.createDataFrame(
        rows, "v string, w string, rid string, sp int, tp int, length int, score int, identity double"
    )


def keys(df):
    return {(r.v, r.w) for r in df.select("v", "w").collect()}


def closed(pairs):
    return set(pairs) | {(flip(w), flip(v)) for v, w in pairs}


def transitive(edges, fuzz=500):
    out = {}
    for (v, w), (length, _) in edges.items():
        out.setdefault(v, []).append((length, w))
    gone = set()
    for v, outs in out.items():
        outs = sorted(outs)
        limit = outs[-1][0] + fuzz
        state = {w: True for _, w in outs}
        for length, w in outs:
            if state[w]:
                for l2, x in out.get(w, []):
                    if length + l2 < limit and x in state:
                        state[x] = False
        for _, w in outs:
            for i, (l2, x) in enumerate(sorted(out.get(w, []))):
                if (i == 0 or l2 < fuzz) and x in state:
                    state[x] = False
        gone |= {(v, w) for w, alive in state.items() if not alive}
    return closed(gone)


def test_transitive_reduction(spark):
    rng = random.Random(11)
    for reads, n in ((8, 40), (15, 90)):
        edges = random_edges(rng, reads, n)
        assert keys(graph.transitive_edges(edge_frame(spark, edges))) == transitive(edges)


def walk(start, node, out):
    seen, open_ = {start}, {start}
    for _ in range(4):
        if not open_:
            break
        v = min(open_)
        open_.remove(v)
        for w in out.get(v, ()):
            if w != node and w not in seen:
                seen.add(w)
                if out.get(w):
                    open_.add(w)
    return seen


def test_chimeric_nodes(spark):
    rng = random.Random(2)
    found = 0
    for n in (16, 24):
        edges = random_edges(rng, 12, n)
        out, into = {}, {}
        for v, w in edges:
            out.setdefault(v, set()).add(w)
            into.setdefault(w, set()).add(v)
        cand = {w for v in out if len(out[v]) > 1 for w in out[v]} & {v for w in into if len(into[w]) > 1 for v in into[w]}
        want = set()
        for node in cand:
            beside = {x for p in into.get(node, ()) for x in out[p]} - {node}
            a = set().union(*[walk(s, node, out) for s in out.get(node, ())])
            b = set().union(*[walk(s, node, out) for s in beside])
            if not a & b:
                want.add(node)
        df = edge_frame(spark, edges)
        got = {r.node for r in graph.chimer_nodes(df, df).collect()}
        assert got == want
        found += len(want)
    assert found


def test_edges_of_the_four_geometries(spark):
    schema = (
        "rid0 long, rid1 long, score int, identity double, a_bgn int, a_end int, len0 int, strand1 int, b_bgn int, b_end int, len1 int"
    )
    rows = [
        (1, 2, -90, 99.0, 10, 100, 100, 0, 0, 90, 120),
        (3, 4, -90, 99.0, 10, 100, 100, 1, 30, 120, 120),
        (5, 6, -90, 99.0, 0, 90, 100, 0, 30, 120, 120),
        (7, 8, -90, 99.0, 0, 90, 100, 1, 0, 90, 120),
    ]
    got = {(r.v, r.w): (r.rid, r.sp, r.tp, r.length) for r in graph.string_edges(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("2:B", "1:B"): (1, 10, 0, 10), ("1:E", "2:E"): (2, 90, 120, 30),
        ("4:E", "3:B"): (3, 10, 0, 10), ("3:E", "4:B"): (4, 30, 0, 30),
        ("5:B", "6:B"): (6, 30, 0, 30), ("6:E", "5:E"): (5, 90, 100, 10),
        ("7:B", "8:E"): (8, 90, 120, 30), ("8:B", "7:E"): (7, 90, 100, 10),
    }
    assert closed(got) == set(got)


def test_best_edges_and_types(spark):
    edges = random_edges(random.Random(4), 10, 50)
    df = edge_frame(spark, edges)
    best = set()
    for side in (0, 1):
        groups = {}
        for e, (length, score) in edges.items():
            groups.setdefault(e[side], []).append((-score, length, e[1 - side], e))
        best |= {min(g)[3] for g in groups.values()}
    assert keys(graph.not_best_edges(df)) == closed(set(edges) - best)
    typed = graph.reduce_graph(df, AssemblyConfig()).collect()
    assert len(typed) == len(edges)
    kept = {(r.v, r.w) for r in typed if r.type == "G"}
    assert closed(kept) == kept
    assert transitive(edges) & set(edges) >= {(r.v, r.w) for r in typed if r.type == "TR"}


def test_lists_and_rings(spark):
    lists = [[f"a{i:03d}" for i in range(37)], ["solo"], [f"b{i}" for i in range(2)]]
    ring = [f"r{i}" for i in (5, 2, 7, 1, 9)]
    rows = [(x, p, x + "'") for l in lists for p, x in zip([None] + l, l)]
    rows += [(x, ring[i - 1], x + "'") for i, x in enumerate(ring)]
    links = spark.createDataFrame(rows, "item string, prev string, mirror string")
    got = {r.item: (r.head, r["rank"]) for r in chains.rank_chains(links).collect()}
    want = {x: (l[0], i) for l in lists for i, x in enumerate(l)}
    want |= {x: ("r1", i) for i, x in enumerate(["r1", "r9", "r5", "r2", "r7"])}
    assert got == want


def test_greedy_claims_equal_the_sequential_pass(spark):
    rng = random.Random(9)
    owners = {f"o{i:02d}": (rng.randrange(4), set(rng.sample(range(25), rng.randrange(1, 5)))) for i in range(20)}
    taken, want = set(), set()
    for size, owner in sorted((s, o) for o, (s, _) in owners.items()):
        if not owners[owner][1] & taken:
            want.add(owner)
            taken |= owners[owner][1]
    df = spark.createDataFrame(
        [(o, s, r) for o, (s, res) in owners.items() for r in res], "owner string, size int, resource int"
    )
    assert {r.owner for r in chains.greedy_claims(df, ["size"]).collect()} == want


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    df = spark.createDataFrame(pairs, "v int, w int")
    assert {r.node: r.component for r in kmers.weak_components(df).collect()} == label


def table(spark, rows):
    return spark.createDataFrame(
        [(f"{s}>{via}", s, t, via if via != "NA" else None, ln, sc, 1, via, "simple") for s, via, t, ln, sc in rows],
        "head string, s string, t string, pre_t string, length long, score long, n_edges long, via string, type string",
    )


def with_mirrors(rows):
    return rows + [(flip(t), flip(via), flip(s), ln, sc) for s, via, t, ln, sc in rows]


def test_spur_goes_and_main_path_stays(spark):
    rows = with_mirrors(
        [("1:E", "x1:E", "2:E", 90000, 10), ("2:E", "x2:E", "3:E", 90000, 10), ("9:E", "x9:E", "2:E", 800, 5)]
    )
    got = {(r.s, r.t) for r in unitigs.spur_unitigs(table(spark, rows), 50_000).collect()}
    assert got == {("9:E", "2:E"), ("2:B", "9:B")}


def test_two_short_tips_do_not_both_go(spark):
    rows = with_mirrors([("1:E", "x1:E", "2:E", 900, 10), ("2:E", "x2:E", "3:E", 90000, 10), ("9:E", "x9:E", "2:E", 800, 5)])
    got = {(r.s, r.t) for r in unitigs.spur_unitigs(table(spark, rows), 50_000).collect()}
    assert got == {("9:E", "2:E"), ("2:B", "9:B")}


BUBBLE = [
    ("1:E", "a:E", "2:E", 5000, 50),
    ("2:E", "b:E", "3:E", 1000, 20),
    ("2:E", "c:E", "3:E", 1100, 30),
    ("3:E", "d:E", "4:E", 5000, 50),
]


def test_bubble_becomes_a_compound(spark):
    t = table(spark, with_mirrors(BUBBLE))
    found, edges = bubbles.compound_unitigs(t)
    comp = {(r.s, r.t): r for r in found.collect()}
    assert set(comp) == {("2:E", "3:E"), ("3:B", "2:B")}
    r = comp[("2:E", "3:E")]
    assert (r.length, r.score, r.n_edges) == (1100, 30, 2)
    assert {(e.s, e.via, e.t) for e in edges.where("bs = '2:E'").collect()} == {("2:E", "b:E", "3:E"), ("2:E", "c:E", "3:E")}


def plain_bundle(steps, fork):
    """Edges from a fork up to the nearest node that everything behind it must pass, or None."""
    out, into = {}, {}
    for s, via, t in steps:
        out.setdefault(s, []).append((s, via, t))
        into.setdefault(t, []).append(s)
    found = []
    for end in into:
        inner, todo = {fork}, [fork]
        while todo:
            for _, _, t in out.get(todo.pop(), []):
                if t not in inner and t != end:
                    inner.add(t)
                    todo.append(t)
        closed = all(out.get(n) and all(s in inner for s in into.get(n, []) if n != fork) for n in inner)
        order, left = set(), set(inner) - {fork}
        while (free := {n for n in left if all(s == fork or s in order for s in into[n])}):
            order, left = order | free, left - free
        if end != fork and closed and not left and not any(s in inner for s in into.get(fork, [])):
            found.append((len(inner), end, sorted(e for n in inner for e in out[n])))
    return min(found)[1:] if found else None


def test_bundles_of_random_graphs(spark):
    rng = random.Random(9)
    steps, fork_of = [], {}
    for g in range(150):
        n = rng.randrange(3, 9)
        own = []
        for k in range(rng.randrange(3, 14)):
            a, b = rng.randrange(n), rng.randrange(n)
            a, b = (a, b) if a < b or rng.random() < 0.05 else (b, a)
            if a != b:
                own.append((f"{g}.{a}:E", f"{g}.v{k}:E", f"{g}.{b}:E"))
        steps += own
        outs = [s for s, _, _ in own]
        fork_of |= {s: own for s in outs if outs.count(s) > 1}
    # a bubble deeper, wider and longer than any limit that was once built in
    deep = [("z:E", f"z{i}:E", f"z{i}.0:E") for i in range(6)]
    deep += [(f"z{i}.{k}:E", f"z{i}.v{k}:E", f"z{i}.{k + 1}:E" if k < 7 else "end:E") for i in range(6) for k in range(8)]
    steps += deep
    fork_of["z:E"] = deep
    t = table(spark, [(s, via, t, 200_000, 7) for s, via, t in steps])
    found, edges = bubbles.bundles(t)
    got = {}
    for r in edges.collect():
        got.setdefault(r.bs, [r.bt, []])[1].append((r.s, r.via, r.t))
    want = {f: plain_bundle(own, f) for f, own in fork_of.items()}
    assert {f: (end, sorted(es)) for f, (end, es) in got.items()} == {f: w for f, w in want.items() if w}
    assert len(got) > 40 and {r.s: r.length for r in found.collect()}["z:E"] == 1_800_000
    assert "z:E" not in {r.s for r in bubbles.bundles(t, longest=500_000).found.collect()}


def test_bundle_paths_and_contig(spark):
    t = table(spark, with_mirrors(BUBBLE))
    comp = bubbles.compound_unitigs(t)
    got = sorted((r.s, r.alt, r.evia) for r in bubbles.bundle_paths(comp, t).collect() if r.s == "2:E")
    assert got == [("2:E", 0, "c:E"), ("2:E", 1, "b:E")]
    inside = comp.edges.select("s", "via", "t").withColumn("hit", F.lit(1))
    full = t.join(inside, ["s", "via", "t"], "left").where("hit is null").drop("hit")
    full = full.unionByName(
        comp.found.select(
            F.lit(None).cast("string").alias("head"), "s", "t", F.lit(None).cast("string").alias("pre_t"), "length", "score",
            F.lit(None).cast("long").alias("n_edges"), F.lit("NA").alias("via"), F.lit("compound").alias("type"),
        )
    )
    best = spark.createDataFrame([], "w string, best_in string")
    rows = unitigs.contig_paths(full, comp, best).collect()
    steps = [(r.s, r.via, r.t) for r in sorted(rows, key=lambda r: r.ord)]
    assert {r.ctg for r in rows} == {"000000F"} and len(steps) == 3 and steps[1][1] == "NA"


def test_unitig_of_a_simple_chain_and_a_ring(spark):
    chain = [("1:E", "2:E"), ("2:E", "3:E"), ("3:E", "4:E")]
    ring = [("7:E", "8:E"), ("8:E", "9:E"), ("9:E", "7:E")]
    edges = {e: (100, 10) for e in closed(chain + ring)}
    members = unitigs.unitig_members(edge_frame(spark, edges).withColumn("best_in", F.lit(None).cast("string")))
    rows = {(r.s, r.via, r.t, r.length, r.n_edges) for r in unitigs.unitigs(members).collect()}
    linear = {x for x in rows if x[0] != x[2]}
    assert linear == {("1:E", "2:E", "4:E", 300, 3), ("4:B", "2:B", "1:B", 300, 3)}
    closed_ = rows - linear
    assert {(flip(t), flip(via), flip(s)) for s, via, t, _, _ in closed_} == {x[:3] for x in closed_} and len(closed_) == 2
