"""Registered queries: one per operator, over the whole of the given tables.

``QUERIES`` maps a name to a function of the shared frames; ``SQL`` holds the
DuckDB statement for those that SQL can express in reasonable time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.config import AssemblyConfig
from readloom.functions import sequence as sq
from readloom.operators import (
    align, colinear, consensus, dimers, graph, kmers, layout, mapping, overlap, pairs, sketch, truth, unitigs,
)
from readloom.plans.frames import (
    BESTN, END_LENGTH, K, MIN_DISTANCE, REDUCTION, W, Frames,
)
from readloom.plans.oracle import STEPS, _mixed, both, flip, statement
from readloom.sources.fasta import fasta_records

QUERIES: dict[str, Callable[[Frames], DataFrame]] = {}
SQL: dict[str, str] = {}

# document lengths call for smaller limits than long reads
CFG = AssemblyConfig(
    k=K, w=W, reduction=REDUCTION, min_pair_distance=MIN_DISTANCE, min_len=300, min_aligned=100,
    window=5_000, window_limit=10_000, window_lead=100, spur_first=2_000, spur_second=3_000, repeat_bridge=2_000,
    min_coverage=1.0,
)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = statement(sql)
        return fn

    return add


LEVEL = ["rid", "idx", "pos", "strand", "hash", "span", "len"]
LEVEL_SQL = ", ".join(LEVEL)
PAIR = ["h0", "span0", "h1", "span1", "rid", "len", "pos0", "strand0", "pos1", "strand1", "direction"]
PAIR_SQL = ", ".join(PAIR)
LABEL = "upper(lpad(format('{:x}', hash), 14, '0'))"

# -- sequences and scalar functions ------------------------------------------


@query("SELECT rid, seq, length(seq) AS len FROM reads")
def reads_view(f):
    return f.reads.select("rid", "seq", F.length("seq").alias("len"))


@query("SELECT rid, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM reads")
def reverse_complement(f):
    return f.reads.select("rid", sq.reverse_complement("seq").alias("rc"))


@query("SELECT rid, seq AS forward, reverse(translate(seq, 'ACGT', 'TGCA')) AS backward FROM reads")
def two_strand_codes(f):
    codes = f.reads.select("rid", sq.two_strand_codes(F.col("seq")).alias("codes"))
    return codes.select(
        "rid",
        sq.decode_two_strand(F.col("codes"), F.lit(0)).alias("forward"),
        sq.decode_two_strand(F.col("codes"), F.lit(1)).alias("backward"),
    )


@query(
    """SELECT rid, count(*) AS n, CAST(sum(f % 1000003) AS BIGINT) AS code_sum, CAST(sum(r % 1000003) AS BIGINT) AS rcode_sum,
         min(pos) - 15 AS first_pos, max(f) AS max_code FROM lkmer GROUP BY rid"""
)
def kmer_codes(f):
    return (
        kmers.kmer_rows(f.reads, K)
        .groupBy("rid")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("code") % 1000003).alias("code_sum"),
            F.sum(F.col("rcode") % 1000003).alias("rcode_sum"),
            F.min("pos").alias("first_pos"),
            F.max("code").alias("max_code"),
        )
    )


@query(
    f"""SELECT rid, CAST(sum(x) AS BIGINT) AS hash_sum, min(x) AS hash_min, max(x) AS hash_max
        FROM ({_mixed("SELECT rid, least(f, r) AS key FROM lkmer", "key", "rid")}) GROUP BY rid"""
)
def kmer_hash(f):
    h = kmers.kmer_rows(f.reads, K).select("rid", sq.mix_hash(F.least("code", "rcode"), K).alias("h"))
    return h.groupBy("rid").agg(F.sum("h").alias("hash_sum"), F.min("h").alias("hash_min"), F.max("h").alias("hash_max"))


@query(
    f"""SELECT rid, pos - 15 AS pos, xor(f, {sq.XOR_KEY}) AS hash, substr(seq, pos - 14, 16) AS text
        FROM ckmer JOIN contigs USING (rid)"""
)
def xor_kmers(f):
    h = kmers.kmer_rows(f.contigs, sq.XOR_K).select("rid", "pos", sq.xor_hash(F.col("code")).alias("hash"))
    return h.withColumn("text", sq.decode_xor_hash(F.col("hash")))


@query(
    f"SELECT rid, pos, {LABEL} AS label, substr(seq, pos - span + 2, span) AS text, len - (pos + 1) + span - 1 AS rpos"
    " FROM l2 JOIN reads USING (rid)"
)
def minimizer_labels(f):
    return f.level(2).join(f.reads, "rid").select(
        "rid",
        "pos",
        sq.hash_label(F.col("hash")).alias("label"),
        sq.minimizer_text(F.col("seq"), F.col("pos"), F.col("span")).alias("text"),
        sq.mirrored_position(F.col("len"), F.col("pos"), F.col("span")).alias("rpos"),
    )


@query(
    """SELECT conv_id, turn, regexp_extract(text, '^(\\S*)') AS id,
         CASE WHEN regexp_matches(text, '\\s') THEN regexp_extract(text, '^\\S*\\s([\\s\\S]*)$', 1) END AS metadata FROM conversations"""
)
def header_split(f):
    c = f.table("conversations")
    return c.select("conv_id", "turn", sq.header_id(F.col("text")).alias("id"), sq.header_metadata(F.col("text")).alias("metadata"))


@query(
    """SELECT '>' || rid || chr(10) || regexp_replace(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value
       FROM reads"""
)
def fasta_wrapped(f):
    return fasta_records(f.reads, "rid", 60)


@query(
    """SELECT l_orderkey, l_linenumber, (CAST(l_partkey AS BIGINT) << 32) + (CAST(l_linenumber AS BIGINT) << 8) + ascii(l_returnflag) AS tag
       FROM lineitem"""
)
def packed_tags(f):
    li = f.table("lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", sq.packed_tag(F.col("l_partkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("tag")
    )


# -- sketches and counts ------------------------------------------------------


@query(f"SELECT {LEVEL_SQL} FROM l0")
def minimizers_l0(f):
    return f.level(0).select(*LEVEL)


@query(f"SELECT {LEVEL_SQL} FROM l1")
def minimizers_l1(f):
    return f.level(1).select(*LEVEL)


@query(f"SELECT {LEVEL_SQL} FROM l2")
def minimizers_l2(f):
    return f.level(2).select(*LEVEL)


@query(f"SELECT {LEVEL_SQL} FROM l1")
def reduce_by_window(f):
    return sketch.reduce_level(f.level(0).select(*LEVEL), REDUCTION)


@query("SELECT hash, mc FROM counts")
def minimizer_counts(f):
    return sketch.minimizer_counts(f.level(2))


@query("SELECT hash, mc FROM counts")
def merged_counts(f):
    chunk = F.pmod("rid", F.lit(4))
    return sketch.merge_counts([sketch.minimizer_counts(f.level(2).where(chunk == c)) for c in range(4)])


@query("SELECT rid, idx, hash, mc FROM l2 JOIN counts USING (hash)")
def annotate_counts(f):
    return sketch.annotate_counts(f.level(2), f.counts).select("rid", "idx", "hash", "mc")


@query("SELECT rid, idx, hash, mc FROM bounded")
def count_filtered(f):
    return f.bounded.select("rid", "idx", "hash", "mc")


@query(
    """SELECT rid, level, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, max(len) AS len,
         CASE WHEN count(*) > 1 THEN max(len) / (count(*) - 1) END AS mean_distance
       FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY rid, level"""
)
def sketch_extent(f):
    return sketch.sketch_extent(f.levels)


@query(
    """SELECT level, count(*) AS n, count(DISTINCT rid) AS reads, count(DISTINCT hash) AS distinct_hashes,
         round(sum(len_once) / count(*), 6) AS bases_per_minimizer
       FROM (SELECT *, CASE WHEN idx = 0 THEN len ELSE 0 END AS len_once FROM
             (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)) GROUP BY level"""
)
def sketch_metrics(f):
    once = f.levels.withColumn("once", F.when(F.col("idx") == 0, F.col("len")).otherwise(0))
    return once.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("rid").alias("reads"),
        F.countDistinct("hash").alias("distinct_hashes"),
        F.round(F.sum("once") / F.count(F.lit(1)), 6).alias("bases_per_minimizer"),
    )


@query("SELECT count(*) AS hashes, round(avg(mc), 6) AS mean_count, median(mc) AS median_count, max(mc) AS max_count FROM counts")
def count_metrics(f):
    return f.counts.agg(
        F.count(F.lit(1)).alias("hashes"),
        F.round(F.avg("mc"), 6).alias("mean_count"),
        F.median("mc").alias("median_count"),
        F.max("mc").alias("max_count"),
    )


ENDS = f"""SELECT rid, pos, hash, 5 AS e FROM bounded WHERE pos + 1 < {END_LENGTH}
    UNION ALL SELECT rid, pos, hash, 3 FROM bounded WHERE len - (pos + 1) + span < {END_LENGTH}"""


@query(f'SELECT rid, pos, hash, e AS "end" FROM ({ENDS})')
def end_minimizers(f):
    return sketch.end_minimizers(f.bounded, END_LENGTH).select("rid", "pos", "hash", "end")


HOLDS = f"SELECT DISTINCT e.rid AS r, e.e, b.rid AS other FROM ({ENDS}) e JOIN bounded b ON b.hash = e.hash AND b.rid <> e.rid"
DOVETAIL = f"SELECT a.r AS rid0, a.e AS end0, a.other AS rid1, b.e AS end1 FROM ({HOLDS}) a JOIN ({HOLDS}) b ON a.r = b.other AND a.other = b.r"


@query(DOVETAIL)
def dovetail_pairs(f):
    return dimers.dovetail_pairs(f.bounded, END_LENGTH)


# -- pairs and candidates -----------------------------------------------------


@query(f"SELECT {PAIR_SQL} FROM adjacent")
def adjacent_pairs(f):
    return f.adjacent.select(*PAIR)


@query(f"SELECT {PAIR_SQL} FROM mirrored")
def mirrored_pairs(f):
    return f.mirrored.select(*PAIR)


@query("SELECT h0, h1, n FROM sizes")
def pair_buckets(f):
    return pairs.bucket_sizes(f.mirrored)


@query("SELECT h0, h1, ord, n, rid, pos0, pos1, direction FROM rows")
def bucket_rows(f):
    return f.rows.select("h0", "h1", "ord", "n", "rid", "pos0", "pos1", "direction")


@query("SELECT h0, h1, ord, off, rid0, rid1, at0, at1, dir0, dir1, lo, hi, rel, place FROM links")
def partner_links(f):
    return f.links.select("h0", "h1", "ord", "off", "rid0", "rid1", "at0", "at1", "dir0", "dir1", "lo", "hi", "rel", "place")


@query("SELECT DISTINCT lo, hi FROM links")
def candidate_pairs(f):
    return pairs.candidate_pairs(f.rows, BESTN)


def _shared(f):
    return f.links.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT rid, count(DISTINCT partner) AS partners FROM (SELECT lo AS rid, hi AS partner FROM links UNION ALL SELECT hi, lo FROM links) GROUP BY rid")
def candidates_per_read(f):
    ends = F.explode(F.array(F.struct(F.col("lo").alias("rid"), F.col("hi").alias("p")), F.struct(F.col("hi").alias("rid"), F.col("lo").alias("p"))))
    return f.links.select(ends.alias("e")).select("e.*").groupBy("rid").agg(F.countDistinct("p").alias("partners"))


@query(
    f"""SELECT rid, partner, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY shared DESC, partner) AS rank FROM
         (SELECT lo AS rid, hi AS partner, shared FROM shared UNION ALL SELECT hi, lo, shared FROM shared)) WHERE rank <= {BESTN}"""
)
def best_n_candidates(f):
    return pairs.best_n_per_read(_shared(f), BESTN)


@query(
    """SELECT lo, hi, h0, h1, ord, off, place FROM (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY h0, h1, ord, off) AS nth FROM links)
       WHERE nth = 1"""
)
def first_per_pair(f):
    cols = ["lo", "hi", "h0", "h1", "ord", "off", "place"]
    return pairs.first_per_pair(f.links.select(*cols), ["lo", "hi"], ["h0", "h1", "ord", "off"])


# -- mapping ------------------------------------------------------------------


@query("SELECT ref_id, ref_bgn, ref_end, read_id, read_bgn, read_end, direction, mc0, mc1 FROM mapped")
def map_reads(f):
    return f.mapped


@query("SELECT ref_id, ref_bgn, ref_end, read_id, read_bgn, read_end, direction, mc0, mc1 FROM mapped ORDER BY ref_id, ref_bgn")
def map_sorted(f):
    return mapping.sort_map(f.mapped)


# -- overlap records ----------------------------------------------------------

# synthetic match rows over the whole lineitem table: lengths and ends from its numbers
MATCH_SQL = """SELECT l_orderkey, l_linenumber, l_partkey AS rid0, l_suppkey AS rid1, 5000 + l_partkey AS len0, 5200 + l_suppkey AS len1,
    700 + CAST(l_quantity AS INT) AS at0, 300 + l_linenumber AS at1, l_linenumber % 2 AS dir0, CAST(l_orderkey % 2 AS INT) AS dir1,
    CAST(l_quantity AS INT) % 48 AS q_bgn, l_linenumber * 5 AS t_bgn, 4300 + l_partkey % 400 AS q_end, 4300 + l_suppkey % 400 AS t_end,
    4000 + l_partkey % 300 AS m_size, CAST(l_orderkey % 90 AS INT) AS dist, l_linenumber % 3 AS type FROM lineitem"""


def _match_rows(f):
    n = F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    return f.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("rid0"),
        F.col("l_suppkey").alias("rid1"),
        (5000 + F.col("l_partkey")).alias("len0"),
        (5200 + F.col("l_suppkey")).alias("len1"),
        (700 + q).alias("at0"),
        (300 + n).alias("at1"),
        (n % 2).alias("dir0"),
        (F.col("l_orderkey") % 2).cast("int").alias("dir1"),
        (q % 48).alias("q_bgn"),
        (n * 5).alias("t_bgn"),
        (4300 + F.col("l_partkey") % 400).alias("q_end"),
        (4300 + F.col("l_suppkey") % 400).alias("t_end"),
        (4000 + F.col("l_partkey") % 300).alias("m_size"),
        (F.col("l_orderkey") % 90).cast("int").alias("dist"),
        (n % 3).alias("type"),
    )


@query(
    f"""SELECT rid0, rid1, -m_size AS score, round(100.0 - 100.0 * dist / m_size, 1) AS identity, 0 AS strand0,
          greatest(CASE WHEN dir0 = 0 THEN at0 - at1 + q_bgn - t_bgn ELSE len0 - (at0 - at1) - q_end END, 0) AS a_bgn,
          least(CASE WHEN dir0 = 0 THEN at0 - at1 + q_end ELSE len0 - (at0 - at1) - (q_bgn - t_bgn) END, len0) AS a_end, len0,
          CASE WHEN dir0 = 0 THEN dir1 ELSE 1 - dir1 END AS strand1,
          greatest(CASE WHEN dir1 = 0 THEN 0 ELSE len1 - t_end END, 0) AS b_bgn,
          least(CASE WHEN dir1 = 0 THEN t_end ELSE len1 END, len1) AS b_end, len1,
          CASE type WHEN 0 THEN 'overlap' WHEN 1 THEN 'contains' ELSE 'contained' END AS type
        FROM ({MATCH_SQL})"""
)
def overlap_coords(f):
    return overlap.overlap_records(_match_rows(f))


@query(
    f"""SELECT rid0, rid1, m_size, dist FROM (SELECT *, row_number() OVER (PARTITION BY least(rid0, rid1), greatest(rid0, rid1)
          ORDER BY l_orderkey, l_linenumber) AS nth FROM ({MATCH_SQL})) WHERE nth = 1"""
)
def overlap_dedup(f):
    rows = _match_rows(f).select("rid0", "rid1", "m_size", "dist", "l_orderkey", "l_linenumber")
    return overlap.unique_pairs(rows, ["l_orderkey", "l_linenumber"]).select("rid0", "rid1", "m_size", "dist")


RECORD = ["rid0", "rid1", "score", "a_bgn", "a_end", "len0", "strand1", "b_bgn", "b_end", "len1", "type"]


@query(f"SELECT {', '.join(RECORD)} FROM projected")
def projected_overlaps(f):
    return f.projected.select(*RECORD)


INNER = "SELECT rid1 AS rid FROM projected WHERE type = 'contains' UNION SELECT rid0 FROM projected WHERE type = 'contained'"


@query(
    f"""SELECT {', '.join(RECORD)} FROM projected WHERE type = 'overlap' AND len0 >= 300 AND len1 >= 300
          AND rid0 NOT IN ({INNER}) AND rid1 NOT IN ({INNER})"""
)
def contained_antijoin(f):
    return graph.usable_overlaps(f.projected, 300, 96.0).select(*RECORD)


# -- string graph -------------------------------------------------------------


@query("SELECT v, w, rid, sp, tp, length, score FROM sedges")
def edge_construct(f):
    return f.edges.select("v", "w", "rid", "sp", "tp", "length", "score")


@query(both("sedges"))
def edge_complements(f):
    return graph.complemented(f.edges)


@query(
    """SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM
       (SELECT v AS node, 0 AS i, 1 AS o FROM sedges UNION ALL SELECT w, 1, 0 FROM sedges) GROUP BY node"""
)
def node_degrees(f):
    return kmers.degrees(f.edges)


@query("SELECT v, w FROM tr")
def transitive_edges(f):
    return graph.transitive_edges(f.edges)


def _after_tr(f):
    return graph._minus(f.edges, f.transitive)


@query(
    """SELECT v, w, CASE WHEN o = 1 THEN 1 ELSE 0 END AS best_out, CASE WHEN i = 1 THEN 1 ELSE 0 END AS best_in FROM
       (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, length, w) AS o,
               row_number() OVER (PARTITION BY w ORDER BY score DESC, length, v) AS i FROM afterTr) WHERE o = 1 OR i = 1"""
)
def best_edges(f):
    out, into = graph.best_edges(_after_tr(f))
    both_ = out.withColumn("o", F.lit(1)).withColumn("i", F.lit(0)).unionByName(into.withColumn("o", F.lit(0)).withColumn("i", F.lit(1)))
    return both_.groupBy("v", "w").agg(F.max("o").alias("best_out"), F.max("i").alias("best_in"))


@query("SELECT v, w FROM notbest")
def best_overlap_filter(f):
    return graph.not_best_edges(_after_tr(f))


@query(
    """SELECT v, w, CASE WHEN t.hit THEN 'TR' WHEN b.hit THEN 'R' ELSE 'G' END AS type FROM sedges
       LEFT JOIN (SELECT v, w, true AS hit FROM tr) t USING (v, w) LEFT JOIN (SELECT v, w, true AS hit FROM notbest) b USING (v, w)"""
)
def edge_types(f):
    marks = f.transitive.withColumn("type", F.lit("TR")).unionByName(
        graph.not_best_edges(_after_tr(f)).withColumn("type", F.lit("R"))
    )
    return f.edges.select("v", "w").join(marks, ["v", "w"], "left").select("v", "w", F.coalesce("type", F.lit("G")).alias("type"))


SPURS = """SELECT v, w FROM afterTr WHERE v IN (SELECT v FROM afterTr GROUP BY v HAVING count(*) > 1) AND w NOT IN (SELECT v FROM sedges)
    UNION SELECT v, w FROM afterTr WHERE w IN (SELECT w FROM afterTr GROUP BY w HAVING count(*) > 1) AND v NOT IN (SELECT w FROM sedges)"""


@query(both(f"({SPURS})"))
def spur_edges(f):
    return graph.spur_edges(f.edges, _after_tr(f))


@query(
    """SELECT DISTINCT node FROM (SELECT w AS node FROM afterTr WHERE v IN (SELECT v FROM afterTr GROUP BY v HAVING count(*) >= 2))
       WHERE node IN (SELECT v FROM afterTr WHERE w IN (SELECT w FROM afterTr GROUP BY w HAVING count(*) >= 2))"""
)
def chimer_candidates(f):
    return graph.chimer_candidates(f.edges, _after_tr(f))


@query()
def chimer_edges(f):
    return graph.chimer_edges(f.edges, _after_tr(f))


PLAIN = """SELECT v AS node FROM afterTr GROUP BY v HAVING count(*) = 1 INTERSECT SELECT w FROM afterTr GROUP BY w HAVING count(*) = 1"""


def _flow(src: str, dst: str) -> str:
    return f"""SELECT r.{src} AS {src}, r.{dst} AS {dst} FROM ({PLAIN}) p JOIN afterTr s ON s.{dst} = p.node JOIN afterTr r ON r.{src} = s.{src} AND r.{dst} <> p.node
      WHERE r.{dst} IN (SELECT {dst} FROM afterTr GROUP BY {dst} HAVING count(*) > 1) AND r.{dst} NOT IN ({PLAIN})
        AND NOT EXISTS (SELECT 1 FROM sedges x JOIN sedges y ON x.{dst} = y.{dst} WHERE x.{src} = p.node AND y.{src} = r.{dst})"""


@query(f"SELECT v, w FROM ({_flow('v', 'w')}) UNION SELECT v, w FROM ({_flow('w', 'v')})")
def local_flow_edges(f):
    return graph.local_flow_edges(f.edges, _after_tr(f))


@query(f"SELECT v AS s, v AS via, w AS t FROM bridge UNION SELECT {flip('w')}, {flip('v')}, {flip('v')} FROM bridge")
def repeat_bridges(f):
    g = _after_tr(f).select(F.col("v").alias("s"), F.col("v").alias("via"), F.col("w").alias("t"), "length")
    return unitigs.repeat_bridges(g, 60_000)


@query(
    """SELECT s, via, t FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY via) AS nth FROM
         (SELECT l_partkey AS s, l_suppkey AS t, printf('%08d-%d', l_orderkey, l_linenumber) AS via, l_linenumber AS n_edges FROM lineitem)
         WHERE n_edges <= 2) WHERE nth > 1"""
)
def dup_simple_paths(f):
    table = f.table("lineitem").select(
        F.col("l_partkey").alias("s"),
        F.col("l_suppkey").alias("t"),
        F.format_string("%08d-%d", "l_orderkey", "l_linenumber").alias("via"),
        F.col("l_linenumber").alias("n_edges"),
        F.lit("simple").alias("type"),
    )
    return unitigs.duplicate_unitigs(table)


@query("SELECT head, rank, v, w, length, score FROM walk JOIN live USING (v, w)")
def unitig_edges(f):
    members = unitigs.unitig_members(f.live.withColumn("best_in", F.lit(None).cast("string")))
    return members.select("head", "rank", "v", "w", "length", "score")


UNITIG_SQL = f"""SELECT s, CASE WHEN head <= mirror THEN post ELSE pre END AS via, t, length, score, n_edges FROM (
    SELECT *, ({flip('t')}) || '>' || ({flip('pre')}) AS mirror FROM (
      SELECT head, arg_min(v, rank) AS s, arg_min(w, rank) AS post, arg_max(v, rank) AS pre, arg_max(w, rank) AS t,
             CAST(sum(length) AS BIGINT) AS length, CAST(sum(score) AS BIGINT) AS score, count(*) AS n_edges
      FROM walk JOIN live USING (v, w) GROUP BY head))"""


@query(UNITIG_SQL)
def unitig_table(f):
    members = unitigs.unitig_members(f.live.withColumn("best_in", F.lit(None).cast("string")))
    return unitigs.unitigs(members).select("s", "via", "t", "length", "score", "n_edges")


# -- k-mer graph, seeds, components -------------------------------------------

STEP_SQL = """SELECT user_id AS rid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_id, value,
    event_type || '-' || CAST(floor(value) AS BIGINT) AS kmer FROM events"""
EDGE_SQL = f"""SELECT v, w, count(*) AS multiplicity FROM (SELECT lag(kmer) OVER (PARTITION BY rid ORDER BY ord) AS v, kmer AS w FROM ({STEP_SQL}))
    WHERE v IS NOT NULL AND v IN (SELECT kmer FROM ({STEP_SQL}) GROUP BY kmer HAVING count(*) > 5 AND count(*) < 60)
      AND w IN (SELECT kmer FROM ({STEP_SQL}) GROUP BY kmer HAVING count(*) > 5 AND count(*) < 60) GROUP BY v, w"""


@query(f"SELECT rid, ord, kmer, count(*) OVER (PARTITION BY kmer) AS mc FROM ({STEP_SQL})")
def kmer_counts(f):
    steps = f.user_steps.select("rid", "ord", "kmer")
    return steps.join(steps.groupBy("kmer").agg(F.count(F.lit(1)).alias("mc")), "kmer").select("rid", "ord", "kmer", "mc")


@query(EDGE_SQL)
def kmer_graph_edges(f):
    return kmers.kmer_edges(f.user_steps)


PRUNE_SQL = f"""WITH e AS ({EDGE_SQL}),
    deg AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT v AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT w, 1, 0 FROM e) GROUP BY node),
    fork AS (SELECT node FROM deg WHERE i > 1 OR o > 1),
    linked AS (SELECT unnest([v, w]) AS node FROM e WHERE v <> w AND v NOT IN (SELECT node FROM fork) AND w NOT IN (SELECT node FROM fork)),
    kept AS (SELECT * FROM e WHERE v IN (SELECT node FROM fork UNION SELECT node FROM linked) AND w IN (SELECT node FROM fork UNION SELECT node FROM linked)),
    alive AS (SELECT node FROM (SELECT v AS node, 0 AS i, 1 AS o FROM kept UNION ALL SELECT w, 1, 0 FROM kept) GROUP BY node HAVING sum(i) > 0 AND sum(o) > 0)
    SELECT v, w, multiplicity FROM kept WHERE v IN (SELECT node FROM alive) AND w IN (SELECT node FROM alive)"""


@query(PRUNE_SQL)
def kmer_graph_pruned(f):
    return kmers.pruned_kmer_graph(kmers.kmer_edges(f.user_steps))


STEPS["pruned"] = PRUNE_SQL
STEPS["prunedways"] = "SELECT v, w FROM pruned UNION SELECT w, v FROM pruned"
STEPS["prunedreach"] = "SELECT v AS node, v AS label FROM prunedways UNION SELECT u.w, r.label FROM prunedreach r JOIN prunedways u ON u.v = r.node"
STEPS["prunedlabel"] = "SELECT node, min(label) AS component FROM prunedreach GROUP BY node"


@query(
    """SELECT l.node, component, in_degree, out_degree, count(*) OVER (PARTITION BY component) AS size FROM prunedlabel l JOIN
         (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM
            (SELECT v AS node, 0 AS i, 1 AS o FROM pruned UNION ALL SELECT w, 1, 0 FROM pruned) GROUP BY node) d ON d.node = l.node"""
)
def kmer_graph_components(f):
    return kmers.component_report(kmers.pruned_kmer_graph(kmers.kmer_edges(f.user_steps)))


SIMPLE_LINKS = "SELECT DISTINCT CAST(lo AS VARCHAR) AS v, CAST(hi AS VARCHAR) AS w FROM links"


@query("SELECT node, min(label) AS component FROM reach GROUP BY node")
def weak_components(f):
    linked = f.links.select(F.col("lo").cast("string").alias("v"), F.col("hi").cast("string").alias("w")).distinct()
    return kmers.weak_components(linked)


# k-mers of the contigs that are rare enough to seed from
MASK_COUNT = 4


def _seeds(f):
    return kmers.seed_matches(f.reads, f.contigs, K, MASK_COUNT)


@query("SELECT q_id, t_id, q_pos, t_pos FROM seeds")
def seed_matches(f):
    return _seeds(f)


@query(
    """SELECT q_id, t_id, bin, hits FROM (SELECT *, row_number() OVER (PARTITION BY q_id, t_id ORDER BY hits DESC, fq, ft) AS nth FROM bins)
       WHERE nth = 1"""
)
def diagonal_mode(f):
    return kmers.diagonal_mode(_seeds(f), 50)


@query(
    """SELECT q_id, t_id, d, width, hits FROM (SELECT *, row_number() OVER (PARTITION BY q_id, t_id ORDER BY hits DESC, d) AS nth FROM
         (SELECT a.q_id, a.t_id, a.d, a.width, CAST(sum(b.c) AS BIGINT) AS hits FROM diagonals a JOIN diagonals b
            ON a.q_id = b.q_id AND a.t_id = b.t_id AND b.d BETWEEN a.d AND a.d + a.width GROUP BY a.q_id, a.t_id, a.d, a.width)) WHERE nth = 1"""
)
def densest_diagonal(f):
    return kmers.densest_diagonal(_seeds(f))


@query(
    """SELECT q_id, t_id, s1, e1, s2, e2, score FROM (
         SELECT *, row_number() OVER (PARTITION BY q_id, t_id ORDER BY score DESC, e1, e2) AS nth, count(*) OVER (PARTITION BY q_id, t_id) AS used
         FROM (SELECT a.q_id, a.t_id, b.q_pos AS s1, a.q_pos AS e1, b.t_pos AS s2, a.t_pos AS e2, CAST(a.total - b.total AS BIGINT) AS score,
                 row_number() OVER (PARTITION BY a.q_id, a.t_id, a.q_pos, a.t_pos ORDER BY b.total, b.q_pos, b.t_pos) AS first
               FROM runs a JOIN runs b ON a.q_id = b.q_id AND a.t_id = b.t_id AND b.nth <= a.nth) WHERE first = 1) WHERE nth = 1 AND used > 1"""
)
def alignment_range(f):
    return kmers.alignment_range(_seeds(f), 50, 3)


@query()
def xor_minimizers(f):
    return kmers.xor_minimizers(f.reads)


# -- truth, intervals, running sums -------------------------------------------

SPAN_SQL = "SELECT user_id AS key, event_id AS id, event_id AS s, event_id + 1 + CAST(floor(value) AS BIGINT) AS e FROM events"


def _spans(f):
    return f.table("events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("id"),
        F.col("event_id").alias("s"),
        (F.col("event_id") + 1 + F.floor("value")).alias("e"),
    )


@query(
    f"""SELECT a.key, a.id AS a_id, a.s AS a_s, a.e AS a_e, b.id AS b_id, b.s AS b_s, b.e AS b_e FROM ({SPAN_SQL}) a JOIN ({SPAN_SQL}) b
        ON a.key = b.key AND a.s < b.e AND b.s < a.e AND a.id <> b.id"""
)
def interval_overlaps(f):
    return truth.interval_overlaps(_spans(f), _spans(f))


CIRCLE = "SELECT event_id AS id, event_id * 8 AS s, event_id * 8 + 1 + CAST(floor(value) AS BIGINT) AS e FROM events"


@query(
    f"""SELECT least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, max(least(a.e, b.e) - greatest(a.s, b.s)) AS olen
        FROM ({CIRCLE}) a JOIN (SELECT id, s, e FROM ({CIRCLE}) UNION ALL SELECT id, s + 8000, e + 8000 FROM ({CIRCLE}) WHERE s < 400) b
          ON a.s < b.e AND b.s < a.e AND a.id <> b.id GROUP BY 1, 2"""
)
def true_pairs(f):
    """Every event as a placement on a circle of 8,000; the first 400 places are also behind its end."""
    start = F.col("event_id") * 8
    placed = f.table("events").select(F.col("event_id").alias("rid"), start.alias("s"), (start + 1 + F.floor("value")).alias("e"))
    return truth.true_pairs(placed, 8_000, 400)


def _strong(f):
    return _shared(f).where("shared >= 4").select("lo", "hi", "shared")


@query(
    """SELECT lo, hi, s.shared, CASE WHEN p.rid0 IS NULL THEN 0 ELSE 1 END AS found FROM shared s
       LEFT JOIN projected p ON p.rid0 = s.lo AND p.rid1 = s.hi WHERE s.shared >= 4"""
)
def recall_flags(f):
    return truth.mark_found(_strong(f), f.projected)


@query(
    """SELECT rid0, rid1, CASE WHEN s.lo IS NULL THEN 0 ELSE 1 END AS is_true FROM projected p
       LEFT JOIN (SELECT * FROM shared WHERE shared >= 4) s ON p.rid0 = s.lo AND p.rid1 = s.hi"""
)
def precision_flags(f):
    return truth.mark_true(f.projected, _strong(f)).select("rid0", "rid1", "is_true")


@query(
    """SELECT conv_id, turn, length(text) AS len,
         CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
       FROM conversations"""
)
def running_offset(f):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return f.table("conversations").select(
        "conv_id", "turn", F.length("text").alias("len"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("start")
    )


@query(
    """SELECT ctg, read_id, strand, support, unnest(starts) AS shift FROM (
         SELECT ctg, read_id, strand, len(offs) AS support, list_reduce(list_prepend([-1000000000], list_transform(list_sort(offs), lambda x: [x])),
            lambda acc, o: CASE WHEN o[1] > acc[len(acc)] + 50 THEN list_append(acc, o[1]) ELSE acc END)[2:] AS starts
         FROM (SELECT user_id AS ctg, user_id % 7 AS read_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS strand,
                 list(event_id - CAST(floor(value) AS BIGINT)) AS offs FROM events GROUP BY 1, 2, 3))"""
)
def offset_groups(f):
    rows = f.table("events").select(
        F.col("user_id").alias("ctg"),
        F.lit(0).alias("win"),
        F.lit(0).alias("left"),
        (F.col("user_id") % 7).alias("read_id"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("direction"),
        F.col("event_id").cast("int").alias("ref_bgn"),
        F.floor("value").cast("int").alias("read_bgn"),
    )
    return consensus.read_offsets(rows).select("ctg", "read_id", "strand", "support", "shift")


# -- consensus ----------------------------------------------------------------


def _text_tags(f):
    """Documents of one language as ungapped reads on a common template."""
    docs = f.table("documents").select(F.col("doc_id").alias("rid"), F.col("lang").alias("ctg")).join(f.reads, "rid")
    base = F.split("seq", "")
    col = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.length("seq") - 1).alias("t"), base.alias("b"), F.concat(F.array(F.lit(".")), base).alias("p")))
    return (
        docs.where(F.length("seq") > 0)
        .select("ctg", col.alias("c"))
        .where("c.t is not null")
        .select(
            "ctg", F.lit(0).alias("win"), F.col("c.t").alias("t_pos"), F.lit(0).alias("delta"), F.col("c.b").alias("base"),
            (F.col("c.t") - 1).alias("p_t_pos"), F.lit(0).alias("p_delta"), F.col("c.p").alias("p_base"), F.lit(1).cast("long").alias("covered"),
        )
    )


TEXT_TAGS = """SELECT lang AS ctg, pos AS t_pos, b AS base, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), '.') AS p_base FROM (
    SELECT doc_id, lang, unnest(string_split(seq, '')) AS b, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos
    FROM documents JOIN reads ON rid = doc_id WHERE length(seq) > 0)"""


@query(f"SELECT ctg, t_pos, base, p_base, count(*) AS times FROM ({TEXT_TAGS}) GROUP BY ALL")
def tag_transitions(f):
    return consensus.tag_edges(_text_tags(f)).select("ctg", "t_pos", "base", "p_base", "times")


@query(f"SELECT ctg, t_pos, count(*) AS coverage FROM ({TEXT_TAGS}) GROUP BY ALL")
def position_coverage(f):
    return consensus.position_coverage(_text_tags(f)).select("ctg", "t_pos", "coverage")


def _tiled(f):
    spots = f.table("events").select(
        F.col("user_id").alias("ref_id"), F.col("event_id").cast("int").alias("ref_bgn"), F.col("event_id").alias("read_id")
    )
    spans = spots.groupBy(F.col("ref_id").alias("rid")).agg((F.max("ref_bgn") + 1).alias("len"))
    return spots, spans


@query('SELECT ctg, win, a - 100 AS "left", stop AS "right" FROM windows')
def contig_windows(f):
    spots, spans = _tiled(f)
    return consensus.tile_windows(spots, spans, AssemblyConfig(window=1000, window_limit=2000, window_lead=100))[0]


@query(
    """SELECT ctg, ref_bgn, read_id, win, a - 100 AS "left", stop AS "right" FROM (
         SELECT e.user_id AS ctg, e.event_id AS ref_bgn, e.event_id AS read_id, win, a, stop, usable,
                row_number() OVER (PARTITION BY e.user_id, e.event_id ORDER BY win DESC) AS nth
         FROM events e JOIN windows w ON w.ctg = e.user_id AND (w.a <= e.event_id OR w.win = 0)) WHERE nth = 1 AND usable"""
)
def window_rows(f):
    spots, spans = _tiled(f)
    cfg = AssemblyConfig(window=1000, window_limit=2000, window_lead=100)
    return consensus.tile_windows(spots, spans, cfg)[1].select("ctg", "ref_bgn", "read_id", "win", "left", "right")


@query()
def polished_contigs(f):
    return consensus.polish(f.contigs, f.reads, f.mapped, CFG)


@query()
def read_set_consensus(f):
    return consensus.read_set_consensus(f.contigs, f.reads, K, W, REDUCTION)


# -- alignment and assembly ---------------------------------------------------


def _placed_texts(f):
    """Each linked read pair at its smallest placement, as texts to align."""
    first = pairs.first_per_pair(f.links, ["lo", "hi"], ["h0", "h1", "ord", "off"])
    texts = f.reads
    q = first.join(texts.withColumnRenamed("rid", "rid0"), "rid0").withColumn(
        "q", F.substring(sq.oriented(F.col("seq"), F.col("dir0")), F.col("at0") - F.col("at1") + 1, F.col("len0"))
    ).drop("seq")
    return q.join(texts.withColumnRenamed("rid", "rid1"), "rid1").select(
        "rid0", "rid1", "dir0", "dir1", "q", sq.oriented(F.col("seq"), F.col("dir1")).alias("t")
    )


@query()
def banded_match(f):
    return align.match_pairs(_placed_texts(f), 100)


@query()
def gapped_alignment(f):
    return align.align_pairs(_placed_texts(f), 150)


@query()
def read_overlaps(f):
    return overlap.overlap_records(overlap.find_overlaps(f.reads, f.mirrored, CFG))


@query()
def colinear_chains(f):
    refs = sketch.sketch(f.contigs, K, W, REDUCTION, levels=(1,))
    anchors = colinear.shared_minimizers(refs, f.level(1), 0, 1)
    return colinear.chain_offsets(colinear.colinear_chains(anchors))


@query(
    f"""SELECT a.rid AS id0, b.rid AS id1, a.idx AS idx0, b.idx AS idx1, abs(a.pos - b.pos) AS diag FROM
         (SELECT *, count(*) OVER (PARTITION BY rid, hash) AS times FROM c1) a JOIN l1 b ON a.hash = b.hash AND a.strand = b.strand WHERE times <= 1"""
)
def shared_minimizers(f):
    refs = sketch.sketch(f.contigs, K, W, REDUCTION, levels=(1,))
    return colinear.shared_minimizers(refs, f.level(1), 0, 1).select("id0", "id1", "idx0", "idx1", "diag")


def _layout(f):
    from readloom.plans.assemble import lay_out

    if "lay" not in f.__dict__:
        f.__dict__["lay"] = lay_out(f.projected, CFG)
    return f.__dict__["lay"]


@query()
def reduced_graph(f):
    return _layout(f).edges.select("v", "w", "rid", "sp", "tp", "score", "type")


@query()
def cleaned_unitigs(f):
    return _layout(f).unitigs.select("s", "via", "t", "type", "length", "score")


@query()
def contig_paths(f):
    return _layout(f).contigs


@query()
def tiling_paths(f):
    return _layout(f).primary


@query()
def draft_contigs(f):
    return layout.stitch_contigs(_layout(f).primary, f.reads, CFG)


# -- dimer graph --------------------------------------------------------------

STRANDED = f"""SELECT h0, strand0, h1, strand1, rid, len, pos0, pos1, direction FROM mirrored"""


@query(STRANDED)
def strand_pairs(f):
    return f.mirrored.select("h0", "strand0", "h1", "strand1", "rid", "len", "pos0", "pos1", "direction")


STEPS["dimerlinks"] = f"""SELECT s.*, coalesce(n.shared, 0) AS shared, CASE WHEN d.rid0 IS NULL THEN 0 ELSE 1 END AS dovetail FROM dimersteps s
        LEFT JOIN (SELECT a.rid AS rid0, b.rid AS rid1, count(*) AS shared FROM
             (SELECT DISTINCT rid, h0, strand0, h1, strand1 FROM mirrored) a JOIN (SELECT DISTINCT rid, h0, strand0, h1, strand1 FROM mirrored) b
             USING (h0, strand0, h1, strand1) GROUP BY a.rid, b.rid) n USING (rid0, rid1)
        LEFT JOIN (SELECT DISTINCT rid0, rid1 FROM ({DOVETAIL})) d USING (rid0, rid1)"""


@query("SELECT * FROM dimerlinks")
def dimer_links(f):
    return dimers.dimer_links(f.mirrored, f.counts, dimers.dovetail_pairs(f.bounded, END_LENGTH))


@query(
    """SELECT rid0 || '-' || dir0 AS v, rid1 || '-' || dir1 AS w FROM dimerlinks WHERE dovetail = 1
       UNION SELECT rid1 || '-' || (1 - dir1), rid0 || '-' || (1 - dir0) FROM dimerlinks WHERE dovetail = 1"""
)
def dimer_graph(f):
    return dimers.dimer_graph(dimer_links(f))


@query(f"SELECT {LEVEL_SQL} FROM l2 WHERE rid = (SELECT min(rid) FROM l2)")
def minimizers_of_read(f):
    """Point look-up of the first read that has minimizers."""
    first = f.level(2).agg(F.min("rid")).first()[0]
    return sketch.minimizers_of_read(f.level(2), first).select(*LEVEL)


@query("SELECT coalesce(sum(mc), 0) AS mc FROM counts WHERE hash = (SELECT max(hash) FROM counts)")
def count_of_minimizer(f):
    """Point look-up of the count of the largest hash."""
    top = f.counts.agg(F.max("hash")).first()[0]
    return sketch.count_of_minimizer(f.counts, top)
