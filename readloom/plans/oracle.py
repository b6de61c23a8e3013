"""ANSI SQL for DuckDB giving the same answers as the registered queries.

Each query is a chain of named steps; a statement lists the steps it needs in
order.  The texts are assembled here and run by the checker only.
"""

from __future__ import annotations

import re

from readloom.plans.frames import (
    BESTN, BUCKET_UPPER, END_LENGTH, FUZZ, K, MC_LOWER, MC_UPPER, MIN_DISTANCE, REDUCTION, W,
)
from readloom.sources.tables import DIGIT_BASES, DIGITS

MASK = (1 << 2 * K) - 1


def _lag_sum(term: str, k: int) -> str:
    return " + ".join(term.format(c=f"lag(code, {j}) OVER o" if j else "code", j=j, back=k - 1 - j) for j in range(k))


def _as_bases(table: str, key: str) -> str:
    digits = "regexp_replace(hex(encode(text)), '.(.)', '\\1', 'g')"
    return f"SELECT {key} AS rid, translate({digits}, '{DIGITS}', '{DIGIT_BASES}') AS seq FROM {table}"


def _mix(key: str) -> list[str]:
    """Steps of the integer mix as nested SELECT items, one a line."""
    return [
        f"({MASK} - {key} + (({key} << 21) & {MASK})) & {MASK}",
        "xor(x, x >> 24)",
        f"(x * 265) & {MASK}",
        "xor(x, x >> 14)",
        f"(x * 21) & {MASK}",
        "xor(x, x >> 28)",
        f"(x + ((x << 31) & {MASK})) & {MASK}",
    ]


def _mixed(source: str, key: str, columns: str) -> str:
    sql = source
    for step in _mix(key):
        sql = f"SELECT {columns}, {step} AS x FROM ({sql})"
    return sql


def _sketch(prefix: str, seqs: str) -> dict[str, str]:
    """Levels 0, 1 and 2 of the sequences in ``seqs`` as steps ``<prefix>0..2``."""
    p = prefix
    steps = {
        f"{p}base": f"""SELECT rid, len, pos, instr('ACGT', b) - 1 AS code FROM (
            SELECT rid, length(seq) AS len, unnest(string_split(seq, '')) AS b,
                   generate_subscripts(string_split(seq, ''), 1) - 1 AS pos FROM {seqs} WHERE length(seq) > 0)""",
        f"{p}kmer": f"""SELECT rid, len, pos, f, r FROM (
            SELECT rid, len, pos, {_lag_sum("CAST({c} AS BIGINT) * (CAST(1 AS BIGINT) << (2 * {j}))", K)} AS f,
                   {_lag_sum("CAST(3 - {c} AS BIGINT) * (CAST(1 AS BIGINT) << (2 * {back}))", K)} AS r
            FROM {p}base WINDOW o AS (PARTITION BY rid ORDER BY pos)) WHERE pos >= {K - 1}""",
        f"{p}hash": f"""SELECT rid, len, pos, CASE WHEN f < r THEN 0 ELSE 1 END AS strand, x AS hash,
                   row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS t, count(*) OVER (PARTITION BY rid) AS n
            FROM ({_mixed(f"SELECT *, least(f, r) AS key FROM {p}kmer WHERE f <> r", "key", "rid, len, pos, f, r")})""",
        # smallest hash of the window ending here, and the largest such minimum over the windows covering a k-mer
        f"{p}win": f"""SELECT *, CASE WHEN t >= {W - 1} THEN min(hash) OVER (PARTITION BY rid ORDER BY t
                   ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) END AS m FROM {p}hash""",
        f"{p}cover": f"""SELECT *, max(m) OVER (PARTITION BY rid ORDER BY t ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS mm
            FROM {p}win""",
        # what the first complete window does to copies of the minimum before it
        f"{p}head": f"""SELECT rid, m0, c, (SELECT max(t) FROM {p}hash h WHERE h.rid = a.rid AND h.t < {W - 1} AND h.hash = a.m0) AS last0
            FROM (SELECT rid, min(CASE WHEN t < {W - 1} THEN hash END) AS m0, max(CASE WHEN t = {W - 1} THEN hash END) AS c
                  FROM {p}hash WHERE n >= {W} AND t <= {W - 1} GROUP BY rid) a""",
        f"{p}tail": f"""SELECT rid, max(t) AS last FROM (SELECT *, min(hash) OVER (PARTITION BY rid) AS low FROM {p}hash WHERE n < {W})
            WHERE hash = low GROUP BY rid""",
        f"{p}0": f"""SELECT rid, 0 AS level, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS idx, pos, strand, hash, {K} AS span, len
            FROM (SELECT k.* FROM {p}cover k LEFT JOIN {p}head d ON k.rid = d.rid LEFT JOIN {p}tail e ON k.rid = e.rid
                  WHERE (k.n < {W} AND k.t = e.last)
                     OR (k.n >= {W} AND ((k.hash = k.mm AND NOT (k.t = d.last0 AND d.c = d.m0))
                         OR (k.t < {W - 1} AND d.c < d.m0 AND k.hash = d.m0 AND k.t < d.last0))))""",
    }
    for level in (1, 2):
        below = f"{p}{level - 1}"
        steps[f"{p}pick{level}"] = f"""SELECT rid, idx AS spot, min(hash * {REDUCTION} + idx % {REDUCTION}) OVER w AS best,
                   max(idx) OVER w AS hi FROM {below}
            WINDOW w AS (PARTITION BY rid ORDER BY idx ROWS BETWEEN {REDUCTION - 1} PRECEDING AND CURRENT ROW)"""
        steps[f"{p}{level}"] = f"""SELECT rid, {level} AS level, row_number() OVER (PARTITION BY rid ORDER BY spot) - 1 AS idx,
                   pos, strand, hash, span, len FROM (
              SELECT q.rid, q.spot, s.idx, s.pos, s.strand, s.hash, s.span, s.len, lag(s.idx) OVER (PARTITION BY q.rid ORDER BY q.spot) AS before
              FROM {p}pick{level} q JOIN {below} s ON s.rid = q.rid AND s.idx BETWEEN q.spot - {REDUCTION - 1} AND q.spot
                   AND s.hash * {REDUCTION} + s.idx % {REDUCTION} = q.best
              WHERE q.spot >= {REDUCTION - 1}) WHERE before IS NULL OR before <> idx"""
    return steps


STEPS: dict[str, str] = {
    "reads": _as_bases("documents", "doc_id"),
    "contigs": _as_bases("benchmark", "item_id"),
    **_sketch("l", "reads"),
    **_sketch("c", "contigs"),
    "counts": "SELECT hash, count(*) AS mc FROM l2 GROUP BY hash",
    "bounded": f"SELECT l2.*, mc FROM l2 JOIN counts USING (hash) WHERE mc BETWEEN {MC_LOWER} AND {MC_UPPER}",
    "once": f"SELECT l2.*, mc FROM l2 JOIN counts USING (hash) WHERE mc BETWEEN 1 AND {MC_UPPER}",
}


def _pairs(source: str) -> str:
    return f"""SELECT hash0 AS h0, span0, hash AS h1, span AS span1, rid, len, pos0, strand0, pos AS pos1, strand AS strand1, 0 AS direction
        FROM (SELECT *, lag(hash) OVER o AS hash0, lag(span) OVER o AS span0, lag(pos) OVER o AS pos0, lag(strand) OVER o AS strand0
              FROM {source} WINDOW o AS (PARTITION BY rid ORDER BY pos)) WHERE pos - pos0 >= {MIN_DISTANCE}"""


def _mirrors(source: str) -> str:
    return f"""SELECT * FROM {source} UNION ALL
        SELECT h1, span1, h0, span0, rid, len, len - (pos1 + 1) + span1 - 1, 1 - strand1, len - (pos0 + 1) + span0 - 1, 1 - strand0, 1
        FROM {source}"""


STEPS |= {
    "adjacent": _pairs("bounded"),
    "mirrored": _mirrors("adjacent"),
    "sizes": f"SELECT h0, h1, count(*) AS n FROM mirrored GROUP BY h0, h1 HAVING count(*) > 2 AND count(*) <= {BUCKET_UPPER}",
    "rows": """SELECT m.*, n, row_number() OVER (PARTITION BY h0, h1 ORDER BY pos0 DESC, rid, pos1, direction) AS ord
        FROM mirrored m JOIN sizes USING (h0, h1)""",
    "links": f"""SELECT *, least(rid0, rid1) AS lo, greatest(rid0, rid1) AS hi, xor(dir0, dir1) AS rel,
          CASE WHEN lo_dir = 0 THEN start ELSE lo_len - start - hi_len END AS place FROM (
          SELECT a.h0, a.h1, a.ord, b.ord - a.ord AS off, a.rid AS rid0, a.pos0 AS at0, a.len AS len0, a.direction AS dir0,
                 b.rid AS rid1, b.pos0 AS at1, b.len AS len1, b.direction AS dir1,
                 CASE WHEN a.rid > b.rid THEN b.pos0 - a.pos0 ELSE a.pos0 - b.pos0 END AS start,
                 CASE WHEN a.rid > b.rid THEN b.direction ELSE a.direction END AS lo_dir,
                 CASE WHEN a.rid > b.rid THEN b.len ELSE a.len END AS lo_len,
                 CASE WHEN a.rid > b.rid THEN a.len ELSE b.len END AS hi_len
          FROM rows a JOIN rows b ON a.h0 = b.h0 AND a.h1 = b.h1 AND b.ord BETWEEN a.ord + 1 AND a.ord + {BESTN} AND a.rid <> b.rid)""",
    "shared": "SELECT lo, hi, count(*) AS shared FROM links GROUP BY lo, hi",
    "refbounded": f"SELECT c2.*, mc FROM c2 JOIN counts USING (hash) WHERE mc BETWEEN 1 AND {MC_UPPER}",
    "refadjacent": _pairs("refbounded"),
    "onceadjacent": _pairs("once"),
    "oncemirrored": _mirrors("onceadjacent"),
    "mapped": """SELECT f.rid AS ref_id, f.pos0 AS ref_bgn, f.pos1 AS ref_end, r.rid AS read_id, r.pos0 AS read_bgn, r.pos1 AS read_end,
          r.direction, a.mc AS mc0, b.mc AS mc1
        FROM refadjacent f JOIN oncemirrored r ON f.h0 = r.h0 AND f.h1 = r.h1
        JOIN counts a ON a.hash = r.h0 JOIN counts b ON b.hash = r.h1""",
    "placed": """SELECT lo, hi, rel, place, lo_len, hi_len, greatest(place, 0) AS a_bgn, greatest(-place, 0) AS skip FROM (
          SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY rel, place, lo_len, hi_len) AS nth FROM links) WHERE nth = 1""",
    "projected": """SELECT lo AS rid0, hi AS rid1, -size AS score, 100.0 AS identity, 0 AS strand0, a_bgn, a_bgn + size AS a_end, lo_len AS len0,
          rel AS strand1, b_bgn, b_bgn + size AS b_end, hi_len AS len1,
          CASE WHEN size = hi_len THEN 'contains' WHEN size = lo_len THEN 'contained' ELSE 'overlap' END AS type
        FROM (SELECT *, CASE WHEN rel = 0 THEN skip ELSE hi_len - skip - size END AS b_bgn FROM (
              SELECT *, least(lo_len - a_bgn, hi_len - skip) AS size FROM placed)) WHERE size > 0""",
    # both edges of each overlap: where g lies relative to f, and on which strand
    "edges": """SELECT * FROM (
          SELECT CASE WHEN ahead = same THEN g || ':B' ELSE g || ':E' END AS v, CASE WHEN ahead THEN f || ':B' ELSE f || ':E' END AS w,
                 f AS rid, CASE WHEN ahead THEN a_bgn ELSE a_end END AS sp, CASE WHEN ahead THEN 0 ELSE len0 END AS tp, size AS score, bad FROM both_ends
          UNION ALL
          SELECT CASE WHEN ahead THEN f || ':E' ELSE f || ':B' END, CASE WHEN ahead = same THEN g || ':E' ELSE g || ':B' END,
                 g, gs, gt, size, bad FROM both_ends) WHERE NOT bad""",
    "dovetails": "SELECT * FROM projected WHERE type = 'overlap'",
    "both_ends": """SELECT *, CASE WHEN ahead THEN a_bgn = 0 ELSE a_end = len0 END OR gs = gt AS bad FROM (
          SELECT *, CASE WHEN ahead = same THEN b_end ELSE b_bgn END AS gs,
                 CASE WHEN ahead = same THEN len1 ELSE 0 END AS gt FROM (
            SELECT *, CAST(rid0 AS VARCHAR) AS f, CAST(rid1 AS VARCHAR) AS g, a_bgn > 0 AS ahead, strand1 = 0 AS same, -score AS size FROM dovetails))""",
    "sedges": "SELECT v, w, rid, sp, tp, abs(sp - tp) AS length, score FROM edges",
}


def flip(node: str) -> str:
    return f"left({node}, length({node}) - 1) || translate(right({node}, 1), 'BE', 'EB')"


def both(source: str) -> str:
    return f"SELECT v, w FROM {source} UNION SELECT {flip('w')} AS v, {flip('v')} AS w FROM {source}"


STEPS |= {
    "ranked": """SELECT v, w, length, row_number() OVER (PARTITION BY v ORDER BY length, w) AS nth,
          max(length) OVER (PARTITION BY v) AS longest FROM sedges""",
    "triangles": f"""SELECT a.v, a.nth AS m_nth, c.nth AS x_nth, c.w AS x, b.nth = 1 OR b.length < {FUZZ} AS near,
          a.length + b.length < a.longest + {FUZZ} AS short
        FROM ranked a JOIN ranked b ON b.v = a.w JOIN ranked c ON c.v = a.v AND c.w = b.w""",
    "fold": """SELECT v, list_reduce(list_prepend([0, 0], list_sort(list([m_nth, x_nth]))),
          lambda gone, t: CASE WHEN list_contains(gone, t[1]) OR list_contains(gone, t[2]) THEN gone ELSE list_append(gone, t[2]) END) AS gone
        FROM triangles WHERE short GROUP BY v""",
    "chained": "SELECT DISTINCT r.v, r.w FROM fold f JOIN ranked r ON r.v = f.v AND list_contains(f.gone, r.nth)",
    "near": "SELECT v, x AS w FROM triangles WHERE near UNION SELECT v, w FROM chained",
    "tr": both("near"),
    "afterTr": "SELECT e.* FROM sedges e ANTI JOIN tr USING (v, w)",
    "best": """SELECT v, w FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, length, w) AS o,
          row_number() OVER (PARTITION BY w ORDER BY score DESC, length, v) AS i FROM afterTr) WHERE o = 1 OR i = 1""",
    "worse": "SELECT v, w FROM afterTr ANTI JOIN best USING (v, w)",
    "notbest": both("worse"),
    "live": "SELECT e.* FROM afterTr e ANTI JOIN notbest USING (v, w)",
}

STEPS |= {
    "bridge": """SELECT v, w FROM afterTr a WHERE length < 60000
          AND v IN (SELECT w FROM afterTr GROUP BY w HAVING count(*) = 1) AND v IN (SELECT v FROM afterTr GROUP BY v HAVING count(*) = 2)
          AND w IN (SELECT w FROM afterTr GROUP BY w HAVING count(*) = 2) AND w IN (SELECT v FROM afterTr GROUP BY v HAVING count(*) = 1)""",
    "undirected": """SELECT CAST(lo AS VARCHAR) AS v, CAST(hi AS VARCHAR) AS w FROM links
          UNION SELECT CAST(hi AS VARCHAR), CAST(lo AS VARCHAR) FROM links""",
    "reach": """SELECT v AS node, v AS label FROM undirected UNION SELECT u.w, r.label FROM reach r JOIN undirected u ON u.v = r.node""",
    "seedtargets": """SELECT rid AS t_id, pos - 15 AS t_pos, f FROM ckmer WHERE f IN (SELECT f FROM ckmer GROUP BY f HAVING count(*) <= 4)""",
    "seeds": """SELECT q.rid AS q_id, t_id, q.pos - 15 AS q_pos, t_pos FROM lkmer q JOIN seedtargets t ON q.f = t.f WHERE (q.pos - 15) % 8 = 0""",
    "lowest": "SELECT q_id, t_id, min(q_pos - t_pos) AS d_min FROM seeds GROUP BY q_id, t_id",
    "bins": """SELECT q_id, t_id, CAST(floor((q_pos - t_pos - d_min) / 50) AS BIGINT) AS bin, count(*) AS hits, min(q_pos) AS fq,
          arg_min(t_pos, q_pos * 1000000 + t_pos) AS ft FROM seeds JOIN lowest USING (q_id, t_id) GROUP BY 1, 2, 3""",
    "mode": """SELECT q_id, t_id, bin AS mode FROM (SELECT *, row_number() OVER (PARTITION BY q_id, t_id ORDER BY hits DESC, fq, ft) AS nth FROM bins)
          WHERE nth = 1""",
    "diagonals": """SELECT *, CAST(floor(0.05 * (max(mq) OVER p + max(mt) OVER p)) AS INT) AS width FROM (
          SELECT q_id, t_id, q_pos - t_pos AS d, count(*) AS c, max(q_pos) AS mq, max(t_pos) AS mt FROM seeds GROUP BY 1, 2, 3)
        WINDOW p AS (PARTITION BY q_id, t_id)""",
    "nearmode": """SELECT s.q_id, s.t_id, q_pos, t_pos FROM seeds s JOIN lowest l ON s.q_id = l.q_id AND s.t_id = l.t_id
        JOIN bins b ON b.q_id = s.q_id AND b.t_id = s.t_id AND b.bin = floor((q_pos - t_pos - d_min) / 50) AND b.hits > 3
        JOIN mode m ON m.q_id = s.q_id AND m.t_id = s.t_id AND abs(b.bin - m.mode) <= 5""",
    "runs": """SELECT *, sum(gain) OVER (PARTITION BY q_id, t_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS total FROM (
          SELECT *, coalesce(32 - (q_pos - lag(q_pos) OVER o), 0) AS gain, row_number() OVER o AS nth FROM nearmode
          WINDOW o AS (PARTITION BY q_id, t_id ORDER BY q_pos, t_pos))""",
    "dimersteps": """SELECT h0, strand0, h1, strand1, rid0, dir0, rid AS rid1, direction AS dir1, len0 - abs(left0 - lft) AS overlap_len FROM (
          SELECT *, lag(rid) OVER o AS rid0, lag(direction) OVER o AS dir0, lag(len) OVER o AS len0, lag(lft) OVER o AS left0, lag(rgt) OVER o AS right0
          FROM (SELECT *, -(pos0 + 1) AS lft, len - pos0 - 1 AS rgt FROM mirrored
                WHERE h0 IN (SELECT hash FROM counts WHERE mc > 1 AND mc < 30) AND h1 IN (SELECT hash FROM counts WHERE mc > 1 AND mc < 30))
          WINDOW o AS (PARTITION BY h0, strand0, h1, strand1 ORDER BY lft, rgt, rid, direction)) WHERE right0 < rgt""",
}

# contig windows over event positions: window 1000, limit 2000, lead 100
STEPS |= {
    "spots": "SELECT DISTINCT user_id AS ctg, event_id AS spot FROM events",
    "spans": "SELECT ctg, max(spot) + 1 AS len FROM spots GROUP BY ctg",
    "jumps": """SELECT ctg, a, (SELECT min(spot) FROM spots s WHERE s.ctg = f.ctg AND s.spot >= f.a + 1000) AS nx
        FROM (SELECT ctg, spot AS a FROM spots UNION SELECT ctg, 100 FROM spans) f""",
    "anchors": """SELECT ctg, 0 AS win, CAST(100 AS BIGINT) AS a FROM spans
        UNION ALL SELECT x.ctg, x.win + 1, n.nx FROM anchors x JOIN jumps n ON n.ctg = x.ctg AND n.a = x.a WHERE n.nx IS NOT NULL""",
    "cuts": """SELECT c.ctg, win, a, len, lead(a) OVER p AS nx, max(win) OVER (PARTITION BY c.ctg) AS last,
          len - max(a) OVER (PARTITION BY c.ctg) AS tail FROM anchors c JOIN spans s ON s.ctg = c.ctg WINDOW p AS (PARTITION BY c.ctg ORDER BY win)""",
    "windows": """SELECT ctg, win, a, CASE WHEN tail <= 100 AND last > 0 AND win = last - 1 THEN len ELSE coalesce(nx, len) END AS stop,
          CASE WHEN nx IS NOT NULL THEN nx - a < 2000 ELSE tail > 100 AND tail < 2000 END AS usable
        FROM cuts WHERE NOT (tail <= 100 AND last > 0 AND win = last)""",
    # unitigs that are lists; rings need an opening rule that SQL does not state well
    "livedeg": """SELECT node FROM (SELECT v AS node, 0 AS i, 1 AS o FROM live UNION ALL SELECT w, 1, 0 FROM live)
        GROUP BY node HAVING sum(i) = 1 AND sum(o) = 1""",
    "walk": """SELECT v || '>' || w AS head, CAST(0 AS BIGINT) AS rank, v, w FROM live WHERE v NOT IN (SELECT node FROM livedeg)
        UNION ALL SELECT k.head, k.rank + 1, e.v, e.w FROM walk k JOIN live e ON e.v = k.w JOIN livedeg d ON d.node = k.w""",
}


# steps that a recursion reads, computed once and not in each of its turns
ONCE: set[str] = set()


def statement(select: str) -> str:
    """The select with every step it reads, directly or not, in front of it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if name in STEPS and name not in need:
                need.append(name)
                visit(STEPS[name])
                # after everything it reads
                need.remove(name)
                need.append(name)

    visit(select)
    if not need:
        return select
    if select.lstrip().startswith("WITH "):
        raise ValueError("put shared parts into STEPS")
    kept = {n: "MATERIALIZED " if n in ONCE else "" for n in need}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {kept[n]}({STEPS[n]})" for n in need) + "\n" + select
