"""The consensus of windows over whole texts: documents of a language as reads of one template.

A text's bases are alignment columns: the second and later bases of a run of T
are insertions, an A behind a C stands for a gap.  Every 300 positions are a
window; its own text is the smallest letter of each position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import consensus, tagpaths
from readloom.operators.consensus import WIN
from readloom.operators.kernels import text_buffer
from readloom.plans.catalog import query
from readloom.plans.oracle import ONCE, STEPS

WIDTH = 300


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = consensus._Counter()
    for batch in batches:
        raw, bounds = text_buffer(batch.column(1))
        for ctg, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            letters = raw[a:b]
            if not letters.size:
                continue
            behind = np.r_[np.uint8(0), letters[:-1]]
            moves = ~((letters == ord("T")) & (behind == ord("T")))
            place = np.cumsum(moves) - 1
            delta = np.arange(letters.size) - np.flatnonzero(moves)[place]
            base = tagpaths.codes(np.where((letters == ord("A")) & (behind == ord("C")), ord("-"), letters))
            tag = tagpaths.tag_keys(place % WIDTH, delta, base)
            win = place // WIDTH
            head = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
            before = np.r_[np.int64(0), tag[:-1]]
            before[head] = tagpaths.tag_keys(np.full(head.size, -1), np.zeros(head.size), tagpaths.BEFORE)
            for i, j in zip(head.tolist(), np.r_[head[1:], letters.size].tolist(), strict=True):
                counter.add(ctg, int(win[i]), tag[i:j], before[i:j], int(moves[i:j].sum()))
            if counter.size > consensus.COLUMNS_AT_ONCE:
                yield from counter.take()
    yield from counter.take()


def _language_columns(f) -> DataFrame:
    """Merged transitions of all documents on their language's template."""
    langs = f.table("documents").select(
        F.col("doc_id").alias("rid"), (F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))).cast("long").alias("ctg")
    )
    return consensus.merged_tags(f.reads.join(langs, "rid").select("ctg", "seq").mapInArrow(_count, consensus.COUNTED))


def _window_texts(tags: DataFrame) -> DataFrame:
    place = F.shiftright("tag", tagpaths.BASE_BITS)
    letter = F.substring(F.lit(tagpaths.LETTERS), (F.col("tag").bitwiseAND(F.lit(7)) + 1).cast("int"), F.lit(1))
    first = tags.where(place.bitwiseAND(F.lit((1 << tagpaths.DELTA_BITS) - 1)) == 0).select(
        *WIN, F.shiftright(place, tagpaths.DELTA_BITS).alias("t"), F.when(letter != "-", letter).alias("l")
    )
    each = first.groupBy(*WIN, "t").agg(F.coalesce(F.min("l"), F.lit("A")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "l"))), lambda x: x["l"]), "")
    return each.groupBy(*WIN).agg(text.alias("ref"))


STEPS |= {
    "cbase": """SELECT doc_id, ascii(lang) * 256 + ascii(substr(lang, 2, 1)) AS ctg, j, b, lag(b) OVER (PARTITION BY doc_id ORDER BY j) AS pb FROM (
          SELECT doc_id, lang, unnest(string_split(seq, '')) AS b, generate_subscripts(string_split(seq, ''), 1) - 1 AS j
          FROM documents JOIN reads ON rid = doc_id WHERE length(seq) > 0)""",
    "ccol": """SELECT doc_id, ctg, j, CASE WHEN pb = 'C' AND b = 'A' THEN '-' ELSE b END AS l,
          CAST(sum(CASE WHEN pb = 'T' AND b = 'T' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY j) - 1 AS BIGINT) AS tp FROM cbase""",
    "ctag": "SELECT *, row_number() OVER (PARTITION BY doc_id, tp ORDER BY j) - 1 AS d FROM ccol",
    "clag": """SELECT ctg, tp // 300 AS win, tp % 300 AS t, d, l, lag(d) OVER o AS ld, lag(l) OVER o AS ll, lag(tp // 300) OVER o AS lwin FROM ctag
        WINDOW o AS (PARTITION BY doc_id ORDER BY j)""",
    "cref": "SELECT ctg, win, t, coalesce(min(l) FILTER (l <> '-'), 'A') AS r FROM clag WHERE d = 0 GROUP BY ALL",
    "cedge": """SELECT ctg, win, t, d, l, pd, pl, count(*) AS times FROM (
          SELECT ctg, win, t, d, l, CASE WHEN lwin = win THEN ld ELSE 0 END AS pd, CASE WHEN lwin = win THEN ll ELSE '.' END AS pl FROM clag
          UNION ALL SELECT ctg, win, t, 0, r, 0, coalesce(lag(r) OVER (PARTITION BY ctg, win ORDER BY t), '.') FROM cref) GROUP BY ALL""",
    "ccover": "SELECT ctg, win, t, sum(times) AS cov FROM cedge WHERE d = 0 GROUP BY ALL",
    "cworth": """SELECT e.ctg, e.win, e.t, d, l, pd, pl, CAST(times - 0.5 * (cov - 1) AS DOUBLE) AS worth,
          row_number() OVER (PARTITION BY e.ctg, e.win, e.t, d, l ORDER BY pd, pl) AS eo FROM cedge e JOIN ccover c ON c.ctg = e.ctg AND c.win = e.win AND c.t = e.t""",
    "clists": "SELECT ctg, win, t, d, l, list({'pd': pd, 'pl': pl, 'worth': worth} ORDER BY eo) AS es FROM cworth GROUP BY ctg, win, t, d, l",
    "ccolumns": """SELECT ctg, win, t, d, row_number() OVER (PARTITION BY ctg, win ORDER BY t, d) AS c, tags FROM (
          SELECT ctg, win, t, d, list({'l': l, 'es': es} ORDER BY l) AS tags FROM clists GROUP BY ctg, win, t, d)""",
    # values column by column; what the next position can need stays in the row
    "cvalue": """SELECT DISTINCT ctg, win, CAST(0 AS BIGINT) AS c, CAST([] AS STRUCT(t BIGINT, d BIGINT, l VARCHAR, v DOUBLE, up BOOLEAN)[]) AS vals,
          CAST([] AS STRUCT(t BIGINT, d BIGINT, l VARCHAR, v DOUBLE, up BOOLEAN)[]) AS fresh FROM cref
        UNION ALL SELECT ctg, win, c, list_concat(list_filter(vals, lambda y: y.t >= t - 1), fresh), fresh FROM (
          SELECT k.ctg, k.win, k.c, k.t, v.vals, list_transform(list_transform(k.tags, lambda x: {'l': x.l, 'f': x.es[1].worth,
              'b': list_max(list_transform(x.es, lambda e: CASE WHEN e.pl = '.' THEN -1e18 ELSE e.worth + coalesce(
                list_filter(v.vals, lambda y: y.l = e.pl AND y.d = e.pd AND y.t = CASE WHEN k.d > 0 THEN k.t ELSE k.t - 1 END)[1].v, -1e18) END))}),
            lambda x: {'t': k.t, 'd': k.d, 'l': x.l, 'v': greatest(x.f, x.b), 'up': x.b > x.f}) AS fresh
          FROM cvalue v JOIN ccolumns k ON k.ctg = v.ctg AND k.win = v.win AND k.c = v.c + 1)""",
    "cbest": "SELECT ctg, win, x.t AS t, x.d AS d, x.l AS l, x.v AS v, x.up AS up FROM (SELECT ctg, win, unnest(fresh) AS x FROM cvalue)",
    "cend": """SELECT ctg, win, t, d, l FROM (SELECT *, row_number() OVER (PARTITION BY ctg, win ORDER BY v DESC, t, d, l) AS nth FROM cbest WHERE up AND v > 0)
        WHERE nth = 1""",
    "cvia": """SELECT ctg, win, t, d, l, pt, pd, pl FROM (
          SELECT w.ctg, w.win, w.t, w.d, w.l, CASE WHEN w.d > 0 THEN w.t ELSE w.t - 1 END AS pt, w.pd, w.pl,
            row_number() OVER (PARTITION BY w.ctg, w.win, w.t, w.d, w.l ORDER BY CASE WHEN NOT b.up OR w.worth + p.v = b.v THEN 0 ELSE 1 END, w.eo) AS nth
          FROM cworth w JOIN cbest b ON b.ctg = w.ctg AND b.win = w.win AND b.t = w.t AND b.d = w.d AND b.l = w.l
          LEFT JOIN cbest p ON p.ctg = w.ctg AND p.win = w.win AND p.t = CASE WHEN w.d > 0 THEN w.t ELSE w.t - 1 END AND p.d = w.pd AND p.l = w.pl)
        WHERE nth = 1""",
    "cpath": """SELECT ctg, win, t, d, l FROM cend
        UNION ALL SELECT v.ctg, v.win, v.pt, v.pd, v.pl FROM cpath k JOIN cvia v ON v.ctg = k.ctg AND v.win = k.win AND v.t = k.t AND v.d = k.d AND v.l = k.l
        WHERE v.pl <> '.'""",
    "ctext": """SELECT k.ctg, k.win, string_agg(CASE WHEN cov > 1 THEN l ELSE lower(l) END, '' ORDER BY k.t, d) AS seq
        FROM cpath k JOIN ccover c ON c.ctg = k.ctg AND c.win = k.win AND c.t = k.t WHERE l <> '-' GROUP BY k.ctg, k.win""",
}


ONCE |= {"ctag", "cedge", "cworth", "ccolumns", "cbest", "cvia", "ccover"}


@query("SELECT r.ctg, r.win, coalesce(seq, '') AS seq FROM (SELECT DISTINCT ctg, win FROM cref) r LEFT JOIN ctext x ON x.ctg = r.ctg AND x.win = r.win")
def window_consensus(f):
    tags = _language_columns(f)
    return consensus.window_consensus(tags, _window_texts(tags), 0.0)
