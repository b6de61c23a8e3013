"""The queries of this subpackage over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.coder import read_ids, write_ids
from readloom.llm.conversations import conversation_audits, damaged
from readloom.llm.decontam import benchmark_matches
from readloom.llm.html import extract_text
from readloom.llm.jaccard import jaccard_components
from readloom.llm.langid import predict_languages
from readloom.llm.lines import dedup_lines
from readloom.llm.merkle import leaf_hash, multiproofs
from readloom.llm.multiindex import near_vectors
from readloom.llm.packing import packed
from readloom.llm.passages import passage_digests
from readloom.llm.quality import quality_scores
from readloom.llm.transducer import token_counts
from readloom.session import scratch_folder, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "weak_label", "quality_score", (F.col("quality_score") >= 0.5).alias("accepted"))


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, folder)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).alias("item_ids"),
        F.array_max(F.transform("matches", lambda m: m["score"])).alias("top_score"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_audits(damaged(_table(spark, sf_dir, "conversations")))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(_table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, grp, leaf, claim``: where 3 divides the crc32 of the id, the claim has A-Z of the text in lower case."""

    def hashed(text: Column) -> Column:
        return leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = hashed(F.col("text"))
    claim = F.when(tampered, hashed(F.translate("text", UPPER, LOWER))).otherwise(leaf)
    return docs.select("doc_id", F.col("lang").alias("grp"), leaf.alias("leaf"), claim.alias("claim"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiproofs(manifest_leaves(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_id_files": op2_id_files,
    "op3_token_counts": op3_token_counts,
    "op4_near_vectors": op4_near_vectors,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_languages": op6_languages,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_main_text": op10_main_text,
    "op11_conversations": op11_conversations,
    "op12_passages": op12_passages,
    "op13_manifest": op13_manifest,
}

# the unsigned crc32 of a text of ASCII characters, bit by bit
CRC32 = r"""
xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]),
        lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))
"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


BLANK = r"[\x20\x09-\x0D]"

SQL: dict[str, str] = {
    "op11_conversations": rf"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM raw WHERE fault <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
        regexp_replace(text, '{BLANK}+$', '') AS body, left(role, 1) AS r
    FROM damaged
), turns AS MATERIALIZED (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), conv AS (
    SELECT DISTINCT coalesce(conv_id::VARCHAR, '') AS key, conv_id FROM conversations
), walk AS (
    SELECT key, 0 AS i, [{{'c': 0, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}] AS v FROM conv
    UNION ALL
    SELECT w.key, w.i + 1, list_transform([
            [[{{'c': e[1].c + 2, 'a': e[1].a || 'D'}}]],
            [[{{'c': e[2].c + 2, 'a': e[2].a || 'D'}}], CASE WHEN t.fault IN ('blank', 'duplicate') THEN [] WHEN t.r = 's' THEN [{{'c': e[1].c + t.more, 'a': e[1].a || 'K'}}] ELSE [] END],
            [[{{'c': e[3].c + 2, 'a': e[3].a || 'D'}}], CASE WHEN t.fault IN ('blank', 'duplicate') THEN [] ELSE list_transform([e[1], e[2], e[4]],
                lambda x: {{'c': x.c + t.more + CASE WHEN t.r = 'u' THEN 0 ELSE 1 END, 'a': x.a || CASE WHEN t.r = 'u' THEN 'K' ELSE 'R' END}}) END],
            [[{{'c': e[4].c + 2, 'a': e[4].a || 'D'}}], CASE WHEN t.fault IN ('blank', 'duplicate') THEN [] ELSE
                [{{'c': e[3].c + t.more + CASE WHEN t.r = 'a' THEN 0 ELSE 1 END, 'a': e[3].a || CASE WHEN t.r = 'a' THEN 'K' ELSE 'R' END}}] END]
        ], lambda s: list_sort(flatten(s))[1])
    FROM (
        SELECT key, i, [v[1], v[2], e2, list_sort([v[4], {{'c': e2.c + 5, 'a': e2.a || 'I'}}])[1]] AS e FROM (
            SELECT key, i, v, list_sort([v[3], {{'c': v[1].c + 5, 'a': v[1].a || 'I'}}, {{'c': v[2].c + 5, 'a': v[2].a || 'I'}}, {{'c': v[4].c + 5, 'a': v[4].a || 'I'}}])[1] AS e2 FROM walk)
    ) w JOIN (SELECT coalesce(conv_id::VARCHAR, '') AS key, i, r, fault, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM turns) t ON t.key = w.key AND t.i = w.i + 1
), best AS MATERIALIZED (
    SELECT key, list_sort([v[1], v[4], {{'c': v[3].c + 5, 'a': v[3].a || 'I'}}, {{'c': v[2].c + 10, 'a': v[2].a || 'II'}}])[1] AS b FROM (
        SELECT key, arg_max(v, i) AS v FROM walk GROUP BY key)
), edit AS (
    SELECT key, b.a AS audit, 1 AS p, 1 AS i, 'x' AS at, CAST(NULL AS VARCHAR) AS line FROM best
    UNION ALL
    SELECT e.key, e.audit, e.p + 1, CASE WHEN e.audit[e.p] = 'I' THEN e.i ELSE e.i + 1 END,
        CASE e.audit[e.p] WHEN 'D' THEN e.at WHEN 'K' THEN t.r ELSE CASE WHEN e.at = 'u' THEN 'a' ELSE 'u' END END,
        CASE e.audit[e.p] WHEN 'D' THEN NULL WHEN 'K' THEN t.role || ':' || t.text
            ELSE CASE WHEN e.at = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN e.audit[e.p] = 'R' THEN t.text ELSE '' END END
    FROM edit e LEFT JOIN (SELECT coalesce(conv_id::VARCHAR, '') AS key, i, r, role, text FROM turns) t ON t.key = e.key AND t.i = e.i AND e.audit[e.p] <> 'I'
    WHERE e.p <= length(e.audit)
), repaired AS (
    SELECT key, string_agg(line, chr(10) ORDER BY p) AS body FROM edit WHERE line IS NOT NULL GROUP BY key
), facts AS (
    SELECT coalesce(conv_id::VARCHAR, '') AS key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT conv.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM conv JOIN best USING (key) LEFT JOIN facts USING (key) LEFT JOIN repaired USING (key)
""",
    "op12_passages": r"""
WITH doc AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS rank,
        list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS MATERIALIZED (
    SELECT rid, rank, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT rid, rank, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)
), hit AS (
    SELECT rid, i FROM win JOIN (SELECT k, min(rank) AS first FROM win GROUP BY k) USING (k) WHERE first < rank
), covered AS (
    SELECT DISTINCT rid, i + j AS i FROM hit, range(50) r(j)
), kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM (
        SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc) ANTI JOIN covered USING (rid, i) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (rid)
""",
    "op13_manifest": rf"""
WITH RECURSIVE doc AS (
    SELECT *, CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 3 = 0
        THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents
), leaf AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
        sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("other")}) AS claim
    FROM doc
), placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf
), node AS (
    SELECT tree, 0 AS level, idx, leaf AS h, n FROM placed
    UNION ALL
    SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) - 1) // 8 + 1
    FROM node WHERE n > 1 GROUP BY tree, level, idx // 8
), subroot AS MATERIALIZED (
    SELECT tree, h FROM node WHERE n = 1
), top AS (
    SELECT -1 AS tree, 0 AS level, tree AS idx, h, (SELECT count(*) FROM subroot) AS n FROM subroot
    UNION ALL
    SELECT -1, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) - 1) // 8 + 1
    FROM top WHERE n > 1 GROUP BY level, idx // 8
), run AS MATERIALIZED (
    SELECT tree, level, idx // 8 AS up, array_agg(h ORDER BY idx) AS hs FROM (SELECT * FROM node UNION ALL SELECT * FROM top) WHERE n > 1 GROUP BY ALL
), climb AS (
    SELECT idx AS first_idx, tree AS own, tree, 0 AS level, idx, n, '' AS proof, claim AS folded FROM placed
    UNION ALL
    SELECT c.first_idx, c.own, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
        CASE WHEN c.n > 1 THEN c.idx // 8 ELSE c.own END, CASE WHEN c.n > 1 THEN (c.n - 1) // 8 + 1 ELSE (SELECT count(*) FROM subroot) END,
        CASE WHEN c.n > 1 THEN c.proof || array_to_string(list_concat(r.hs[:c.idx % 8], r.hs[c.idx % 8 + 2:]), '') ELSE c.proof END,
        CASE WHEN c.n > 1 THEN sha256(array_to_string(list_concat(list_append(r.hs[:c.idx % 8], c.folded), r.hs[c.idx % 8 + 2:]), '')) ELSE c.folded END
    FROM climb c LEFT JOIN run r ON r.tree = c.tree AND r.level = c.level AND r.up = c.idx // 8 AND c.n > 1
    WHERE c.n > 1 OR c.tree >= 0
)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.h AS verified
FROM placed p JOIN subroot s ON s.tree = p.tree JOIN climb c ON c.own = p.tree AND c.first_idx = p.idx AND c.tree = -1 AND c.n = 1
CROSS JOIN (SELECT h FROM top WHERE n = 1) t
""",
    "op4_near_vectors": r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), pair AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a
)
SELECT e.vec_id, (SELECT count(*) FROM pair WHERE pair.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
""",
    "op8_jaccard_join": r"""
WITH RECURSIVE word AS (
    SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM word
), token AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, md5(unnest(s)) AS t FROM sets
), pair AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM token a JOIN token b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, r.component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = sets.doc_id
""",
}
