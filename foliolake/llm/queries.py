"""The operators' queries over the test tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import apply_bitmaps, keep_bitmaps

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS winner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, pos, line, hot.k IS NOT NULL AND keyed.doc_id <> winner AS gone
  FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {f.__name__: f for f in (op8_token_counts, op9_line_dedup)}
ORACLES = {"op9_line_dedup": OP9_SQL}


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES |= {f.__name__: f for f in (op4_quality, op6_toxicity)}


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest, windows

    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digest(windows(turns))


QUERIES |= {"op7_chat_format": op7_chat_format}


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
QUERIES |= {"op1_topk_search": op1_topk_search}
ORACLES |= {"op1_topk_search": OP1_SQL}


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES |= {"op2_ngram_jaccard": op2_ngram_jaccard}


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES |= {"op10_decontamination": op10_decontamination}


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


QUERIES |= {"op5_html_text": op5_html_text}


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import encode
    from .token_counts import tokenizer_path

    return encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES |= {"op3_sentencepiece": op3_sentencepiece}

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS seen FROM both_ways UNION SELECT r.doc_id, b.y FROM r JOIN both_ways b ON r.seen = b.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, CAST(least(s.doc_id, coalesce(m, s.doc_id)) AS BIGINT) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(seen) AS m FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""
ORACLES |= {"op2_ngram_jaccard": OP2_SQL}

#: The query's parameters (a budget of 2048, 256 tokens and 4 turns of history) and its template's lengths stand in the SQL as numbers.
OP7_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, len(regexp_extract_all(text, '\w+|[^\w\s]')) + 4 AS n,
         len(regexp_replace(regexp_replace(text, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g'))
           + CASE WHEN role = 'assistant' THEN 4 ELSE 6 + len(role) + 1 + 7 END AS chars
  FROM c),
u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t),
v AS (
  SELECT *, upto - n AS before, i = 1 AND role = 'system' AS is_system,
         max(CASE WHEN i = 1 AND role = 'system' THEN upto ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM u),
g AS (
  SELECT conv_id, i, system AS base FROM v WHERE i = 1
  UNION ALL
  SELECT v.conv_id, v.i, CASE WHEN v.upto - g.base > greatest(1, 2048 - 256 - v.system) AND v.before > g.base THEN v.before ELSE g.base END
  FROM g JOIN v ON v.conv_id = g.conv_id AND v.i = g.i + 1),
b AS (SELECT conv_id, base, row_number() OVER (PARTITION BY conv_id ORDER BY base) - 1 AS k FROM (SELECT DISTINCT conv_id, base FROM g)),
x AS (SELECT v.*, b.k FROM v JOIN g ON v.conv_id = g.conv_id AND v.i = g.i JOIN b ON b.conv_id = g.conv_id AND b.base = g.base),
h AS (
  SELECT x.conv_id, x.chars, row_number() OVER (PARTITION BY x.conv_id, b.k ORDER BY x.i DESC) AS back
  FROM x JOIN b ON x.conv_id = b.conv_id AND NOT x.is_system AND x.k < b.k AND b.k <= x.k + 4 AND b.base - x.before <= 256),
extra AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM h WHERE back <= 4
    UNION ALL SELECT b.conv_id, 3 FROM b
    UNION ALL SELECT x.conv_id, x.chars FROM x JOIN b ON x.conv_id = b.conv_id AND x.is_system AND b.k > 0) GROUP BY conv_id)
SELECT x.conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(x.chars) + any_value(extra.chars) AS BIGINT) AS formatted_chars
FROM x JOIN extra ON x.conv_id = extra.conv_id GROUP BY x.conv_id
"""
ORACLES |= {"op7_chat_format": OP7_SQL}
