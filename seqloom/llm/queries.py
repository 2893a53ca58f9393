"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, exact_dedup, html_text, minhash, mixing, sharding, span_dedup, telephony, token_files, toxicity


def op1_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup.clean(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_units", "n_removed", F.concat_ws(",", "removed").alias("removed_units"), "text")


def op1_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_span_dedup without what its SQL leaves out."""
    out = span_dedup.clean(common.documents(spark, sf_dir), whole=True)
    return out.select("doc_id", "n_units", "n_removed", F.concat_ws(",", "removed").alias("removed_units"), "text")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ws, length(regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*')) AS lead FROM documents),
t AS (SELECT doc_id, unnest(ws) AS raw, unnest(range(len(ws))) AS i FROM w),
u AS (SELECT *, regexp_extract(raw, '^[^\x20\x09-\x0D]+') AS word FROM t),
v AS (SELECT *, coalesce(lag(regexp_matches(word, '[.!?]$') OR contains(raw, chr(10))) OVER (PARTITION BY doc_id ORDER BY i), true)::INTEGER AS starts FROM u),
s AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS sentence FROM v),
p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sentence ORDER BY i) - 1) // 16 AS piece FROM s),
x AS (SELECT doc_id, sentence, piece, string_agg(word, ' ' ORDER BY i) AS unit, string_agg(raw, '' ORDER BY i) AS raw, count(*) AS words FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence, piece) - 1 AS pos FROM x),
r AS (SELECT doc_id, pos, unit || chr(10) || lead(unit) OVER o || chr(10) || lead(unit, 2) OVER o AS run, words + lead(words) OVER o + lead(words, 2) OVER o AS words FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM r WHERE run IS NOT NULL AND words >= 10),
g AS (SELECT DISTINCT doc_id, pos + d AS pos FROM f, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
y AS (SELECT n.doc_id, count(*)::INTEGER AS n_units, count(g.pos)::INTEGER AS n_removed, coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY n.pos) FILTER (g.pos IS NOT NULL), '') AS removed_units,
  coalesce(string_agg(n.raw, '' ORDER BY n.pos) FILTER (g.pos IS NULL), '') AS text FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_units, '') AS removed_units,
  CASE WHEN d.text IS NULL THEN NULL ELSE substr(d.text, 1, lead) || coalesce(y.text, '') END AS text
FROM documents d JOIN w ON d.doc_id = w.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(common.documents(spark, sf_dir)).drop("__rid")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(common.documents(spark, sf_dir), 24)


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digest(common.documents(spark, sf_dir), like="lang")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(spark, common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_digest(spark, common.documents(spark, sf_dir), common.new_path(spark, "tokens"), common.tokenizer_path("word_bpe_49k.json"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(common.documents(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS nu, any_value(b.n) AS nv FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 75 AND b.n * 100 >= a.n * 75 GROUP BY ALL HAVING 100 * k >= 75 * (nu + nv - k)),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) ON a = doc_id
"""


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digest(common.documents(spark, sf_dir), common.tokenizer_path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir), max_repetition=2.0, budget=1.0).withColumns({c: F.round(c, 6) for c in ("tau", "weight", "repetition")}).drop("__rid")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS src,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS tokens FROM documents),
s AS (SELECT src, count(*) AS n_docs, sum(tokens)::BIGINT AS tokens FROM d GROUP BY src),
a AS (SELECT list(tokens::DOUBLE ORDER BY src) AS t, sum(tokens)::DOUBLE AS total FROM s),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL SELECT i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (
    SELECT i, lo, hi, m, 1.0 * list_max(list_transform(t, lambda x: pow(x / total, m) / x)) * total / list_sum(list_transform(t, lambda x: pow(x / total, m))) <= 2.0 AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m FROM b WHERE i < 60), a)),
w AS (SELECT hi AS tau, total, list_sum(list_transform(t, lambda x: pow(x / total, hi))) AS z FROM b, a WHERE i = 60),
p AS (SELECT src, tokens AS src_tokens, ceil(sqrt(n_docs))::BIGINT AS blocks, tau, pow(tokens / total, tau) / z AS weight, total * pow(tokens / total, tau) / z / tokens AS repetition FROM s, w),
q AS (SELECT *, floor(repetition + 1e-9)::BIGINT AS passes, greatest(floor((repetition - floor(repetition + 1e-9)) * src_tokens + 1e-6), 0)::BIGINT AS rest FROM p),
r AS (SELECT d.*, q.* EXCLUDE (src), (('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % blocks)::INTEGER AS block FROM d JOIN q USING (src)),
k AS (SELECT src, block, sum(tokens)::BIGINT AS block_tokens, any_value(passes) AS passes, any_value(rest) AS rest FROM r GROUP BY src, block),
e AS (SELECT *, unnest(range(0, passes + (rest > 0)::INTEGER)) AS pass FROM k),
o AS (SELECT *, row_number() OVER v - 1 AS block_pos, sum(block_tokens) OVER v AS upto FROM e
  WINDOW v AS (PARTITION BY src, pass ORDER BY ('0x' || substr(md5('12|' || pass || '|' || src || '|' || block), 1, 15))::BIGINT, block)),
m AS (SELECT *, CASE WHEN pass < passes THEN block_tokens ELSE rest - upto + block_tokens END AS room FROM o),
u AS (SELECT r.*, m.pass, m.block_pos, m.room, m.block_tokens FROM r JOIN m ON r.src = m.src AND r.block = m.block WHERE room > 0),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY src, pass, block ORDER BY ('0x' || substr(md5('13|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS inside FROM u)
SELECT doc_id, source, pass::INTEGER AS pass, block, block_pos::INTEGER AS block_pos, tokens, round(tau, 6) AS tau, round(weight, 6) AS weight, round(repetition, 6) AS repetition
FROM c WHERE room >= block_tokens OR inside <= room
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_span_dedup, op1_passage_dedup, op2_exact_dedup, op3_sharding, op4_telephony, op5_toxicity, op6_html_text, op7_token_files, op8_minhash, op9_bpe_roundtrip, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_span_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op8_minhash": OP8_SQL, "op10_mixing": OP10_SQL}
