"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import chat, decontam, linededup, mixing, quality, simhash, tokens, topk, toxicity, warc
from sluice.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, tau=4)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), block=128, budget=1.5, repeat=2.0)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_payload=0)


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"), host_col="source", max_ratio=0.001, min_pages=4)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), limit=512)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), F.round("importance", 3).alias("importance"), F.round("key", 6).alias("key"), "selected")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5)


QUERIES = {
    "op1_chat": op1_chat,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_topk": op4_topk,
    "op5_warc": op5_warc,
    "op6_linededup": op6_linededup,
    "op7_tokens": op7_tokens,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_chat": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS l FROM o GROUP BY conv_id),
r AS (SELECT min(conv_id) AS conv_id, n, l FROM c GROUP BY n, l),
m AS (SELECT conv_id, n FROM r WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.n > r.n AND b.l[1 : r.n] = r.l))
SELECT m.conv_id, CAST((o.pos - 1) // 256 AS INTEGER) AS segment, m.n AS n_turns,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM m JOIN o ON o.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY 1, 2, 3""",
    "op4_topk": """
WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * coalesce(c.e[i], 0))) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.id <> c.id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top,
             row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) // (1 << CAST((15 - 5 * (i % 4)) AS INTEGER))) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place = 1 THEN NULL ELSE top END AS refers_to
FROM d""",
    "op6_linededup": """
WITH p AS (SELECT *, min(id) OVER (PARTITION BY source, text) AS page
           FROM (SELECT row_number() OVER () AS id, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents)),
l AS (SELECT id, page, source, pos, lines[pos] AS line, trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
      FROM (SELECT id, page, source, lines, unnest(range(1, len(lines) + 1)) AS pos FROM p)),
tot AS (SELECT source, count(DISTINCT page) AS pages FROM p GROUP BY source),
cnt AS (SELECT source, k, count(DISTINCT page) AS n FROM l WHERE k <> '' GROUP BY source, k),
bad AS (SELECT cnt.source, cnt.k FROM cnt JOIN tot ON cnt.source IS NOT DISTINCT FROM tot.source WHERE n >= 4 AND n / pages > 0.001),
kept AS (SELECT l.id, l.pos, l.line FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.k = bad.k WHERE bad.k IS NULL),
s AS (SELECT id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY id)
SELECT p.doc_id, CAST(coalesce(len(p.lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(p.lines), 0) - coalesce(s.n, 0) AS INTEGER) AS n_dropped,
       CAST(CASE WHEN p.text IS NULL THEN NULL ELSE length(coalesce(s.text, '')) END AS INTEGER) AS n_chars,
       CASE WHEN p.text IS NULL THEN NULL ELSE sha256(coalesce(s.text, '')) END AS text_sha256
FROM p LEFT JOIN s ON p.id = s.id""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
