"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.llm import decontaminate, html, language, lines, nearcopies, packing, quality, secrets, topk, warc
from tracelake.llm.common import table


def op1_warc(spark, sf_dir):
    """Every page as a record of a WARC archive converted from ARC, read back."""
    return warc.read_pages(warc.write_pages(table(spark, sf_dir, "pages"))).drop("url")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS b FROM p),
e AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + 16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT)
        + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT) AS BIGINT), 1)), '') AS d FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM e)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


def op2_decontaminate(spark, sf_dir):
    """Word windows shared by documents and benchmark items, per document."""
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(len(w) - 8, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 8], ' '))) AS g
  FROM iw WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(string_split(g, ' ')) AS n FROM win),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) AS w
  FROM documents),
cand AS (
  SELECT r, n, w, unnest(range(0, len(w) - n + 1)) AS s FROM dw CROSS JOIN lens WHERE len(w) >= n),
grams AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g FROM cand),
hit AS (SELECT r, n, s, item_id FROM grams JOIN win USING (g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, n, s FROM hit)) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(len(items), 0) >= 2 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

def op3_line_dedup(spark, sf_dir):
    """Lines of every document that repeat others, up to one edit in 20 characters, and where those are."""
    return lines.summary(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    """Every document's tokens in sequences of at most 1,024."""
    return packing.pack_public(table(spark, sf_dir, "documents"))


def op5_language(spark, sf_dir):
    """Predicted language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op6_near_copies(spark, sf_dir):
    """Components of documents whose sets of three-word shingles are 85 % alike."""
    return nearcopies.near_copies(table(spark, sf_dir, "documents"), 3, 85)


def op7_secrets(spark, sf_dir):
    """Spans of secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_html(spark, sf_dir):
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark, sf_dir):
    """Quality of every document from weak labels and the scorer they train."""
    return quality.classify(table(spark, sf_dir, "documents"))


def op10_top_k(spark, sf_dir):
    """Five best exact integer inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

QUERIES = {"op3_line_dedup": op3_line_dedup, "op6_near_copies": op6_near_copies, "op9_quality": op9_quality, "op8_html": op8_html, "op4_packing": op4_packing, "op7_secrets": op7_secrets, "op5_language": op5_language, "op1_warc": op1_warc, "op10_top_k": op10_top_k, "op2_decontaminate": op2_decontaminate}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op10_top_k": OP10_SQL, "op2_decontaminate": OP2_SQL}
