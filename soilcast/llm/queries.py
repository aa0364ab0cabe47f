"""Registered queries of the operators in this folder (production parameters, whole tables) and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from soilcast.llm import (bm25, forced_bpe, html_text, langid, mixing, nra, packing, pii, quality, records, simhash,
                          spelling, warc)
from soilcast.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("group_key")


@query("op2_bm25_top_k")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, F.col("doc_id") % 100 == 0)


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, found_into="n_found")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_binary_records")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"))


@query("op6_html_main_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op7_source_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *[f"mix.{c}" for c in ("size", "source_size", "target", "taken")])


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op9_warc_archives", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
FROM t""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op11_forced_boundary_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op12_ranked_search", r"""
WITH terms AS (
  SELECT d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, text FROM documents)),
ids AS (SELECT row_number() OVER () AS d, doc_id FROM documents),
tf AS (SELECT d, term, count(*) AS tf FROM terms GROUP BY d, term),
len AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY d),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf CROSS JOIN tot GROUP BY term, nn),
imp AS (SELECT d, tf.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS gain
        FROM tf JOIN len USING (d) JOIN w ON w.term = tf.term CROSS JOIN tot),
items AS (SELECT item_id, text, term, count(*) AS times FROM (
  SELECT item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, text, term),
scores AS (SELECT item_id, text, d, CAST(sum(times * gain) AS BIGINT) AS score
           FROM items JOIN imp USING (term) GROUP BY item_id, text, d HAVING sum(times * gain) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (
        PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scores JOIN ids USING (d))
WHERE rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
