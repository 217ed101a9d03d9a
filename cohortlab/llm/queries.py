"""The registered queries ``opN_<name>`` with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, jaccard, langid, lbl, licenses, packing, quality, secretscan, tokencount, urlfilter, variants, warc
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.languages(docs, langid.prototypes(docs))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), size=3, percent=90)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(secretscan.secrets(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.ranked_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def captures(pages: DataFrame) -> DataFrame:
    """Captures made of the pages, in the schema of ``warc.resolve``: of each
    page a full response and a not-modified one, at seconds spread by its id."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    date = F.concat(F.lit("day "), F.col("page_id") % 50)
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    some = lambda *hs: F.filter(F.array(*hs), lambda h: h["value"].isNotNull())
    when = lambda factor: F.lit(1_600_000_000) + F.col("page_id") * factor % 1_000_003
    etag = F.when(F.col("page_id") % 5 != 0, tag)
    weak = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("W/"), etag)).otherwise(etag)
    dated = F.when(F.col("page_id") % 10 != 0, date)
    full = pages.select((F.col("page_id") * 2).alias("capture_id"), "url", when(7919).alias("ts"), F.lit(200).alias("status"), etag.alias("etag"), dated.alias("last_modified"),
                        some(pair("Content-Type", F.lit("text/html")), pair("Cache-Control", F.lit("max-age=60")), pair("Date", when(7919).cast("string")),
                             pair("ETag", etag), pair("Last-Modified", dated)).alias("headers"), F.col("html").alias("payload"))
    not_modified = pages.select((F.col("page_id") * 2 + 1).alias("capture_id"), "url", when(104_729).alias("ts"), F.lit(304).alias("status"), weak.alias("etag"), date.alias("last_modified"),
                                some(pair("Cache-Control", F.lit("max-age=120")), pair("Date", when(104_729).cast("string")), pair("ETag", weak),
                                     pair("Content-Length", F.lit("0")), pair("Last-Modified", date)).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(not_modified)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.scores(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT page_id, url, html, regexp_extract(url, '^[^:/?#]*://([^#]*)', 1) AS rest, regexp_matches(url, '^[^:/?#]*://') AS good FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)?$', ''), '^www\\.', '') AS host,
        regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'),
          lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$'))) AS query FROM p),
k AS (SELECT page_id, html, CASE WHEN good THEN host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url_key,
        1600000000 + page_id * 7919 % 1000003 AS full_ts, 1600000000 + page_id * 104729 % 1000003 AS ts,
        CASE WHEN page_id % 5 <> 0 THEN '"' || md5(html) || '"' END AS etag, 'day ' || (page_id % 50) AS day FROM h),
f AS (SELECT page_id * 2 AS id, url_key, full_ts, etag, CASE WHEN page_id % 10 <> 0 THEN day END AS dated, html FROM k WHERE url_key IS NOT NULL AND html IS NOT NULL),
a AS (SELECT page_id * 2 + 1 AS capture_id, url_key, ts, etag, day FROM k),
m AS (SELECT a.capture_id, arg_max(f, (f.full_ts, f.id)) AS r FROM a JOIN f ON a.url_key = f.url_key AND f.full_ts < a.ts GROUP BY a.capture_id),
j AS (SELECT a.*, m.r, coalesce(a.etag = m.r.etag, a.day = m.r.dated) AS agree FROM a LEFT JOIN m USING (capture_id)),
o AS (SELECT *, CASE WHEN url_key IS NULL OR ts IS NULL THEN 'unplaced' WHEN r IS NULL THEN 'orphan' WHEN agree IS NULL THEN 'unvalidated'
        WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT capture_id, url_key, ts, r.id AS response_id, outcome,
    CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts
        || coalesce(chr(10) || 'etag: ' || coalesce(CASE WHEN capture_id // 2 % 3 = 0 THEN 'W/' ELSE '' END || etag, r.etag), '')
        || coalesce(chr(10) || 'last-modified: ' || r.dated, '') END AS headers,
    CASE WHEN outcome = 'resolved' THEN md5(r.html) END AS payload_md5,
    CASE WHEN outcome = 'resolved' THEN CAST(strlen(r.html) AS BIGINT) END AS payload_length
FROM o
"""

QUERIES = {f.__name__: f for f in (op1_packing, op2_language_id, op3_license_scans, op4_url_filters, op5_jaccard_join, op6_secret_scans, op7_quality_rules, op8_benchmark_decontamination, op9_token_counts, op10_warc_revisits, op11_source_divergence, op12_lm_scores, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {
    "op3_license_scans": licenses.oracle_sql(),
    "op10_warc_revisits": _WARC_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
}
