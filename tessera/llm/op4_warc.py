"""op4_warc: metadata and conversion records of every page, written as WARC files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, table
from tessera.llm.warc import block_of, derive, header, read_warc, response_record, write_warc


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record of the files: its type, id, what it refers to, and its digests as written and as found."""
    pages = table(spark, sf_dir, "pages")
    made = derive(pages.select(response_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record")))
    path = scratch(spark, "op4")
    write_warc(made.select(F.explode(F.array("record", "metadata", "conversion")).alias("value")), path, "gzip")
    rec, block = F.col("record"), block_of(F.col("record"))
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "source_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest"}
    back = read_warc(spark, path)
    return back.select(*[header(rec, n).alias(c) for c, n in names.items()], F.octet_length(block).cast("long").alias("n_bytes"), (F.concat(F.lit("sha256:"), F.sha2(block, 256)) == header(rec, "WARC-Block-Digest")).alias("intact"))


QUERIES = {"op4_warc": op4_warc}
_UUID = "'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-8' || {h}[14:16] || '-8' || {h}[18:20] || '-' || {h}[21:32] || '>'"
ORACLES = {
    "op4_warc": rf"""
WITH src AS (SELECT page_id, url, coalesce(html, '') AS html, nullif(regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g'), '') AS uri, chr(13) || chr(10) AS nl FROM pages),
resp AS (SELECT *, sha256('response' || chr(31) || page_id || chr(31) || coalesce(url, chr(0)) || chr(31) || html) AS h,
  'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html AS http,
  regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:!--.*?-->|(?i:script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>|head\b[^>]*>.*?</head\s*>))', ' ', 'g'), '<(?i:/?(?:br|p|div|h[1-6]|li|tr|article|nav|footer|title)\b)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS bare,
  regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g') AS title,
  regexp_extract(html, '(?i)<html\b[^>]*?\blang\s*=\s*["'']([^"''>]*)["'']', 1) AS lang,
  regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"''>]*)["'']', 1) AS links FROM src),
ids AS (SELECT *, {_UUID.format(h="h")} AS rid,
  replace(replace(replace(replace(replace(replace(replace(replace(bare, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&') AS plain FROM resp),
more AS (SELECT *, sha256('metadata' || chr(31) || rid) AS mh, sha256('conversion' || chr(31) || rid) AS ch,
  trim(regexp_replace(regexp_replace(plain, '[ \t\r\f]{{2,}}|[\t\r\f]', ' ', 'g'), '(?: \n|\n )[ \n]*|\n{{2,}}[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS body,
  'source-status: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl || 'source-header: Content-Length: ' || strlen(html) || nl || 'title: ' || title || nl || 'language: ' || lang
  || coalesce(array_to_string(list_transform(links, lambda x: nl || 'outlink: ' || regexp_replace(x, '[\r\n]+', ' ', 'g')), ''), '') AS fields FROM ids),
kinds AS (SELECT 'response' AS warc_type, rid AS record_id, uri AS target_uri, NULL AS refers_to, NULL AS concurrent_to, NULL AS source_digest, http AS block FROM more
  UNION ALL SELECT 'metadata', {_UUID.format(h="mh")}, uri, rid, NULL, 'sha256:' || sha256(html), fields FROM more
  UNION ALL SELECT 'conversion', {_UUID.format(h="ch")}, uri, rid, {_UUID.format(h="mh")}, 'sha256:' || sha256(html), body FROM more)
SELECT warc_type, record_id, target_uri, refers_to, concurrent_to, source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS n_bytes, true AS intact FROM kinds
"""
}
