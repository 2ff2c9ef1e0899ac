"""One query for each training-data operator over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, exact_dedup, html_extract, langid, line_dedup, near_dedup, packing, quality_pu, sharding, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=16)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_documents(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss is borne by what follows a document's first line. Its limit is the sequence, as the contract wants little padding."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs.withColumn("share", packing.response_share(F.col("text"))), loss_col="share")


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.measure(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256 of the text that is left (null: empty), kept (something is left, or nothing went)."""
    rows = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("text_sha256"), ((F.col("n_dropped") == 0) | (F.trim(text) != "")).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_rendezvous_sharding,
        op2_html_extraction,
        op3_language_id,
        op4_exact_dedup,
        op5_packing,
        op6_quality_pu,
        op7_decontamination,
        op8_warc_transactions,
        op9_line_templates,
        op10_minhash_near_dedup,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_rendezvous_sharding": r"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_filter(list_transform(
    string_split(rtrim(regexp_replace(hex(coalesce(text, '')), '(..)', '\1,', 'g'), ','), ','),
    lambda h: CASE WHEN h = '' THEN NULL ELSE ('0x' || h)::BIGINT END), lambda x: x IS NOT NULL) AS b
  FROM documents),
keyed AS (
  SELECT doc_id, size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
    list_transform(range(17), lambda i: -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS s
  FROM bytes, polynomial),
placed AS (
  SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, list_position(s, list_min(s[1:16])) - 1 AS shard,
    list_position(s, list_min(s)) - 1 AS grown_shard,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || text_crc32 || '/' || size), 1, 3))::INT AS bucket
  FROM keyed)
SELECT doc_id, size, text_crc32, law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed""",
    "op4_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents)""",
    "op10_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1) USING (doc_id)""",
    "op7_decontamination": rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s
  FROM item_words WHERE len(w) > 0),
words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 's': array_to_string(w[i:i + k - 1], ' ')}})) AS p
  FROM words, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k),
hits AS (SELECT doc_id, p.i AS i, places.k AS k, item_id FROM places JOIN item_windows v ON v.k = places.k AND v.s = p.s),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM words LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)""",
    "op8_warc_transactions": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM d""",
    "op9_line_templates": r"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, pos, regexp_replace(regexp_replace(trim(regexp_replace(ls[pos], '[\t\x0B\f\r]', ' ', 'g')), ' +', ' ', 'g'),
    '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS masked
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM split)),
l AS (SELECT *, string_split(masked, ' ') AS t FROM lines),
paths AS (SELECT *, len(t) || '/' || array_to_string(t[1:3], ' ') AS leaf FROM l WHERE len(t) >= 3 OR trim(replace(masked, '<*>', '')) <> ''),
kinds AS (SELECT masked, leaf, any_value(t) AS t, min(doc_id) AS a, max(doc_id) AS z FROM paths GROUP BY 1, 2),
sizes AS (SELECT leaf, count(*) AS size FROM kinds GROUP BY 1 HAVING count(*) > 1 AND min(a) <> max(z)),
tokens AS (SELECT masked, leaf, size, k, t[k] AS token, a, z FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM kinds JOIN sizes USING (leaf))),
steady AS (SELECT leaf, k, token, count(*) AS c FROM tokens GROUP BY 1, 2, 3 HAVING count(*) > 1),
levels AS (SELECT unnest(range(6)) AS level, unnest([1 / 2, 1 / 8, 1 / 32, 1 / 128, 1 / 512, 0]::DOUBLE[]) AS share),
general AS (
  SELECT masked, level, leaf || '/' || string_agg(CASE WHEN c > size * share THEN 'is ' || token ELSE 'any' END, ' ' ORDER BY k) AS template, min(a) AS a, max(z) AS z
  FROM tokens LEFT JOIN steady USING (leaf, k, token), levels GROUP BY masked, leaf, level HAVING avg((coalesce(c, 0) > size * share)::INT) >= 0.8),
options AS (
  SELECT masked, level, 'general/' || template AS template FROM general WHERE template IN (SELECT template FROM general GROUP BY 1 HAVING min(a) <> max(z))
  UNION ALL SELECT masked, 6, masked FROM kinds WHERE a <> z),
chosen AS (SELECT masked, min_by(template, level) AS template FROM options GROUP BY 1),
found AS (SELECT doc_id, pos, template FROM paths JOIN chosen USING (masked)),
late AS (SELECT doc_id, pos FROM found QUALIFY row_number() OVER (PARTITION BY template ORDER BY doc_id, pos) > 1),
gone AS (SELECT doc_id, list(pos) AS places FROM late GROUP BY 1),
cut AS (
  SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(places), 0)::BIGINT AS n_dropped,
    CASE WHEN places IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(places, i)), chr(10)), '') END AS kept_text
  FROM split LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS text_sha256, n_dropped = 0 OR trim(kept_text) <> '' AS kept FROM cut""",
}
