"""Queries opN_<name> over whole tables, and the SQL that expresses those that SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm import ann, hosts, langid, linededup, minhash, packing, pieces, simhash, toxicity, warc
from inkgraph.llm.shared import fold, spread

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    found = langid.identify(docs, docs.where(~F.coalesce(held_out, F.lit(True))))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(pieces.with_lengths(docs, public_tokenizers.path(TOKENIZER)))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.round_trip(docs, public_tokenizers.path(TOKENIZER))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edited(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 4) != 2))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_simhash, op2_language_id, op3_warc, op4_nearest, op5_packing, op6_pieces, op7_url_filter, op8_minhash, op9_line_dedup, op10_toxicity]
    return {f.__name__: f for f in named}


_OP3 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS least FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.least < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.least < d.page_id THEN f.least END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""

_OP7 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u
), p AS (
  SELECT page_id, translate(raw, '{hosts.UPPER}', '{hosts.LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
), b AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM r
), c AS (
  SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^([0-9]+(\\.[0-9]+){{3}}|\\[.*\\])$') AS number,
    CASE WHEN array_to_string(string_split(name, '.')[-2:], '.') IN ({", ".join(f"'{s}'" for s in hosts.SUFFIXES)}) THEN 2 ELSE 1 END AS labels FROM b
), d AS (
  SELECT * EXCLUDE (name, parts, number, labels), CASE WHEN number THEN name ELSE array_to_string(parts[-labels:], '.') END AS suffix,
    CASE WHEN number THEN name ELSE array_to_string(parts[-(labels + 1):], '.') END AS domain FROM c
), hosts AS (
  SELECT suffix, domain, host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM d GROUP BY suffix, domain, host
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(k) AS k, (sum(k) + 0.5) / (sum(n) + 1) AS raw FROM hosts GROUP BY suffix, domain
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (sum(k) + 0.5) / (sum(n) + 1) AS raw FROM hosts GROUP BY suffix
), top AS (
  SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS raw FROM hosts
), groups AS (
  SELECT 's' AS level, s.n, s.k, t.raw AS p FROM suffixes s, top t
  UNION ALL SELECT 'd', d.n, d.k, s.raw FROM domains d JOIN suffixes s ON d.suffix = s.suffix
  UNION ALL SELECT 'h', h.n, h.k, d.raw FROM hosts h JOIN domains d ON h.domain = d.domain
), fitted AS (
  SELECT level, coalesce((sum(CASE WHEN n > 0 THEN (k - n * p) * (k - n * p) / (n * p * (1 - p)) END) - sum(CASE WHEN n > 0 THEN 1 ELSE 0 END))
    / nullif(sum(CASE WHEN n > 0 THEN n - 1 END), 0), 0.5) AS rho FROM groups GROUP BY level
), m AS (
  SELECT level, 1 / greatest(least(rho, {hosts.RHO[1]}), {hosts.RHO[0]}) - 1 AS strength FROM fitted
), sm AS (
  SELECT s.suffix, (s.k + m.strength * t.raw) / (s.n + m.strength) AS mean FROM suffixes s, top t, m WHERE m.level = 's'
), dm AS (
  SELECT d.domain, (d.k + m.strength * sm.mean) / (d.n + m.strength) AS mean FROM domains d JOIN sm ON d.suffix = sm.suffix, m WHERE m.level = 'd'
), hm AS (
  SELECT h.host, (h.k + m.strength * dm.mean) / (h.n + m.strength) AS mean, h.n + m.strength AS size
  FROM hosts h JOIN dm ON h.domain = dm.domain, m WHERE m.level = 'h'
)
SELECT b.page_id, b.host, b.path, b.rule,
  CASE WHEN b.bad = 1 THEN 'block' WHEN b.bad = 0 THEN 'allow'
       WHEN hm.mean - {hosts.Z} * sqrt(hm.mean * (1 - hm.mean) / (hm.size + 1)) >= {hosts.BLOCK_FROM} THEN 'block' ELSE 'allow' END AS verdict
FROM b JOIN hm ON b.host = hm.host
"""

_OP9 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _OP3, "op7_url_filter": _OP7, "op9_line_dedup": _OP9}
