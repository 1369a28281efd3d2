"""The queries over the test tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.llm.common import own_columns
from tempograin.llm.decontaminate import benchmark_hits
from tempograin.llm.exact_dedup import exact_dedup
from tempograin.llm.language import identify, learn_language_model
from tempograin.llm.licenses import LEAST, NOTICES, SHINGLE, license_matches, template_words, window_class
from tempograin.llm.mixing import mix
from tempograin.llm.quality import held_out, learn, quality_scores
from tempograin.llm.secrets import secret_spans, spans_digest
from tempograin.llm.simhash import hex_fingerprint, simhash_components
from tempograin.llm.tokens import token_counts
from tempograin.llm.warc import read_records, write_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


SQL["op1_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    best = F.coalesce(F.round(F.array_max("matches.containment"), 6), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join("matches.license", ",").alias("licenses"), best.alias("best_containment"))


def _license_sql() -> str:
    """Every window of every document against every notice, without MinHash."""
    rows = [(name, k, template_words(t)) for name, texts in NOTICES.items() for k, t in enumerate(texts)]
    notice = ", ".join(f"('{n}', {k}, {window_class(len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}))}, {w})" for n, k, w in rows)
    return f"""
WITH n(license, part, w, ws) AS (VALUES {notice}),
t AS (
  SELECT DISTINCT license, part, w, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM n)
), sizes AS (SELECT license, part, count(*) AS n FROM t GROUP BY license, part),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS ws FROM documents
), g AS (
  SELECT r, i - 1 AS i, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM d)
), m AS (
  SELECT r, license, part, (i // (w // 2) - o) * (w // 2) AS j, count(DISTINCT g.s) AS hit
  FROM g JOIN t ON g.s = t.s CROSS JOIN (VALUES (0), (1)) AS x(o)
  WHERE i // (w // 2) >= o GROUP BY ALL
), b AS (
  SELECT r, license, max(hit / n) AS c FROM m JOIN sizes USING (license, part) WHERE hit / n >= {LEAST} GROUP BY r, license
), l AS (
  SELECT r, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, max(c) AS c FROM b GROUP BY r
)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(round(c, 6), 0.0)::DOUBLE AS best_containment
FROM d LEFT JOIN l USING (r)
"""


SQL["op2_license_scan"] = _license_sql()


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    scored = quality_scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), *learn_language_model(table(spark, sf_dir, "documents")))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(own_columns(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


SQL["op6_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(8, len(ws)) AS n, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 7) + 1)) AS i FROM b WHERE len(ws) > 0)
), g AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))
), m AS (
  SELECT r, i, g.n, item_id FROM g JOIN p ON g.n = p.n AND g.k = p.k
), h AS (
  SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS w FROM m) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents")).select("doc_id", *spans_digest())


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_records(write_pages(table(spark, sf_dir, "pages")))
    number = lambda c: F.col(c).try_cast("long")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


SQL["op10_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages
), bits AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(sha1(payload), i, 1))::INTEGER), 4, '0')), 'string_agg', '') AS b FROM p
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * substr(b, i * 5 + 1, 1)::INTEGER + 8 * substr(b, i * 5 + 2, 1)::INTEGER + 4 * substr(b, i * 5 + 3, 1)::INTEGER
         + 2 * substr(b, i * 5 + 4, 1)::INTEGER + substr(b, i * 5 + 5, 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM bits
"""
