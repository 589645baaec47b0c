"""The thin queries over the operators, and DuckDB SQL where SQL can express them.

Each reads its whole table and returns the operator's full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, license_scan, piece_sampler, quality, secret_scan, simhash, substring_dedup, url_filter, warc
from .common import new_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents")).drop("n_chunks")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write_archive(_read(spark, sf_dir, "pages"), folder)
    return warc.parse_records(warc.read_records(spark, folder)).drop("url")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampler.encode_samples(_read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"), shingle=3)


def secret_columns(found: DataFrame) -> DataFrame:
    """The findings as counts, joined spans and their digest."""

    def joined(of):
        return F.array_join(F.transform(of, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")

    def count(name):
        return F.size(F.filter("findings", lambda f: f.kind == name)).cast("bigint").alias(f"n_{name}")

    base = F.filter("findings", lambda f: f.base)
    counts = [count(r.name) for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(secret_scan.scan_secrets(_read(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages")).drop("pattern")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_warc": op2_warc,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_decontaminate": op4_decontaminate,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_url_filter": op7_url_filter,
        "op8_quality": op8_quality,
        "op9_license_scan": op9_license_scan,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_TEMPLATES = ", ".join(f"({i}, '{label}', {base}, string_split('{text}', ' '))" for i, (label, text, base) in enumerate([(*p, True) for p in license_scan.PHRASES] + [(*n, False) for n in license_scan.NOTICES]))

_SQL = {
    "op9_license_scan": rf"""
        WITH w AS (
            SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{license_scan.WORD}') AS words FROM documents
        ), t(tid, label, base, words) AS (VALUES {_TEMPLATES}),
        g AS (SELECT tid, label, base, len(words) - 1 AS grams, i - 1 AS tpos, words[i] AS a, words[i + 1] AS b FROM t, unnest(range(1, len(words))) AS r(i)),
        e AS (SELECT uid, i - 1 AS pos, words[i] AS a, words[i + 1] AS b FROM w, unnest(range(1, len(words))) AS r(i)),
        votes AS (SELECT uid, tid, label, base, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS held FROM e JOIN g USING (a, b) GROUP BY ALL),
        steps AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER o > {license_scan.STEP}, true) THEN 1 ELSE 0 END AS new FROM votes WINDOW o AS (PARTITION BY uid, tid ORDER BY diagonal)),
        islands AS (SELECT *, sum(new) OVER (PARTITION BY uid, tid ORDER BY diagonal) AS island FROM steps),
        spans AS (SELECT uid, label, base, len(list_distinct(flatten(list(held)))) / grams AS cover, min(diagonal) AS start FROM islands GROUP BY uid, tid, label, base, grams, island),
        found AS (
            SELECT uid, count(*) FILTER (base AND cover = 1) AS n_base, min(start) FILTER (base AND cover = 1) AS first_word, max(start) FILTER (base AND cover = 1) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND cover = 1) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (cover >= CASE WHEN base THEN 1 ELSE {license_scan.COVER} END) AS labels,
                   max(CASE WHEN cover >= CASE WHEN base THEN 1 ELSE {license_scan.COVER} END THEN 1.0 WHEN NOT base THEN cover ELSE 0.0 END) AS score
            FROM spans GROUP BY uid
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM w LEFT JOIN found USING (uid)
    """,
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
        )
        SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest,
               CASE WHEN octet_length(b) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN octet_length(b) >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM p
    """,
    "op7_url_filter": r"""
        WITH u AS (
            SELECT page_id, coalesce(url, '') AS url,
                   CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE '' END AS raw_host
            FROM pages
        ), s AS (
            SELECT page_id, url, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM u
        ), rules(verdict, h, p) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), fits AS (
            SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
            FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id
        )
        SELECT s.page_id, host, path, rule,
               coalesce(verdict, CASE
                   WHEN regexp_matches(lower(url), '^[a-z]+://([^/?#]*\.)?(spam-farm|cheap-pills|free-bets|adult-[a-z0-9]+)\.') THEN 'block'
                   WHEN regexp_matches(lower(url), '[?&]sessionid=[0-9a-f]{16,}') THEN 'block'
                   WHEN regexp_matches(lower(url), '/wp-login\.php($|[?#])') THEN 'block'
                   ELSE 'allow' END) AS verdict
        FROM s LEFT JOIN fits USING (page_id)
    """,
    "op10_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), starts AS (
            SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win
            FROM w, unnest(generate_series(1, len(words) - 34)) AS g(i)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM starts) WHERE c > 1
        ), gone AS (
            SELECT DISTINCT doc_id, p FROM twice, unnest(generate_series(i, i + 34)) AS g(p)
        ), gone_list AS (
            SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
        ), k AS (
            SELECT w.doc_id, words, coalesce(ps, []) AS ps FROM w LEFT JOIN gone_list USING (doc_id)
        )
        SELECT doc_id, len(words) AS n_words, len(ps) AS n_removed,
               sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
        FROM k
    """,
}
