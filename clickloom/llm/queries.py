"""The queries of this subpackage over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, exact_dedup, line_dedup, maxent_lm, mixing, near_dup, packing, quality, secret_scan, url_filter


def vocabulary() -> packing.Vocabulary:
    """Where a public vocabulary lies; it is read there and never copied."""
    import public_tokenizers

    return packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and novel spans of every whole text of documents; null texts count as empty and have none."""
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probabilities of every whole text of documents, learned from the rows that aren't held out; a null text is one end token."""
    return maxent_lm.score_documents(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines deleted from every document as later copies of runs of 50 words or more, with a digest of the text that stays; a null text is one blank line."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text of documents, learned from labels of the rows that aren't held out; empty texts score by the bias."""
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every url of pages; null urls have empty parts and no rule."""
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), url_filter.rule_frame(spark))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of documents, of which the largest doc_id stays; null texts count as empty."""
    return exact_dedup.dedup_exact(_read(spark, sf_dir, "documents"), keep="largest")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each stated query vector of embeddings by inner product; null, zero and non-finite vectors take no part."""
    return ann_search.nearest(_read(spark, sf_dir, "embeddings"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, with its source's size and target; null sources are one source, null texts have size 0."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a similarity of 0.8 or more of two-word shingles; texts without words are linked with nothing."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), near_dup.NearDupParams(words=2))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens; a null text is its closing id alone."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_maxent_lm, op3_line_dedup, op4_quality, op5_url_filter, op6_exact_dedup, op7_ann_search, op8_mix_sources, op9_near_dup, op10_packing)
}

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)

ORACLE_SQL = {
    "op5_url_filter": rf"""
        WITH rules(verdict, host, path) AS (VALUES {_RULES_SQL}),
        parts AS (
            SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
                   row_number() OVER () AS n FROM pages),
        split AS (
            SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        best AS (
            SELECT s.n, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY s.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS nth
            FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
        SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, '{url_filter.DEFAULT_VERDICT}') AS verdict
        FROM split s LEFT JOIN best b ON s.n = b.n AND b.nth = 1""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_mix_sources": rf"""
        WITH rows AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS chars FROM documents),
        sizes AS (
            SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM rows GROUP BY source),
        levels AS (SELECT *, 3.0::DOUBLE * source_size / weight AS full_at FROM sizes),
        steps AS (
            SELECT full_at, ((sum(source_size) OVER ())::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY full_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY full_at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM levels),
        final AS (SELECT level FROM steps WHERE level <= full_at ORDER BY full_at LIMIT 1),
        targets AS (
            SELECT source, source_size, least(weight * level, 3.0::DOUBLE * source_size)::DOUBLE AS target FROM levels, final),
        needs AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM targets),
        keyed AS (
            SELECT r.doc_id, r.size, n.source_size, n.target, n.epochs, round(n.target - n.epochs * n.source_size)::BIGINT AS need, n.source,
                   -ln((('0x' || substr(md5('17:' || r.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
                   / greatest(0.2::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + abs(r.chars::DOUBLE / greatest(r.size, 1) - 6.5::DOUBLE) / 6.5::DOUBLE)) AS key
            FROM rows r JOIN needs n ON r.source IS NOT DISTINCT FROM n.source),
        cum AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM keyed)
        SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(need - before, 0), size))::BIGINT AS taken FROM cum""",
}
