"""The queries of the corpus operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    exact_dedup,
    html_extract,
    language_id,
    lexical_search,
    media,
    mixing,
    packing,
    pii,
    pivot_search,
    simhash,
    substring_dedup,
    whitening,
)
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repair_conversations(table(spark, sf_dir, "conversations"))


def op4_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_copies(media.rendered_vectors(table(spark, sf_dir, "embeddings")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[pii.tagged(k) for k in pii.KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(pii.all_spans()).alias("spans"),
        pii.span_list(F.array_sort("discovered")).alias("discovered"),
        pii.span_list(pii.all_spans(("secret",))).alias("secrets"),
        F.size(pii.all_spans(pii.RULED)).cast("long").alias("n_found"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_matches(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_text": op2_html_text,
    "op3_chat_format": op3_chat_format,
    "op4_media_copies": op4_media_copies,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_mix_sources": op10_mix_sources,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || doc_id::VARCHAR) AS k FROM documents),
ranked AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
rated AS (
  SELECT *, row_number() OVER o AS place,
         ((sum(source_size) OVER ())::DOUBLE * 1.5
            - 2.0 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM ranked WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
common AS (SELECT arg_min(rate, place) AS rate FROM rated WHERE rate * w <= 2.0 * source_size),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(c.rate * w, 2.0 * source_size)) AS target
  FROM rated CROSS JOIN common c),
budget AS (
  SELECT *, floor(target)::BIGINT AS b, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS epochs
  FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, epochs, b - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN budget t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.y, v.y)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM lengths),
sized AS (SELECT doc_id, 10 + (90 * n * nn) // l AS m FROM lengths, totals),
postings AS (SELECT term, doc_id, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY term, doc_id),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM postings, totals GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL, "op10_mix_sources": OP10_SQL, "op11_exact_top_k": OP11_SQL, "op12_lexical_search": OP12_SQL,
}
