"""The queries ``opN_<name>``: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, lm_scoring, near_dup, packing, piece_codec, quality, secret_scan, sharding, topk, url_filter
from .common import id_bucket, shared_dir, table

#: Rules of op6 (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_bucket(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = lm_scoring.score_all(docs, ~held, vocabulary("byte_bpe_50k.json"), byte_level_pattern(), lower=True)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("strong", lambda p: p["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.written(F.col("strong")).cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), **near_dup.NARROW)
    return found.select("doc_id", near_dup.fingerprint_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(language_id.learnable(docs)))
    found = language_id.identify(docs, model, with_spans=False)
    return found.select("doc_id", F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four deliveries, are compacted, and are read back through the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/passagemill/store-{uuid.uuid4().hex}")
    for arrival in range(4):
        store.append(docs.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == arrival))
    store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), byte_level_pattern())


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_secret_scans, op3_near_duplicates, op4_language_id, op5_quality_rules, op6_url_filters, op7_sharding, op8_exact_top_k, op9_packing, op10_piece_codec)}
ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": r"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        split AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        best AS (
            SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
            FROM (SELECT DISTINCT host, path FROM split) u
            JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)""",
    "op7_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op8_exact_top_k": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}
