"""The queries of the text operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.langid import learn_and_identify

    return learn_and_identify(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.ngram_join import similar

    return similar(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.substring import passages

    return passages(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.exact import content_sort

    return content_sort(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.toxicity import learn_and_score

    return learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.bpe import vocabulary
    from tidegate.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"), vocabulary())


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.bpe import vocabulary
    from tidegate.llm.tokenbin import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidegate.llm.secretscan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidegate.llm.bpe import vocabulary
    from tidegate.llm.counts import edited_counts

    return edited_counts(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_shards": op7_token_shards,
    "op8_secret_scan": op8_secret_scan,
    "op9_edit_counts": op9_edit_counts,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), r AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS rn
            FROM n
        )
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
}
