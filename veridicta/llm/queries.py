"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridicta.llm import entropy_mix, filter_audit, merkle, url_markov
from veridicta.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.prob_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.compression import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.transport import media_column

    return media_column(table(spark, sf_dir, "documents"))


def media_access_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every access unit of every document's stream, with its stamps and random-access mark."""
    from veridicta.llm.transport import access_units, media_column

    return access_units(media_column(table(spark, sf_dir, "documents"), keep_media=True), "media", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.suffix_trees import dedup_words

    return dedup_words(table(spark, sf_dir, "documents"), texts=False)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.gru_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.entropy_mix import mix

    return mix(table(spark, sf_dir, "documents"), columns=("doc_id", "source")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.multiprobe import search_embeddings

    return search_embeddings(table(spark, sf_dir, "embeddings"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridicta.llm.prefix_free import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veridicta.llm.packing import TOKENIZER, pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veridicta.llm.edit_counts import VOCABULARY, edited_counts

    return edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.url_verdicts(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' part of op12: host, path, the longest rule that fits, and what it says."""
    return url_markov.with_rules(table(spark, sf_dir, "pages")).drop("url")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_quality_classifier, op3_media_columns, op4_substring_dedup, op5_lm_scoring, op6_mixing, op7_nearest_neighbours,
        media_access_units, op8_suffix_array_dedup, op9_best_fit_packing, op10_token_counts, op11_filter_audit,
        op12_url_filters, url_rules, op13_merkle_manifest,
    )
}
ORACLES = {"op6_mixing": entropy_mix.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL, "url_rules": url_markov.RULES_SQL}
