"""The registered queries of this folder, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bwt_dedup, host_reputation, ngram_join, oracles, packing, piece_sampling, quality, substring_dedup, syncmers, token_counts, toxicity, vector_codes, warc, whitening
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("lang", "text")


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_merged_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.shared_byte_digests(table(spark, sf_dir, "documents"))


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op5_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_window_digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.in_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return host_reputation.judge(pages, host_reputation.labelled_outcomes(pages, table(spark, sf_dir, "labels")))


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_vantage_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings")).drop("label")


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_distribution_rules": op1_distribution_rules,
    "op2_sampled_pieces": op2_sampled_pieces,
    "op3_merged_bwt": op3_merged_bwt,
    "op4_closed_syncmers": op4_closed_syncmers,
    "op5_superkmer_dedup": op5_superkmer_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_url_reputation": op10_url_reputation,
    "op11_tiled_whitening": op11_tiled_whitening,
    "op12_vantage_codes": op12_vantage_codes,
    "op13_warc_index": op13_warc_index,
}

#: The others tokenise, sample, hash or train, which SQL can't; the tests hold them against brute force.
ORACLES: dict[str, str] = {"op3_merged_bwt": oracles.OP3, "op5_superkmer_dedup": oracles.OP5, "op7_ngram_jaccard": oracles.OP7, "op10_url_reputation": oracles.OP10, "op12_vantage_codes": oracles.OP12, "op13_warc_index": oracles.OP13}
