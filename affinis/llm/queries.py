"""Queries over the test tables, one for each operator, with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fingerprint, langid, licenses, minhash, mixing, multiindex, oracles, pieces, secretscan, sharding, toxicity, urlrules, variants, whitening
from .runtime import crc_bucket, table


#: Folder of the public tokenizers' files; a parameter of the queries that need one.
TOKENIZERS = "/opt/tokenizers"


def piece_model(folder: str = TOKENIZERS) -> bytes:
    return Path(folder, "piece_bpe_32k.model").read_bytes()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents"), model), model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_bucket("doc_id", 5) != 0))
    out = langid.identify(docs, model)
    return out.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "bits")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secretscan.digest(secretscan.scan(docs, secretscan.fit(docs)))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels.where(crc_bucket("doc_id", 4) != 2)))
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlrules.rule_table(spark, urlrules.DEFAULT_RULES)
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


#: Target weights of op10 and of the pipeline; a domain is the last digit of the source's name, by halves.
MIX_WEIGHTS = {"domain": {"low": 2.0, "high": 1.0}, "language": {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0}}


def mix_domain():
    return F.when(F.col("source").rlike("[5-9]$"), F.lit("high")).otherwise(F.lit("low"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mix_domain(), MIX_WEIGHTS, fraction=0.5, epochs=2)
    return out.select("doc_id", "domain", "language", "origin", "epoch", "tokens", "budget", "upto")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents"), licenses.TEMPLATES))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=16)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.count_words(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_secret_scans, op4_minhash_near_dedup, op5_sharding, op6_toxicity, op7_embedding_near_dedup, op8_document_fingerprints, op9_url_filters, op10_mixing_sources, op11_license_scans, op12_embedding_whitening, op13_spelling_variants)}

ORACLES = {
    "op4_minhash_near_dedup": oracles.OP4,
    "op7_embedding_near_dedup": oracles.OP7,
    "op9_url_filters": oracles.OP9,
    "op10_mixing_sources": oracles.op10(seed=7, fraction=0.5, epochs=2, weights=MIX_WEIGHTS),
    "op11_license_scans": oracles.op11(licenses.TEMPLATES),
    "op13_spelling_variants": oracles.OP13,
}
