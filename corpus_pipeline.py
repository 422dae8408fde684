"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Language identification drops texts without a language and mends labels that the text contradicts; of near duplicates one stays; secrets are redacted; sources
are mixed to target weights; SentencePiece gives the ids. Null texts have no language and go first; every other case
is defined by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.llm import langid, minhash, mixing, pieces, secretscan
from affinis.llm.queries import MIX_WEIGHTS, mix_domain, piece_model
from affinis.llm.runtime import crc_bucket, stored

#: Bits that a byte takes without a model: a text that its best language doesn't code shorter is in none of them.
MOST_BITS = 8
#: Share of the likelihood of an average stretch of the text from which it overrules its label; a few letters may fit several languages.
SURE = 0.99
#: Share of the tokens that the mixture takes, once each.
MIX_FRACTION = 0.8
#: At a similarity of 0.8 these tables miss about two pairs in 100,000.
TENSOR = minhash.Tensor(rows=3, half=16)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of an unknown language go; a missing language is filled in, and one that the text contradicts is replaced.

    The text contradicts its label if another language has at least ``SURE`` of the likelihood. Unknown are texts without a letter and those that no language codes in fewer than ``MOST_BITS`` a byte.
    Columns of any name stay as they are.
    """
    model = langid.fit(docs.where(crc_bucket("doc_id", 5) != 0))
    aside = {c: f"_own_{c}" for c in langid.ADDED if c in docs.columns}
    tagged = langid.tag(docs.withColumnsRenamed(aside), model).where((F.col("lang_pred") != "und") & (F.col("bits") < MOST_BITS * F.octet_length("text")))
    label = F.when(F.col("score") < SURE, F.col("lang"))
    mended = tagged.withColumn("lang", F.coalesce(label, "lang_pred")).drop(*langid.ADDED)
    return mended.withColumnsRenamed({there: c for c, there in aside.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, by five-word shingles and a similarity of 0.8."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80, tensor=TENSOR)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in place; no document goes."""
    return secretscan.redact(docs, secretscan.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within each source's budget, in seeded order, once each."""
    return mixing.selected(docs, mix_domain(), MIX_WEIGHTS, fraction=MIX_FRACTION, epochs=1).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and their number."""
    return pieces.encode(docs, piece_model()).withColumn("n_tokens", F.size("ids"))


STAGES = [("language ID", identify_language), ("MinHash near-dedup", drop_near_duplicates), ("secret scans", redact_secrets), ("mixing sources", mix_sources), ("SentencePiece", encode_pieces)]

#: The stages learn models and merge byte pairs, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
