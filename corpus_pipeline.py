"""A pipeline from raw documents to packed training sequences.

STAGES run in order; each gets what its predecessor kept and returns the columns of ``documents``
(the last one returns pieces of sequences).

1. language: documents without a letter, or whose most probable language has less than ``LEAST_SCORE``, go.
2. near_duplicates: one document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) stays,
   that with the smallest id.
3. secrets: spans of secrets are replaced by a mask, and ``n_chars`` is counted anew.
4. mix: a document stands as often as the mix of sources takes it.
5. pack: documents are cut and packed into sequences of 1024 ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.llm import langid, mixing, packing, secret_scan, simhash, tokens
from rillgrid.llm.common import free
from rillgrid.staging import fresh_path

LEAST_SCORE = 0.5
ORACLE_SQL = None  # models, fingerprints and tokenizers cannot be written in SQL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or with a doubtful language go."""
    model = langid.fit(docs)
    guess = free(docs, "guess")[0]
    marked = docs.withColumn(guess, langid.predicted(docs, model))
    known = (F.col(guess)["lang_pred"] != langid.UNKNOWN) & (F.col(guess)["score"] >= LEAST_SCORE)
    return marked.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; a null text stays null."""
    spans = free(docs, "spans")[0]
    found = secret_scan.scan(docs, out=spans)
    clean = found.withColumn("text", secret_scan.masked(F.col("text"), F.col(spans)))
    counted = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(docs, tokens.read_spec(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
