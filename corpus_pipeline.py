"""From raw documents to packed training sequences, in five stages.

Language ID drops what has no language; of near copies one document stays;
personal data is masked; sources are mixed to target weights, good documents
first; texts become token ids packed into sequences. Every stage but the last
returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervalis.llm import bootstrap_pii, harmonic_packing, hyper_language, parity_join, source_mixing
from intervalis.llm._batches import free_names
from intervalis.llm.queries import quality_weights, tokenizer_path
from intervalis.plans.scratch import materialize

#: Texts with a lower cosine to every language are rejected.
MIN_LANGUAGE_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language of the corpus, go."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    prototypes = hyper_language.learn(docs.filter(~held))
    lang, score = free_names(docs, "lang_pred", "score")
    judged = hyper_language.predict(docs, prototypes, names=(lang, score))
    return judged.filter((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return parity_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses and numbers are masked, and n_chars counted anew; all documents stay."""
    return bootstrap_pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    quality = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return source_mixing.mixed(docs, quality).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of at most 2048."""
    return harmonic_packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("language id", language_id), ("near copies", near_copies), ("personal data", personal_data), ("mixing", mixing), ("packing", packing)]
#: SQL cannot learn language profiles or encode tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
