"""A training-data pipeline of five operators over ``documents``.

Every stage takes (spark, docs, sf_dir), where ``docs`` is what its predecessor
kept, and returns a DataFrame. All but the last return rows of ``documents`` with
their columns unchanged: a stage drops rows, it never edits them. Stages set the
session to hand texts to Python in batches of 1,000 rows, which bounds a worker's memory.

* toxicity: drops rows scored 0.5 or more by the model trained on ``labels``.
* language_id: drops rows without a letter, and those whose bits contradict every language's codeword.
* near_duplicates: keeps the row of least doc_id of each class of near copies: SimHash links of five-word shingles, widened to similarity 0.8 and checked exactly.
* decontamination: drops rows that hold an item of ``benchmark``.
* bpe: token count and digests of the encoded and decoded text of every row left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowgrid.llm import bpe, decontam, langid, nearcopies, toxicity
from sparrowgrid.llm.components import durable, hand_over_small


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_over_small(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_over_small(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_over_small(spark)
    return nearcopies.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_over_small(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_over_small(spark)
    return bpe.encode_documents(docs, bpe.vocabulary_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Trained models and iterated components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written to the shared folder before the next reads it, perhaps more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else durable(docs), sf_dir)
    return docs
