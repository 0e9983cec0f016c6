"""From raw documents to packed training sequences, a stage at a time.

Every stage but the last takes and returns the columns of documents, whatever others there are beside doc_id and
text, under their names and as they are; run() writes each stage's rows to the shared folder and reads them again, so
a later stage never computes an earlier one twice.

Defined cases, stage by stage: a null text counts as an empty one, which the classifier scores like any other and
whose kept row stays null; a null or empty text is no near-duplicate, holds no passage and no secret, and packs as the
end id alone. Repeated rows are scored alike, are one document for the near-duplicate stage, which keeps them
all or none, and are packed each for itself. A null doc_id is linked with nothing. Texts are read whole, however long.
An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import common, decontaminate, near_duplicates, packing, quality, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of rows that aren't held out."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accept(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates (five words, 0.8)."""
    return near_duplicates.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date."""
    ledger = common.materialize(secrets.scan(docs), "secret-ledger")
    masked = secrets.redact(docs, ledger)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.packed(docs, end_id=2)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: No SQL computes the classifier's fit, MinHash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"pipeline-{k}")
    return docs
