"""A corpus pipeline over ``documents``: each stage gets what the one before kept, written as Parquet and read again.

All stages but the last keep every column, whatever its name. Each judges a row by its own text, nulls as empty: a null or
empty text is scored as such by the first stage, is linked with nothing, holds no benchmark passage and no secret, and has no
token. Rows without an id are never dropped as copies. Rows that repeat are judged alike; of several rows of one id the copies
stage keeps one (see ``ngram_join.keep_one``). Empty tables give empty results; without labels nothing counts as toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe, decontaminate, ngram_join, secrets, toxicity

#: SQL can't express the network, the merges or the redaction's guess costs.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(toxicity.training_rows(docs), labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold much of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in a text is replaced by a mark, and n_chars follows the text."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document: count and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared folder, and goes when the next stage is written."""
    from eventloom.llm.common import remove, shared_folder

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
