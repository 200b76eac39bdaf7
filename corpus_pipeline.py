"""The corpus pipeline: documents in, token digests of the mixed corpus out.

Defined results, of every stage: an empty table gives an empty one; null texts
count as empty (and score as clean, have no secret, weigh nothing in the mix);
null ids are rows like any other; repeated rows are judged alike, and the
near-duplicate stage leaves one of them; very long texts are read whole; extra
columns, whatever their names, are passed on by all stages but the last, which
returns the digests only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import bpe, jaccard, mixing, queries, secrets, simhash, toxicity
from specloom.llm.common import durable, remove, shared_folder


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, toxicity.learnable()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: texts linked by SimHash or alike in 0.8 of their five-word shingles."""
    marked = durable(jaccard.marks(docs))
    return simhash.keep_first(docs, fps=marked, links=jaccard.links(docs, marked))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is cut out of its text; all documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of every remaining row."""
    import public_tokenizers

    return queries.bpe_digest(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", clean), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixture", mixture), ("tokens", tokens)]
#: SQL can't express the classifier, SimHash or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        folder = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:  # read for the last time by the stage now written
            remove(spark, before)
        before = folder
    return docs
