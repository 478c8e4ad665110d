"""Documents made ready for training: rejected ones go, one of each group of near copies stays, secrets are
masked, and what remains is packed into sequences.

Each stage works on all that the one before it kept. All but the last return the columns of documents, whatever else there is of
them and however it is named.

Null and empty texts are scored as the classifier scores empty text; where they are kept, the join keeps each of them, since
without words they are like nothing, the scan leaves them as they are (null stays null, and so does its ``n_chars``), and packing counts
them as one closing id. Of repeated rows, and of rows with one text under several ids, the join keeps one: the smallest id, a null one last.
Very long texts take part whole. An empty table gives an empty result with the same columns; without labels of both kinds
every text has the share of good labels as its score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import credentials, jaccard, packing, quality
from tierflow.workspace import durable

#: Texts scored below this are rejected.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the dictionary classifier, learnt from the labels, does not reject."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by three quarters."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credentials masked in the text."""
    masked = credentials.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("best-fit packing", sequence_packing),
]

#: Compression and merges cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
