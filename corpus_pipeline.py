"""From raw documents to packed sequences: five stages, each written as Parquet and read again for the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns a row for
each piece of a document in a training sequence. Intermediate tables stand in the folder of spark.checkpoint.dir, each until the
next one is written; the last one stays, as the result reads it.

Defined results: a null text counts as empty in every stage and stays null until packing, where it is a document of the
end id alone; rows that repeat are near copies, of which one stays; null ids are ids like any other, of which rows are
judged by their text; further columns, whatever their names, travel along to the mixing stage's output; an empty table passes through as an
empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_copies, packing, pii, simhash, toxicity
from tessera.llm.common import shared_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; an empty text scores like any other, by features that are all zero."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    The one of the smallest id (null last), then of the least hash of the text. Texts without words are one group.
    """
    return simhash.one_of_each(docs, method=near_copies.near_copies, shingle=5, similarity=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; documents stand in training order, and those taken twice stand twice."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of bounded length, as few as can be."""
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Scores, fingerprints and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            _delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
