"""A corpus pipeline: each stage takes (spark, docs, sf_dir), works on all rows and returns a DataFrame.

The stages drop documents of low quality, keep one document of each group of near copies, remove
secrets from the texts, sample documents to target weights and pack what remains into sequences.
All but the last return the columns of documents. Null texts count as empty everywhere, repeated rows
are rows of their own until near copies go, and an empty table gives an empty result of each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.llm import mixing, near_copies, packing, quality, secret_scan
from spokeworks.llm.common import read, shared_folder
from spokeworks.llm.queries import POWERS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores 0.3 or more.

    Null and empty texts are scored like any other; without labels the score is a constant 0.5 and all stay.
    """
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Texts without words are one group. Of rows that repeat an id each different text is a document of
    its own; rows without an id stay.
    """
    return near_copies.one_of_each(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew; null texts stay null, with null n_chars."""
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that the tokens by source, language and topic meet their targets.

    Texts without words weigh nothing and are drawn with their cell; rows that repeat an id are drawn together.
    """
    return mixing.sample(docs, powers=POWERS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document with its token ids and its place in a sequence of 4096 tokens; empty texts are their end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing weights", mixing_weights),
    ("best-fit packing", packed),
]

#: The stages' models can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, job: str | None = None) -> DataFrame:
    """Apply the stages to documents; each writes Parquet, in the cluster's shared folder, that the next one reads.

    job: a name for the run. A run of the same name takes up after the last stage that was finished, so
    a lost driver costs one stage; ``remove`` deletes a job's folders. Without a name each run is new.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{job or uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '-')}"
        if not exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _path(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, job: str) -> None:
    """Delete what the stages of a named job wrote; the result of its run can't be read from then on."""
    place, files = _path(spark, f"{shared_folder(spark)}/pipeline-{job}")
    files.delete(place, True)
