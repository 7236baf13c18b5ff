"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, one temporary folder a session on one machine; an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in the shared folder, which takes less room than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_batches(df: DataFrame, inputs: Iterable[Column], work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch of the columns ``inputs``, named a0, a1 and so on; None gives no rows.

    Only these columns are read, so other columns of ``df``, whatever their names, have no effect.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.select(*(c.alias(f"a{i}") for i, c in enumerate(inputs))).mapInArrow(run, schema)


def from_batches(df: DataFrame, inputs: Iterable[Column], work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """As ``over_batches``, where ``work`` gives several batches, none of which is held until the last is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.select(*(c.alias(f"a{i}") for i, c in enumerate(inputs))).mapInArrow(run, schema)


def text_of(column: str) -> Column:
    """The text in ``column``; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
