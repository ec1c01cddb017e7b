"""Helpers that several operators of this subpackage use: cutting lineage, size checks, row keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset, a new local one, in local mode only."""
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="morphlake-"))
    return folder or context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared folder, so that a lost executor never sends work back past this point."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learns_from(doc_id: str, divisor: int, held_out: int) -> Column:
    """True where crc32 of the id as text leaves another remainder than ``held_out``; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor != held_out, F.lit(True))


def id_text(doc_id: str = "doc_id") -> Column:
    """An id as text, in which form it passes pandas whole: a null beside it would make it a float there."""
    return F.col(doc_id).cast("long").cast("string").alias("doc_id")
