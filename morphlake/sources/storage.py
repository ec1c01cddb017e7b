"""Where intermediate tables go when a loop must be cut from its lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """A checkpoint of ``frame`` in spark.checkpoint.dir, or in a new folder where that is unset and Spark is local."""
    session = frame.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and not session.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        session.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="morphlake-"))
    return frame.checkpoint(eager=True)


def kept(frame: DataFrame) -> DataFrame:
    """``frame`` in files by columns, compressed, beside the checkpoints: for many rows, which are much smaller so."""
    session = frame.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        cut(session.range(1).limit(0))
    folder = f"{session.sparkContext.getCheckpointDir()}/{uuid4().hex}"
    frame.write.parquet(folder)
    return session.read.schema(frame.schema).parquet(folder)
