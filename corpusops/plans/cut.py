"""Cutting the lineage of loops, and tables on the way, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary folder only where none is set and driver and tasks are one process."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query inside is deleted when the query ends, not when the driver's memory is next cleaned. For frames that are computed once."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder; its files go with the frame where the session cleans checkpoints."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
