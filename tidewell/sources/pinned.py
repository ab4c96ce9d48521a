"""Tables that are written down once, so that what is read from them stays the same."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name in the folder that the cluster shares (spark.checkpoint.dir). Where none is named, a session on this machine alone
    gets a temporary one, and a session on a cluster raises ValueError."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("the session needs spark.checkpoint.dir, a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
    return f"{context.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df as it is now, from the shared folder: rows keep their order and partitions, and lost executors lose none of them."""
    shared_folder(df.sparkSession, "pinned")
    return df.checkpoint()
