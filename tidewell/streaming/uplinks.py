"""Uplink messages as a stream: the parsers hold no state, so they run on streams as they do on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators.uplink import parse_v2, parse_v3

PARSERS = {"v2": parse_v2, "v3": parse_v3}


def uplink_stream(spark: SparkSession, path: str, version: str = "v2", max_files: int = 100) -> DataFrame:
    """Messages from text files that arrive in a folder, one a line."""
    if version not in PARSERS:
        raise ValueError("the version is v2 or v3")
    return PARSERS[version](spark.readStream.option("maxFilesPerTrigger", max_files).text(path))
