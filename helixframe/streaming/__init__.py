"""Alignment files as streams of a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.sources import sam
from helixframe.sources.header import Header


def read_text_stream(spark: SparkSession, path: str, header: Header, mode: str = "FAILFAST") -> DataFrame:
    """Records of the text files that arrive in a folder, by Spark's file stream."""
    return sam.decode(spark.readStream.text(path), header, mode)
