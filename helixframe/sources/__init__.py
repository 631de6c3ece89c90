"""File formats as sources and sinks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to a session."""
    from helixframe.runtime import prepare
    from helixframe.sources.bam import AlignmentSource
    from helixframe.sources.bgzf import BlockSource

    prepare(spark)
    spark.dataSource.register(AlignmentSource)
    spark.dataSource.register(BlockSource)
    return spark
