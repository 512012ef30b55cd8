"""Entries of a growing folder of text logs: parsers are stateless projections, so they run on streams as they are."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Detection
from ..operators.parse import parse


def tail(spark: SparkSession, folder: str, detection: Detection, now: datetime) -> DataFrame:
    """A stream of entries; lines have no numbers, and the journal's blocks aren't supported."""
    if detection.format == "systemd_journal":
        raise ValueError("journal entries span lines; load them in batches")
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("source_file"), F.lit(None).cast("bigint").alias("line_number"), F.col("value").alias("raw_line"))
    return parse(lines, detection, now)


def hourly_stream(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Entries by hour; hours are final once times are ``late`` past them."""
    stamped = entries.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", "1 hour")).count()
