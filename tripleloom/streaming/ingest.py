"""Triplets as a stream: deduplicated ingestion and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from ..schemas import TRIPLET


def read_triplet_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of JSON lines as they arrive, with the time they were read."""
    stream = spark.readStream.schema(TRIPLET).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return stream.withColumn("seen_at", F.current_timestamp())


def distinct_triplets(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each triplet once within the watermark, so state stays bounded."""
    keys = ["subject", "subject_type", "relation", "object", "object_type"]
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(keys)


def relation_counts(stream: DataFrame) -> DataFrame:
    """Running mention counts of relations."""
    return stream.select(normalize_label(F.col("relation")).alias("relation")).filter("relation <> ''").groupBy("relation").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Counts by tumbling window and key; late rows beyond ``delay`` are left out by the watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
