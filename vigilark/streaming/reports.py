"""Signals kept up to date while report files arrive, by Structured Streaming.

The toolkit reads whole files; this is its signal table as a standing query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Reports as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_pair_counts(reports: DataFrame, time: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """`start`, `drug`, `reaction`, `n` per window of event time.

    State is one row per pair and open window; rows later than `late` are dropped by the watermark.
    """
    timed = reports.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "drug", "reaction")
    return timed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "drug", "reaction", "n")
