"""Cutting lineage in the shared folder, as in the rest of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from vigilark.sources import tables
from vigilark.sources.tables import settle, shared_folder

__all__ = ["release", "settle", "settle_bucketed", "shared_folder"]


def settle_bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written once under the shared folder, bucketed by `key`: joins and groups by the key move none of its rows."""
    spark, name = df.sparkSession, f"settled_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    out._settled_at, out._settled_as = path, name
    return out


def release(*frames: DataFrame) -> None:
    """Delete what was settled as Parquet for these frames, bucketed or not."""
    for df in frames:
        if hasattr(df, "_settled_as"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._settled_as}")
        tables.release(df)
