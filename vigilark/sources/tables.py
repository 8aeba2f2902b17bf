"""Cutting lineage in the shared folder, and tables kept for later runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`.

    Only a session on one machine may do without the setting, as in tests: it gets a folder beside the
    warehouse. On a cluster a machine's own folder would lose what is kept there, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            place = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def settle(df: DataFrame, columnar: bool = False, parts: list[str] | None = None) -> DataFrame:
    """`df` computed once and kept under the shared folder.

    `columnar` writes Parquet, for tables that are wide, read in part, or given back by `release`; else
    the rows are checkpointed. The columns `parts`, of which there are few different values, are folders, so that a filter on
    them reads its own share only.
    """
    folder = shared_folder(df.sparkSession)
    if not columnar:
        return df.checkpoint(eager=True)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=parts)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what `settle` wrote as Parquet for these frames; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save_table(df: DataFrame, path: str) -> None:
    """A small table kept for other runs: vectors, scaler parameters, losses."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table kept for other runs, bucketed by `keys`: groups and joins by these move none of its rows."""
    name = _name_of(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_bucketed(df: DataFrame, path: str) -> None:
    """Forget a table of `save_bucketed` and delete what it holds."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {_name_of(path)}")
    df._settled_at = path
    release(df)


def load_bucketed(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table of `save_bucketed`, in this session or another; the keys and their number have to be those it was saved with."""
    name, columns = _name_of(path), spark.read.parquet(path).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _name_of(path: str) -> str:
    return f"kept_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
