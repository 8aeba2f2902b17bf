"""Writers: delimited text from DataFrames, one folder of part files each."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.operators.ranks import dense_index
from vigilark.sources.tables import settle


def write_rows(rows: DataFrame, path: str, delimiter: str = "|", append: bool = False, header: bool = False) -> None:
    """Any flat table as delimited lines."""
    rows.write.mode("append" if append else "overwrite").option("sep", delimiter).option("header", header).csv(path)


def write_vectors(vectors: DataFrame, path: str, delimiter: str = "|") -> None:
    """`term` and the components of `v`, one line per term."""
    line = F.concat_ws(delimiter, F.array(F.col("term").cast("string")), F.col("v").cast("array<string>"))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)


def square_matrix(sims: DataFrame, names: list) -> DataFrame:
    """Long `i`, `j`, `sim` as one row per `i` with a column per name, in order of `i`.

    The names are given, so their number is known and no pass is spent on finding them. For more than some
    thousand names, `write_matrix` writes the same without a column for each.
    """
    return sims.groupBy("i").pivot("j", names).agg(F.first("sim")).orderBy("i")


def ranking_table(ranked: DataFrame, metrics: list[str]) -> DataFrame:
    """Top-k lists side by side: per rank a name and a score column for each metric."""
    wide = ranked.groupBy("rank").pivot("metric", metrics).agg(F.first("term").alias("name"), F.first("sim").alias("score"))
    return wide.orderBy("rank")


def stat_table(results: DataFrame, metrics: list[str], stat: str | None = None) -> DataFrame:
    """Long `drug`, `metric`, `stat`, `value` as rows of drug and stat, a column per metric."""
    rows = results.filter(F.col("stat") == stat) if stat else results
    return rows.groupBy("drug", "stat").pivot("metric", metrics).agg(F.first("value"))


def transpose(rows: DataFrame, index: str) -> DataFrame:
    """Columns become rows: `index` keeps its name and holds the old column names."""
    values = [c for c in rows.columns if c != index]
    cells = rows.select(F.col(index).cast("string").alias("_new"), *[F.col(c).cast("string") for c in values])
    return cells.unpivot(["_new"], values, index, "_cell").groupBy(index).pivot("_new").agg(F.first("_cell"))


def matrix_lines(cells: DataFrame, row: str, column: str, value: str, delimiter: str = "|") -> DataFrame:
    """`at`, `row`, `line`: a header of all columns (`at` -1), then a line for each row, missing cells empty.

    Columns stand in the order of their names, and so do rows by `at`, both as given by distributed
    indexes; no column of the result is made for a name, so there may be any number. What one task
    holds is one line. Of repeated cells the largest value is written; rows and columns are told apart as text.
    """
    text = cells.select(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column"), F.col(value).cast("string").alias("value"))
    text = settle(text.groupBy("row", "column").agg(F.max("value").alias("value")), columnar=True)
    columns = settle(dense_index(text.select("column").distinct(), "column").withColumnRenamed("index", "place"), columnar=True)
    rows = settle(dense_index(text.select("row").distinct(), "row").withColumnRenamed("index", "at"), columnar=True)
    width = columns.count()
    names = columns.select(F.lit("").alias("row"), F.lit(-1).cast("bigint").alias("at"), "place", F.col("column").alias("value"))
    filled = text.join(columns, "column").join(rows, "row").select("row", "at", "place", "value")

    def line(key, table):
        own = np.full(width, "", object)
        own[table.column("place").to_numpy()] = ["" if x is None else x for x in table.column("value").to_pylist()]
        at, name = (x.as_py() for x in key)
        return pa.table({"at": pa.array([at], pa.int64()), "row": pa.array([name], pa.string()), "line": pa.array([delimiter.join([name or "", *own])], pa.string())})

    return names.unionByName(filled).groupBy("at", "row").applyInArrow(line, "at bigint, row string, line string")


def write_matrix(cells: DataFrame, path: str, row: str = "i", column: str = "j", value: str = "sim", delimiter: str = "|") -> None:
    """Long cells as a matrix in text: a header line, then a line for each row in order, over part files in this order."""
    matrix_lines(cells, row, column, value, delimiter).orderBy("at").select("line").write.mode("overwrite").text(path)


def write_transposed(rows: DataFrame, index: str, path: str, delimiter: str = "|") -> None:
    """The columns of a table as lines, in the order of their names, its rows as the columns: any number of both."""
    values = [c for c in rows.columns if c != index]
    cells = rows.select(F.col(index).cast("string").alias("_row"), *[F.col(c).cast("string") for c in values]).unpivot(["_row"], values, "_column", "_cell")
    write_matrix(cells, path, "_column", "_row", "_cell", delimiter)


def write_epoch(vectors: DataFrame, folder: str, epoch: int, delimiter: str = "|") -> None:
    """Vectors of one epoch of training: a folder for the targets and one for the contexts."""
    for side in ("target", "context"):
        write_vectors(vectors.filter(F.col("side") == side), f"{folder.rstrip('/')}/{epoch}_{side}_dict.csv", delimiter)


def write_config(config: dict, folder: str, name: str = "config.json") -> str:
    """A copy of the run's settings in its output folder, on the driver; the path written."""
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(config, indent=2), encoding="utf-8")
    return str(path)


def output_dir(base: str, name: str) -> str:
    """A stamped output folder name, in UTC."""
    return f"{base.rstrip('/')}/{datetime.now(UTC):%Y%m%d_%H%M%S}_{name.lower()}"
