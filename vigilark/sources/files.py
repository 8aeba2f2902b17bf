"""Readers of the delimited input files. Every reader gives a DataFrame and reads nothing twice.

Files have fixed positions and no schema of their own; `header` says whether the first line of each
file is to be skipped. Where the order of lines counts, `_order` is the file's name, where the part
of it that a task reads begins, and the row's place in the task's scan: lines of one file keep their
order and part files go by name.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_config(path: str) -> dict:
    """A JSON config as a dict; its keys are left as they are."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def metric_names(config: dict, section: str) -> list[str]:
    """Names switched on in a config section: keys lower-cased without their leading 'o'."""
    return [key[1:].lower() for key, on in config.get(section, {}).items() if on]


def _lines(spark: SparkSession, path: str, delimiter: str, header: bool, fields: int) -> DataFrame:
    schema = ", ".join(f"_c{k} string" for k in range(fields))
    rows = spark.read.schema(schema).option("sep", delimiter).option("header", header).csv(path)
    return rows.withColumn("_order", _order())


def _order() -> Column:
    file = F.col("_metadata")
    return F.struct(file["file_path"].alias("file"), file["file_block_start"].alias("begin"), F.monotonically_increasing_id().alias("line"))


def read_pairs(spark: SparkSession, path: str, delimiter: str = "|", header: bool = False) -> DataFrame:
    """`target`, `context`; repeated rows are kept."""
    rows = _lines(spark, path, delimiter, header, 2)
    return rows.select(F.col("_c0").alias("target"), F.col("_c1").alias("context"))


def last_wins(rows: DataFrame, keys: list[str], order: str = "_order") -> DataFrame:
    """One row per key: the values of the last line, `ord` the place of the first."""
    values = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(
        *[F.max_by(c, order).alias(c) for c in values], F.min(order).alias("ord")
    )


def read_frequencies(
    spark: SparkSession, path: str, delimiter: str = "|", header: bool = False, key: int = 0, value: int = 1
) -> DataFrame:
    """`term`, `freq`, `ord`; of a repeated term the last value and the first place hold."""
    rows = _lines(spark, path, delimiter, header, max(key, value) + 1)
    named = rows.select(F.col(f"_c{key}").alias("term"), F.expr(f"try_cast(_c{value} as double)").alias("freq"), "_order")
    return last_wins(named, ["term"])


def read_names(
    spark: SparkSession, path: str, delimiter: str = "|", header: bool = False, key: int = 0, value: int = 1
) -> DataFrame:
    """Upper-cased `term` and its `name`."""
    rows = _lines(spark, path, delimiter, header, max(key, value) + 1)
    named = rows.select(F.upper(f"_c{key}").alias("term"), F.col(f"_c{value}").alias("name"), "_order")
    return last_wins(named, ["term"]).drop("ord")


def read_vectors(spark: SparkSession, path: str, delimiter: str = "|", header: bool = False) -> DataFrame:
    """`term`, `v array<double>` of any length; a term alone on its line has an empty vector."""
    lines = spark.read.text(path).withColumn("_order", _order())
    if header:
        first = lines.groupBy("_order.file").agg(F.min("_order").alias("_first"))  # a row per file
        lines = lines.withColumn("file", F.col("_order.file")).join(first, "file").filter("_order > _first").drop("file", "_first")
    parts = F.split("value", "\\" + delimiter if delimiter in "|.+*?" else delimiter)
    tail = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    named = lines.select(F.element_at(parts, 1).alias("term"), F.transform(tail, lambda x: x.cast("double")).alias("v"), "_order")
    return last_wins(named, ["term"])


def read_valid_pairs(spark: SparkSession, paths: list[str], delimiter: str = "|", header: bool = True) -> DataFrame:
    """Distinct `drug`, `reaction` over all files; a third column is ignored."""
    parts = [_lines(spark, p, delimiter, header, 3) for p in paths]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.col("_c0").alias("drug"), F.col("_c1").alias("reaction")).distinct()


def group_pairs(pairs: DataFrame) -> DataFrame:
    """`drug`, `reactions`: the list of each group, in order of name."""
    return pairs.groupBy("drug").agg(F.array_sort(F.collect_list("reaction")).alias("reactions"))


def read_reference_pairs(
    spark: SparkSession, paths: list[str], delimiter: str = "|", header: bool = False, labelled: bool = True
) -> DataFrame:
    """`drug`, `reaction`, `label` over all files; of contradicting labels the last file's last holds."""
    parts = [
        _lines(spark, p, delimiter, header, 3).withColumn("_file", F.lit(k)) for k, p in enumerate(paths)
    ]
    rows = reduce(DataFrame.unionByName, parts)
    label = F.expr("try_cast(_c2 as int)") if labelled else F.lit(None).cast("int")
    named = rows.select(
        F.col("_c0").alias("drug"), F.col("_c1").alias("reaction"), label.alias("label"), F.struct("_file", "_order").alias("_order")
    )
    return last_wins(named, ["drug", "reaction"]).drop("ord")


def read_paths(
    spark: SparkSession, path: str, columns: dict[str, int], delimiter: str = "|", header: bool = True,
    primary_only: bool = False, distinct: bool = False,
) -> DataFrame:
    """A hierarchy file as one row per path: `columns` maps names to positions; '-' becomes null.

    With `primary_only` only rows whose `rank` is PRIMARY stay.
    """
    rows = _lines(spark, path, delimiter, header, max(columns.values()) + 1)
    named = rows.select(*[F.nullif(F.col(f"_c{at}"), F.lit("-")).alias(name) for name, at in columns.items()])
    if primary_only:
        named = named.filter(F.col("rank") == "PRIMARY")
    return named.distinct() if distinct else named


#: Positions of the two hierarchy layouts.
THREE_LEVELS = {"pt": 2, "hlt": 4, "hlgt": 6, "soc": 8, "rank": 10}
FIVE_LEVELS = {"pt": 0, "smq5": 2, "smq4": 4, "smq3": 6, "smq2": 8, "smq1": 10}


def name_code_map(paths: DataFrame, pairs: dict[str, str], term: str = "pt") -> DataFrame:
    """`term` and `codes`: a map from each level's name to its code and back."""
    both = [F.array(F.col(a), F.col(b)) for a, b in pairs.items()] + [F.array(F.col(b), F.col(a)) for a, b in pairs.items()]
    rows = paths.select(F.col(term).alias("term"), F.explode(F.array(*both)).alias("p"))
    rows = rows.filter(F.col("p")[0].isNotNull()).select("term", F.col("p")[0].alias("k"), F.col("p")[1].alias("v"))
    latest = rows.groupBy("term", "k").agg(F.max("v").alias("v"))
    return latest.groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("codes"))


def read_main_table(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """The classifier's main table; text that is no number becomes null."""
    rows = _lines(spark, path, delimiter, False, 6)
    number = lambda k, kind: F.expr(f"try_cast(_c{k} as {kind})")
    return rows.select(
        F.col("_c0").alias("comb_name"), F.col("_c1").alias("drug"), F.col("_c2").alias("reaction"),
        number(3, "int").alias("label"), number(4, "double").alias("freq"), number(5, "double").alias("ror"),
    )


def read_matrix(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """A stored square matrix as `i`, `j`, `sim`; unavailable (infinite) cells and the diagonal go."""
    rows = read_vectors(spark, path, delimiter, header=True)
    names = rows.select(F.col("term").alias("j"), (F.row_number().over(Window.orderBy("ord")) - 1).alias("at"))
    cells = rows.select(F.col("term").alias("i"), F.posexplode("v").alias("at", "sim"))
    return cells.join(names, "at").filter((F.col("i") != F.col("j")) & (F.abs("sim") < float("inf"))).select("i", "j", "sim")


def text_or_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
