"""Lookups, filters and recodings of pair tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.vectors import total


def lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str = "term") -> DataFrame:
    """Left join of one key; what is not found is null."""
    return rows.join(table.withColumnRenamed(table_key, key), key, "left")


def gather(pairs: DataFrame, **tables: DataFrame) -> DataFrame:
    """`pairs` with a column `v` of each table, named as given; pairs that lack one are dropped.

    A name is `drug_...` or `reaction_...`, by the side that the table describes.
    """
    out = pairs
    for name, table in tables.items():
        side = name.split("_", 1)[0]
        out = out.join(table.select(F.col("term").alias(side), F.col("v").alias(name)), side)
    return out


def with_features(pairs: DataFrame, drugs: list[DataFrame], reactions: list[DataFrame]) -> DataFrame:
    """Pairs whose drug and reaction have every kind of feature."""
    for side, tables in (("drug", drugs), ("reaction", reactions)):
        for t in tables:
            pairs = pairs.join(t.select(F.col("term").alias(side)), side, "left_semi")
    return pairs


def without_positives(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows less the positives that the reference set holds."""
    held = reference.select("drug", "reaction", F.lit(1).alias("label"))
    return rows.join(held, ["drug", "reaction", "label"], "left_anti")


def partial_table(partial: DataFrame, main: DataFrame) -> DataFrame:
    """Every pair of `partial` with its own label and the numbers of `main`, 0 where it has none."""
    numbers = main.select("drug", "reaction", "freq", "ror", "ror_norm", F.lit(1).alias("found"))
    joined = partial.join(numbers, ["drug", "reaction"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return joined.select("drug", "reaction", "label", zero("freq"), zero("ror"), zero("ror_norm"), F.coalesce("found", F.lit(0)).alias("found"))


def recode_label(label: Column) -> Column:
    """-1 is a negative; 0 and 1 stay."""
    return F.when(label == -1, 0).otherwise(label)


def scale_signal(rows: DataFrame, least: int = 3) -> DataFrame:
    """`ror_norm`: the ratio scaled to the range over the whole table, 0 below `least` reports."""
    ends = rows.agg(F.min("ror").alias("_low"), F.max("ror").alias("_high"))  # one row
    scaled = F.try_divide(F.col("ror") - F.col("_low"), F.col("_high") - F.col("_low"))
    norm = F.when(F.col("freq") < least, 0.0).otherwise(F.coalesce(scaled, F.lit(0.0)))
    return rows.join(F.broadcast(ends)).withColumn("ror_norm", norm).drop("_low", "_high")


def in_list(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Terms whose upper-cased name is in a list of names."""
    listed = names.select(F.upper("name").alias("_name")).distinct()
    return terms.withColumn("_name", F.upper(F.col("term").cast("string"))).join(listed, "_name", "left_semi").drop("_name")


def frequent(terms: DataFrame, freq: DataFrame, threshold: float) -> DataFrame:
    return terms.join(freq.filter(F.col("freq") >= threshold).select("term"), "term", "left_semi")


def non_empty(features: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Features with at least one component, and the other tables' rows of the same terms."""
    kept = features.filter(F.size("v") > 0)
    return (kept, *[o.join(kept.select("term"), "term", "left_semi") for o in others])


def concatenated(rows: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return rows.withColumn(name, F.concat(*columns))


def table_counts(rows: DataFrame) -> DataFrame:
    """One row: rows, drugs, reactions, pairs and positives of a labelled table."""
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("drug").alias("n_drugs"),
        F.countDistinct("reaction").alias("n_reactions"),
        F.countDistinct("drug", "reaction").alias("n_pairs"),
        F.count(F.when(F.col("label") == 1, 1)).alias("n_positive"),
    )


def union_files(files: list[DataFrame]) -> DataFrame:
    """The files' rows with `ord`, the place of the file."""
    return reduce(DataFrame.unionByName, [f.withColumn("ord", F.lit(k)) for k, f in enumerate(files)])


def complete_rows(rows: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return rows.na.drop("any")


def counts_before_and_after(rows: DataFrame) -> DataFrame:
    """`table_counts` of all rows (`stage` 'all') and of the complete ones ('complete')."""
    stages = {"all": rows, "complete": complete_rows(rows)}
    return reduce(DataFrame.unionByName, [table_counts(r).select(F.lit(k).alias("stage"), "*") for k, r in stages.items()])


def scaler(train: DataFrame, column: str) -> DataFrame:
    """`dim`, `mean`, `spread` of a vector column: what a stored scaler holds. A spread of 0 counts as 1."""
    cells = train.select(F.posexplode(column).alias("dim", "x")).groupBy("dim")
    spread = F.stddev_pop("x")
    return cells.agg(F.avg("x").alias("mean"), F.when(spread == 0, 1.0).otherwise(spread).alias("spread"))


def scale(rows: DataFrame, column: str, parameters: DataFrame) -> DataFrame:
    """`rows` with `column` less the mean over the spread of `parameters`, a row for each dimension."""
    one = parameters.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "spread"))).alias("_p"))  # as long as a vector
    scaled = F.zip_with(column, "_p", lambda x, p: (x - p["mean"]) / p["spread"])
    return rows.join(F.broadcast(one)).withColumn(column, scaled).drop("_p")


def standardise(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """`rows` scaled by the mean and the population deviation of `train`."""
    return scale(rows, column, scaler(train, column))


def mean_vector(v: Column) -> Column:
    return total(v) / F.size(v)
