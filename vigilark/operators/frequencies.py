"""Counts, sampling probabilities and information content of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Power of counts in smoothed draws, and the share of the corpus at which thinning begins.
SMOOTHING, THINNING = 0.75, 1e-5


def _with_total(rows: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """`rows` with the sum of `value` over all of them; the sum is one row."""
    return rows.join(F.broadcast(rows.agg(F.sum(value).alias(name))))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """`target`, `context`, `n`; rows without one of both are left out."""
    return pairs.na.drop(subset=["target", "context"]).groupBy("target", "context").agg(F.count("*").alias("n"))


def entity_counts(pairs: DataFrame, column: str) -> DataFrame:
    """`term`, `freq` of one side of the pairs."""
    return pairs.groupBy(F.col(column).alias("term")).agg(F.count("*").cast("double").alias("freq"))


def smoothed_unigram(freq: DataFrame) -> DataFrame:
    """`term`, `p`: counts to the power SMOOTHING, normalised."""
    rows = freq.select("term", F.pow("freq", F.lit(SMOOTHING)).alias("w"))
    return _with_total(rows, F.col("w")).select("term", (F.col("w") / F.col("total")).alias("p"))


def keep_probability(freq: DataFrame, corpus_rows: DataFrame) -> DataFrame:
    """`term`, `p_keep`: common terms are thinned; values over 1 always keep."""
    n = corpus_rows.agg((F.count("*") * F.lit(THINNING)).alias("t"))  # one row
    share = F.col("freq") / F.col("t")
    return freq.join(F.broadcast(n)).select("term", ((F.sqrt(share) + 1) / share).alias("p_keep"))


def _content(rows: DataFrame) -> DataFrame:
    """Information content: minus the binary logarithm of the share of `freq` in the total."""
    return _with_total(rows, F.col("freq")).withColumn("ic", -F.log(F.col("freq") / F.col("total")) / F.log(F.lit(2.0))).drop("total")


def content_of_terms(freq: DataFrame) -> DataFrame:
    """`term`, `ic` over the terms alone."""
    return _content(freq.select("term", "freq")).select("term", "ic")


def content_of_levels(freq: DataFrame, paths: DataFrame, levels: list[str]) -> DataFrame:
    """`level`, `name`, `ic` for terms (level 'pt') and all their ancestors.

    A term adds its frequency once to each distinct ancestor, over all its paths; missing levels
    are skipped; terms without a path do not count. Names are kept apart by level.
    """
    named = paths.unpivot(["term"], levels, "level", "name").filter("name is not null").distinct()
    own = freq.join(paths.select("term").distinct(), "term", "left_semi")
    above = named.join(own, "term").groupBy("level", "name").agg(F.sum("freq").alias("freq"))
    terms = own.select(F.lit("pt").alias("level"), F.col("term").cast("string").alias("name"), "freq")
    return _content(terms.unionByName(above)).select("level", "name", "ic")
