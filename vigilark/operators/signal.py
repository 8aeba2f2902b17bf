"""Disproportionality signals and how well a score tells labels apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR_THRESHOLD, BOUND_THRESHOLD = 3, 1.0


def reporting_odds(pairs: DataFrame) -> DataFrame:
    """`drug`, `reaction`, `freq`, `ror`: count and lower 95 % bound of the reporting odds ratio.

    An extension: inputs of the classifier hold these numbers ready-made. Tables with an empty
    cell have no ratio and get -1.
    """
    a = pairs.groupBy("drug", "reaction").agg(F.count("*").alias("a"))
    by_drug = pairs.groupBy("drug").agg(F.count("*").alias("nd"))
    by_reaction = pairs.groupBy("reaction").agg(F.count("*").alias("nr"))
    n = pairs.agg(F.count("*").alias("n"))  # one row
    rows = a.join(by_drug, "drug").join(by_reaction, "reaction").join(F.broadcast(n))
    rows = rows.withColumn("b", F.col("nd") - F.col("a")).withColumn("c", F.col("nr") - F.col("a"))
    rows = rows.withColumn("d", F.col("n") - F.col("nd") - F.col("nr") + F.col("a"))
    inverse = lambda x: F.lit(1.0) / F.col(x)
    bound = F.exp(
        F.ln(F.col("a") * F.col("d") / (F.col("b") * F.col("c")))
        - 1.96 * F.sqrt(inverse("a") + inverse("b") + inverse("c") + inverse("d"))
    )
    full = (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    return rows.select("drug", "reaction", F.col("a").cast("double").alias("freq"), F.when(full, bound).otherwise(-1.0).alias("ror"))


def signal_performance(rows: DataFrame) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, specificity of the signal.

    A pair is signalled with at least PAIR_THRESHOLD reports and a bound of at least
    BOUND_THRESHOLD. A ratio of nothing is -1.
    """
    hit = (F.col("freq") >= PAIR_THRESHOLD) & (F.col("ror") >= BOUND_THRESHOLD)
    count = lambda c: F.count(F.when(c, 1))
    one = rows.agg(
        count(hit & (F.col("label") == 1)).alias("tp"), count(hit & (F.col("label") == 0)).alias("fp"),
        count(~hit & (F.col("label") == 1)).alias("fn"), count(~hit & (F.col("label") == 0)).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(-1.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.select(
        "*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"),
    )


def coverage(partial: DataFrame) -> DataFrame:
    """Share of the rows of a partial table that the main table knows."""
    return partial.agg(F.avg(F.col("found").cast("double")).alias("coverage"))


#: Ranges of the score, at its approximate quantiles, in which the curve is summed on its own.
SLICES = 64


def _curve(rows: DataFrame) -> DataFrame:
    """Per distinct score from the top: positives and negatives there, and those above.

    Scores are counted first; running sums go range by range of the score, with the ranges'
    totals before them, so the curve is never ordered as a whole in one task.
    """
    at = rows.filter("score is not null and label is not null").groupBy("score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n")
    )
    cuts = [k / SLICES for k in range(1, SLICES)]
    ends = at.agg(F.percentile_approx("score", cuts, 10_000).alias("cuts"), F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # one row
    part = F.size(F.filter("cuts", lambda c: c > F.col("score")))  # equal scores have the same, higher ones a lower
    at = at.join(F.broadcast(ends)).withColumn("part", part).drop("cuts")
    sums = at.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows
    offset = sums.select("part", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("on"))
    run = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(F.broadcast(offset), "part").withColumn("cp", F.sum("p").over(run) + F.col("op")).withColumn("cn", F.sum("n").over(run) + F.col("on"))
    return out.select("score", "p", "n", "cp", "cn", "all_p", "all_n")


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties shared; null if a class is missing."""
    wins = F.col("n") * (F.col("cp") - F.col("p") / 2)
    one = _curve(rows).agg(F.sum(wins).alias("w"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"))
    return one.select(F.try_divide(F.col("w"), F.col("all_p") * F.col("all_n")).cast("double").alias("auroc"))


def auprc(rows: DataFrame) -> DataFrame:
    """Area under precision over recall by trapezoids, from recall 0 at precision 1."""
    points = _curve(rows)
    recall, precision = F.col("cp") / F.col("all_p"), F.col("cp") / (F.col("cp") + F.col("cn"))
    above_p, above_n = F.col("cp") - F.col("p"), F.col("cn") - F.col("n")
    earlier = F.when(above_p + above_n > 0, above_p / F.greatest(above_p + above_n, F.lit(1))).otherwise(1.0)
    area = (recall - above_p / F.col("all_p")) * (precision + earlier) / 2
    return points.filter("all_p > 0").agg(F.sum(area).alias("auprc"))


def accuracy(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of labels that score > threshold meets."""
    return rows.agg(F.avg(((F.col("score") > threshold).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
