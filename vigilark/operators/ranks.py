"""Places in an order, and sums up to there, without putting a whole order into one task.

Rows are dealt to ranges of the order; a range is a task, and a large group has several. The range of a
row is written down before it is used, so it stays the same in every later step, whatever adaptive
execution makes of the partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.sources.tables import settle


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """`rows` with `_range`: rows of a smaller range stand before those of a larger one in `order`, and
    equal ones are in one range. Settled."""
    return settle(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), columnar=True)


def sums_before(rows: DataFrame, by: list[str], order: str, amounts: list[str]) -> DataFrame:
    """`rows` with `before_<a>` for each of the `amounts`: its sum over the rows of equal `by` that are smaller in `order`.

    Rows that are equal in `by` and `order` have to be one row (see `tallied`). Nulls in `order` come
    first; null amounts count as 0. A group of `by` is spread over as many tasks as it has ranges.
    """
    return _sums(rows, by, order, amounts, "before", lambda w: w.rowsBetween(Window.unboundedPreceding, -1))


def sums_upto(rows: DataFrame, by: list[str], order: str, amounts: list[str]) -> DataFrame:
    """The same with `upto_<a>`, over the rows that are smaller or equal, the row itself among them. Equal ones may be many rows."""
    return _sums(rows, by, order, amounts, "upto", lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow))


def _sums(rows: DataFrame, by: list[str], order: str, amounts: list[str], name: str, frame: Callable) -> DataFrame:
    placed = ranged(rows, *by, order)
    total = lambda a: F.coalesce(F.sum(a), F.lit(0))
    parts = placed.groupBy(*by, "_range").agg(*[total(a).alias(f"_all_{a}") for a in amounts])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_all_{a}").over(earlier), F.lit(0)).alias(f"_off_{a}") for a in amounts])
    inside = frame(Window.partitionBy(*by, "_range").orderBy(order))
    rows = placed.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_in_{a}") for a in amounts])
    keys = [*by, "_range"]
    other = offsets.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[f"_off_{a}" for a in amounts])
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    joined = rows.join(other, same)
    out = [c for c in rows.columns if c != "_range" and not c.startswith("_in_")]
    return joined.select(*out, *[(F.col(f"_in_{a}") + F.col(f"_off_{a}")).alias(f"{name}_{a}") for a in amounts])


def beyond_taken(draws: DataFrame, by: list[str], u: str, taken: DataFrame) -> DataFrame:
    """`draws` whose column `u` is a place among what is free of its key, moved to that place among everything.

    `taken` holds `by`, `at` and `size`: what is taken of a key, as stretches that do not overlap. So nobody
    has to list what is free: a draw goes on by the sizes of the stretches that begin before it.
    """
    placed = sums_before(taken.select(*by, "at", "size"), by, "at", ["size"])
    kind = dict(draws.dtypes)[u]
    rest = F.struct(*[c for c in draws.columns if c not in (*by, u)], F.lit(0).alias("_none"))
    none = F.lit(None).cast(dict(draws.select(rest.alias("_rest")).dtypes)["_rest"])
    events = draws.select(*by, F.col(u).alias("_pos"), F.lit(0).cast(kind).alias("size"), rest.alias("_rest"), F.lit(True).alias("_draw")).unionByName(
        placed.select(*by, (F.col("at") - F.col("before_size")).cast(kind).alias("_pos"), F.col("size").cast(kind).alias("size"), none.alias("_rest"), F.lit(False).alias("_draw"))
    )
    moved = sums_upto(events, by, "_pos", ["size"]).filter("_draw")
    return moved.select(*by, (F.col("_pos") + F.col("upto_size")).cast(kind).alias(u), "_rest.*").drop("_none")


def tallied(values: DataFrame, by: list[str], value: str, **amounts: Column) -> DataFrame:
    """A row for each different value of each group, with the sums `amounts` over its rows; null values do not count."""
    return values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(x).alias(n) for n, x in amounts.items()])


def medians(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """`by`, `median` of every group, exact: the value in the middle, or the mean of the two there."""
    placed = settle(sums_before(tallied(values, by, value, n=F.lit(1)), by, value, ["n"]), columnar=True)
    return median_of_tally(placed, by, value)


def median_of_tally(placed: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same from a tally with `n` and `before_n`."""
    sizes = placed.groupBy(*by).agg(F.sum("n").alias("_size"))
    upto = F.col("before_n") + F.col("n")
    holds = lambda k: (F.col("before_n") <= k) & (k < upto)
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    middle = placed.join(sizes, by).filter(holds(low) | holds(high))  # one or two rows a group
    lower, upper = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
    return middle.groupBy(*by).agg(((lower + upper) / 2).alias("median"))


def dense_index(rows: DataFrame, order: str = "ord") -> DataFrame:
    """`rows` with `index` from 0 without gaps in the order of a column; equal ones are put in an order of their own.

    Nulls come first. An order over all rows is never made in one task, nor one over equal rows.
    """
    mark = F.xxhash64(*rows.columns).alias("_mark")
    placed = ranged(rows.withColumn("_mark", mark), order, "_mark")
    within = Window.partitionBy("_range").orderBy(F.asc_nulls_first(order), "_mark")
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    found = placed.withColumn("_at", F.row_number().over(within)).join(before, "_range")
    return found.withColumn("index", (F.col("_at") - 1 + F.col("_before")).cast("bigint")).drop("_range", "_mark", "_at", "_before")
