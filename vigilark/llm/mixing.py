"""Mixing sources to target weights by temperature, in DataFrame operations only.

Token shares of the sources are raised to an exponent and normalised again: 1 keeps the shares,
0 makes the sources equal. The exponent is bisected until the mix meets a target, either an
entropy or a limit on how often the most repeated source recurs for each pass over the least
repeated one. The weights are then realised within a token budget: every source is laid out in
blocks, each a permutation of all its documents, as many whole ones as its budget holds and of
the last one the documents whose tokens still fit.

Order within a block is a hash of seed, source, block and document. The cut of the last block is
found by sums over hash ranges, coarse ones first, so no order of a whole source is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm._tables import settle

#: Halvings of the exponent's interval, done so many at a time by trying all their midpoints.
HALVINGS, AT_ONCE = 40, 5
#: Hash ranges of each level at which the cut of the last block is sought, and levels.
RANGE_BITS, LEVELS = 10, 2


@dataclass(frozen=True)
class Target:
    """What the mix must meet: entropy in nats, as a share of the largest possible, or how often
    documents of the most repeated source stand for one of the least repeated."""

    entropy_share: float | None = None
    max_repeats: float | None = None


def token_count(text: Column) -> Column:
    """White-space separated words of a text; none of a null one."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")


def source_shares(tokens: DataFrame) -> DataFrame:
    """`source`, `source_tokens`, `n_docs`, `share` for sources with tokens."""
    sums = tokens.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n_docs"))
    total = sums.agg(F.sum("source_tokens").alias("all_tokens"))
    return (
        sums.filter("source_tokens > 0")
        .join(F.broadcast(total))  # one row
        .select("source", "source_tokens", "n_docs", (F.col("source_tokens") / F.col("all_tokens")).alias("share"))
    )


def meets(shares: DataFrame, exponents: list[float], target: Target) -> list[bool]:
    """For each exponent whether the mix keeps within the target; one aggregate over the sources."""
    aggs = []
    for k, a in enumerate(exponents):
        p = F.pow("share", F.lit(a))
        aggs += [
            F.sum(p).alias(f"z{k}"),
            F.sum(p * F.log(p)).alias(f"l{k}"),
            (F.max(p / F.col("share")) / F.min(p / F.col("share"))).alias(f"r{k}"),
        ]
    row = shares.agg(F.count("*").alias("n"), *aggs).first()
    if row["n"] <= 1:
        return [True] * len(exponents)
    if target.max_repeats is not None:
        return [row[f"r{k}"] <= target.max_repeats for k in range(len(exponents))]
    limit = target.entropy_share * log(row["n"])
    return [log(row[f"z{k}"]) - row[f"l{k}"] / row[f"z{k}"] <= limit for k in range(len(exponents))]


def bisect_exponent(shares: DataFrame, target: Target) -> float:
    """The least exponent in 0..1 that keeps within the target; 1 if none does.

    Entropy and repetition both fall as the exponent grows to 1, so the interval is halved
    HALVINGS times; AT_ONCE halvings need one pass, which tries every midpoint they may reach.
    """
    if meets(shares, [0.0], target)[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(0, HALVINGS, AT_ONCE):
        n, base, width = 1 << AT_ONCE, low, high - low
        kept = [True, *meets(shares, [base + width * k / n for k in range(1, n)], target), True]
        i, j = 0, n
        while j - i > 1:
            i, j = (i, (i + j) // 2) if kept[(i + j) // 2] else ((i + j) // 2, j)
        low, high = base + width * i / n, base + width * j / n
    return high


def mix_weights(shares: DataFrame, target: Target) -> DataFrame:
    """`shares` with `exponent` and `weight`, which sums to 1."""
    a = bisect_exponent(shares, target)
    z = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("z"))  # one row
    rows = shares.join(F.broadcast(z)).withColumn("exponent", F.lit(a))
    return rows.withColumn("weight", F.pow("share", F.lit(a)) / F.col("z")).drop("z")


def plan_blocks(weights: DataFrame, budget_tokens: int | None) -> DataFrame:
    """`weights` with `budget`, `whole` (full blocks) and `rest` (tokens of the last one).

    Without a budget the least repeated source gets one whole block, so no document is left out.
    """
    if budget_tokens is None:
        total = weights.agg(F.max(F.col("source_tokens") / F.col("weight")).alias("all_budget"))
    else:
        total = weights.agg(F.lit(float(budget_tokens)).alias("all_budget"))
    return (
        weights.join(F.broadcast(total))  # one row
        .withColumn("budget", F.round(F.col("weight") * F.col("all_budget")).cast("bigint"))
        .withColumn("whole", F.floor(F.col("budget") / F.col("source_tokens")).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_tokens"))
        .drop("all_budget")
    )


def _place(seed: int, block: Column) -> Column:
    """Where a document stands in a block: 62 pseudo-random bits of what identifies it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", block, "id", "mark"), 2)


def last_cuts(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """`source`, `cut`: the last place of a source's last block that is still within its budget.

    Level by level the tokens of a source's hash ranges are summed (before the shuffle) and only
    the range that holds the cut goes on, so what is ordered at the end is a small share of a
    source. Documents at one place come together.
    """
    going = rows.join(plan.filter("rest > 0").select("source", "whole", "rest"), "source").select(
        "source", "tokens", "rest", _place(seed, F.col("whole")).alias("place")
    )
    for level in range(LEVELS):
        keyed = going.withColumn("cell", F.shiftright("place", 62 - RANGE_BITS * (level + 1)))
        sums = keyed.groupBy("source", "rest", "cell").agg(F.sum("tokens").alias("n"))
        sums = sums.withColumn("upto", F.expr("sum(n) over (partition by source order by cell)"))
        # the range in which the budget ends; if it lasts to the end, the last one
        sums = sums.withColumn("end", F.expr("max(cell) over (partition by source)"))
        holds = (F.col("upto") - F.col("n") <= F.col("rest")) & ((F.col("upto") > F.col("rest")) | (F.col("cell") == F.col("end")))
        ends = sums.filter(holds).groupBy("source").agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
        ends = settle(ends.select("source", F.col("e.cell").alias("cell"), F.col("e.left").alias("left")), columnar=True)
        going = keyed.join(ends, ["source", "cell"]).select("source", "tokens", F.col("left").alias("rest"), "place")
    running = going.withColumn("upto", F.expr("sum(tokens) over (partition by source order by place)"))
    first_out = running.filter("upto > rest").groupBy("source").agg(F.min("place").alias("cut"))
    # nothing goes beyond the budget in the last range: all of it is in
    ends_in = running.groupBy("source").agg(F.max("place").alias("last"))
    return ends_in.join(first_out, "source", "left").select(
        "source", F.when(F.col("cut").isNull(), F.col("last")).otherwise(F.col("cut") - 1).alias("cut")
    )


def mix(
    docs: DataFrame,
    target: Target,
    budget_tokens: int | None = None,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents of the mix: all columns of `docs` in a struct `row`, with `weight`, `block`
    and `place`; reading by block, then place, is the permutation.

    A null source counts as the empty name. Sources without tokens have no weight, their
    documents come once. Repeated rows are drawn together; null texts have no tokens; an empty
    table gives an empty result; the columns of `docs` keep their names inside `row`, so none can
    clash. The plan has one row per source, and documents are matched with it by Spark's own
    choice of join, so its size is not assumed; no text is moved to count or to cut.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
        docs[id_col].alias("id"),
        F.xxhash64(text).alias("mark"),
        token_count(docs[text_col]).alias("tokens"),
    )
    narrow = settle(keyed.select("source", "id", "mark", "tokens"), columnar=True)
    shares = settle(source_shares(narrow), columnar=True)
    plan = settle(plan_blocks(mix_weights(shares, target), budget_tokens), columnar=True)
    plan = settle(plan.join(last_cuts(narrow, plan, seed), "source", "left"), columnar=True)
    rows = keyed.drop("tokens").join(plan.select("source", "weight", "whole", "cut"), "source", "left")
    whole = F.coalesce("whole", F.lit(1))
    extra = (F.coalesce("cut", F.lit(-1)) >= _place(seed, F.col("whole"))).cast("bigint")
    copies = whole + F.coalesce(extra, F.lit(0))
    drawn = rows.withColumn("copies", copies).filter("copies > 0")
    drawn = drawn.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return drawn.select("row", "source", "weight", "block", _place(seed, F.col("block")).alias("place"))
