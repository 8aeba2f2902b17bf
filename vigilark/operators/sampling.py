"""Corpora and negative samples drawn with repeatable pseudo-random numbers.

Draws follow a distribution through its cumulative sums, cut into slots: a draw falls into one of
about as many equal slots of [0, 1) as there are terms and joins the few terms that overlap it, an
equi-join at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.random import uniform
from vigilark.operators.frequencies import smoothed_unigram
from vigilark.operators.ranks import beyond_taken, dense_index
from vigilark.sources.tables import settle

#: Slices in which cumulative sums are made, and the least and greatest number of slots.
SLICES, LEAST_SLOTS, MOST_SLOTS = 4096, 64, 1 << 30
#: Times as many attempts as before for those still without a negative.
MORE_ATTEMPTS = 16


def shuffle(rows: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """All rows in a pseudo-random order that depends on their keys."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys)


def slice_of(term: Column) -> Column:
    """One of SLICES parts, the first digits of the term's md5 digest."""
    return F.conv(F.substring(F.md5(term.cast("string")), 1, 3), 16, 10).cast("int")


def intervals(unigram: DataFrame) -> DataFrame:
    """`term`, `lo`, `hi`: terms laid end to end over [0, 1), by slice, then term.

    Sums are made per slice of terms first, so the order over all terms is not made in one task.
    """
    sliced = unigram.withColumn("slice", slice_of(F.col("term")))
    sizes = sliced.groupBy("slice").agg(F.sum("p").alias("s"))
    offsets = sizes.select("slice", (F.sum("s").over(Window.orderBy("slice")) - F.col("s")).alias("before"))  # SLICES rows
    run = Window.partitionBy("slice").orderBy("term").rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("upto", F.sum("p").over(run)).join(F.broadcast(offsets), "slice")
    return placed.select("term", (F.col("before") + F.col("upto") - F.col("p")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi"))


def intervals_within(weights: DataFrame, key: str) -> DataFrame:
    """The same for each `key` on its own: `weights` holds `key`, `term`, `p`, which need not add up to 1."""
    run = Window.partitionBy(key).orderBy("term").rowsBetween(Window.unboundedPreceding, 0)
    rows = weights.withColumn("upto", F.sum("p").over(run)).withColumn("total", F.sum("p").over(Window.partitionBy(key)))
    return rows.select(key, "term", ((F.col("upto") - F.col("p")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))


def draw(draws: DataFrame, spans: DataFrame, name: str, u: str = "u", within: list[str] | None = None) -> DataFrame:
    """`draws` with `name`: the term whose interval holds the column `u`, among those of the same
    `within` if it is given.

    There are as many slots as terms, to the next power of two, so a draw meets few terms and no slot
    has a large share of the draws. A term covers as many slots as it is likely.
    """
    keys = within or []
    n = spans.agg(F.count("*").alias("_n"))  # one row
    bits = F.ceil(F.log2(F.greatest("_n", F.lit(LEAST_SLOTS))))
    slots = n.select(F.least(F.pow(F.lit(2.0), bits), F.lit(float(MOST_SLOTS))).alias("_slots"))
    slot = lambda c: F.greatest(F.least(F.floor(c * F.col("_slots")), F.col("_slots") - 1), F.lit(0)).cast("bigint")
    cells = spans.join(F.broadcast(slots)).select(
        *keys, F.col("term").alias(name), "lo", "hi", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))).alias("_slot")
    )
    rows = draws.join(F.broadcast(slots)).withColumn("_slot", slot(F.col(u))).drop("_slots")
    return rows.join(cells, [*keys, "_slot"]).filter((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("_slot", "lo", "hi")


def thin(pairs: DataFrame, keep: DataFrame, seed: int = 1, key: str = "row") -> DataFrame:
    """Pairs whose target passes its keep probability; targets without one are dropped.

    `key` tells rows apart, so repeated pairs are drawn on their own.
    """
    u = uniform(F.col(key).cast("string"), "keep", seed)
    return pairs.join(keep.withColumnRenamed("term", "target"), "target").filter(u < F.col("p_keep")).drop("p_keep")


def corpus_with_negatives(pairs: DataFrame, unigram: DataFrame, k: int, seed: int = 1, key: str = "row") -> DataFrame:
    """`key`, `target`, `context`, `label`: every pair and `k` negatives of its target.

    Negatives follow the unigram but never equal the pair's own context, which is cut out of
    [0, 1) before the draw instead of being drawn again.
    """
    spans = intervals(unigram)
    own = pairs.join(spans.withColumnRenamed("term", "context"), "context")
    width = F.col("hi") - F.col("lo")
    tries = own.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(k))))
    v = uniform(F.col(key).cast("string"), F.col("attempt").cast("string"), seed) * (1 - width)
    tries = tries.withColumn("u", F.when(v >= F.col("lo"), v + width).otherwise(v)).drop("lo", "hi")
    negatives = draw(tries, spans, "drawn").select(key, "target", F.col("drawn").alias("context"), F.lit(0).alias("label"))
    positives = own.select(key, "target", "context", F.lit(1).alias("label"))
    return positives.unionByName(negatives)


def contrastive_batches(counts: DataFrame, size: int, epoch: int, by_frequency: bool = True, seed: int = 1) -> DataFrame:
    """`batch`, `target`, `context`: batches of `size` targets (the last may be smaller), each with a
    context that no other target of the batch has.

    Targets are ranked by pseudo-random numbers and dealt to batches by rank; inside a batch, targets
    choose in turn among their contexts, in the order of weighted random keys; one whose contexts are
    all taken is left out. Batches are independent of each other.
    """
    import pandas as pd

    targets = counts.select("target").distinct()
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col("target").cast("string")))
    dealt = dense_index(targets.withColumn("_place", place), "_place").select("target", F.floor(F.col("index") / size).alias("batch"))
    weight = F.pow("n", F.lit(0.75)) if by_frequency else F.lit(1.0)
    u = uniform(F.col("target").cast("string"), F.col("context").cast("string"), epoch, seed)
    keyed = counts.join(dealt, "target").select("batch", "target", "context", (F.log(F.greatest(u, F.lit(1e-12))) / weight).alias("draw"))
    # others of the batch take at most size - 1 contexts, so one of the first `size` is free if any is
    best = Window.partitionBy("batch", "target").orderBy(F.desc("draw"), "context")
    keyed = keyed.withColumn("choice", F.row_number().over(best)).filter(F.col("choice") <= size)

    def choose(key, frame):
        taken, out = set(), []
        for target, own in frame.sort_values(["target", "choice"]).groupby("target", sort=True):
            context = next((c for c in own["context"] if c not in taken), None)
            if context is not None:
                taken.add(context)
                out.append((key[0], target, context))
        return pd.DataFrame(out, columns=["batch", "target", "context"])

    kind = dict(counts.dtypes)
    schema = f"batch bigint, target {kind['target']}, context {kind['context']}"
    return keyed.groupBy("batch").applyInPandas(choose, schema)


def split(rows: DataFrame, test_fraction: float, keys: list[str], seed: int = 1) -> DataFrame:
    """`rows` with `is_test`, about `test_fraction` of them, by a hash of their keys."""
    return rows.withColumn("is_test", uniform(*[F.col(k).cast("string") for k in keys], "split", seed) < test_fraction)


_PAIR = ["drug", "reaction"]


def _tries(positives: DataFrame, first: int, last: int) -> DataFrame:
    return positives.select(F.struct(*_PAIR).alias("positive")).withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last))))


def _u(side: str, seed: int) -> Column:
    return uniform(F.col("positive.drug").cast("string"), F.col("positive.reaction").cast("string"), F.col("attempt").cast("string"), side, seed)


def _first_free(tries: DataFrame, known: DataFrame) -> DataFrame:
    """Per positive the drawn pair (`n`) of the first attempt that is not known."""
    free = tries.join(known, _PAIR, "left_anti")
    return free.groupBy("positive").agg(F.min_by(F.struct(*_PAIR), "attempt").alias("n"))


def _without(positives: DataFrame, found: DataFrame) -> DataFrame:
    return positives.join(found.select("positive.*"), _PAIR, "left_anti")


def negatives_by_key(
    positives: DataFrame, key: str, other: str, known: DataFrame, by_frequency: bool = True, attempts: int = 12, seed: int = 1,
    source: DataFrame | None = None,
) -> DataFrame:
    """`drug`, `reaction`, `label` 0: for each positive one pair that keeps `key` and draws `other`.

    Each positive makes `attempts` draws, MORE_ATTEMPTS times as many if these are all known pairs,
    and takes the first that is not. What is left then has a key that is known with nearly all that is
    drawn: it draws among the rest of its key, by the same weights, without that rest being listed. Only a
    positive whose key is known with everything gets none. `source` holds the pairs whose `other` is drawn, the positives
    themselves by default.
    """
    known = settle(known.select(*_PAIR).distinct())
    chances = settle(_distribution(source or positives, other, by_frequency))
    spans = settle(intervals(chances))

    def attempt(rows: DataFrame, first: int, last: int) -> DataFrame:
        tries = draw(_tries(rows, first, last).withColumn("u", _u(key, seed)), spans, "drawn")
        named = tries.select("positive", "attempt", F.col(f"positive.{key}").alias(key), F.col("drawn").alias(other))
        return settle(_first_free(named, known))

    found = attempt(positives, 1, attempts)
    more = attempt(_without(positives, found), attempts + 1, attempts * (1 + MORE_ATTEMPTS))
    last = settle(_without(_without(positives, found), more))
    rows = last.select(F.struct(*_PAIR).alias("positive"), key, F.lit(0).alias("attempt")).withColumn("u", _u(key, seed))
    final = _free_of_key(rows, key, other, known, spans).select("positive", F.struct(*_PAIR).alias("n"))
    return found.unionByName(more).unionByName(final).select("n.drug", "n.reaction", F.lit(0).alias("label"))


def _known_stretches(known: DataFrame, other: str, spans: DataFrame) -> DataFrame:
    """Known pairs with the interval `lo`, `hi` of their `other`, of those that can be drawn."""
    return known.join(spans.withColumnRenamed("term", other), other)


def _free_of_key(rows: DataFrame, key: str, other: str, known: DataFrame, spans: DataFrame) -> DataFrame:
    """`rows` (`positive`, `key`, `u`) with `other` drawn by the weights of `spans` among what their key is not known with.

    Keys known with everything have no row. Known intervals of a key are skipped by sums of their
    widths; where rounding puts a draw on a known one after all, it takes the free one of that rank instead.
    """
    own = known.join(rows.select(key).distinct(), key)
    stretches = settle(_known_stretches(own, other, spans).select(key, F.col("lo").alias("at"), (F.col("hi") - F.col("lo")).alias("size")), columnar=True)
    total = spans.agg(F.count("*").alias("_all"))  # one row
    taken = stretches.groupBy(key).agg(F.count("*").alias("_n"), F.sum("size").alias("_mass"))
    open_ = rows.join(taken, key, "left").join(F.broadcast(total)).filter(F.coalesce("_n", F.lit(0)) < F.col("_all"))
    open_ = settle(open_.select("positive", key, "u", (F.col("_all") - F.coalesce("_n", F.lit(0))).alias("_free"), (1 - F.coalesce("_mass", F.lit(0.0))).alias("_mass")), columnar=True)
    at = beyond_taken(open_.select("positive", key, (F.col("u") * F.greatest("_mass", F.lit(0.0))).alias("u")), [key], "u", stretches)
    drawn = settle(draw(at.withColumn("u", F.least("u", F.lit(1 - 2.0**-53))), spans, other).select("positive", key, other).join(known, _PAIR, "left_anti"), columnar=True)
    missed = settle(open_.join(drawn.select("positive"), "positive", "left_anti"), columnar=True)
    if missed.isEmpty():
        return drawn
    places = settle(dense_index(spans.select("term"), "term"), columnar=True)
    held = own.join(places.withColumnRenamed("term", other), other).select(key, F.col("index").alias("at"), F.lit(1).cast("bigint").alias("size"))
    ranks = missed.select("positive", key, F.floor(F.col("u") * F.col("_free")).cast("bigint").alias("index"))
    named = beyond_taken(ranks, [key], "index", held).join(places.withColumnRenamed("term", other), "index")
    return drawn.unionByName(named.select("positive", key, other))


def negatives_at_random(
    positives: DataFrame, known: DataFrame, by_frequency: bool = True, attempts: int = 12, seed: int = 1, source: DataFrame | None = None
) -> DataFrame:
    """As many pairs as there are positives with both sides drawn, none of them known.

    Positives whose draws are all known pairs draw again, MORE_ATTEMPTS times as often. What is left
    then draws among the free pairs alone: a drug by its weight times that of what it is not known with, then
    one of these. If known pairs cover all there is, ValueError.
    """
    known = settle(known.select(*_PAIR).distinct())
    chances = {side: settle(_distribution(source or positives, side, by_frequency)) for side in _PAIR}
    spans = {side: settle(intervals(chances[side])) for side in _PAIR}
    held = _known_stretches(known, "reaction", spans["reaction"]).groupBy("drug").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("mass"))
    every = spans["reaction"].agg(F.count("*").alias("all"))  # one row
    rest = chances["drug"].join(held.withColumnRenamed("drug", "term"), "term", "left").join(F.broadcast(every))
    rest = rest.filter(F.coalesce("n", F.lit(0)) < F.col("all"))
    # rounding may leave no mass to a drug that has free reactions
    rest = settle(rest.select("term", (F.col("p") * F.greatest(1 - F.coalesce("mass", F.lit(0.0)), F.lit(1e-15))).alias("p")))
    if rest.isEmpty() and not positives.isEmpty():
        raise ValueError("all pairs of the drawn sides are known")
    left, parts = positives, []
    for first, last in ((1, attempts), (attempts + 1, attempts * (1 + MORE_ATTEMPTS))):
        tries = _tries(left, first, last)
        for side in _PAIR:
            tries = draw(tries.withColumn("u", _u(side, seed)), spans[side], side).drop("u")
        parts.append(settle(_first_free(tries, known)))
        left = settle(_without(left, parts[-1]))
    if not left.isEmpty():
        whole = rest.agg(F.sum("p").alias("whole"))  # one row
        free = settle(intervals(rest.join(F.broadcast(whole)).select("term", (F.col("p") / F.col("whole")).alias("p"))))
        rows = draw(_tries(left, 0, 0).withColumn("u", F.least(_u("drug", seed), F.lit(1 - 2.0**-40))), free, "drug").drop("u")
        found = _free_of_key(rows.withColumn("u", _u("reaction", seed)), "drug", "reaction", known, spans["reaction"])
        parts.append(found.select("positive", F.struct(*_PAIR).alias("n")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("n.drug", "n.reaction", F.lit(0).alias("label"))


def _distribution(positives: DataFrame, side: str, by_frequency: bool) -> DataFrame:
    freq = positives.groupBy(F.col(side).alias("term")).agg(F.count("*").cast("double").alias("freq"))
    if by_frequency:
        return smoothed_unigram(freq)
    n = freq.agg(F.count("*").alias("n"))  # one row
    return freq.join(F.broadcast(n)).select("term", (1 / F.col("n")).alias("p"))


def balanced(positives: DataFrame, negatives: DataFrame, repeat: int = 1) -> DataFrame:
    """Positives (label 1) and negatives, each `repeat` times: a training sample."""
    rows = positives.select("drug", "reaction", F.lit(1).alias("label")).unionByName(negatives)
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop("_k") if repeat > 1 else rows


def false_negative_rate(train_negatives: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct training negatives that are test positives, over the test rows; 0 without any."""
    pairs = ["drug", "reaction"]
    wrong = train_negatives.select(*pairs).distinct().join(test.filter("label = 1").select(*pairs).distinct(), pairs, "left_semi")
    one = wrong.agg(F.count("*").alias("wrong")).join(F.broadcast(test.agg(F.count("*").alias("n"))))  # one row each
    return one.select(F.coalesce(F.try_divide(F.col("wrong"), F.col("n")), F.lit(0.0)).cast("double").alias("rate"))
