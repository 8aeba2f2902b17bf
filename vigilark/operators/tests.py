"""Univariate tests of two groups of similarities: statistics by aggregates, p-values by kernels.

`values` are rows `drug`, `metric`, `grp` ('V' or 'R'), `sim`; nulls do not count. Tests that need means
and variances only take sums of parts of the values as well: rows with `n`, `total`, `ss`. Statistics
are null where their guards fail: too few values, no spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vigilark.functions.distributions import chi2_tail, exact_rank_p, f_pvalue, normal_quantile, normal_tail, two_tails
from vigilark.operators.ranks import median_of_tally, sums_before, tallied
from vigilark.sources.tables import settle

KEYS = ["drug", "metric"]
GROUPS = ("V", "R")
#: Largest size of the smaller group whose rank test is exact, and ranks that are scored at once.
EXACT, SCORED = 8, 1_000_000


def _wide(values: DataFrame, column: str = "sim") -> DataFrame:
    """Per key the size, mean and sum of squares about the mean of both groups."""
    aggs = []
    if "ss" in values.columns:  # parts: their squares, and those of their means about the whole one
        for g in GROUPS:
            own = lambda c, g=g: F.sum(F.when(F.col("grp") == g, c))
            n, total = F.coalesce(own(F.col("n")), F.lit(0)), own(F.col("total"))
            between = own(F.try_divide(F.col("total") * F.col("total"), F.col("n"))) - F.try_divide(total * total, n)
            aggs += [n.alias(f"n_{g}"), F.try_divide(total, n).alias(f"m_{g}"), (own(F.col("ss")) + F.greatest(between, F.lit(0.0))).alias(f"ss_{g}")]
        rows = values.groupBy(*KEYS).agg(*aggs)
    else:
        for g in GROUPS:
            x = F.when(F.col("grp") == g, F.col(column))
            aggs += [F.count(x).alias(f"n_{g}"), F.avg(x).alias(f"m_{g}"), (F.var_pop(x) * F.count(x)).alias(f"ss_{g}")]
        rows = values.filter(F.col(column).isNotNull()).groupBy(*KEYS).agg(*aggs)
    n = F.col("n_V") + F.col("n_R")
    return rows.withColumn("n", n).withColumn("m", (F.col("n_V") * F.col("m_V") + F.col("n_R") * F.col("m_R")) / n)


def _between() -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"n_{g}") * (F.col(f"m_{g}") - F.col("m")) * (F.col(f"m_{g}") - F.col("m")) for g in GROUPS])


def _result(rows: DataFrame, stat: Column, ok: Column, df1: Column | None = None, df2: Column | None = None) -> DataFrame:
    out = [*KEYS, F.when(ok, stat).alias("stat")]
    if df1 is not None:
        out += [F.when(ok, df1.cast("double")).alias("df1"), F.when(ok, df2.cast("double")).alias("df2")]
    return rows.select(*out)


def with_pvalue(rows: DataFrame) -> DataFrame:
    """Adds `p`, the upper tail of the F distribution."""
    return rows.withColumn("p", f_pvalue("df1", "df2", "stat"))


def anova(values: DataFrame, column: str = "sim") -> DataFrame:
    """F of the means: between over within."""
    rows = _wide(values, column)
    inside = F.col("ss_V") + F.col("ss_R")
    df2 = F.col("n") - 2
    ok = (F.col("n_V") > 0) & (F.col("n_R") > 0) & (df2 > 0) & (inside > 0)
    return _result(rows, F.try_divide(_between(), inside) * df2, ok, F.lit(1), df2)


def welch(values: DataFrame, textbook: bool = False) -> DataFrame:
    """Welch's F of the means with weights n / SS, or n / variance if `textbook`."""
    rows = _wide(values)
    weight = {g: F.try_divide(F.col(f"n_{g}") * ((F.col(f"n_{g}") - 1) if textbook else F.lit(1)), F.col(f"ss_{g}")) for g in GROUPS}
    total = weight["V"] + weight["R"]
    mean = F.try_divide(weight["V"] * F.col("m_V") + weight["R"] * F.col("m_R"), total)
    above = reduce(lambda a, b: a + b, [weight[g] * (F.col(f"m_{g}") - mean) * (F.col(f"m_{g}") - mean) for g in GROUPS])
    part = {g: 1 - F.try_divide(weight[g], total) for g in GROUPS}
    spread = reduce(lambda a, b: a + b, [F.try_divide(part[g] * part[g], F.col(f"n_{g}") - 1) for g in GROUPS])
    ok = (F.col("n_V") > 1) & (F.col("n_R") > 1) & (F.col("ss_V") > 0) & (F.col("ss_R") > 0)
    # two groups: 2 (k - 2) / (k * k - 1) vanishes
    return _result(rows, above, ok, F.lit(1), F.try_divide(F.lit(3.0), 3 * spread))


def brown_forsythe_means(values: DataFrame, textbook: bool = False) -> DataFrame:
    """F of the means over the groups' sums of squares, weighted by 1 - n / N (their variances if
    `textbook`), with Satterthwaite's freedom."""
    rows = _wide(values)
    spread = {g: F.try_divide(F.col(f"ss_{g}"), F.col(f"n_{g}") - 1) if textbook else F.col(f"ss_{g}") for g in GROUPS}
    share = {g: (1 - F.col(f"n_{g}") / F.col("n")) * spread[g] for g in GROUPS}
    below = share["V"] + share["R"]
    c = {g: F.try_divide(share[g], below) for g in GROUPS}
    freedom = reduce(lambda a, b: a + b, [F.try_divide(c[g] * c[g], F.col(f"n_{g}") - 1) for g in GROUPS])
    ok = (F.col("n_V") > 1) & (F.col("n_R") > 1) & (below > 0)
    return _result(rows, F.try_divide(_between(), below), ok, F.lit(1), F.try_divide(F.lit(1.0), freedom))


def variance_ratio(values: DataFrame) -> DataFrame:
    """Larger over smaller sample variance; the freedoms stay in the order of the groups."""
    rows = _wide(values)
    v = {g: F.try_divide(F.col(f"ss_{g}"), F.col(f"n_{g}") - 1) for g in GROUPS}
    ok = (F.col("n_V") > 1) & (F.col("n_R") > 1) & (v["V"] > 0) & (v["R"] > 0)
    stat = F.try_divide(F.greatest(v["V"], v["R"]), F.least(v["V"], v["R"]))
    return _result(rows, stat, ok, F.col("n_V") - 1, F.col("n_R") - 1)


def bartlett(values: DataFrame) -> DataFrame:
    """Bartlett's statistic and its `p`, chi-squared with one degree of freedom."""
    rows = _wide(values)
    d = {g: F.col(f"n_{g}") - 1 for g in GROUPS}
    v = {g: F.try_divide(F.col(f"ss_{g}"), d[g]) for g in GROUPS}
    df = F.col("n") - 2
    pooled = F.try_divide(F.col("ss_V") + F.col("ss_R"), df)
    above = df * F.ln(pooled) - d["V"] * F.ln(v["V"]) - d["R"] * F.ln(v["R"])
    below = 1 + (F.try_divide(F.lit(1.0), d["V"]) + F.try_divide(F.lit(1.0), d["R"]) - F.try_divide(F.lit(1.0), df)) / 3
    ok = (F.col("n_V") > 1) & (F.col("n_R") > 1) & (F.col("ss_V") > 0) & (F.col("ss_R") > 0)
    stat = _result(rows, above / below, ok)
    return stat.withColumn("p", two_tails(F.sqrt(F.greatest("stat", F.lit(0.0)))))


def levene(values: DataFrame) -> DataFrame:
    """ANOVA of the absolute deviations from the group means."""
    return anova(from_means(values))


def brown_forsythe_variances(values: DataFrame) -> DataFrame:
    """ANOVA of the absolute deviations from the group medians.

    Medians come from tallies in ranges of the values, so a large group is not held in one task.
    """
    return anova(from_medians(values))


def from_medians(values: DataFrame) -> DataFrame:
    """Sums of parts of the absolute deviations from the group medians."""
    own = [*KEYS, "grp"]
    placed = settle(sums_before(tallied(values, own, "sim", n=F.lit(1)), own, "sim", ["n"]), columnar=True)
    dev = F.abs(F.col("sim") - F.col("median"))
    return placed.join(median_of_tally(placed, own, "sim"), own).select(*own, "n", (F.col("n") * dev).alias("total"), F.lit(0.0).alias("ss"))


def from_means(values: DataFrame) -> DataFrame:
    """Sums of parts of the absolute deviations from the group means."""
    own = [*KEYS, "grp"]
    known = values.filter("sim is not null")
    dev = F.abs(F.col("sim") - F.col("centre"))
    known = known.join(known.groupBy(*own).agg(F.avg("sim").alias("centre")), own)
    return known.groupBy(*own).agg(F.count("*").alias("n"), F.sum(dev).alias("total"), (F.var_pop(dev) * F.count("*")).alias("ss"))


#: Columns of sums of parts, and of what ranks and shapes are tested by.
PARTS = {"grp": "string", "n": "bigint", "total": "double", "ss": "double"}
RANKS = {"n_V": "bigint", "n_R": "bigint", "varied_V": "boolean", "varied_R": "boolean", "r_V": "double", "tied": "double"}
SHAPES = {"grp": "string", "n": "bigint", **dict.fromkeys(("m2", "m3", "m4", "sd", "square", "product", "wide", "narrow", "off"), "double")}


def moments_of(sims: dict[str, np.ndarray]) -> list[dict]:
    """Size, sum, and sum of squares about the mean of each group of one drug."""
    return [{"grp": g, "n": len(x), "total": float(x.sum()), "ss": float(((x - x.mean()) ** 2).sum())} for g, x in sims.items() if len(x)]


def moments(values: DataFrame) -> DataFrame:
    """The same of every group from a table of values."""
    known = values.filter("sim is not null")
    return known.groupBy(*KEYS, "grp").agg(F.count("*").alias("n"), F.sum("sim").alias("total"), (F.var_pop("sim") * F.count("*")).alias("ss"))


def deviations_of(sims: dict[str, np.ndarray], centre: Callable[[np.ndarray], float]) -> list[dict]:
    """Sums of the absolute deviations from the `centre` of each group of one drug."""
    rows = []
    for g, x in sims.items():
        if len(x):
            d = np.abs(x - centre(x))
            rows.append({"grp": g, "n": len(x), "total": float(d.sum()), "ss": float(((d - d.mean()) ** 2).sum())})
    return rows


def ranks_of(sims: dict[str, np.ndarray]) -> list[dict]:
    """The columns RANKS of one drug's two groups."""
    v, r = (sims[g] for g in GROUPS)
    if not len(v) + len(r):
        return []
    both = np.sort(np.concatenate([v, r]))
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    ties = np.diff(np.r_[first, len(both)]).astype(float)
    rank = first + (ties + 1) / 2
    varied = lambda x: bool(len(x) and x.max() > x.min())
    total = float(rank[np.searchsorted(both[first], v)].sum())
    return [{"n_V": len(v), "n_R": len(r), "varied_V": varied(v), "varied_R": varied(r), "r_V": total, "tied": float((ties * (ties * ties - 1)).sum())}]


@lru_cache(maxsize=4)
def _scores(n: int) -> np.ndarray:
    return normal_score(np.arange(1, n + 1), n)


def furthest(x: np.ndarray, mean: float, sd: float, step: int = 64) -> float:
    """The largest distance of sorted values from the normal curve.

    Curve and share grow from value to value, so between two values both distances are at most those of
    the ends taken crosswise; only stretches where these reach the largest one found are looked at.
    """
    n = len(x)
    curve = lambda at: np.array([1 - normal_tail(z) for z in ((x[at] - mean) / sd).tolist()])
    ends = np.unique(np.r_[np.arange(0, n, step), n - 1])
    f = curve(ends)
    best = max(((ends + 1) / n - f).max(), (f - ends / n).max())
    for k in np.flatnonzero(np.maximum(ends[1:] / n - f[:-1], f[1:] - (ends[:-1] + 1) / n) > best):
        at = np.arange(ends[k] + 1, ends[k + 1])
        if len(at):
            inner = curve(at)
            best = max(best, ((at + 1) / n - inner).max(), (inner - at / n).max())
    return float(best)


def shapes_of(sims: dict[str, np.ndarray]) -> list[dict]:
    """The columns SHAPES of each group of one drug."""
    rows = []
    for g, x in sims.items():
        if len(x):
            x, n = np.sort(x), len(x)
            mean = x.mean()
            d = x - mean
            m2, m3, m4 = (float((d**k).mean()) for k in (2, 3, 4))
            sd, m = math.sqrt(m2), _scores(n)
            off = furthest(x, mean, sd) if sd > 0 else math.nan
            narrow = float(x[-2] - x[1]) if n > 1 else None
            rows.append({
                "grp": g, "n": n, "m2": m2, "m3": m3, "m4": m4, "sd": sd, "square": float(m @ m), "product": float(m @ x),
                "wide": float(x[-1] - x[0]), "narrow": narrow, "off": off,
            })
    return rows


def mann_whitney(values: DataFrame) -> DataFrame:
    """U of the valid group (`stat`) from average ranks, the `z` score that ties and continuity
    correct, and the two-sided `p`: exact if a group has at most EXACT values and none are tied, else
    the normal approximation. Null if a group has fewer than two values or all its values are equal.

    `values`, or rows as of `rank_sums`.
    """
    one = values if "r_V" in values.columns else rank_sums(values)
    n = F.col("n_V") + F.col("n_R")
    u = F.col("r_V") - F.col("n_V") * (F.col("n_V") + 1) / 2
    mean = F.col("n_V") * F.col("n_R") / 2
    spread = F.sqrt(F.col("n_V") * F.col("n_R") / 12 * (n + 1 - F.try_divide(F.col("tied"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)), spread)
    exact = (F.least("n_V", "n_R") <= EXACT) & (F.col("tied") == 0)
    p = F.when(exact, exact_rank_p("n_V", "n_R", u)).otherwise(two_tails(z))
    ok = (F.col("n_V") > 1) & (F.col("n_R") > 1) & F.col("varied_V") & F.col("varied_R")
    return one.select(*KEYS, F.when(ok, u).alias("stat"), F.when(ok, z).alias("z"), F.when(ok, p).alias("p"))


def rank_sums(values: DataFrame) -> DataFrame:
    """Per key the columns RANKS: sizes, the sum of the valid group's ranks, and that of ties.

    Equal values are counted first; ranks are the counts before them, added up over ranges of values.
    """
    size = {g: F.when(F.col("grp") == g, 1).otherwise(0) for g in GROUPS}
    tally = tallied(values, KEYS, "sim", c_V=size["V"], c_R=size["R"]).withColumn("ties", F.col("c_V") + F.col("c_R"))
    ranked = sums_before(tally, KEYS, "sim", ["ties"]).withColumn("r", F.col("before_ties") + (F.col("ties") + 1) / 2)
    own = {g: F.when(F.col(f"c_{g}") > 0, F.col("sim")) for g in GROUPS}
    ties = F.col("ties").cast("double")
    return ranked.groupBy(*KEYS).agg(
        *[F.sum(f"c_{g}").alias(f"n_{g}") for g in GROUPS], *[(F.max(own[g]) > F.min(own[g])).alias(f"varied_{g}") for g in GROUPS],
        F.sum(F.col("c_V") * F.col("r")).alias("r_V"), F.sum(ties * (ties * ties - 1)).alias("tied"),
    )


# -- one group against the normal distribution -------------------------------------------------
# Each test is a function of a few sums over the group, which Spark makes; the functions of whole arrays
# put the same sums together for one group.
def moments_p(n: int, m2: float, m3: float, m4: float, least: int = 20) -> float | None:
    """p of D'Agostino and Pearson's test from central moments; None below `least` values."""
    if n < least or m2 <= 0:
        return None
    y = m3 / m2**1.5 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    s = (m4 / m2**2 - mean) / math.sqrt(var)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + math.sqrt(1 + 4 / skew**2))
    inner = (1 - 2 / a) / (1 + s * math.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - math.copysign(abs(inner) ** (1 / 3), inner)) / math.sqrt(2 / (9 * a))
    return chi2_tail(z1 * z1 + z2 * z2, 2)


def dagostino(x: np.ndarray, least: int = 20) -> float | None:
    d = x - x.mean()
    return moments_p(len(x), *(float((d**k).mean()) for k in (2, 3, 4)), least)


def normal_score(rank: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """Where the rank-th of n values of a normal sample is expected, by Blom."""
    return normal_quantile((np.asarray(rank, float) - 0.375) / (np.asarray(n, float) + 0.25))


def score_sums(before: np.ndarray, ties: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the normal scores of the `ties` ranks behind `before` of `n`, and of their squares; some ranks at a time."""
    total, square = np.zeros(len(n)), np.zeros(len(n))
    for first in range(0, len(n), SCORED):
        part = slice(first, first + SCORED)
        score = normal_score(before[part] + 1, n[part])
        total[part], square[part] = score, score**2
    for k in np.flatnonzero(ties > 1).tolist():
        for first in range(1, int(ties[k]), SCORED):
            score = normal_score(before[k] + 1 + np.arange(first, min(first + SCORED, int(ties[k]))), n[k])
            total[k], square[k] = total[k] + score.sum(), square[k] + (score**2).sum()
    return total, square


def scores_p(n: int, ss: float, square: float, product: float, wide: float, narrow: float) -> tuple[float, float] | None:
    """W and p by Royston's approximation; None below 3 values or without spread.

    `ss` is the sum of squares about the mean, `square` that of the normal scores, `product` of scores
    and ordered values; `wide` and `narrow` are the distances of the outermost values and of the next.
    """
    if n <= 2 or ss <= 0:
        return None
    u, top, next_ = 1 / math.sqrt(n), float(normal_score(n, n)), float(normal_score(n - 1, n))
    if n == 3:
        total = math.sqrt(0.5) * wide
    else:
        # Royston's polynomials for the outermost weights.
        last = float(np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, top / math.sqrt(square)], u))
        if n > 5:
            second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, next_ / math.sqrt(square)], u))
            rest = (square - 2 * top**2 - 2 * next_**2) / (1 - 2 * last**2 - 2 * second**2)
            total = last * wide + second * narrow + (product - top * wide - next_ * narrow) / math.sqrt(rest)
        else:
            rest = (square - 2 * top**2) / (1 - 2 * last**2)
            total = last * wide + (product - top * wide) / math.sqrt(rest)
    w = min(1.0, total**2 / ss)
    if n == 3:
        return w, max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    # Royston's polynomials for the normalising transform.
    if n <= 11:
        g = 0.459 * n - 2.273
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        if w >= 1 or g - math.log1p(-w) <= 0:
            return w, 1.0 if w >= 1 else 0.0
        y = -math.log(g - math.log1p(-w))
    else:
        log_n = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
        if w >= 1:
            return w, 1.0
        y = math.log1p(-w)
    return w, normal_tail((y - mu) / sd)


def shapiro(x: np.ndarray) -> tuple[float, float] | None:
    if len(x) <= 2:
        return None
    x, n = np.sort(x), len(x)
    m = normal_score(np.arange(1, n + 1), n)
    return scores_p(n, float(((x - x.mean()) ** 2).sum()), float(m @ m), float(m @ x), x[-1] - x[0], x[-2] - x[1])


def kolmogorov(x: np.ndarray) -> float | None:
    """p of the largest distance from the normal curve of the values' own mean and spread."""
    n, sd = len(x), x.std()
    if not n or sd == 0:
        return None
    cdf = np.array([1 - normal_tail(z) for z in (np.sort(x) - x.mean()) / sd])
    d = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    return _kolmogorov_tail(n, float(d))


def _kolmogorov_tail(n: int, d: float) -> float:
    """P(D >= d): exact by powers of Durbin's matrix for up to 200 values, else the limit."""
    if n > 200:
        t = d * math.sqrt(n)
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    grid = np.arange(m)
    a = (grid[:, None] - grid[None, :] + 1 >= 0).astype(float)
    a[:, 0] -= h ** (grid + 1)
    a[-1, :] -= h ** (m - grid)
    a[-1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                a[i, j] /= math.factorial(i - j + 1)
    power, scale, out = np.eye(m), 0.0, 1.0
    for i in range(1, n + 1):
        power = power @ a * (i / n)
        top = np.abs(power).max()
        if top > 1e100 or 0 < top < 1e-100:
            power, scale = power / top, scale + math.log(top)
    out = 1 - power[k - 1, k - 1] * math.exp(scale)
    return min(1.0, max(0.0, float(out)))


def normality(values: DataFrame) -> DataFrame:
    """`drug`, `metric`, `grp`, `normality`, `shapiro`, `kolsir`: p-values of each group.

    Equal values are counted first, their ranks are the counts before them, added up over ranges of
    values; moments, normal scores and distances from the curve are sums over these. So a large group is
    spread over as many tasks as it has ranges. `values`, or rows as of `shapes`.
    """
    sums = values if "off" in values.columns else shapes(values)

    @pandas_udf("normality double, shapiro double, kolsir double")
    def tails(n: pd.Series, m2: pd.Series, m3: pd.Series, m4: pd.Series, square: pd.Series, product: pd.Series, wide: pd.Series, narrow: pd.Series, off: pd.Series) -> pd.DataFrame:
        out = []
        for k, a, b, c, s, p, far, near, d in zip(n, m2, m3, m4, square, product, wide, narrow, off, strict=True):
            w = scores_p(k, a * k, s, p, far, near)
            out.append((moments_p(k, a, b, c), w[1] if w else None, _kolmogorov_tail(k, d) if a > 0 and d == d else None))
        return pd.DataFrame(out, columns=["normality", "shapiro", "kolsir"], dtype="float64")

    # values that are all equal have no spread, whatever rounding makes of their moments
    flat = F.col("wide") == 0
    found = sums.withColumn("m2", F.when(flat, 0.0).otherwise(F.col("m2"))).withColumn(
        "p", tails("n", "m2", "m3", "m4", "square", "product", "wide", "narrow", "off")
    )
    return found.select(*KEYS, "grp", "p.*")


def shapes(values: DataFrame) -> DataFrame:
    """Per key and group the columns SHAPES: what the tests against the normal distribution need."""
    by = [*KEYS, "grp"]
    placed = settle(sums_before(tallied(values, by, "sim", c=F.lit(1)), by, "sim", ["c"]), columnar=True)
    sizes = placed.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("sim")) / F.sum("c")).alias("mean"))
    around = placed.join(sizes, by).withColumn("d", F.col("sim") - F.col("mean"))
    spread = around.groupBy(*by).agg(F.sqrt(F.sum(F.col("c") * F.col("d") * F.col("d")) / F.sum("c")).alias("sd"))

    @pandas_udf("total double, square double, curve double")
    def at(before: pd.Series, ties: pd.Series, n: pd.Series, z: pd.Series) -> pd.DataFrame:
        total, square = score_sums(before.to_numpy(), ties.to_numpy(), n.to_numpy())
        return pd.DataFrame({"total": total, "square": square, "curve": [math.nan if x != x else 1 - normal_tail(x) for x in z.astype("float64")]})

    z = F.try_divide(F.col("d"), F.col("sd"))
    scored = around.join(spread, by).withColumn("at", at("before_c", "c", "n", z))
    n, upto = F.col("n"), F.col("before_c") + F.col("c")
    power = lambda k: F.sum(F.col("c") * F.pow("d", F.lit(k))) / F.sum("c")
    pick = lambda rank: F.max(F.when((F.col("before_c") < rank) & (rank <= upto), F.col("sim")))
    off = F.greatest(upto / n - F.col("at.curve"), F.col("at.curve") - F.col("before_c") / n)
    return scored.groupBy(*by).agg(
        F.max("n").alias("n"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"), F.max("sd").alias("sd"),
        F.sum("at.square").alias("square"), F.sum(F.col("at.total") * F.col("sim")).alias("product"),
        (F.max("sim") - F.min("sim")).alias("wide"), (pick(n - 1) - pick(F.lit(2))).alias("narrow"), F.max(off).alias("off"),
    )


# -- false discovery rate ----------------------------------------------------------------------
def adjust_pvalues(rows: DataFrame, within: list[str], p: str = "p") -> DataFrame:
    """`p_adjusted` of Benjamini and Hochberg over the rows of each `within`; null p do not count."""
    w = Window.partitionBy(*within)
    rank = F.row_number().over(w.orderBy(p))
    known = rows.filter(F.col(p).isNotNull())
    scaled = known.withColumn("_q", F.col(p) * F.count("*").over(w) / rank).withColumn("_r", rank)
    least = F.min("_q").over(w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("p_adjusted", F.least(least, F.lit(1.0))).drop("_q", "_r")


def pass_rate(rows: DataFrame, within: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Share of the rows of each `within` whose adjusted p is at most `alpha`, and their number."""
    passed = F.avg((F.col("p_adjusted") <= alpha).cast("double"))
    return adjust_pvalues(rows, within, p).groupBy(*within).agg(F.count("*").alias("n"), passed.alias("rate"))


def summary(gain_rows: DataFrame, columns: list[str]) -> DataFrame:
    """`metric`, `stat`, `value`: the mean over drugs of each column, nulls and NaN left out."""
    long = gain_rows.unpivot(["drug", "metric"], columns, "stat", "x")
    return long.groupBy("metric", "stat").agg(F.avg(F.when(~F.isnan("x"), F.col("x"))).alias("value"))


#: Statistics whose means, and p-values whose pass rates, sum up a comparison.
AVERAGED = ("valid", "rand", "valid_norm", "rand_norm", "gain_norm", "gain_norm_pop")
COUNTED = (
    "valid_normality", "rand_normality", "valid_shapiro", "rand_shapiro", "valid_kolsir", "rand_kolsir",
    "mean_mannwhitney_p", "var_brown_p", "permdisp_p", "permanova_p",
)


def normality_long(rows: DataFrame) -> DataFrame:
    """Results of `normality` as `drug`, `metric`, `stat`, `value`; the group is part of the name."""
    long = rows.unpivot([*KEYS, "grp"], ["normality", "shapiro", "kolsir"], "test", "value")
    side = F.when(F.col("grp") == "V", "valid_").otherwise("rand_")
    return long.select(*KEYS, F.concat(side, F.col("test")).alias("stat"), "value")


def all_tests(values: DataFrame) -> DataFrame:
    """`drug`, `metric`, `stat`, `value`: statistic and p-value of every univariate test."""
    return all_tests_of(values, values, from_means(values), from_medians(values), values)


def all_tests_of(moments: DataFrame, ranks: DataFrame, means: DataFrame, medians: DataFrame, shapes: DataFrame) -> DataFrame:
    """The same from sums of parts of the values and of their deviations from means and medians, and from rows as of `rank_sums` and `shapes`."""
    named = {
        "mean_anova": with_pvalue(anova(moments)), "mean_welch": with_pvalue(welch(moments)),
        "mean_brown": with_pvalue(brown_forsythe_means(moments)), "mean_mannwhitney": mann_whitney(ranks),
        "var_f": with_pvalue(variance_ratio(moments)), "var_bartlett": bartlett(moments),
        "var_levene": with_pvalue(anova(means)), "var_brown": with_pvalue(anova(medians)),
    }
    parts = []
    for name, rows in named.items():
        both = F.array(*[F.struct(F.lit(f"{name}_{k}").alias("stat"), F.col(c).alias("value")) for k, c in (("f", "stat"), ("p", "p"))])
        parts.append(rows.select(*KEYS, F.explode(both).alias("s")).select(*KEYS, "s.*"))
    return reduce(DataFrame.unionByName, [*parts, normality_long(normality(shapes))])


def validity_summary(results: DataFrame, properties: DataFrame) -> DataFrame:
    """`metric`, `stat`, `value`: properties of all pairs, means over drugs of what is AVERAGED, and of
    the p-values that are COUNTED the share that passes after adjustment. Nulls and NaN are left out; a
    statistic without any value has no row.

    `results` is long: `drug`, `metric`, `stat`, `value`.
    """
    known = results.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    means = known.filter(F.col("stat").isin(*AVERAGED)).groupBy("metric", "stat").agg(F.avg("value").alias("value"))
    rates = pass_rate(known.filter(F.col("stat").isin(*COUNTED)), ["metric", "stat"], "value").select("metric", "stat", F.col("rate").alias("value"))
    ends = properties.unpivot(["metric"], ["min", "max", "mean", "normed_mean"], "stat", "value")
    return reduce(DataFrame.unionByName, [ends, means, rates])
