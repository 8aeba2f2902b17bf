"""Similarities of terms from the paths that lead to them in a hierarchy.

Paths are rows `term`, one column per level (lowest first, null where missing) and, if wanted,
`rank` and `ord` (place of the path). A few stated query terms are compared with all terms as
columns; all pairs of terms are compared block by block, where the paths of a term are one row
(`term_paths`, `path_matrix`). Scores of path pairs are averaged over all pairs of paths of two terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stated query terms that are compared at once; for more, compare all pairs block by block.
MAX_QUERIES = 100
#: Pairs of paths that are scored at once, few enough for a processor's cache.
CELLS = 1 << 16


def path_pairs(paths: DataFrame, queries: DataFrame, levels: list[str]) -> DataFrame:
    """Pairs of a path of a query term (`q`) with a path of any term (`t`)."""
    stated = [r["term"] for r in queries.select("term").distinct().limit(MAX_QUERIES + 1).collect()]
    if len(stated) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} query terms: compare all pairs in blocks instead")
    wanted = paths.filter(F.col("term").isin(stated))
    extra = [c for c in ("rank", "ord") if c in paths.columns]
    left = wanted.select(F.col("term").alias("q"), *[F.col(c).alias(f"q_{c}") for c in [*levels, *extra]])
    right = paths.select(F.col("term").alias("t"), *[F.col(c).alias(f"t_{c}") for c in [*levels, *extra]])
    return right.join(F.broadcast(left), F.col("q") != F.col("t"))  # paths of at most MAX_QUERIES terms


def _same(level: str) -> Column:
    return F.col(f"q_{level}") == F.col(f"t_{level}")  # null where missing, so no match


def first_match(levels: list[str]) -> Column:
    """1/2 for the lowest level in common, 1/4 for the next and so on; half a step below none."""
    out = F.lit(1 / (2 * (len(levels) + 1)))
    for k in reversed(range(len(levels))):
        out = F.when(_same(levels[k]), F.lit(1 / (2 * (k + 1)))).otherwise(out)
    return out


def sum_of_matches(levels: list[str]) -> Column:
    """The same scores added up over all levels in common."""
    total = sum((F.when(_same(c), F.lit(1 / (2 * (k + 1)))).otherwise(0.0) for k, c in enumerate(levels)), F.lit(0.0))
    return F.when(total > 0, total).otherwise(F.lit(1 / (2 * (len(levels) + 1))))


def mean_score(pairs: DataFrame, score: Column) -> DataFrame:
    return pairs.groupBy("q", "t").agg(F.avg(score).alias("sim"))


def primary_score(pairs: DataFrame, score: Column, summed: bool = False) -> DataFrame:
    """Over pairs of primary paths only: the last pair's score, or their sum; no row without such
    a pair. The last is that of the last paths by `ord`."""
    rows = pairs.filter("q_rank = 'PRIMARY' and t_rank = 'PRIMARY'")
    last = F.max_by(score, F.struct("q_ord", "t_ord"))
    return rows.groupBy("q", "t").agg((F.sum(score) if summed else last).alias("sim"))


def shared_content(pairs: DataFrame, content: DataFrame, levels: list[str]) -> DataFrame:
    """`pairs` with `ic_q`, `ic_t` and `ic_shared`, that of the lowest level in common (else 0)."""
    low = F.coalesce(*[F.when(_same(c), F.struct(F.lit(c).alias("level"), F.col(f"q_{c}").cast("string").alias("name"))) for c in levels])
    rows = pairs.withColumn("low", low)
    above = content.filter("level <> 'pt'").select("level", "name", F.col("ic").alias("ic_low"))
    rows = rows.join(above, (F.col("low.level") == F.col("level")) & (F.col("low.name") == F.col("name")), "left").drop("level", "name")
    for side in ("q", "t"):
        own = content.filter("level = 'pt'").select(F.col("name").alias(f"pt_{side}"), F.col("ic").alias(f"ic_{side}"))
        rows = rows.join(own, F.col(side).cast("string") == F.col(f"pt_{side}"), "left").drop(f"pt_{side}")
    return rows.withColumn("ic_shared", F.coalesce("ic_low", F.lit(0.0)))


def resnik(pairs: DataFrame) -> DataFrame:
    return mean_score(pairs, F.col("ic_shared"))


def jiang_conrath(pairs: DataFrame) -> DataFrame:
    """One over the content that both terms have beyond what they share."""
    return mean_score(pairs, F.try_divide(F.lit(1.0), F.col("ic_q") + F.col("ic_t") - 2 * F.col("ic_shared")))


def lin(pairs: DataFrame) -> DataFrame:
    return mean_score(pairs, F.try_divide(2 * F.col("ic_shared"), F.col("ic_q") + F.col("ic_t")))


# -- all pairs, block by block -----------------------------------------------------------------
#: Score of a path pair, and how the pairs of two terms are summed up, per metric.
PATH_METRICS = {
    "meanminpath": ("first", "mean"), "meanpath": ("first", "mean"), "meanpath_additive": ("additive", "mean"),
    "primaryminpath": ("first", "last"), "primarypath": ("first", "sum"), "primarypath_additive": ("additive", "sum"),
    "smqmeanminpath": ("first", "mean"), "resnik": ("resnik", "mean"), "jiangconrath": ("jiang", "mean"), "lin": ("lin", "mean"),
}


def term_paths(paths: DataFrame, levels: list[str], content: DataFrame | None = None) -> DataFrame:
    """`term`, `v`: the paths of each term in order, with the content of the names and of the term.

    A name's content is looked up by level and name; without `content` it is left empty.
    """
    rank = F.col("rank") if "rank" in paths.columns else F.lit("PRIMARY")
    rows = paths.select("term", F.col("ord") if "ord" in paths.columns else F.lit(0).alias("ord"), (rank == "PRIMARY").alias("primary"), *levels)
    if content is None:
        contents, own = F.array(*[F.lit(None).cast("double")] * len(levels)), F.lit(None).cast("double")
    else:
        for level in levels:
            names = content.filter(F.col("level") == level).select(F.col("name").alias(f"n_{level}"), F.col("ic").alias(f"ic_{level}"))
            rows = rows.join(names, F.col(level).cast("string") == F.col(f"n_{level}"), "left")
        terms = content.filter("level = 'pt'").select(F.col("name").alias("n_pt"), F.col("ic").alias("ic_pt"))
        rows = rows.join(terms, F.col("term").cast("string") == F.col("n_pt"), "left")
        contents, own = F.array(*[F.col(f"ic_{c}") for c in levels]), F.col("ic_pt")
    names = F.array(*[F.col(c).cast("string") for c in levels])
    path = F.struct("ord", names.alias("names"), contents.alias("ic"), own.alias("own"), "primary")
    return rows.groupBy("term").agg(F.array_sort(F.collect_list(path)).alias("v"))


@dataclass
class Paths:
    """Paths of a block's terms, those of one term next to each other."""

    begin: np.ndarray  # per term: its first path; one more at the end
    names: np.ndarray  # per path and level: name or None
    ic: np.ndarray  # per path and level
    own: np.ndarray  # per term
    primary: np.ndarray  # per path

    @classmethod
    def load(cls, rows: list[list[dict]]) -> Paths:
        flat = [p for row in rows for p in row]
        width = len(flat[0]["names"]) if flat else 0
        number = lambda x: np.nan if x is None else x
        return cls(
            np.r_[0, np.cumsum([len(r) for r in rows])].astype(int),
            np.array([p["names"] for p in flat], object).reshape(len(flat), width),
            np.array([[number(x) for x in p["ic"]] for p in flat], float).reshape(len(flat), width),
            np.array([number(r[0]["own"]) if r else np.nan for r in rows], float),
            np.array([p["primary"] for p in flat], bool),
        )

    def __len__(self) -> int:
        return len(self.own)

    def __getitem__(self, which: np.ndarray) -> Paths:
        which = np.flatnonzero(which) if which.dtype == bool else which
        spans = [np.arange(self.begin[k], self.begin[k + 1]) for k in which]
        at = np.concatenate(spans) if spans else np.zeros(0, int)
        return Paths(np.r_[0, np.cumsum([len(s) for s in spans])].astype(int), self.names[at], self.ic[at], self.own[which], self.primary[at])


def path_matrix(metric: str, a: Paths, b: Paths) -> np.ndarray:
    """Scores of all terms of `a` with all of `b`; NaN where there is none. Some terms of `a` at a time, which stay in the cache."""
    out = np.full((len(a), len(b)), np.nan)
    if not len(a.names) or not len(b.names):
        return out
    codes = [[], []]
    for k in range(a.names.shape[1]):
        # names as numbers; a missing one matches nothing
        known = {x for x in (*a.names[:, k], *b.names[:, k]) if x is not None}
        code = {x: n for n, x in enumerate(known)}
        for side, missing, own in ((a, -1, codes[0]), (b, -2, codes[1])):
            own.append(np.array([code.get(x, missing) for x in side.names[:, k]], np.int32))
    step = max(1, CELLS * len(a) // (len(a.names) * len(b.names)))
    for first in range(0, len(a), step):
        terms = np.arange(first, min(first + step, len(a)))
        at = slice(a.begin[terms[0]], a.begin[terms[-1] + 1])
        if at.start < at.stop:
            out[terms] = _path_rows(metric, a[terms], b, [c[at] for c in codes[0]], codes[1])
    return out


def _path_rows(metric: str, a: Paths, b: Paths, codes_a: list[np.ndarray], codes_b: list[np.ndarray]) -> np.ndarray:
    kind, fold = PATH_METRICS[metric]
    out = np.full((len(a), len(b)), np.nan)
    levels = len(codes_a)
    score = np.zeros((len(codes_a[0]), len(codes_b[0])))
    open_ = np.ones(score.shape, bool)  # pairs of paths without a match yet
    for k in range(levels):
        same = codes_a[k][:, None] == codes_b[k][None, :]
        worth = a.ic[:, k, None] if kind in ("resnik", "jiang", "lin") else 1 / (2 * (k + 1))
        np.add(score, worth, out=score, where=same if kind == "additive" else same & open_)
        open_ &= ~same
    if kind in ("first", "additive"):
        score[open_] = 1 / (2 * (levels + 1))
    else:
        count = lambda p: np.repeat(p.own, np.diff(p.begin))
        both = count(a)[:, None] + count(b)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "jiang":
                score = np.where(both - 2 * score != 0, 1 / (both - 2 * score), np.nan)
            elif kind == "lin":
                score = np.where(both != 0, 2 * score / both, np.nan)
    counted = ~np.isnan(score)
    if fold != "mean":
        counted &= a.primary[:, None] & b.primary[None, :]
    if fold == "last":
        # of each pair of terms the last path of both: walk in order and overwrite
        rows, cols = np.nonzero(counted)
        ta, tb = (np.repeat(np.arange(len(p)), np.diff(p.begin)) for p in (a, b))
        out[ta[rows], tb[cols]] = score[rows, cols]
        return out
    some = [np.flatnonzero(np.diff(p.begin)) for p in (a, b)]
    sizes = [np.unique(np.diff(p.begin)[s]) for p, s in zip((a, b), some, strict=True)]

    def fold_up(m: np.ndarray) -> np.ndarray:
        if any(len(n) != 1 for n in sizes):
            return np.add.reduceat(np.add.reduceat(m, a.begin[some[0]], axis=0), b.begin[some[1]], axis=1)
        m = sum(m[k :: sizes[0][0]] for k in range(sizes[0][0]))  # all have as many paths
        return sum(m[:, k :: sizes[1][0]] for k in range(sizes[1][0]))

    whole = bool(counted.all())
    total = fold_up(score if whole else np.where(counted, score, 0.0))
    n = float(sizes[0][0] * sizes[1][0]) if whole and all(len(x) == 1 for x in sizes) else fold_up(counted.astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        out[np.ix_(*some)] = np.where(n > 0, total if fold == "sum" else total / n, np.nan)
    return out


# -- tiers as text ---------------------------------------------------------------------------
def tier_names(paths: DataFrame, levels: list[str]) -> DataFrame:
    """`term` and, per level, its distinct names in order, each after ' | '."""
    joined = lambda c: F.concat_ws("", F.transform(F.array_sort(F.collect_set(F.col(c).cast("string"))), lambda x: F.concat(F.lit(" | "), x)))
    return paths.groupBy("term").agg(*[joined(c).alias(c) for c in levels])


def drugs_of_reactions(pairs: DataFrame) -> DataFrame:
    """`reaction` and its drugs in order, each after ' | '."""
    named = F.transform(F.array_sort(F.collect_set(F.col("drug").cast("string"))), lambda x: F.concat(F.lit(" | "), x))
    return pairs.groupBy("reaction").agg(F.concat_ws("", named).alias("drugs"))


def tiers_of_reactions(pairs: DataFrame, paths: DataFrame, levels: list[str]) -> DataFrame:
    """Tier names of all drugs of a reaction, as text."""
    rows = pairs.select("reaction", F.col("drug").alias("term")).distinct().join(paths, "term")
    return tier_names(rows.select(F.col("reaction").alias("term"), *levels), levels).withColumnRenamed("term", "reaction")
