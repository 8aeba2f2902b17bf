"""Neighbours of a term, all pairs in blocks, and properties of similarity tables.

Terms are rows `term`, `v array<double>`. All-pairs work is cut into pairs of blocks: a term is
sent once to every block pair that it takes part in, and each pair of blocks is compared as
matrices in one task. What a query needs of the pairs (the best k, extremes) is reduced there,
so the quadratic table itself is only ever made when it is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.vectors import METRICS, MINKOWSKI_P, euclidean, normalise
from vigilark.operators.hierarchy import Paths, path_matrix
from vigilark.sources.tables import settle

#: Terms of a block: two blocks and their matrix of similarities fit easily in a task.
BLOCK = 2048
#: Terms of a block where what is kept of a pair of blocks is made in strips, never as a whole matrix, and blocks aimed at before
#: blocks grow; fewer blocks send a term, and its best neighbours, fewer times.
WIDE, SPREAD = 32768, 8
#: Cells of a matrix that are made at once, few enough for a processor's cache.
CELLS = 1 << 16
#: Pairs that are given out at once.
ROWS = 1 << 19
#: Metrics of changed vectors (see `prepare`).
CHANGED = ("seuclidean", "mahalanobis")


def dimension_moments(terms: DataFrame) -> DataFrame:
    """`dim`, `mean`, `variance` (population) of every dimension."""
    cells = terms.select(F.posexplode("v").alias("dim", "x"))
    return cells.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def rescale_variance(terms: DataFrame) -> DataFrame:
    """Vectors over their dimensions' standard deviations: euclidean of these is seuclidean."""
    row = dimension_moments(terms).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "variance"))), lambda s: F.sqrt(s["variance"])).alias("scale")
    )  # one row, as long as a vector
    scaled = F.zip_with("v", "scale", lambda x, s: F.try_divide(x, s))
    return terms.join(F.broadcast(row)).withColumn("v", scaled).drop("scale")


def covariance(terms: DataFrame) -> np.ndarray:
    """Sample covariance of the dimensions; sums of products are made in the tasks."""

    def sums(batches):
        total = None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                x = np.c_[x, np.ones(len(x))]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    parts = terms.select("v").mapInArrow(sums, "g array<double>")
    # element-wise sum over the tasks' matrices, position by position
    cells = parts.select(F.posexplode("g").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    width = int(len(cells) ** 0.5)
    g = np.array([c["x"] for c in cells]).reshape(width, width)
    n, mean = g[-1, -1], g[-1, :-1] / g[-1, -1]
    return (g[:-1, :-1] - n * np.outer(mean, mean)) / (n - 1)


def whiten(terms: DataFrame) -> DataFrame:
    """Vectors times a root of the inverse covariance: euclidean of these is mahalanobis."""
    value, vector = np.linalg.eigh(np.linalg.pinv(covariance(terms), hermitian=True))
    root = vector * np.sqrt(np.maximum(value, 0))
    columns = [F.array(*[F.lit(float(x)) for x in root[:, k]]) for k in range(root.shape[1])]
    image = F.array(*columns)
    dot = lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return terms.withColumn("v", F.transform(image, dot))


def prepare(terms: DataFrame, metric: str) -> DataFrame:
    """Terms changed so that the metric is a function of two vectors alone."""
    return rescale_variance(terms) if metric == "seuclidean" else whiten(terms) if metric == "mahalanobis" else terms


def similarities_to(terms: DataFrame, query, metrics: list[str]) -> DataFrame:
    """`term`, `metric`, `sim` of one query term with every other; null where there is no value.

    Metrics of the vectors as they are share one pass over the terms; those that change the vectors
    first (by variance or covariance) take one each.
    """
    plain = [m for m in metrics if m in METRICS]
    out = None
    for group in [plain] * bool(plain) + [[m] for m in metrics if m not in METRICS]:
        rows = prepare(terms, group[0])
        one = rows.filter(F.col("term") == query).select(F.col("v").alias("q"))  # one row
        both = rows.filter(F.col("term") != query).join(F.broadcast(one))
        sims = F.array(*[F.struct(F.lit(m).alias("metric"), METRICS.get(m, euclidean)(F.col("q"), F.col("v")).alias("sim")) for m in group])
        part = both.select("term", F.explode(sims).alias("s")).select("term", "s.metric", F.when(~F.isnan("s.sim"), F.col("s.sim")).alias("sim"))
        out = part if out is None else out.unionByName(part)
    return out


def top_neighbours(sims: DataFrame, k: int = 25) -> DataFrame:
    """The best `k` of each metric with `rank`; ties go by term."""
    best = Window.partitionBy("metric").orderBy(F.desc_nulls_last("sim"), "term")
    return sims.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


# -- all pairs -------------------------------------------------------------------------------
def load(column: pa.ChunkedArray) -> np.ndarray | Paths:
    """The `v` of a block's terms: a matrix of vectors, or the paths of a hierarchy."""
    if pa.types.is_struct(column.type.value_type):
        return Paths.load(column.to_pylist())
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten()
    if len(lists) and not lists.null_count and not values.null_count and len(pc.unique(pc.list_value_length(lists))) == 1:
        return values.to_numpy().astype(float).reshape(len(lists), -1)
    return np.array(column.to_pylist(), float)


def pair_matrix(metric: str, a: np.ndarray | Paths, b: np.ndarray | Paths) -> np.ndarray:
    """Similarities of all rows of `a` with all of `b`; NaN where there is no value."""
    if isinstance(a, Paths):
        return path_matrix(metric, a, b)
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    if metric == "dot":
        return a @ b.T
    if metric in ("euclidean", "sqeuclidean", "seuclidean", "mahalanobis"):
        d = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)
        return -d if metric == "sqeuclidean" else -np.sqrt(d)
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, len(b)))
    across = np.ascontiguousarray(b.T)
    for k in range(0, len(a), step):
        out[k : k + step] = -_by_dimension(metric, a[k : k + step], across)
    return out


def _by_dimension(metric: str, a: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Distances of some rows to all, added up a dimension at a time, so that what is worked on stays in the cache."""
    out = np.zeros((len(a), across.shape[1]))
    below = np.zeros_like(out) if metric == "braycurtis" else None
    d, other = np.empty_like(out), np.empty_like(out)
    for x, y in zip(a.T, across, strict=True):
        np.abs(np.subtract(x[:, None], y[None, :], out=d), out=d)
        if metric == "chebyshev":
            np.maximum(out, d, out=out)
            continue
        if metric == "minkowski":
            np.power(d, MINKOWSKI_P, out=d)
        elif metric == "braycurtis":
            below += np.abs(np.add(x[:, None], y[None, :], out=other), out=other)
        elif metric == "canberra":
            with np.errstate(divide="ignore", invalid="ignore"):
                np.divide(d, np.add(np.abs(x)[:, None], np.abs(y)[None, :], out=other), out=d)
            np.nan_to_num(d, copy=False)
        out += d
    if metric == "braycurtis":
        with np.errstate(divide="ignore", invalid="ignore"):
            return out / below
    return out ** (1 / MINKOWSKI_P) if metric == "minkowski" else out


def _block_pairs(terms: DataFrame, wide: bool = False, size: int | None = None) -> DataFrame:
    """Every term once for each pair of blocks (`p` <= `q`) that it takes part in, with its other columns; with `wide` ones there are SPREAD
    blocks of up to WIDE terms where there would be more of `size` terms, BLOCK by default."""
    count = terms.count()
    n = max(1, -(-count // (size or BLOCK)))
    if wide:
        n = min(n, max(SPREAD, -(-count // WIDE)))
    own = F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = [c for c in terms.columns if c not in ("term", "v")]
    rows = terms.select("term", "v", *kept, own.alias("own"), other.alias("other"))
    return rows.select("term", "v", *kept, "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))


def block_of(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, bool]:
    """The terms of a block pair in order, the rows of each of the two blocks, and whether these are the same one."""
    p, q = (x.as_py() for x in key)
    table = pa.Table.from_batches(list(batches))
    table = table.take(pa.array(np.argsort(table.column("term").to_numpy(zero_copy_only=False), kind="stable")))
    own = table.column("own").to_numpy()
    return table, np.flatnonzero(own == p), np.flatnonzero(own == q), p == q


def strips(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of BLOCK rows of each block, so that a wide block pair is never a whole matrix: each pair of rows of one block once,
    with those of the strips that meet themselves told apart."""
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            yield a[i : i + BLOCK], b[j : j + BLOCK], same and i == j


def _in_blocks(terms: DataFrame, metric: str, reduce_, schema: str) -> DataFrame:
    """The tables that `reduce_(names_a, names_b, sims, same)` yields for every strip of every block pair, as rows of `schema`."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, a, b, same = block_of(key, batches)
        names, v = table.column("term").to_numpy(zero_copy_only=False), load(table.column("v"))
        for x, y, itself in strips(a, b, same):
            for found in reduce_(names[x], names[y], pair_matrix(metric, v[x], v[y]), itself):
                yield from found.to_batches()

    return _block_pairs(prepare(terms, metric), wide=True).groupBy("p", "q").applyInArrow(run, schema)


def all_pairs(terms: DataFrame, metric: str) -> DataFrame:
    """`i`, `j`, `sim` for every unordered pair once (i < j)."""
    kind = dict(terms.dtypes)["term"]

    def cells(a, b, s, same):
        step = max(1, ROWS // max(1, len(b)))
        for k in range(0, len(a), step):
            part = s[k : k + step]
            i, j = (x.ravel() for x in np.indices(part.shape)) if not same else np.nonzero(np.arange(len(b))[None, :] > np.arange(k, k + len(part))[:, None])
            x, y = a[i + k], b[j]
            flip = x > y
            yield pa.table({"i": np.where(flip, y, x), "j": np.where(flip, x, y), "sim": part[i, j]})

    out = _in_blocks(terms, metric, cells, f"i {kind}, j {kind}, sim double")
    return out.withColumn("sim", F.when(F.isnan("sim"), None).otherwise(F.col("sim")))


def _best_of(metric: str, a: np.ndarray | Paths, b: np.ndarray | Paths, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `a`, rows of `b` and similarities: the best k of every row of `a`, equal ones by place in `b`; with `same`, not itself.

    Made in strips of BLOCK rows and columns. What a row has kept is the least that the next strip has to reach, so that
    few cells are looked at twice.
    """
    rows, places, sims = [], [], []
    for i in range(0, len(a), BLOCK):
        part = a[np.arange(i, min(i + BLOCK, len(a)))]
        place, sim = np.full((len(part), k), len(b)), np.full((len(part), k), -np.inf)
        for j in range(0, len(b), BLOCK):
            s = pair_matrix(metric, part, b[np.arange(j, min(j + BLOCK, len(b)))])
            if same and i == j:
                np.fill_diagonal(s, -np.inf)
            # NaN is no value; of values as great as the last kept one, that one stands before
            x, y = np.nonzero(s > sim[:, -1:])
            if not len(x):
                continue
            most = np.bincount(x, minlength=len(part))
            if most.max() > k:  # not more than k of a row can stay: those up to its k-th value
                floor = np.full(len(part), -np.inf)
                many = np.flatnonzero(most > k)
                known = np.where(np.isnan(s[many]), -np.inf, s[many])
                floor[many] = np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k]
                kept = s[x, y] >= floor[x]
                x, y = x[kept], y[kept]
            held = np.flatnonzero(np.isfinite(sim).any(1) & (most > 0))
            old = np.isfinite(sim[held])
            all_x = np.r_[np.repeat(held, old.sum(1)), x]
            all_y, all_s = np.r_[place[held][old], y + j], np.r_[sim[held][old], s[x, y]]
            order = np.lexsort((all_y, -all_s, all_x))
            all_x, all_y, all_s = all_x[order], all_y[order], all_s[order]
            at = np.arange(len(all_x)) - np.searchsorted(all_x, all_x)
            fit = at < k
            place[all_x[fit], at[fit]], sim[all_x[fit], at[fit]] = all_y[fit], all_s[fit]
        x, at = np.nonzero(sim > -np.inf)
        rows.append(x + i)
        places.append(place[x, at])
        sims.append(sim[x, at])
    return tuple(np.concatenate(c) if c else np.zeros(0, int) for c in (rows, places, sims))


def all_top_neighbours(terms: DataFrame, metric: str, k: int = 25) -> DataFrame:
    """`term`, `rank`, `neighbour`, `sim`: the best k of every term, reduced block by block."""
    kind = dict(terms.dtypes)["term"]

    def run(key, table):
        p, q = (x.as_py() for x in key)
        order = np.argsort(table.column("term").to_numpy(zero_copy_only=False), kind="stable")  # of equals the first by name
        table = table.take(pa.array(order))
        names, own = table.column("term").to_numpy(zero_copy_only=False), table.column("own").to_numpy()
        v = load(table.column("v"))
        a, b = np.flatnonzero(own == p), np.flatnonzero(own == q)
        parts = []
        for x, y in [(a, b)] + ([] if p == q else [(b, a)]):
            if len(x) and len(y) and k > 0:
                i, j, sim = _best_of(metric, v[x], v[y], k, p == q)
                parts.append(pa.table({"term": names[x][i], "neighbour": names[y][j], "sim": sim}))
        empty = pa.table({"term": names[:0], "neighbour": names[:0], "sim": np.zeros(0)})
        return pa.concat_tables(parts) if parts else empty

    rows = _block_pairs(prepare(terms, metric), wide=True).groupBy("p", "q").applyInArrow(run, f"term {kind}, neighbour {kind}, sim double")
    order = Window.partitionBy("term").orderBy(F.desc("sim"), "neighbour")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pair_properties(terms: DataFrame, metric: str) -> DataFrame:
    """One row: `n`, `min`, `max`, `mean`, `normed_mean` over all pairs, each summed in its block."""
    return properties_of(terms, [metric]).drop("metric")


def properties_of(terms: DataFrame, metrics: list[str]) -> DataFrame:
    """The same of each `metric`: metrics of the vectors as they are share one pass.

    Terms with equal vectors (or paths) are one node with a weight: a pair of nodes counts as often as there are pairs of their
    terms, and a node is compared with itself if it has more than one.
    """
    plain = [m for m in metrics if m not in CHANGED]
    out = None
    for group in [plain] * bool(plain) + [[m] for m in metrics if m in CHANGED]:
        sums = _property_sums(prepare(terms, group[0]), group)
        out = sums if out is None else out.unionByName(sums)
    one = out.groupBy("metric").agg(F.sum("n").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("total").alias("total"))
    known = out.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    one = known.join(one, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("n"), "min", "max", F.try_divide("total", "n").alias("mean"))
    return one.withColumn("normed_mean", F.try_divide(F.col("mean") - F.col("min"), F.col("max") - F.col("min")))


def _property_sums(terms: DataFrame, metrics: list[str]) -> DataFrame:
    """`metric`, `n`, `low`, `high`, `total` of each block pair of nodes."""
    nodes = settle(terms.groupBy("v").agg(F.min("term").alias("term"), F.count("*").alias("weight")), columnar=True)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, a, b, same = block_of(key, batches)
        v, weight = load(table.column("v")), table.column("weight").to_numpy()
        found = {m: [0, None, None, 0.0] for m in metrics}
        for x, y, itself in strips(a, b, same):
            left, right = v[x], v[y]
            for m in metrics:
                s = pair_matrix(m, left, right)
                counted = np.isfinite(s)
                if itself:
                    counted &= np.tri(len(x), k=0, dtype=bool).T
                    counted[np.arange(len(x)), np.arange(len(x))] &= weight[x] > 1
                if not counted.any():
                    continue
                one = found[m]
                one[1] = min(float(s.min(where=counted, initial=np.inf)), np.inf if one[1] is None else one[1])
                one[2] = max(float(s.max(where=counted, initial=-np.inf)), -np.inf if one[2] is None else one[2])
                s = np.where(counted, s, 0.0)
                one[0] += int(weight[x] @ (counted @ weight[y]))
                one[3] += float(weight[x] @ (s @ weight[y].astype(float)))
                if itself:  # n * n pairs of a node's own terms were counted for n * (n - 1) / 2
                    own = np.diag(counted)
                    over = weight[x] * (weight[x] + 1) // 2
                    one[0] -= int(over[own].sum())
                    one[3] -= float((np.diag(s) * over)[own].sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found)), *(pa.array([one[k] for one in found.values()], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64())))],
            names=["metric", "n", "low", "high", "total"],
        )

    return _block_pairs(nodes, wide=True).groupBy("p", "q").applyInArrow(run, "metric string, n bigint, low double, high double, total double")


def to_distance(sims: DataFrame, group: list[str]) -> DataFrame:
    """`dist`: 1 - sim for cosine, else the group's largest similarity less this one."""
    top = F.max("sim").over(Window.partitionBy(*group, "metric"))
    return sims.withColumn("dist", F.when(F.col("metric") == "cosine", 1 - F.col("sim")).otherwise(top - F.col("sim")))


def unit_vectors(terms: DataFrame) -> DataFrame:
    return terms.withColumn("v", normalise(F.col("v")))
