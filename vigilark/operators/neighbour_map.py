"""A map of term vectors in two dimensions that keeps neighbours together (stochastic neighbour embedding).

Affinities are sparse: of every term to its nearest neighbours, with a width that gives its row the
wanted perplexity. In the rounds neighbours attract each other along these links; all others repel, summed
up by cells of a grid, of which there are at most CELLS * CELLS whatever the number of terms. Maps of up to
MOST_LINKS links make all rounds in one task, where the repulsion is that of all pairs of terms, summed up over the points of a
grid by Fourier transforms if there are more than FEW terms; a round of a larger map is some Spark jobs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.operators.clustering import projection
from vigilark.operators.similarity import all_top_neighbours, prepare
from vigilark.sources.tables import release, settle

#: Neighbours for each unit of perplexity, cells on a side of the grid, and point-cell pairs made at once.
NEIGHBOURS, CELLS, AT_ONCE = 3, 64, 4_000_000
#: Links up to which one task makes all rounds, those that it takes at once, and terms up to which it makes all pairs.
MOST_LINKS, LINKS, FEW = 1 << 23, 1 << 20, 8192
#: Pairs of places that are made at once, few enough for a processor's cache.
CACHED = 1 << 15
#: Points of the grid in a box, on a side; boxes to a unit of the map, and the least and most on a side of it.
POINTS, FINE, LEAST_BOXES, MOST_BOXES = 3, 2, 50, 256
#: Early rounds in which attraction counts this many times, and the momentum then and later.
EARLY, MORE, MOMENTUM = 0.25, 12.0, (0.5, 0.8)
#: Spread of the places at the start, and of a component's own rate: what it grows by while the gradient keeps
#: its way, what it shrinks to where it turns, and the least.
SPREAD, GAIN, LOSS, LEAST_GAIN = 1e-4, 0.2, 0.8, 0.01


def row_affinities(square: np.ndarray, known: np.ndarray, perplexity: float) -> np.ndarray:
    """For each row of squared distances weights that add up to 1 and have the entropy ln(perplexity), by bisection.

    `known` marks the cells that count. A row with fewer cells than the perplexity gets even weights.
    """
    low, high = np.full(len(square), -40.0), np.full(len(square), 40.0)  # logarithms of the inverse width
    least = np.where(known, square, np.inf).min(1, initial=np.inf)
    d = np.where(known, square - np.where(np.isfinite(least), least, 0)[:, None], 0.0)

    def weights(log_beta: np.ndarray) -> np.ndarray:
        w = np.where(known, np.exp(-np.minimum(d * np.exp(log_beta)[:, None], 700)), 0.0)
        return w / np.maximum(w.sum(1, keepdims=True), 1e-300)

    for _ in range(80):
        middle = (low + high) / 2
        w = weights(middle)
        wide = -(w * np.log(np.maximum(w, 1e-300))).sum(1) > math.log(perplexity)
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    return weights((low + high) / 2)


def affinities(terms: DataFrame, perplexity: float = 30.0, metric: str = "euclidean") -> DataFrame:
    """`term`, `neighbour`, `p`: weights of every term over its 3 * perplexity nearest neighbours, which add up to 1.

    A row has the wanted perplexity, or even weights if there are no more neighbours than that. A single term has no row.
    """
    k = int(NEIGHBOURS * perplexity)
    near = all_top_neighbours(prepare(terms, metric), "euclidean" if metric in ("seuclidean", "mahalanobis") else metric, k)
    kind = dict(near.dtypes)["term"]
    lists = near.groupBy("term").agg(F.collect_list(F.struct("neighbour", "sim")).alias("near"))  # at most k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1).flatten()
            sizes = batch.column(1).value_lengths().to_numpy()
            square, known = np.zeros((len(batch), int(sizes.max(initial=0)))), np.arange(int(sizes.max(initial=0)))[None, :] < sizes[:, None]
            square[known] = cells.field("sim").to_numpy() ** 2
            p = row_affinities(square, known, perplexity)
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), sizes)))
            yield pa.RecordBatch.from_arrays([rows, cells.field("neighbour"), pa.array(p[known])], names=["term", "neighbour", "p"])

    return lists.mapInArrow(run, f"term {kind}, neighbour {kind}, p double")


def joint(rows: DataFrame) -> DataFrame:
    """`i`, `j`, `p` of both directions: the mean of both rows' weights over the number of terms, adding up to 1."""
    n = rows.select("term").distinct().agg(F.count("*").alias("n"))  # one row
    both = rows.select(F.col("term").alias("i"), F.col("neighbour").alias("j"), "p").unionByName(rows.select(F.col("neighbour").alias("i"), F.col("term").alias("j"), "p"))
    summed = both.groupBy("i", "j").agg(F.sum("p").alias("p")).join(F.broadcast(n))
    return summed.select("i", "j", (F.col("p") / (2 * F.col("n"))).alias("p"))


def _repelled(places: DataFrame, kind: str) -> DataFrame:
    """`term`, `fx`, `fy`, `z`: the pull away from all others and the sum of their weights, by cells of a grid."""
    box = places.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    side = {c: max((box[f"high_{c}"] - box[f"low_{c}"]) / CELLS, 1e-9) for c in "xy"}
    cell = {c: F.least(F.floor((F.col(c) - box[f"low_{c}"]) / side[c]), F.lit(CELLS - 1)).cast("int") for c in "xy"}
    sums = places.groupBy(cell["x"].alias("a"), cell["y"].alias("b")).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    held = sums.orderBy("a", "b").toPandas()  # at most CELLS * CELLS rows
    n, sx, sy = (held[c].to_numpy(float) for c in ("n", "x", "y"))
    at = {(a, b): k for k, (a, b) in enumerate(zip(held["a"], held["b"], strict=True))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, AT_ONCE // max(1, len(n)))
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                x, y = part.column("x").to_numpy(), part.column("y").to_numpy()
                own = np.array([at[a, b] for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)], np.int64)
                rows = np.arange(len(x))
                count = np.broadcast_to(n, (len(x), len(n))).copy()
                count[rows, own] -= 1  # a term does not repel itself
                cx, cy = (np.broadcast_to(s / n, count.shape).copy() for s in (sx, sy))
                for c, s, z in ((cx, sx, x), (cy, sy, y)):
                    c[rows, own] = (s[own] - z) / np.maximum(count[rows, own], 1)
                dx, dy = x[:, None] - cx, y[:, None] - cy
                q = 1 / (1 + dx**2 + dy**2)
                pull = count * q * q
                yield pa.RecordBatch.from_arrays([part.column("term"), *(pa.array(v) for v in ((pull * dx).sum(1), (pull * dy).sum(1), (count * q).sum(1)))], names=["term", "fx", "fy", "z"])

    return places.select("term", "x", "y", cell["x"].alias("a"), cell["y"].alias("b")).mapInArrow(run, f"term {kind}, fx double, fy double, z double")


def _between_all(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pull of every place away from all others, and the sum of its weights, pair by pair."""
    pull, z = np.empty_like(y), np.empty(len(y))
    x, v = (np.ascontiguousarray(c) for c in y.T)
    step = max(1, CACHED // max(1, len(y)))
    for k in range(0, len(y), step):
        part = slice(k, k + step)
        q = np.subtract.outer(x[part], x) ** 2
        q += np.subtract.outer(v[part], v) ** 2
        q += 1
        np.divide(1, q, out=q)
        z[part] = q.sum(1) - 1  # a place does not repel itself
        q *= q
        pull[part] = y[part] * q.sum(1)[:, None] - q @ y
    return pull, z


def _between_points(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `_between_all`, through a grid: places are dealt to the points of their box by Lagrange's polynomials, what the points
    do to each other is a convolution, and its values at the places are read off by the same polynomials."""
    low = y.min(0)
    width = max(float((y.max(0) - low).max()), 1e-12)
    boxes = int(min(max(LEAST_BOXES, math.ceil(width * FINE)), MOST_BOXES))
    side, m = width / boxes, boxes * POINTS
    box = np.minimum((y - low) / side, boxes - 1).astype(np.int64)
    t = (y - low) / side - box  # place in the box, from 0 to 1
    knots = (np.arange(POINTS) + 0.5) / POINTS
    weights = np.ones((POINTS, *t.shape))
    for a in range(POINTS):
        for b in range(POINTS):
            if a != b:
                weights[a] *= (t - knots[b]) / (knots[a] - knots[b])
    centred = y - y.mean(0)
    charges = (np.ones(len(y)), centred[:, 0], centred[:, 1])
    cells = [(weights[a, :, 0] * weights[b, :, 1], (box[:, 0] * POINTS + a) * m + box[:, 1] * POINTS + b) for a in range(POINTS) for b in range(POINTS)]
    held = np.zeros((3, m * m))
    for w, at in cells:
        for k, c in enumerate(charges):
            held[k] += np.bincount(at, w * c, m * m)
    apart = np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m)) * (side / POINTS)
    q = 1 / (1 + apart[:, None] ** 2 + apart[None] ** 2)
    spread = [np.fft.rfft2(h.reshape(m, m), (2 * m, 2 * m)) for h in held]
    near, square = np.fft.rfft2(q), np.fft.rfft2(q * q)
    fields = [np.fft.irfft2(f * kernel, (2 * m, 2 * m))[:m, :m].ravel() for f, kernel in ((spread[0], near), *((f, square) for f in spread))]
    z, one, x, v = (sum(w * field[at] for w, at in cells) for field in fields)
    return np.stack([centred[:, 0] * one - x, centred[:, 1] * one - v], 1), z - 1.0


def _attracted(y: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The pull of every place along its links; `i` is in order."""
    out = np.zeros_like(y)
    for k in range(0, len(i), LINKS):
        a, d = i[k : k + LINKS], y[i[k : k + LINKS]] - y[j[k : k + LINKS]]
        w = p[k : k + LINKS] / (1 + (d**2).sum(1))
        for c in (0, 1):
            out[:, c] += np.bincount(a, w * d[:, c], len(y))
    return out


def _rounds_in_task(y: np.ndarray, speed: np.ndarray, gain: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray], steps: range, early: int, rate: float) -> float:
    """The rounds `steps`, written into places, speeds and gains (n x 2); the divergence after the last."""
    away = _between_all if len(y) <= FEW else _between_points
    for step in steps:
        pull, z = away(y)
        more, keep = (MORE, MOMENTUM[0]) if step <= early else (1.0, MOMENTUM[1])
        grad = 4 * (more * _attracted(y, *links) - pull / (z.sum() or 1.0))
        gain[:] = np.maximum(np.where(speed * grad < 0, gain + GAIN, gain * LOSS), LEAST_GAIN)
        speed[:] = keep * speed - rate * gain * grad
        y += speed
    i, j, p = links
    z, loss = float(away(y)[1].sum()) or 1.0, 0.0
    for k in range(0, len(i), LINKS):
        d, w = y[i[k : k + LINKS]] - y[j[k : k + LINKS]], p[k : k + LINKS]
        loss += float((w[w > 0] * (np.log(w[w > 0]) + np.log1p((d[w > 0] ** 2).sum(1)) + math.log(z))).sum())
    return loss


def map_rounds(terms: DataFrame, perplexity: float = 30.0, rounds: int = 3000, every: int = 50, metric: str = "euclidean", rate: float | None = None) -> Iterator[tuple[int, DataFrame, float]]:
    """(round, places `term`, `x`, `y`, divergence) every `every` rounds and after the last.

    The divergence is that of the joint affinities from those of the map. Places start from the first two principal
    components, scaled down; the rate grows with the number of terms unless it is given. Earlier places are deleted
    when later ones are made.
    """
    edges = settle(joint(settle(affinities(terms, perplexity, metric), columnar=True)), columnar=True)
    kind = dict(edges.dtypes)["i"]
    start = settle(projection(prepare(terms, metric), 2), columnar=True)
    wide = start.agg(F.stddev_pop(F.get("coords", 0)).alias("s")).first()["s"] or 1.0
    first = [(F.coalesce(F.get("coords", k), F.lit(0.0)) / wide * SPREAD).alias(c) for k, c in enumerate("xy")]
    places = settle(start.select("term", *first, *[F.lit(0.0).alias(c) for c in "uv"], *[F.lit(1.0).alias(c) for c in "gh"]), columnar=True)
    rate = rate or max(places.count() / MORE / 4, 50.0)
    if edges.count() <= MOST_LINKS:
        yield from _small_map(edges, places, kind, rounds, every, rate)
        return
    for step in range(1, rounds + 1):
        early = step <= EARLY * rounds
        there = places.select(F.col("term").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
        here = places.select(F.col("term").alias("i"), "x", "y")
        linked = edges.join(there, "j").join(here, "i")
        dx, dy = F.col("x") - F.col("xj"), F.col("y") - F.col("yj")
        q = 1 / (1 + dx * dx + dy * dy)
        pulled = linked.groupBy(F.col("i").alias("term")).agg(F.sum(F.col("p") * q * dx).alias("ax"), F.sum(F.col("p") * q * dy).alias("ay"))
        away = settle(_repelled(places, kind), columnar=True)
        z = away.agg(F.sum("z").alias("z")).first()["z"] or 1.0
        more, keep = (MORE if early else 1.0), MOMENTUM[0 if early else 1]
        moved = places.join(away, "term").join(pulled, "term", "left")
        for c, s, g, a, f in (("x", "u", "g", "ax", "fx"), ("y", "v", "h", "ay", "fy")):
            grad = 4 * (more * F.coalesce(F.col(a), F.lit(0.0)) - F.col(f) / z)
            gain = F.greatest(F.when(F.col(s) * grad < 0, F.col(g) + GAIN).otherwise(F.col(g) * LOSS), F.lit(LEAST_GAIN))
            moved = moved.withColumn(g, gain).withColumn(s, keep * F.col(s) - rate * F.col(g) * grad).withColumn(c, F.col(c) + F.col(s))
        old, places = places, settle(moved.select("term", *"xyuvgh"), columnar=True)
        if step % every == 0 or step == rounds:
            z_now = _repelled(places, kind).agg(F.sum("z").alias("z")).first()["z"] or 1.0
            far = linked_places(edges, places)
            loss = far.agg(F.sum(F.col("p") * (F.log("p") - F.log(F.col("q") / z_now))).alias("d")).first()["d"]
            yield step, places.select("term", "x", "y"), float(loss or 0.0)
        release(old, away)


def _small_map(edges: DataFrame, places: DataFrame, kind: str, rounds: int, every: int, rate: float) -> Iterator[tuple[int, DataFrame, float]]:
    """What `map_rounds` gives, a job for the rounds between two of them; all links are a task's."""
    early = math.floor(EARLY * rounds)

    def between(first: int, last: int) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("term")
            terms = right.column("term").combine_chunks()
            at = [pc.index_in(left.column(c).combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ij"]
            order = np.lexsort(at[::-1])
            links = (at[0][order], at[1][order], left.column("p").to_numpy()[order])
            y, speed, gain = (np.stack([right.column(c).to_numpy() for c in pair], 1).copy() for pair in ("xy", "uv", "gh"))
            loss = _rounds_in_task(y, speed, gain, links, range(first, last + 1), early, rate)
            made = dict(zip("xyuvgh", np.concatenate([y, speed, gain], 1).T.copy(), strict=True))
            return pa.table({"term": terms, **made, "loss": np.full(len(y), loss)})

        sides = [rows.withColumn("_all", F.lit(0)).groupBy("_all") for rows in (edges, places)]
        doubles = ", ".join(f"{c} double" for c in (*"xyuvgh", "loss"))
        return settle(sides[0].cogroup(sides[1]).applyInArrow(run, f"term {kind}, {doubles}"), columnar=True)

    for first in range(1, rounds + 1, every):
        old, places = places, between(first, min(first + every - 1, rounds))
        row = places.select("loss").first()
        yield min(first + every - 1, rounds), places.select("term", "x", "y"), row["loss"] if row else 0.0
        release(old)


def linked_places(edges: DataFrame, places: DataFrame) -> DataFrame:
    """`p` and `q`, the map's weight before it is divided by the sum of all, of every link."""
    ends = edges
    for side in ("i", "j"):
        ends = ends.join(places.select(F.col("term").alias(side), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}")), side)
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    return ends.select("p", (1 / (1 + dx * dx + dy * dy)).alias("q"))
