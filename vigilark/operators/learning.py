"""Learning term vectors from pairs, and a classifier of pairs.

Vectors are rows of a table (`side`, `term`, `v`), never broadcast, so vocabularies may be of any
size. The negative-sampling model is trained in strata: terms of both sides are dealt to blocks,
and in one stratum every task owns one block of targets and one of contexts, so tasks never
write to the same vector. The contrastive model deals its batches to strata in the same way and takes a step a batch.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.optimisers import Optimiser
from vigilark.functions.random import uniform
from vigilark.operators.similarity import load
from vigilark.sources.tables import drop_bucketed, release, save_bucketed, settle, shared_folder

BATCH = 256
#: Samples of a block of targets and one of contexts that a task takes, on average at most.
CELL = 1 << 19
#: Vectors of a side that a task of the contrastive model holds, on average at most.
HELD = 1 << 17
#: Samples whose loss is made at once.
AT_ONCE = 1 << 16


def _start(seed: int, dim: int, *names: Column) -> Column:
    """Small pseudo-random numbers that depend on the names and the place."""
    draw = lambda d: F.pmod(F.xxhash64(F.lit(seed), *names, d), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (draw(d) - 0.5) / F.lit(float(dim) ** 0.5))


def initial_vectors(samples: DataFrame, dim: int, seed: int = 1) -> DataFrame:
    """`side`, `term` (text), `v` of all targets and contexts."""
    sides = [samples.select(F.lit(s).alias("side"), F.col(s).cast("string").alias("term")) for s in ("target", "context")]
    return sides[0].unionByName(sides[1]).distinct().withColumn("v", _start(seed, dim, F.col("side"), _own("term")))


def _with_state(params: DataFrame) -> DataFrame:
    """Vectors with the optimiser's state (empty before the first step) and their steps so far."""
    return params.withColumn("state", F.array().cast("array<double>")).withColumn("steps", F.lit(0).cast("bigint"))


_PARAMS = "side string, term string, v array<double>, state array<double>, steps bigint"


def _unpack(frame: pd.DataFrame, optimiser: Optimiser) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, state and steps of the rows of a frame."""
    v = np.array(frame["v"].tolist(), float)
    state, steps = optimiser.fresh(v.shape), frame["steps"].to_numpy(np.int64).copy()
    for k in np.flatnonzero(steps):
        state[k] = np.asarray(frame["state"].iloc[k], float).reshape(optimiser.slots, -1)
    return v, state, steps


def _pack(frame: pd.DataFrame, v: np.ndarray, state: np.ndarray, steps: np.ndarray) -> pd.DataFrame:
    kept = [s.ravel() if n else np.zeros(0) for s, n in zip(state, steps, strict=True)]
    return pd.DataFrame({"side": frame["side"], "term": frame["term"], "v": list(v), "state": kept, "steps": steps})


def pair_gradients(a: np.ndarray, c: np.ndarray, y: np.ndarray, shared: np.ndarray, norm: bool = False):
    """Summed logistic loss of pairs (rows of `a` and `c`) and its gradients for `a`, `c`, `shared`.

    `shared` holds the bias of targets, that of contexts, and weight and bias of the last unit,
    which is put on the product of the two biased vectors, or on their cosine if `norm`.
    """
    dim = a.shape[1]
    x, w = a + shared[:dim], c + shared[dim : 2 * dim]
    size_x, size_w = (np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if norm else 1.0 for m in (x, w))
    x, w = x / size_x, w / size_w
    dot = (x * w).sum(1)
    z = np.clip(dot * shared[-2] + shared[-1], -30, 30)
    loss = float(np.log1p(np.exp(np.where(y > 0, -z, z))).sum())
    err = 1 / (1 + np.exp(-z)) - y
    dx, dw = (err * shared[-2])[:, None] * w, (err * shared[-2])[:, None] * x
    if norm:
        dx, dw = (dx - x * (x * dx).sum(1, keepdims=True)) / size_x, (dw - w * (w * dw).sum(1, keepdims=True)) / size_w
    return loss, dx, dw, np.r_[dx.sum(0), dw.sum(0), (err * dot).sum(), err.sum()]


def _rows_of(params: pd.DataFrame, side: str, terms: pd.Series) -> np.ndarray:
    """The rows of `params` that hold the terms of a side."""
    own = np.flatnonzero((params["side"] == side).to_numpy())
    return own[pd.Index(params["term"].to_numpy()[own]).get_indexer(terms)]


def _in_turn(pairs: pd.DataFrame, seed: int) -> pd.DataFrame:
    """`pairs`, which come in no fixed order, sorted and then shuffled, so that a retried task repeats its steps."""
    target, context = (pd.factorize(pairs[c], sort=True)[0] for c in ("target", "context"))
    order = np.lexsort((pairs["label"].to_numpy(), context, target))
    return pairs.iloc[order[pd.Series(np.arange(len(pairs))).sample(frac=1, random_state=seed).to_numpy()]]


def _descend(pairs: pd.DataFrame, params: pd.DataFrame, head: pd.DataFrame, optimiser: Optimiser, norm: bool) -> pd.DataFrame:
    """Mini-batch steps over the pairs of one stratum's task; the shared row comes back last."""
    if not len(params):
        return head
    v, state, steps = _unpack(params, optimiser)
    shared, shared_state, shared_steps = _unpack(head, optimiser)
    i, j = (_rows_of(params, side, pairs[side]) for side in ("target", "context"))
    y = pairs["label"].to_numpy(float)
    for b in range(0, len(y), BATCH):
        a, c = i[b : b + BATCH], j[b : b + BATCH]
        _, ga, gc, gs = pair_gradients(v[a], v[c], y[b : b + BATCH], shared[0], norm)
        rows, at = np.unique(np.r_[a, c], return_inverse=True)
        g = np.zeros((len(rows), v.shape[1]))
        np.add.at(g, at, np.r_[ga, gc])
        steps[rows] += 1
        v[rows], state[rows] = optimiser.step(v[rows], g, state[rows], steps[rows])
        shared_steps += 1
        shared, shared_state = optimiser.step(shared, gs[None, :] / len(a), shared_state, shared_steps)
    return pd.concat([_pack(params, v, state, steps), _pack(head, shared, shared_state, shared_steps)])


#: Stands between a frequent term and the number of its copy.
COPY = "\0"


def _own(term: Column | str) -> Column:
    """The term that a copy stands for."""
    return F.substring_index(F.col(term) if isinstance(term, str) else term, COPY, 1)


def _block(term: str, blocks: int) -> Column:
    """Block of a term; its copies have one each, one behind the other."""
    copy = F.coalesce(F.get(F.split(F.col(term), COPY), 1).cast("int"), F.lit(0))
    return F.pmod(F.xxhash64(_own(term)) + copy, F.lit(blocks))


def with_copies(named: DataFrame, blocks: int, seed: int = 1) -> DataFrame:
    """`named` (`target`, `context`, `label`) with frequent terms dealt to copies.

    A term with more than a `blocks`-th of all rows, of which there are fewer than `blocks`, has as many copies as such
    shares, and each of its rows goes to one of them. So no block has many more rows than others.
    """
    total = named.agg(F.count("*").alias("_all"))  # one row
    for side in ("target", "context"):
        counts = named.groupBy(side).agg(F.count("*").alias("_n")).join(F.broadcast(total))
        often = counts.filter(F.col("_n") * blocks > F.col("_all")).select(side, F.ceil(F.col("_n") * blocks / F.col("_all")).cast("int").alias("_copies"))
        part = F.floor(F.rand(seed) * F.col("_copies")).cast("int")
        name = F.when(F.col("_copies").isNotNull(), F.concat(side, F.lit(COPY), part.cast("string"))).otherwise(F.col(side))
        named = named.join(F.broadcast(often), side, "left").withColumn(side, name).drop("_copies")
    return named.select("target", "context", "label")


def merge_copies(params: DataFrame) -> DataFrame:
    """`params` whose copies of one term have the means of their vectors and states; fewer than twice the blocks are such terms."""
    copies = params.filter(F.col("term").contains(COPY)).withColumn("own", _own("term"))
    out = copies.groupBy("side", "own").agg(F.max("steps").alias("_steps"))
    for c, rows in (("v", copies), ("state", copies.filter("steps > 0"))):
        cells = rows.select("side", "own", F.posexplode(c).alias("at", "x")).groupBy("side", "own", "at").agg(F.avg("x").alias("x"))
        one = cells.groupBy("side", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(f"_{c}"))
        out = out.join(one, ["side", "own"], "left")
    joined = params.withColumn("own", F.when(F.col("term").contains(COPY), _own("term"))).join(F.broadcast(out), ["side", "own"], "left")
    return joined.select("side", "term", F.coalesce("_v", "v").alias("v"), F.coalesce("_state", "state").alias("state"), F.coalesce("_steps", "steps").alias("steps"))


def nsg_rounds(
    samples: DataFrame | Callable[[int], DataFrame],
    dim: int = 200,
    epochs: int = 30,
    rate: float = 0.1,
    blocks: int = 8,
    seed: int = 1,
    optimiser: Optimiser | None = None,
    norm: bool = False,
    epochs_per_out: int = 1,
    losses: bool = True,
) -> Iterator[tuple[int, DataFrame, float | None]]:
    """(epoch, vectors, mean loss of the epoch's samples) after the first epoch, every `epochs_per_out`
    epochs and the last. Without `losses` none is made.

    `samples` holds `target`, `context` and `label` 1 (a pair) or 0 (a negative); given as a function
    of the epoch, the corpus is drawn anew for each output. Vectors are rows `side`, `term`, `v`;
    the row of side 'shared' holds the biases of the two sides and weight and bias of the last unit,
    whose values the tasks of a stratum average. Without an optimiser it is plain descent with `rate`.
    There are at least `blocks` blocks, and so many that a task has CELL samples on average at most.
    Frequent terms are trained as copies, which are averaged after every epoch (see `with_copies`). Terms that a
    later corpus brings in start anew; tables that are no longer needed are deleted.
    """
    opt = optimiser or Optimiser("sgd", rate)
    least = blocks
    block = lambda c: _block(c, blocks)
    shared = np.r_[np.zeros(2 * dim), 1.0, 0.0]
    head = pd.DataFrame({"side": ["shared"], "term": [""], "v": [shared], "state": [np.zeros(0)], "steps": [0]})
    dealt = params = None
    for epoch in range(1, epochs + 1):
        if dealt is None or (callable(samples) and (epoch - 2) % epochs_per_out == 0):
            drawn = samples(epoch) if callable(samples) else samples
            named = drawn.select(F.col("target").cast("string").alias("target"), F.col("context").cast("string").alias("context"), "label")
            named = settle(named, columnar=True)
            blocks = max(least, math.ceil((named.count() / CELL) ** 0.5))
            keyed = with_copies(named, blocks, seed).select("*", block("target").alias("key"), F.pmod(block("context") - block("target"), F.lit(blocks)).alias("stratum"))
            old, dealt = dealt, settle(keyed, columnar=True, parts=["stratum"])
            release(named)
            fresh = _with_state(initial_vectors(dealt, dim, seed))
            if params is None:
                params = settle(fresh, columnar=True)
            else:  # copies of a term are alike here, so one of them is what is known of it
                known = params
                one = known.withColumn("own", _own("term")).dropDuplicates(["side", "own"]).select("side", "own", *[F.col(c).alias(f"_{c}") for c in ("v", "state", "steps")])
                asked = fresh.withColumn("own", _own("term")).join(one, ["side", "own"], "left")
                new = asked.select("side", "term", *[F.coalesce(f"_{c}", c).alias(c) for c in ("v", "state", "steps")])
                kept = known.withColumn("own", _own("term")).join(asked.select("side", "own").distinct(), ["side", "own"], "left_anti")
                params = settle(new.unionByName(kept.select(*new.columns)), columnar=True)
                release(old, known)
            often = not dealt.filter(F.col("target").contains(COPY) | F.col("context").contains(COPY)).isEmpty()
        for s in range(blocks):
            home = F.when(F.col("side") == "target", block("term")).otherwise(F.pmod(block("term") - s, F.lit(blocks)))
            keyed = params.select(home.alias("key"), "side", "term", "v", "state", "steps")
            pairs = dealt.filter(F.col("stratum") == s)
            now, order = head, seed + epoch

            def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                return _descend(_in_turn(left, order), right, now.assign(term=str(key[0])), opt, norm)

            moved = settle(pairs.groupBy("key").cogroup(keyed.groupBy("key")).applyInPandas(run, _PARAMS), columnar=True)
            old, params = params, moved.filter("side <> 'shared'")
            params._settled_at = moved._settled_at
            release(old)
            found = moved.filter("side = 'shared'").toPandas()  # one row a block
            found = found[found["steps"] > head["steps"].iloc[0]].sort_values("term")
            if len(found):
                mean = lambda c: np.mean(found[c].tolist(), axis=0)
                head = head.assign(v=[mean("v")], state=[mean("state")], steps=[int(found["steps"].max())])
        if often:
            old, params = params, settle(merge_copies(params), columnar=True)
            release(old)
        if epoch in (1, epochs) or epoch % epochs_per_out == 0:
            row = dealt.sparkSession.createDataFrame([("shared", "", [float(x) for x in head["v"].iloc[0]])], "side string, term string, v array<double>")
            one = params.withColumn("term", _own("term")).dropDuplicates(["side", "term"]) if often else params
            vectors = settle(one.select("side", "term", "v").unionByName(row), columnar=True)
            yield epoch, vectors, _mean_loss(dealt, params, head["v"].iloc[0], blocks, norm) if losses else None


def _mean_loss(dealt: DataFrame, params: DataFrame, shared: np.ndarray, blocks: int, norm: bool) -> float | None:
    """As `nsg_loss`, where the samples' cells meet their vectors; a vector is sent once for each block of the other side."""
    at = _block("term", blocks)
    homes = params.select("side", "term", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("stratum"))
    homes = homes.withColumn("key", F.when(F.col("side") == "target", at).otherwise(F.pmod(at - F.col("stratum"), F.lit(blocks))))
    dim = len(shared) // 2 - 1

    def run(pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        total, n = 0.0, 0
        for k in range(0, len(pairs), AT_ONCE):
            part = pairs.iloc[k : k + AT_ONCE]
            u, w = (np.array(own["v"].iloc[_rows_of(own, side, part[side])].tolist(), float) + bias for side, bias in (("target", shared[:dim]), ("context", shared[dim : 2 * dim])))
            z = (u * w).sum(1)
            if norm:
                size = np.sqrt((u * u).sum(1) * (w * w).sum(1))
                z = np.divide(z, size, out=np.full(len(z), np.nan), where=size > 0)
            z = z * shared[-2] + shared[-1]
            one = np.logaddexp(0, np.where(part["label"] == 1, -z, z))
            total, n = total + float(np.nansum(one)), n + int((~np.isnan(one)).sum())
        return pd.DataFrame({"total": [total], "n": [n]})

    parts = dealt.groupBy("key", "stratum").cogroup(homes.groupBy("key", "stratum")).applyInPandas(run, "total double, n bigint")
    return parts.agg(F.try_divide(F.sum("total"), F.sum("n")).alias("loss")).first()["loss"]


def train_nsg(
    samples: DataFrame,
    dim: int = 200,
    epochs: int = 30,
    rate: float = 0.1,
    blocks: int = 8,
    seed: int = 1,
    optimiser: Optimiser | None = None,
    norm: bool = False,
) -> DataFrame:
    """The vectors after the last epoch over one corpus; see `nsg_rounds`."""
    *_, (_, vectors, _) = nsg_rounds(samples, dim, epochs, rate, blocks, seed, optimiser, norm, epochs_per_out=epochs, losses=False)
    return vectors


def nsg_loss(samples: DataFrame, params: DataFrame, norm: bool = False) -> DataFrame:
    """One row: mean cross-entropy of the samples. Without a shared row biases are zero."""
    row = params.filter("side = 'shared'").first()
    out = samples
    for k, (side, name) in enumerate((("target", "u"), ("context", "w"))):
        own = params.filter(F.col("side") == side).select(F.col("term").alias(side), F.col("v").alias(name))
        out = out.withColumn(side, F.col(side).cast("string")).join(own, side)
        if row is not None:
            dim = len(row["v"]) // 2 - 1
            bias = F.array(*[F.lit(x) for x in row["v"][k * dim : (k + 1) * dim]])
            out = out.withColumn(name, F.zip_with(name, bias, lambda x, y: x + y))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    z = product("u", "w")
    if norm:
        z = F.try_divide(z, F.sqrt(product("u", "u") * product("w", "w")))
    if row is not None:
        z = z * row["v"][-2] + row["v"][-1]
    margin = F.when(F.col("label") == 1, z).otherwise(-z)
    return out.agg(F.avg(F.log1p(F.exp(-margin))).alias("loss"))


# -- contrastive training ------------------------------------------------------------------------
def _head(flat: np.ndarray, dim: int, hidden: int):
    w1, rest = flat[: dim * hidden].reshape(dim, hidden), flat[dim * hidden :]
    return w1, rest[:hidden], rest[hidden : hidden + hidden * hidden].reshape(hidden, hidden), rest[-hidden:]


def first_head(dim: int, hidden: int, seed: int) -> np.ndarray:
    """Weights of both layers, evenly drawn within the root of 6 over the sum of a layer's sides, and no biases."""
    rng = np.random.default_rng(seed)
    w1, w2 = (rng.uniform(-1, 1, a * hidden) * (6 / (a + hidden)) ** 0.5 for a in (dim, hidden))
    return np.r_[w1, np.zeros(hidden), w2, np.zeros(hidden)]


def contrastive_gradients(u: np.ndarray, w: np.ndarray, flat: np.ndarray, hidden: int, temperature: float):
    """Loss of one batch and its gradients for targets, contexts and the shared head.

    Row k of one side belongs to row k of the other; both directions count the same.
    """
    n, dim = u.shape
    w1, b1, w2, b2 = _head(flat, dim, hidden)
    x = np.r_[u, w]
    h = np.maximum(x @ w1 + b1, 0)
    z = h @ w2 + b2
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    unit = z / size
    s = unit[:n] @ unit[n:].T / temperature
    soft = lambda m: np.exp(m - m.max(1, keepdims=True)) / np.exp(m - m.max(1, keepdims=True)).sum(1, keepdims=True)
    p, q = soft(s), soft(s.T).T
    loss = -0.5 * (np.log(np.diag(p)) + np.log(np.diag(q))).mean()
    ds = (p + q - 2 * np.eye(n)) / (2 * n * temperature)
    d_unit = np.r_[ds @ unit[n:], ds.T @ unit[:n]]
    dz = (d_unit - unit * (unit * d_unit).sum(1, keepdims=True)) / size
    dh = (dz @ w2.T) * (h > 0)
    head = np.r_[(x.T @ dh).ravel(), dh.sum(0), (h.T @ dz).ravel(), dz.sum(0)]
    dx = dh @ w1.T
    return loss, dx[:n], dx[n:], head


def contrastive_pairs(counts: DataFrame, size: int, epoch: int, blocks: int, by_frequency: bool = True, seed: int = 1) -> DataFrame:
    """`key`, `stratum`, `target`, `context`, `turn`, `rank`: the pairs that an epoch's batches choose from.

    Every target takes part once. The context that it draws first, by weighted random keys, gives the block
    of contexts that it chooses from; targets of one block that choose from the same block are a cell. Cells of
    one stratum share no target and no context. `turn` puts a cell's targets in order, `rank` a target's contexts.
    """
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(blocks))
    weight = F.pow("n", F.lit(0.75)) if by_frequency else F.lit(1.0)
    u = uniform(F.col("target").cast("string"), F.col("context").cast("string"), epoch, seed)
    drawn = counts.select("target", "context", (F.log(F.greatest(u, F.lit(1e-12))) / weight).alias("draw"), block("context").alias("home"))
    first = drawn.groupBy("target").agg(F.max(F.struct("draw", "home")).alias("m")).select("target", F.col("m.home").alias("home"))
    order = Window.partitionBy("target").orderBy(F.desc("draw"), "context")
    # others of a batch take at most size - 1 contexts, so one of the first `size` is free if any is
    kept = drawn.join(first, ["target", "home"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col("target").cast("string")))
    return kept.select(
        block("target").alias("key"), F.pmod(F.col("home") - block("target"), F.lit(blocks)).alias("stratum"),
        F.col("target").cast("string").alias("target"), F.col("context").cast("string").alias("context"), turn.alias("turn"), "rank",
    )


def batches_of(cell: pd.DataFrame, size: int) -> Iterator[list[tuple[str, str]]]:
    """Batches of up to `size` targets in their turn, each with the first of its contexts that no other of the batch has;
    a target without a free one is left out."""
    own = [(t, list(f["context"])) for (_, t), f in cell.sort_values(["turn", "target", "rank"]).groupby(["turn", "target"], sort=False)]
    for k in range(0, len(own), size):
        taken: dict[str, str] = {}
        for target, contexts in own[k : k + size]:
            free = next((c for c in contexts if c not in taken), None)
            if free is not None:
                taken[free] = target
        if taken:
            yield [(t, c) for c, t in taken.items()]


def _contrast(cell: pd.DataFrame, params: pd.DataFrame, head: pd.DataFrame, size: int, temperature: float, hidden: int, optimiser: Optimiser, head_optimiser: Optimiser) -> pd.DataFrame:
    """A step for each batch of a cell; the shared row (biases of both sides, then the head) comes back last."""
    if not len(params):
        return head
    v, state, steps = _unpack(params, optimiser)
    shared, shared_state, shared_steps = _unpack(head, head_optimiser)
    place = {key: k for k, key in enumerate(zip(params["side"], params["term"], strict=True))}
    dim = v.shape[1]
    for batch in batches_of(cell, size):
        i = np.array([place["target", t] for t, _ in batch], np.int64)
        j = np.array([place["context", c] for _, c in batch], np.int64)
        flat = shared[0]
        _, du, dw, dh = contrastive_gradients(v[i] + flat[:dim], v[j] + flat[dim : 2 * dim], flat[2 * dim :], hidden, temperature)
        rows = np.r_[i, j]  # no target and no context is twice in a batch
        steps[rows] += 1
        v[rows], state[rows] = optimiser.step(v[rows], np.r_[du, dw], state[rows], steps[rows])
        shared_steps += 1
        shared, shared_state = head_optimiser.step(shared, np.r_[du.sum(0), dw.sum(0), dh][None, :], shared_state, shared_steps)
    return pd.concat([_pack(params, v, state, steps), _pack(head, shared, shared_state, shared_steps)])


def ntx_rounds(
    counts: DataFrame,
    dim: int = 200,
    epochs: int = 1000,
    size: int = 16,
    temperature: float = 0.3,
    hidden: int = 128,
    rate: float = 0.5,
    seed: int = 1,
    optimiser: Optimiser | None = None,
    blocks: int = 8,
) -> Iterator[tuple[int, DataFrame, int]]:
    """(epoch, vectors, batches of the epoch) after every epoch, one step a batch.

    `counts` holds `target`, `context`, `n`. Cells of a stratum are trained side by side (see
    `contrastive_pairs`), each batch of a cell after the other; the shared row of side 'shared' (biases of
    targets and of contexts, then the head), which cells move on their own, is averaged after a stratum. With one block
    the epoch is one sequence of batches. There are at least `blocks` blocks, and so many that a task has CELL pairs and HELD vectors
    of a side on average at most. Without an optimiser it is plain descent with `rate`, a tenth of it for the shared row. Vectors are rows `side`, `term`, `v`; earlier epochs' are deleted when the next is done.
    """
    opt, head_opt = optimiser or Optimiser("sgd", rate), optimiser or Optimiser("sgd", rate * 0.1)
    params = settle(_with_state(initial_vectors(counts, dim, seed)), columnar=True)
    held = params.groupBy("side").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(blocks, math.ceil(held / HELD), math.ceil((counts.count() / CELL) ** 0.5))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    head = pd.DataFrame({"side": ["shared"], "term": [""], "v": [np.r_[np.zeros(2 * dim), first_head(dim, hidden, seed)]], "state": [np.zeros(0)], "steps": [0]})
    vectors = None
    for epoch in range(epochs):
        dealt, taken = settle(contrastive_pairs(counts, size, epoch, blocks, seed=seed), columnar=True), 0
        for s in [r["stratum"] for r in dealt.select("stratum").distinct().orderBy("stratum").collect()]:  # at most `blocks`
            home = F.when(F.col("side") == "target", block).otherwise(F.pmod(block - s, F.lit(blocks)))
            keyed = params.select(home.alias("key"), "side", "term", "v", "state", "steps")
            now = head

            def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                return _contrast(left, right, now.assign(term=str(key[0])), size, temperature, hidden, opt, head_opt)

            moved = settle(dealt.filter(F.col("stratum") == s).groupBy("key").cogroup(keyed.groupBy("key")).applyInPandas(run, _PARAMS), columnar=True)
            old, params = params, moved.filter("side <> 'shared'")
            params._settled_at = moved._settled_at
            release(old)
            found = moved.filter("side = 'shared'").toPandas()  # one row a block
            found = found[found["steps"] > head["steps"].iloc[0]].sort_values("term")
            if len(found):
                taken += int((found["steps"] - head["steps"].iloc[0]).sum())
                mean = lambda c: np.mean(found[c].tolist(), axis=0)
                head = head.assign(v=[mean("v")], state=[mean("state")], steps=[int(found["steps"].max())])
        row = counts.sparkSession.createDataFrame([("shared", "", [float(x) for x in head["v"].iloc[0]])], "side string, term string, v array<double>")
        before, vectors = vectors, settle(params.select("side", "term", "v").unionByName(row), columnar=True)
        release(dealt, *([before] if before is not None else []))
        yield epoch + 1, vectors, taken


def train_ntx(counts: DataFrame, dim: int = 200, epochs: int = 10, size: int = 16, temperature: float = 0.3, hidden: int = 128, rate: float = 0.5, seed: int = 1, optimiser: Optimiser | None = None, blocks: int = 8) -> DataFrame:
    """Vectors (`side`, `term`, `v`) after the last epoch; see `ntx_rounds`, which also gives biases and head."""
    *_, (_, vectors, _) = ntx_rounds(counts, dim, epochs, size, temperature, hidden, rate, seed, optimiser, blocks)
    return vectors.filter("side <> 'shared'")


# -- classifier ----------------------------------------------------------------------------------
def _ready(rows: DataFrame) -> DataFrame:
    return rows.select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y"))


def train_classifier(rows: DataFrame, width: int, hidden: tuple[int, ...] = (64, 16), rounds: int = 50, seed: int = 1):
    """A perceptron over `features array<double>` of `width` and a `label` of 0 or 1."""
    return MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[width, *hidden, 2], maxIter=rounds, seed=seed).fit(_ready(rows))


def classifier_rounds(rows: DataFrame, width: int, hidden: tuple[int, ...] = (64, 16), rounds: int = 50, every: int = 10, seed: int = 1):
    """(rounds so far, model) every `every` rounds, each going on from the weights before."""
    ready, weights = _ready(rows), None
    for done in range(0, rounds, every):
        step = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[width, *hidden, 2], maxIter=min(every, rounds - done), seed=seed)
        model = (step if weights is None else step.setInitialWeights(weights)).fit(ready)
        weights = model.weights
        yield min(done + every, rounds), model


def classify(model, rows: DataFrame) -> DataFrame:
    """`rows` with `score`, the probability of label 1; labels are not needed."""
    ready = rows.withColumn("x", array_to_vector("features"))
    scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "score")


def save_classifier(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassificationModel.load(path)


#: Reactions up to which the weights are few enough for Spark ML, which holds all of them in the driver.
MOST_DENSE = 1 << 16
RATE, FACTOR_SPREAD = 0.05, 0.1


@dataclass(frozen=True)
class IndexedModel:
    """A factorisation machine whose reactions' weights are rows: `reaction`, `p`, its own weight and then its factors.

    `shared` holds the intercept, the weights of the features and, feature by feature, their factors.
    """

    weights: DataFrame
    shared: np.ndarray
    rank: int


def machine_scores(p: np.ndarray, x: np.ndarray, shared: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of rows of reaction weights `p` and features `x`, the features' sums of factors and those of all."""
    width = x.shape[1]
    factors = shared[1 + width :].reshape(width, rank)
    own = x @ factors
    both = p[:, 1:] + own
    square = p[:, 1:] ** 2 + x**2 @ factors**2
    return shared[0] + p[:, 0] + x @ shared[1 : 1 + width] + (both**2 - square).sum(1) / 2, own, both


def machine_gradients(p: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the summed logistic loss for the reactions' weights (rows of `p`, which `at` names) and for `shared`."""
    z, own, both = machine_scores(p[at], x, shared, rank)
    err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
    mine = np.stack([np.bincount(at, err * c, len(p)) for c in (1.0, *own.T)], axis=1)
    factors = shared[1 + x.shape[1] :].reshape(-1, rank)
    return mine, np.r_[err.sum(), x.T @ err, (x.T @ (err[:, None] * both) - factors * (x**2.0).T.dot(err)[:, None]).ravel()]


def _train_rows(rows: DataFrame, rank: int, rounds: int, seed: int) -> IndexedModel:
    """The machine fitted by adam over all rows in each round.

    Rows are bucketed by blocks of reactions and stay where they are; a round sends a block its weights and gives back those of
    the next, and a gradient of what is shared for each block.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("reaction").cast("string").alias("reaction"), "features", F.col("label").cast("double").alias("y"))
    total, width = rows.count(), len(rows.first()["features"])
    blocks = max(1, math.ceil(4 * total / CELL))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("reaction"), F.lit(blocks)))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table = save_bucketed(rows.repartition(blocks, "block"), path, ["block"], blocks)
    first = F.concat(F.array(F.lit(0.0)), F.transform(_start(seed, rank, F.col("reaction")), lambda x: x * FACTOR_SPREAD))
    none = F.array_repeat(F.lit(0.0), 2 * (rank + 1))
    weights = settle(table.select("block", "reaction").distinct().select("block", "reaction", first.alias("p"), none.alias("state")), columnar=True)
    optimiser = Optimiser("adam", RATE)
    shared = np.r_[np.zeros(1 + width), np.random.default_rng(seed).normal(0, 0.01, width * rank)][None, :]
    state = optimiser.fresh(shared.shape)
    for turn in range(1, rounds + 1):
        now = shared[0]

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            names = left.column("reaction").combine_chunks()
            p = load(left.column("p"))
            own, g, all_ = load(left.column("state")).reshape(len(p), 2, -1), np.zeros_like(p), np.zeros(len(now))
            for k in range(0, len(right), AT_ONCE):
                part = right.slice(k, AT_ONCE)
                at = pc.index_in(part.column("reaction").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
                mine, theirs = machine_gradients(p, at, load(part.column("features")), part.column("y").to_numpy(), now, rank)
                g, all_ = g + mine, all_ + theirs
            p, own = optimiser.step(p, g / total, own, np.full(len(p), turn))
            lists = pa.list_(pa.float64())
            kept = pa.table({"block": left.column("block"), "reaction": names, "p": pa.array(list(p), lists), "state": pa.array(list(own.reshape(len(p), -1)), lists)})
            return pa.concat_tables([kept, pa.table({"block": pa.array([-1], pa.int64()), "reaction": pa.array([None], pa.string()), "p": pa.array([all_], lists), "state": pa.array([[]], lists)})])

        moved = settle(weights.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(run, "block bigint, reaction string, p array<double>, state array<double>"), columnar=True)
        old, weights = weights, moved.filter("block >= 0")
        weights._settled_at = moved._settled_at
        release(old)
        found = np.array([r["p"] for r in moved.filter("block < 0").select("p").collect()])  # one row a block
        # added up in an order of their values, as blocks come in none
        shared, state = optimiser.step(shared, np.sort(found, axis=0).sum(0)[None, :] / total, state, np.array([turn]))
    drop_bucketed(table, path)
    return IndexedModel(weights.select("reaction", "p"), shared[0], rank)


def train_indexed_classifier(rows: DataFrame, rank: int = 8, rounds: int = 50, seed: int = 1) -> PipelineModel | IndexedModel:
    """A classifier for reactions without vectors: the reaction is one of its features by index.

    `rows` hold `reaction`, `features array<double>` of the drug and `label`. A factorisation machine
    learns a vector for each reaction from the sparse index and one for each feature, so neither
    the index nor a weight per pair is ever dense. Reactions unseen in training share a place. Weights of more than
    MOST_DENSE reactions are rows of a table, and nothing of their number is in the driver.
    """
    if rows.select("reaction").distinct().count() > MOST_DENSE:
        return _train_rows(rows, rank, rounds, seed)
    stages = [
        StringIndexer(inputCol="reaction", outputCol="at", handleInvalid="keep"),
        OneHotEncoder(inputCol="at", outputCol="one", dropLast=False),
        VectorAssembler(inputCols=["one", "x"], outputCol="all"),
        FMClassifier(featuresCol="all", labelCol="y", factorSize=rank, maxIter=rounds, stepSize=RATE, seed=seed),
    ]
    return Pipeline(stages=stages).fit(_with_index(rows).withColumn("y", F.col("label").cast("double")))


def _with_index(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reaction", F.col("reaction").cast("string")).withColumn("x", array_to_vector("features"))


def classify_indexed(model: PipelineModel | IndexedModel, rows: DataFrame) -> DataFrame:
    """`drug`, `reaction` (text) and `score`, the probability of label 1."""
    if isinstance(model, PipelineModel):
        scored = model.transform(_with_index(rows))
        return scored.select("drug", "reaction", vector_to_array("probability")[1].alias("score"))
    shared, rank = model.shared, model.rank
    named = rows.withColumn("reaction", F.col("reaction").cast("string")).join(model.weights, "reaction", "left")
    named = named.select("drug", "reaction", "features", F.coalesce("p", F.array_repeat(F.lit(0.0), rank + 1)).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                z = machine_scores(load(batch.column("p")), load(batch.column("features")), shared, rank)[0]
                yield pa.RecordBatch.from_arrays([batch.column("drug"), batch.column("reaction"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["drug", "reaction", "score"])

    return named.mapInArrow(run, f"drug {dict(rows.dtypes)['drug']}, reaction string, score double")
