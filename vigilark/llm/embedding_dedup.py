"""Embedding near-duplicates by an inverted multi-index.

Two independent codebooks quantise the halves of the unit vectors, and their product is a fine
grid of cells. Every distinct vector is stored in its cell and looks up the cells nearest to it
in the order of the summed half distances (multi-sequence order); how fine the grid is and how many
cells are visited is measured on a bounded sample so that the target recall is met, in dense regions
as well as elsewhere. What is met there is verified by cosine in double precision. Equal vectors are
one node with a count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm._graph import components
from vigilark.llm._tables import settle

MIN_COSINE = 0.95
#: The index is fitted on at most SAMPLE vectors; TARGET is the recall measured on pairs drawn
#: there. Codebooks have between MIN_BOOK and MAX_BOOK entries at first, so that a cell holds about
#: PER_CELL vectors. At most MAX_CELLS cells are visited: where these do not meet the target, the
#: grid is made coarser until they do, at the latest when it is one cell.
SAMPLE, TARGET = 12_000, 0.995
MIN_BOOK, MAX_BOOK, PER_CELL, MAX_CELLS = 4, 4096, 8, 64
#: Measured vectors of a kind, and what sending a vector to a cell costs, in comparisons.
MEASURED, SENDING = 3000, 50
#: Centres whose halves are this near can be those of one pair at MIN_COSINE.
NEAR_HALF = (1 - MIN_COSINE) ** 0.5
#: Stored and asking vectors of a cell that are compared at a time; larger cells are dealt out.
BLOCK, ASKS = 4096, 16_384


@dataclass
class Index:
    books: tuple[np.ndarray, np.ndarray]  # centres, those of a region together
    begins: tuple[np.ndarray, np.ndarray]  # where each region begins
    cells: int  # visited per vector
    recall: float  # as measured on the sample, the least of all kinds of pairs

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """To each region of both halves, that is, to its nearest centre."""
        h = len(self.books[0][0])
        return tuple(
            np.minimum.reduceat((c**2).sum(1)[None, :] - 2 * x @ c.T, begin, axis=1)
            for x, c, begin in zip((unit[:, :h], unit[:, h:]), self.books, self.begins, strict=True)
        )

    def home(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.begins[1]) + b.argmin(1)

    def visit(self, unit: np.ndarray, count: int) -> np.ndarray:
        """The `count` nearest cells of each vector, nearest first.

        Of the pairs of ranks (r, s) only those with (r + 1)(s + 1) <= count can be among them,
        since every pair of lower or equal ranks is at least as near.
        """
        a, b = self.distances(unit)
        k = len(self.begins[0]), len(self.begins[1])
        count = min(count, k[0] * k[1])
        ra, rb = (np.argsort(d, axis=1, kind="stable")[:, :count] for d in (a, b))
        stair = np.array([(r, s) for r in range(min(count, k[0])) for s in range(min(count // (r + 1), k[1]))])
        da, db = np.take_along_axis(a, ra, 1), np.take_along_axis(b, rb, 1)
        total = da[:, stair[:, 0]] + db[:, stair[:, 1]]
        best = np.argsort(total, axis=1, kind="stable")[:, :count]
        chosen = stair[best]
        return np.take_along_axis(ra, chosen[..., 0], 1) * k[1] + np.take_along_axis(rb, chosen[..., 1], 1)


def _book(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means centres; an empty one is put on a random point."""
    centres = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=size)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=size)])
    return centres


def _regions(centres: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """The centres in the order of their regions, and where each region begins; chains of centres
    no further apart than `within` are one region."""
    label = np.arange(len(centres))
    if within > 0:
        square = (centres**2).sum(1)
        near = square[:, None] + square[None, :] - 2 * centres @ centres.T <= within**2
        np.fill_diagonal(near, True)
        while True:
            least = np.where(near, label[None, :], len(centres)).min(1)
            if (least == label).all():
                break
            label = least
    order = np.argsort(label, kind="stable")
    return centres[order], np.flatnonzero(np.r_[True, np.diff(label[order]) > 0])


def _measured_pairs(sample: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each kind: vectors with a point at a cosine between MIN_COSINE and 1 in a random
    direction, then vectors of the sample with one of their neighbours there, by how many they have
    (fewer than 8, than 64, and so on), so that dense regions are measured by themselves."""
    u = sample[rng.permutation(len(sample))[:MEASURED]]
    side = rng.normal(size=u.shape)
    side -= (side * u).sum(1)[:, None] * u
    side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
    cosine = rng.uniform(MIN_COSINE, 1, len(u))[:, None]
    kinds = [(u, cosine * u + np.sqrt(1 - cosine**2) * side)]
    degree, other = np.zeros(len(sample), int), np.zeros(len(sample), int)
    for begin in range(0, len(sample), 1000):
        near = sample[begin : begin + 1000] @ sample.T >= MIN_COSINE
        near[np.arange(len(near)), begin + np.arange(len(near))] = False
        i, j = np.nonzero(near)
        n = np.bincount(i, minlength=len(near))
        degree[begin : begin + 1000] = n
        first = np.cumsum(n) - n
        some = np.flatnonzero(n)
        other[begin + some] = j[first[some] + rng.integers(n[some])]
    kind = np.where(degree > 0, np.log2(np.maximum(degree, 1)).astype(int) // 3, -1)
    for k in range(kind.max(initial=-1) + 1):
        of = rng.permutation(np.flatnonzero(kind == k))[:MEASURED]
        if len(of):
            kinds.append((sample[of], sample[other[of]]))
    return kinds


def _measure(index: Index, kinds: list, sample: np.ndarray, total: int) -> float:
    """Sets the index's cells and recall; what a vector then costs, in comparisons.

    A pair is met if either vector visits the other's cell. Recall is the least over the kinds.
    """
    found = np.ones(MAX_CELLS + 1)
    for u, v in kinds:
        rank = np.full(len(u), MAX_CELLS)
        for x, y in ((u, v), (v, u)):
            same = index.visit(x, MAX_CELLS) == index.home(y)[:, None]
            rank = np.minimum(rank, np.where(same.any(1), same.argmax(1), MAX_CELLS))
        met = np.cumsum(np.bincount(rank, minlength=MAX_CELLS + 1)[:MAX_CELLS]) / len(u)
        found = np.minimum(found, np.r_[0.0, met])
    good = np.flatnonzero(found >= TARGET)
    index.cells = int(good[0]) if len(good) else MAX_CELLS
    index.recall = float(found[index.cells])
    held = np.bincount(index.home(sample), minlength=len(index.begins[0]) * len(index.begins[1])) / len(sample)
    visits = index.visit(sample[:MEASURED], index.cells)
    return total * float(held[visits].sum(1).mean()) + SENDING * visits.shape[1]


def fit_index(sample: np.ndarray, total: int, seed: int = 5) -> Index:
    """Codebooks from unit vectors, and the cells to visit for the target recall.

    If the finest grid does not reach it, the cheapest that does is taken from coarser ones: those
    that join centres which one pair can have, so that only dense regions are coarser, and those
    with half as many centres each time. The last is one cell, where every pair is met.
    """
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    kinds = _measured_pairs(sample, rng)
    size = int(np.clip(round((total / PER_CELL) ** 0.5), MIN_BOOK, MAX_BOOK))
    reached: list[tuple[float, Index]] = []
    finest = True
    while size:
        books = _book(sample[:, :half], size, rng), _book(sample[:, half:], size, rng)
        for within in (0.0, NEAR_HALF):
            ordered, begins = zip(*(_regions(c, within) for c in books), strict=True)
            index = Index(ordered, begins, 1, 0.0)
            cost = _measure(index, kinds, sample, total)
            if index.recall >= TARGET:
                reached.append((cost, index))
            if finest and reached:
                return index
            finest = False
        size //= 2
    if not reached:
        raise RuntimeError(f"no grid reaches a recall of {TARGET}")
    return min(reached, key=lambda r: r[0])[1]


def _usable(v: Column) -> Column:
    """Whether all components are finite and not all are zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: pa.Array, width: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _deal(nodes: DataFrame, index: Index, width: int) -> DataFrame:
    """Each node once in its own cell (`asks` false) and once in every cell it visits."""

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                part = batch.slice(begin, 4096)
                unit = _unit(part.column(1), width)
                visits = index.visit(unit, index.cells)
                cell = np.c_[index.home(unit), visits].ravel()
                row = np.repeat(np.arange(len(part)), 1 + visits.shape[1])
                asks = np.tile(np.r_[False, np.ones(visits.shape[1], bool)], len(part))
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(asks), out.column(0), out.column(1)],
                    names=["cell", "asks", "node", "v"],
                )

    kinds = dict(nodes.dtypes)
    return nodes.mapInArrow(run, f"cell bigint, asks boolean, node {kinds['node']}, v {kinds['v']}")


def _compare(dealt: DataFrame, width: int) -> DataFrame:
    """Verified pairs within each (cell, tile); rows come sorted by it, the stored ones first, so
    only these are held while those that ask pass by."""

    def pairs(ids: np.ndarray, unit: np.ndarray, stored_ids: np.ndarray, stored: np.ndarray):
        for begin in range(0, len(ids), 512):
            i, j = np.nonzero(unit[begin : begin + 512] @ stored.T >= MIN_COSINE - 1e-9)
            i += begin
            exact = np.einsum("ij,ij->i", unit[i], stored[j]) >= MIN_COSINE
            a, b = ids[i], stored_ids[j]
            keep = exact & (a != b)
            if keep.any():
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        group, held_ids, held = None, np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            if not len(batch):
                continue
            cell, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            asks, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            unit = _unit(batch.column(4), width)
            new = (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])
            edges = np.flatnonzero(np.r_[True, new])
            for a, b in zip(edges, [*edges[1:], len(cell)], strict=True):
                if group != (cell[a], tile[a]):
                    group, held_ids, held = (cell[a], tile[a]), held_ids[:0], held[:0]
                split = b - int(asks[a:b].sum())
                if split > a:
                    held_ids, held = np.r_[held_ids, ids[a:split]], np.r_[held, unit[a:split]]
                if split < b and len(held):
                    yield from pairs(ids[split:b], unit[split:b], held_ids, held)

    return dealt.select("cell", "tile", "asks", "node", "v").mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, seed: int = 5) -> DataFrame:
    """Distinct pairs `a` < `b` of a table (`node` bigint, distinct `v`, all usable).

    Vectors of different lengths never link. The commonest length and each with more than SAMPLE vectors
    have an index of their own; those of all other lengths are compared in full, a length being one cell.
    """
    counts = nodes.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").collect()  # a row a length
    indexed = [(r["width"], r["count"]) for k, r in enumerate(counts) if k == 0 or r["count"] > SAMPLE]
    out = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for width, count in indexed:
        own = nodes.filter(F.size("v") == width)
        drawn = own.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow()
        index = fit_index(_unit(drawn.column("v").combine_chunks(), width), count, seed)
        out = out.unionByName(_tiled(_deal(own, index, width), width))
    rest = sorted({r["width"] for r in counts} - {width for width, _ in indexed})
    if rest:
        width = max(rest)
        filled = F.concat("v", F.array_repeat(F.lit(0).cast(nodes.schema["v"].dataType.elementType), F.lit(width) - F.size("v")))
        own = nodes.filter(F.size("v").isin(rest)).select(F.size("v").cast("bigint").alias("cell"), "node", filled.alias("v"))
        both = own.withColumn("asks", F.explode(F.array(F.lit(False), F.lit(True)))).select("cell", "asks", "node", "v")
        out = out.unionByName(_tiled(both, width))
    return out.distinct()


def _tiled(dealt: DataFrame, width: int) -> DataFrame:
    """Verified pairs of the cells. Cells with more vectors than should be compared at a time are cut
    into tiles, of which each has a block of the stored vectors and a slice of those that ask."""
    parts = lambda asks, size: F.greatest(F.ceil(F.count_if(F.col("asks") == asks) / size), F.lit(1)).cast("int")
    sizes = dealt.groupBy("cell").agg(parts(False, BLOCK).alias("blocks"), parts(True, ASKS).alias("slices"))
    large = settle(sizes.filter("blocks > 1 or slices > 1"), columnar=True)
    one = lambda c: F.coalesce(c, F.lit(1))
    sized = dealt.join(large, "cell", "left").withColumns({"blocks": one("blocks"), "slices": one("slices")})
    hashed = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    # a stored vector goes to all slices of its block, one that asks to all blocks with its slice
    tiles = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b * F.col("slices") + hashed("slices")))
    tiles = tiles.otherwise(F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: hashed("blocks") * F.col("slices") + k))
    placed = sized.withColumn("tile", F.explode(tiles))
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = placed.repartition(n, "cell", "tile").sortWithinPartitions("cell", "tile", "asks")
    return _compare(sorted_, width)


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`id_col`, `n_links`, `component_id`, `kept`, one row per row.

    Links are between rows with cosine of at least MIN_COSINE. Null or zero vectors, those with
    null or non-finite components link with nothing and are kept; vectors link with those of their
    own length only. Repeated rows count as other vectors; a row with a null id links with nothing; an
    empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", _usable(F.col("v")) & F.col("id").isNotNull()).withColumn("h", F.xxhash64("v"))
    nodes = settle(
        rows.filter("ok").groupBy("h", "v").agg(F.min("id").alias("node"), F.count("*").alias("n")), columnar=True
    )
    pairs = settle(links(nodes.select("node", "v")), columnar=True)
    found = components(pairs, "a", "b")
    sizes = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = ends.join(sizes, "b").groupBy("a").agg(F.sum("n_b").alias("linked")).withColumnRenamed("a", "node")
    known = settle(
        nodes.join(counts, "node", "left")
        .join(found, "node", "left")
        .select(
            F.col("h").alias("h_n"), F.col("v").alias("v_n"),
            (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"),
        ),
        columnar=True,
    )
    same = F.col("ok") & (F.col("h") == F.col("h_n")) & (F.col("v") == F.col("v_n"))
    joined = rows.join(known, same, "left").withColumn("component_id", F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
