"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. The Manhattan
distance of two such maps is never more than the Hamming distance of the fingerprints, so
fingerprints within 3 bits lie within 3 of each other there: of any parts that the map is cut into at
most 3 differ. The map is cut into `depth` + 3 parts; for every choice of `depth` of them there is a
grid whose cells are these parts' counts, and two near fingerprints share a cell of one grid at least.
How deep the grids are follows from the number of fingerprints: deeper ones hold fewer strangers in a
cell, shallower ones are fewer. Each pair found is verified on the fingerprints within the join.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations
from math import comb
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm._arrow import map_texts
from vigilark.llm._graph import components
from vigilark.llm._tables import settle

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: What a row sent to a cell costs, in fingerprints met there.
SENDING = 20
_ODD = 0x5555555555555555

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every shingle of `SHINGLE` words, repeats included; of the whole sequence if
    there are fewer words; none without words."""
    words = text.encode().translate(_LOWER).split()  # splits at ASCII white space
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(SHINGLE, n)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    pieces = [joined[a:b] for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.fromiter(map(digest, pieces), np.uint64, len(pieces))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the fingerprint whose bits are set in over half of them."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([hashes[k] for k in full]).astype(">u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32).astype(np.int64)
        packed = np.packbits(2 * ones > sizes[full][:, None], axis=1)
        out[full] = packed.view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `fp` (64 bits as a long) of every whole text; null, empty and blank texts
    get 0; repeated rows are kept; an empty table gives an empty result."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array(majority([shingle_hashes(t) for t in texts]).view(np.int64), pa.int64())]

        return work

    return map_texts(docs, make, "fp bigint", id_col, text_col)


def popcount_map(fp: Column) -> Column:
    """Bit counts (0 to 2) of the 32 two-bit segments, in two bits each."""
    low, high = fp.bitwiseAND(_ODD), F.shiftrightunsigned(fp, 1).bitwiseAND(_ODD)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_depth(n: int) -> int:
    """Equal parts asked for among `n` fingerprints: the cheapest, where a row of a grid costs as much as
    SENDING strangers met in its cell. Two random segments have equal counts 3 times in 8."""
    cost = lambda k: comb(k + MAX_BITS, k) * (SENDING + n * 0.375 ** (32 * k / (k + MAX_BITS)))
    return min(range(1, 10), key=cost)


def _parts(n: int) -> list[int]:
    """Masks of the two-bit segments of `n` parts of the map, as signed longs."""
    edges = [2 * round(32 * k / n) for k in range(n + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links_between(fps: DataFrame, depth: int | None = None) -> DataFrame:
    """Pairs `a`, `b` of `node`s of a table (`node`, distinct `fp`) within MAX_BITS bits, each pair once.

    The first grid in which a pair shares a cell reports it: the one of its first equal parts.
    """
    depth = depth or grid_depth(fps.count())
    masks = _parts(depth + MAX_BITS)
    grids = []
    for g, chosen in enumerate(combinations(range(len(masks)), depth)):
        passed = [masks[p] for p in range(chosen[-1]) if p not in chosen]  # parts that have to differ
        grids.append((g, sum(masks[p] for p in chosen), passed + [0] * (MAX_BITS - len(passed))))
    long = lambda x: F.lit(x).cast("bigint")
    spec = F.array(*[F.struct(F.lit(g).alias("g"), long(m).alias("m"), F.array(*map(long, ps)).alias("passed")) for g, m, ps in grids])
    rows = fps.select("node", "fp", popcount_map(F.col("fp")).alias("map"), F.explode(spec).alias("s"))
    cell = F.col("map").bitwiseAND(F.col("s.m"))
    left = rows.select(F.col("s.g").alias("g"), cell.alias("cell"), F.col("node").alias("a"), F.col("fp").alias("fp_a"), F.col("map").alias("map_a"), "s.passed")
    right = rows.select(F.col("s.g").alias("g_b"), cell.alias("cell_b"), F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("map").alias("map_b"))
    moved = F.col("map_a").bitwiseXOR(F.col("map_b"))
    first = reduce(and_, [(F.col("passed")[k] == 0) | (moved.bitwiseAND(F.col("passed")[k]) != 0) for k in range(MAX_BITS)])
    near = (F.col("fp_a") < F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= MAX_BITS)
    same_cell = (F.col("g") == F.col("g_b")) & (F.col("cell") == F.col("cell_b"))
    return left.join(right, same_cell & near & first).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `fp` and `component_id`: the smallest id reachable over fingerprints that
    differ in at most MAX_BITS bits, itself included.

    Equal fingerprints, those of empty and null texts too, are one node of the graph, so a group
    of copies of any size costs one row there. Rows without an id are left as components of
    their own (null). Repeated rows share their component.
    """
    rows = settle(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    nodes = settle(rows.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    found = components(links_between(nodes), "a", "b")
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    classes = settle(classes)
    return rows.join(classes, "fp", "left").select(
        F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )
