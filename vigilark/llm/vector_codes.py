"""Compression of vectors to product codes, with codebooks of integer means.

Vectors are kept as blocks: NumPy arrays of whole numbers, dimension by dimension. A round is one
`treeAggregate` over the blocks: every block finds the nearest entry of each of its parts, adding up
distances dimension by dimension, and adds its parts to sums and counts per entry with `np.add.at`;
these tensors, as large as the codebooks, merge through a reduction tree. All sums are of 64-bit
integers, so neither the partitioning nor the order of the merges shows in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm._tables import release, settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a block, and the largest whole number of one: beyond it distances would not fit 64 bits.
BLOCK_CELLS, LARGEST = 1 << 18, 1 << 27
#: A label with more than this share of the rows is joined apart, so there are fewer than its inverse.
HOT = 2000


@dataclass
class Codebooks:
    """`entries[part, entry, dimension of the part]`, whole numbers; `width` dimensions in all."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part of each row of `x` (dimension by row), and its squared distance; ties
        go to the lower entry."""
        parts, entries, dims = self.entries.shape
        codes, best = np.zeros((parts, x.shape[1]), np.int64), np.zeros((parts, x.shape[1]), np.int64)
        for p in range(parts):
            total = np.zeros((x.shape[1], entries), np.int64)
            for d in range(dims):
                step = x[p * dims + d][:, None] - self.entries[p, :, d][None, :]
                step *= step
                total += step
            codes[p] = total.argmin(1)
            best[p] = total[np.arange(x.shape[1]), codes[p]]
        return codes, best


def codebook_digest(books: Codebooks | None) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: str) -> Column:
    """Not null, and neither null nor non-finite components."""
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole_numbers(vector: str, scale: int) -> Column:
    """Components times `scale`, rounded down, as 32-bit integers between -LARGEST and LARGEST."""
    near = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    down = lambda x: F.floor(near(x)).cast("int")
    return F.transform(F.col(vector), down)


def blocks_of(whole: DataFrame) -> RDD:
    """NumPy arrays, dimension by row, of the column `x` of equally long lists; none is empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0)
            width = len(x[0]) if len(x) else 1
            table = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
            step = max(1, BLOCK_CELLS // max(1, width))
            for k in range(0, len(x), step):
                part = np.ascontiguousarray(table[k : k + step].T, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["n", "x"])

    rows = whole.select("x").mapInArrow(pack, "n int, x binary").rdd
    return rows.map(lambda r: np.frombuffer(r["x"], np.int32).reshape(-1, r["n"]).astype(np.int64))


def train_codebooks(blocks: RDD, seeds: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the parts of `seeds` and take the floored means of their parts, `rounds` times.

    An entry without parts stays.
    """
    dims = seeds.shape[1] // parts
    books = Codebooks(seeds.reshape(len(seeds), parts, dims).transpose(1, 0, 2).astype(np.int64))
    sc = blocks.context
    for _ in range(rounds):
        now = sc.broadcast(books)  # as large as the codebooks, whatever the number of vectors

        def add(total, x: np.ndarray, now=now):
            sums, counts = total if total is not None else (np.zeros_like(now.value.entries), np.zeros(now.value.entries.shape[:2], np.int64))
            codes, _ = now.value.nearest(x)
            for p in range(parts):
                np.add.at(counts[p], codes[p], 1)
                for d in range(dims):
                    np.add.at(sums[p, :, d], codes[p], x[p * dims + d])
            return sums, counts

        def merge(a, b):
            return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

        sums, counts = blocks.treeAggregate(None, add, merge, depth=3)
        used = counts[:, :, None] > 0
        books = Codebooks(np.where(used, sums // np.maximum(counts, 1)[:, :, None], books.entries))
        now.unpersist()
    return books


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Codebooks | None]:
    """`id_col`, `label_col`, `codes array<int>` (an entry per part), `error` and `label_error`, and the codebooks.

    `error` is the sum over parts of the squared distance to the entry, `label_error` its sum over rows of
    equal label, null labels together. Codebooks start from the rows of the `entries` smallest ids (null
    ids last, equal ids by their components).

    Rows whose vector is null or holds null or non-finite components are left out. Vectors are coded if
    they have the commonest length that is a multiple of `parts` (of equally common ones the smallest);
    others, empty ones too, get null codes and no error, and add nothing to their label's. Components
    beyond LARGEST / `scale` count as that. Repeated rows are coded each; fewer rows than `entries` make
    smaller codebooks; without any row to code there are none. Other columns are not read.
    """
    kept = vectors.filter(usable(vector_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(vector_col, scale).alias("x")
    )
    kept = settle(kept, columnar=True)
    lengths = kept.groupBy(F.size("x").alias("width")).count().filter((F.col("width") > 0) & (F.col("width") % parts == 0))
    common = lengths.orderBy(F.desc("count"), "width").first()
    books = None
    fits = F.lit(False)
    if common is not None:
        fits = F.size("x") == common["width"]
        first = kept.filter(fits).orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
        books = train_codebooks(blocks_of(kept.filter(fits)), np.array([r["x"] for r in first], np.int64), parts, rounds)
    kinds = dict(kept.dtypes)
    coded = settle(_coded(kept, fits, books, kinds), columnar=True)
    release(kept)
    sums = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), columnar=True)
    return _with_label_errors(coded, sums).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books


def _coded(kept: DataFrame, fits: Column, books: Codebooks | None, kinds: dict[str, str]) -> DataFrame:
    """`id`, `label`, `codes`, `error`; null where a vector does not fit the codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK_CELLS // books.width)
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, books.width).T.astype(np.int64)
                codes, best = books.nearest(x)
                n = codes.shape[0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * part.num_rows + 1, n), pa.int32()), pa.array(codes.T.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), lists, pa.array(best.sum(0))], names=["id", "label", "codes", "error"])

    schema = f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error bigint"
    other = kept.filter(~fits).select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("bigint").alias("error"))
    return other if books is None else kept.filter(fits).mapInArrow(run, schema).unionByName(other)


def _with_label_errors(coded: DataFrame, sums: DataFrame) -> DataFrame:
    """Labels that many rows share are few and are broadcast; others are joined by value."""
    total = sums.agg(F.sum("n").alias("rows"))  # one row
    marked = sums.join(F.broadcast(total)).withColumn("hot", F.col("n") * HOT > F.col("rows"))
    hot = marked.filter("hot").select(F.col("label").alias("l"), F.col("label_error").alias("known"), F.lit(True).alias("found"))
    rest = marked.filter("not hot").select(F.col("label").alias("l"), "label_error")
    rows = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")  # fewer than HOT rows
    apart = rows.filter("found").withColumn("label_error", F.col("known"))
    joined = rows.filter("found is null").join(rest, F.col("label").eqNullSafe(F.col("l"))).drop("l")
    return apart.unionByName(joined)
