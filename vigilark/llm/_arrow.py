"""Helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts handled together inside a task, in characters. A longer text is handled alone.
CHUNK_CHARS = 500_000


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of `texts` of about `limit` characters each, in order, covering all of them."""
    return _stretches((len(text or "") for text in texts), limit)


def text_parts(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[slice, list[str | None]]]:
    """The slices of `chunks` of a column, each with its texts; no others are Python strings at that time."""
    for part in _stretches((n or 0 for n in pc.utf8_length(column).to_pylist()), limit):
        yield part, column[part.start : part.stop].to_pylist()


def _stretches(sizes: Iterable[int], limit: int) -> Iterator[slice]:
    begin = used = end = 0
    for end, size in enumerate(sizes, 1):
        used += size
        if used >= limit:
            yield slice(begin, end)
            begin, used = end, 0
    if begin < end:
        yield slice(begin, end)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`run`, after which the worker gives free memory back to the system: it stays for later stages, some of
    which need no Python but all of the executor's memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return whole


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    out_schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: `id_col` and what `make()(texts)` gives for its whole text.

    `make` runs once per task, so models and tables load there. `out_schema` is DDL for the
    columns that follow `id_col`. A null text is handed over as the empty text. Other columns
    of `docs` are pruned before anything leaves the JVM.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = dict(src.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            ids = batch.column(0)
            for part, texts in text_parts(batch.column(1)):
                arrays = work(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], *arrays], names=["id", *names]
                )

    schema = StructType.fromDDL(f"id {id_type}, {out_schema}")
    names = schema.names[1:]
    return src.mapInArrow(handing_back(run), schema).withColumnRenamed("id", id_col)
