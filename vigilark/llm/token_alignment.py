"""Alignment of two tokenizers over a corpus, each distinct segment tokenised and aligned once.

A text is cut before runs of white space, where neither vocabulary has an entry that could reach
across (`Pair` looks through both and leaves out the white space for which one could, as "\\r" after
";"). Tokens never cross such a cut, so what holds for a segment holds wherever it stands.

1. `segment_blocks`: texts become blocks of documents, each with its distinct segments and, per
   document, the places of its segments among these. The table is bucketed by block, so that it is
   joined twice later without being moved.
2. `align_segments`: the blocks' segments are dealt out by hash; in each bucket distinct segments are
   tokenised and aligned once, and joined back to the blocks that hold them.
3. `compose`: documents are put together from the alignments of their segments; the id pairs that are
   linked in each document are counted once per document.
4. `weigh`: corpus-wide counts go to the distinct segments, and back to blocks and documents.

What goes between tasks is packed: a row is one block's share of one bucket, its columns compressed
Arrow buffers. There are in all as many buckets as keep a bucket's segments at a constant number, so
no task's memory grows with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vigilark.llm._tables import release, settle, settle_bucketed
from vigilark.llm.bpe import byte_alphabet

#: Characters of a block's texts (a longer text is a block of its own), blocks to a bucket, segments put
#: together at once, and rows sent at once.
BLOCK_CHARS, BLOCKS_A_BUCKET, LEAST_BUCKETS, COMPOSED, SENT = 6_000_000, 2, 48, 200_000, 50_000
#: Characters before which a text may be cut, if the vocabularies allow.
CUTS = " \t\n\x0b\x0c\r"
#: An id pair is one number: the id of A times this, plus the id of B.
PAIR = 1 << 24


def pack(**columns: np.ndarray | pa.Array) -> bytes:
    """Arrays of any lengths as compressed Arrow buffers, whole numbers in as few bytes as they need."""
    row = {}
    for name, x in columns.items():
        if isinstance(x, np.ndarray):
            x = pa.array(x if x.dtype == bool or x.min(initial=0) < 0 else x.astype(np.min_scalar_type(x.max(initial=0))))
        row[name] = pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x)
    table, sink = pa.table(row), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, pa.Array]:
    table = pa.ipc.open_stream(data).read_all()
    return {c: table.column(c).combine_chunks().flatten() for c in table.column_names}


def number(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64)


class Pair:
    """Both tokenizers, the bytes of their tokens, and where texts can be cut for both."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.bytes_a = _by_id({i: bytes(to_byte[c] for c in s) for s, i in spec["model"]["vocab"].items()})
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.name != "identity" or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the second vocabulary changes texts, so segments cannot stand for them")
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("the first vocabulary is not a plain byte-level one")
        rules.add_dummy_prefix = False  # the space before the text is part of its first segment
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bytes_b = _by_id({i: _piece(p.piece) for i, p in enumerate(model.pieces)})
        entries = [x.decode(errors="replace") for x in (*self.bytes_a, *self.bytes_b) if len(x) > 1]  # parts of letters count as letters
        self.cuts = [c for c in CUTS if not any(re.search(r"\S" + re.escape(c), x) for x in entries)]
        self.cut = re.compile(rf"(?<=\S)(?=[{re.escape(''.join(self.cuts))}])") if self.cuts else None
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def split(self, text: str) -> list[str]:
        """Segments of the text behind one space; none of the empty text."""
        if not text:
            return []
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def align(self, segments: list[str]) -> pa.Table:
        """Per segment: `valid`, ids `a` and `b`, and how many of them each group takes (`in_a`, `in_b`).

        Groups end where a token of A and one of B end on the same byte. A segment whose tokens do not
        spell its own bytes is not valid and has none.
        """
        raw = [s.encode() for s in segments]
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode(segments, num_threads=1) if segments else []
        valid = [
            b"".join([self.bytes_a[i] for i in x]) == r and b"".join([self.bytes_b[i] for i in y]) == r
            for r, x, y in zip(raw, a, b, strict=True)
        ]
        a = [x if ok else [] for x, ok in zip(a, valid, strict=True)]
        b = [x if ok else [] for x, ok in zip(b, valid, strict=True)]
        ids_a, in_a = _flat(a)
        ids_b, in_b = _flat(b)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        stops = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a = np.bincount(np.searchsorted(stops, ends_a), minlength=len(stops))
        group_b = np.bincount(np.searchsorted(stops, ends_b), minlength=len(stops))
        sizes = np.array([len(r) if ok else 0 for r, ok in zip(raw, valid, strict=True)], np.int64)
        upto = np.searchsorted(stops, np.cumsum(sizes), side="right")
        groups = np.diff(np.r_[0, upto])
        return pa.table({"valid": pa.array(valid, pa.bool_()), "a": lists(ids_a, in_a), "b": lists(ids_b, in_b), "in_a": lists(group_a, groups), "in_b": lists(group_b, groups)})


def _by_id(entries: dict[int, bytes]) -> list[bytes]:
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def _piece(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum())), sizes


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """int32 lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int32()))


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    """Both vocabularies, read once per worker process."""
    return Pair(path_a, path_b)


# -- 1: documents as places of segments --------------------------------------------------------
def segment_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`block`, `docs` (ids and numbers of segments), `places`, `segments`: about BLOCK_CHARS of texts a row."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, first = tokenizers(path_a, path_b).split, TaskContext.get().partitionId() << 32
        index: dict[str, int] = {}
        ids, sizes, places, chars = [], [], array("i"), 0

        def block() -> pa.RecordBatch:
            nonlocal index, ids, sizes, places, chars, first
            docs = pack(id=pa.concat_arrays(ids), n=np.array(sizes, np.int64))
            row = [docs, pack(k=np.frombuffer(places, np.int32)), pack(s=pa.array(list(index), pa.string()))]
            out = pa.RecordBatch.from_arrays([pa.array([first]), *(pa.array([x], pa.binary()) for x in row)], names=["block", "docs", "places", "segments"])
            index, ids, sizes, places, chars, first = {}, [], [], array("i"), 0, first + 1
            return out

        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = split(text)
                places.extend([index.setdefault(s, len(index)) for s in found])
                ids.append(batch.column(0).slice(k, 1))
                sizes.append(len(found))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield block()
        if ids:
            yield block()

    return src.mapInArrow(run, "block bigint, docs binary, places binary, segments binary")


# -- 2: distinct segments ----------------------------------------------------------------------
_RAGGED = {"a": "n_a", "b": "n_b", "in_a": "n_groups", "in_b": "n_groups"}


def _packed(found: pa.Table) -> bytes:
    """Alignments as flat arrays and their sizes."""
    columns = {c: found.column(c).combine_chunks() for c in found.column_names}
    flat = {c: number(columns[c].flatten()) for c in _RAGGED}
    sizes = {n: _sizes(columns[c]) for c, n in _RAGGED.items()}
    return pack(valid=number(columns["valid"]).astype(bool), **flat, **sizes)


def align_segments(blocks: DataFrame, buckets: int, path_a: str, path_b: str) -> DataFrame:
    """Rows of a bucket: for each block `places` (of its segments in the block and in the bucket) and
    their alignments `found`; and one row of the block -1 - bucket, with all its distinct segments."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segments = unpack(data.as_py())["s"]
                bucket = np.fromiter((crc32(s.encode()) % buckets for s in segments.to_pylist()), np.int64, len(segments))
                for k in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == k)
                    part = pack(step=np.diff(np.r_[0, at]), s=segments.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([k], pa.int32()), pa.array([part])], names=["block", "bucket", "part"])

    def align(key, rows):
        bucket = key[0].as_py()
        parts = [unpack(x.as_py()) for x in rows.column("part")]
        once = pa.chunked_array([p["s"] for p in parts], pa.string()).combine_chunks().dictionary_encode()
        found = tokenizers(path_a, path_b).align(once.dictionary.to_pylist())
        out, at = [(-1 - bucket, pack(), _packed(found))], 0
        for block, part in zip(rows.column("block").to_pylist(), parts, strict=True):
            own = once.indices.slice(at, len(part["s"]))
            at += len(own)
            out.append((block, pack(step=number(part["step"]), at=number(own)), _packed(found.take(own))))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
        return pa.Table.from_arrays([pa.array([bucket] * len(out), pa.int32()), *columns], names=["bucket", "block", "places", "found"])

    dealt = blocks.select("block", "segments").mapInArrow(deal, "block bigint, bucket int, part binary")
    return dealt.groupBy("bucket").applyInArrow(align, "bucket int, block bigint, places binary, found binary")


# -- 3: documents ------------------------------------------------------------------------------
class Segments:
    """Alignments of segments, in the order of the places `at` that they are given for."""

    def __init__(self, parts: list[dict[str, pa.Array]], at: np.ndarray | None = None) -> None:
        all_of = lambda c: np.concatenate([number(p[c]) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable") if at is not None else np.arange(len(all_of("valid")))
        self.valid = all_of("valid")[order] > 0
        self.n_a, self.n_b, self.n_groups = (all_of(c)[order] for c in ("n_a", "n_b", "n_groups"))
        self.a, self.b, self.in_a, self.in_b = (lists(all_of(c), all_of(n)).take(pa.array(order)).flatten() for c, n in _RAGGED.items())

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked id pairs end to end, and how many each segment has, repeats included."""
        ga, gb = number(self.in_a), number(self.in_b)
        width = np.repeat(gb, ga)  # per token of A: tokens of B in its group
        first = np.repeat(np.cumsum(gb) - gb, ga) - (np.cumsum(width) - width)
        left = np.repeat(number(self.a), width)
        right = number(self.b)[np.repeat(first, width) + np.arange(len(left))]
        return left * PAIR + right, _spans(ga * gb, np.cumsum(self.n_groups))

    def texts(self) -> pa.Array:
        """Each segment's groups as text, `a1,a2|b1;a3|b2`."""
        join = lambda ids, sizes, sign: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), ids), sign)
        left = join(self.a.cast(pa.string()), number(self.in_a), ",")
        right = join(self.b.cast(pa.string()), number(self.in_b), ",")
        return join(pc.binary_join_element_wise(left, right, "|"), self.n_groups, ";")


def _sizes(column: pa.ListArray) -> np.ndarray:
    return number(pc.list_value_length(column))


def _spans(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of `values` up to each end from the end before it."""
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, ends]])


def _documents(row: dict[str, pa.Array]) -> tuple[pa.Array, np.ndarray]:
    return row["id"], np.cumsum(number(row["n"]))


#: Kinds of rows of `compose`.
DOCUMENT, LINKED, HOLDS, DISTINCT = range(4)


def compose(blocks: DataFrame, aligned: DataFrame, id_type: str, digest: bool = True) -> DataFrame:
    """Rows of four `kind`s: DOCUMENT (`id`, `block`, `place` in it, `n_a` ... `groups`, of which only the SHA-256
    with `digest`); LINKED, per block an id `pair` and the number `n` of its documents that hold it; and what
    `weigh` needs of the alignments: HOLDS, for a `block` and `bucket` the places in both, and DISTINCT, the
    alignments of a bucket's segments."""
    schema = "kind tinyint, block bigint, bucket int, data binary, pair bigint, n bigint, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = dict(zip(names, (pa.int8(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()), strict=True))

    def run(key, left, right):
        def rows(kind: int, size: int, block: int | None, **columns) -> pa.Table:
            """`size` rows of one kind; columns not given are null."""
            known = {"kind": [kind] * size, "block": [block] * size} | columns
            found = {c: pa.array(known[c], t) if c in known else pa.nulls(size, t) for c, t in kinds.items()}
            return pa.table({"id": known["id"] if "id" in known else pa.nulls(size, id_kind), **found})

        block = key[0].as_py()
        if block < 0:
            return rows(DISTINCT, 1, None, bucket=[-1 - block], data=[right.column("found")[0].as_py()])
        parts = [unpack(f.as_py()) for f in right.column("found")]
        places = [x.as_py() for x in right.column("places")]
        at = np.concatenate([np.cumsum(number(unpack(x)["step"])) for x in places]) if places else np.zeros(0, np.int64)
        seg = Segments(parts, at)
        ids, ends = _documents(unpack(left.column("docs")[0].as_py()))
        of = number(unpack(left.column("places")[0].as_py())["k"])
        good = _spans(~seg.valid[of], ends) == 0
        pairs, n_links = seg.links()
        totals = {c: np.where(good, _spans(x[of], ends), 0) for c, x in (("n_a", seg.n_a), ("n_b", seg.n_b), ("n_groups", seg.n_groups), ("n_links", n_links))}
        known, code = np.unique(pairs, return_inverse=True)
        held = _documents_with(of, ends, good, n_links, code.astype(np.int32), len(known))
        some = held > 0
        found = rows(DOCUMENT, len(ends), block, id=ids, place=np.arange(len(ends)), groups=_group_texts(of, ends, good, seg.texts(), digest), **totals)
        known, held = known[some], held[some]
        linked = [rows(LINKED, len(known[k : k + SENT]), None, pair=known[k : k + SENT], n=held[k : k + SENT]) for k in range(0, len(known), SENT)]
        return pa.concat_tables([found, *linked, rows(HOLDS, len(places), block, bucket=right.column("bucket").to_pylist(), data=places)])

    id_kind = pa_type(id_type)
    left = blocks.select("block", "docs", "places").groupBy("block")
    return left.cogroup(aligned.groupBy("block")).applyInArrow(run, f"id {id_type}, {schema}")


def pa_type(ddl: str) -> pa.DataType:
    """Arrow type of a column."""
    return to_arrow_schema(StructType.fromDDL(f"x {ddl}")).field("x").type


def _documents_with(of: np.ndarray, ends: np.ndarray, good: np.ndarray, n_links: np.ndarray, code: np.ndarray, known: int) -> np.ndarray:
    """For each known pair, how many good documents hold it."""
    held, seen_seg, seen = np.zeros(known, np.int64), np.zeros(len(n_links), np.int32), np.zeros(known, np.int32)
    first = np.cumsum(n_links) - n_links
    for begin, end, ok in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), good.tolist(), strict=True):
        if not ok or begin == end:
            continue
        s = of[begin:end]
        order = np.arange(len(s), dtype=np.int32)
        seen_seg[s] = order  # the last of equal ones stays
        s = s[seen_seg[s] == order]
        width = n_links[s]
        c = code[np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width - first[s], width)]
        order = np.arange(len(c), dtype=np.int32)
        seen[c] = order
        held[c[seen[c] == order]] += 1
    return held


def _group_texts(of: np.ndarray, ends: np.ndarray, good: np.ndarray, texts: pa.Array, digest: bool) -> list[str]:
    """Groups of each document, joined; empty for those without tokens. Some documents at a time."""
    out: list[str] = []
    starts = np.r_[0, ends[:-1]]
    doc = 0
    while doc < len(ends):
        upto = max(doc + 1, int(np.searchsorted(ends, starts[doc] + COMPOSED, side="right")))
        some = texts.take(pa.array(of[starts[doc] : ends[upto - 1]]))
        bounds = pa.array(np.r_[0, ends[doc:upto] - starts[doc]], pa.int32())
        for text, ok in zip(pc.binary_join(pa.ListArray.from_arrays(bounds, some), ";"), good[doc:upto].tolist(), strict=True):
            text = text.as_py() if ok else ""
            out.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
        doc = upto
    return out


# -- 4: counts of the corpus -------------------------------------------------------------------
def weigh(blocks: DataFrame, composed: DataFrame) -> DataFrame:
    """`block`, `place`, `n_best`, `count_sum` of every document.

    A bucket asks for the counts of its different pairs and adds them up over the links of each distinct
    segment, once; the sums go to the blocks that hold it, and there to the documents.
    """
    counts = composed.filter(F.col("kind") == LINKED).groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / PAIR))
    table = counts.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("long"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.unique(Segments([unpack(data.as_py())]).links()[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket), pa.int32()), pa.array(own)], names=["bucket", "pair"])

    distinct = composed.filter(F.col("kind") == DISTINCT).select("bucket", "data")
    priced = distinct.mapInArrow(pairs, "bucket int, pair bigint").join(table, "pair")

    def to_blocks(key, left, right):
        order = np.argsort(number(right.column("pair").combine_chunks()))
        price = {c: number(right.column(c).combine_chunks())[order] for c in ("pair", "best", "n")}
        kind = number(left.column("kind").combine_chunks())
        data = [unpack(x.as_py()) for x in left.column("data")]
        links, n_links = Segments([data[k] for k in np.flatnonzero(kind == DISTINCT).tolist()]).links()
        # pairs without a count stand only in documents that have no tokens
        at = np.minimum(np.searchsorted(price["pair"], links), max(0, len(price["pair"]) - 1))
        known = price["pair"][at] == links if len(price["pair"]) else np.zeros(len(links), bool)
        best, total = (_spans(np.where(known, price[c][at], 0) if len(price["pair"]) else np.zeros(len(links), np.int64), np.cumsum(n_links)) for c in ("best", "n"))
        out = []
        for k in np.flatnonzero(kind == HOLDS).tolist():
            own = number(data[k]["at"])
            out.append(pack(step=number(data[k]["step"]), n_best=best[own], count_sum=total[own]))
        block = left.column("block").combine_chunks().filter(pa.array(kind == HOLDS))
        return pa.Table.from_arrays([block, pa.array(out, pa.binary())], names=["block", "sums"])

    left = composed.filter(F.col("kind").isin(HOLDS, DISTINCT)).select("kind", "bucket", "block", "data").groupBy("bucket")
    shares = left.cogroup(priced.groupBy("bucket")).applyInArrow(to_blocks, "block bigint, sums binary")

    def to_docs(key, left, right):
        parts = [unpack(x.as_py()) for x in right.column("sums")]
        of = number(unpack(left.column("places")[0].as_py())["k"])
        _, ends = _documents(unpack(left.column("docs")[0].as_py()))
        found = {}
        for c in ("n_best", "count_sum"):
            per_segment = np.zeros(sum(len(p[c]) for p in parts), np.int64)
            for p in parts:
                per_segment[np.cumsum(number(p["step"]))] = number(p[c])
            found[c] = _spans(per_segment[of], ends)
        n = len(ends)
        return pa.table({"block": pa.array([key[0].as_py()] * n, pa.int64()), "place": pa.array(np.arange(n), pa.int32()), **found})

    docs = blocks.select("block", "docs", "places").groupBy("block")
    return docs.cogroup(shares.groupBy("block")).applyInArrow(to_docs, "block bigint, place int, n_best bigint, count_sum bigint")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row per row of `docs`: `id_col`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum` and `groups`.

    `path_a` is a byte-level vocabulary of the tokenizers library, `path_b` a SentencePiece model; both
    encode a space and the text, strings of special tokens being text. `groups` reads
    `a1,a2|b1;a3|b2,b3`, with `digest` its SHA-256 (of documents with tokens). All pairs of an A token
    and a B token of one group are links; the count of an id pair is the number of rows that hold it.
    `n_best` counts links whose count is the highest of their A id, `count_sum` adds the counts up.

    A null or empty text, or one that either vocabulary does not spell byte for byte (as one with the
    sign U+2581), has no tokens: zeros and an empty `groups`. Repeated rows are documents of their own; ids
    may be null; an empty table gives an empty result; no other column is read. A text of any length is
    cut and put together in one task.
    """
    id_type = dict(docs.dtypes)[id_col]
    blocks = settle_bucketed(segment_blocks(docs, path_a, path_b, id_col, text_col), "block")
    buckets = max(LEAST_BUCKETS, -(-blocks.count() // BLOCKS_A_BUCKET))
    composed = settle(compose(blocks, align_segments(blocks, buckets, path_a, path_b), id_type, digest), columnar=True)
    weights = settle(weigh(blocks, composed), columnar=True)
    release(blocks)
    rows = composed.filter(F.col("kind") == DOCUMENT).join(weights, ["block", "place"])
    none = F.col("n_links") == 0  # a document without tokens keeps its segments' sums to itself
    return rows.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        *(F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("n_best", "count_sum")), "groups",
    )
