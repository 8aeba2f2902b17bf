"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is cut at content-defined anchors: of any 25 successive runs of 26 words the one
with the least hash is an anchor, so two documents that share 50 words in a row share an anchor
there. An anchor's reference block is where it stands in the smallest document. Parsing a document
against these blocks is greedy: successive anchors that follow each other in the same way in one
smaller document are one match, which is then extended word by word on both sides, against the words
of the reference block, as far as these agree. Such a longest match is a factor; if it has at least
50 words all of them are duplicates. What a factor cannot tell is settled at its boundaries: windows
that hold a shared anchor and reach beyond all factors are hashed and looked up among all
documents. The smallest document that holds a window never has it inside a factor, so it is always
there.

Anchors and windows are compared by two independent 64-bit hashes, words of an extension by one: with
n windows looked up, about n * n / 2**129 pairs of different windows may collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm import _words
from vigilark.llm._arrow import chunks
from vigilark.llm._tables import release, settle

WINDOW = 50
RUN = 26  # words of an anchor; WINDOW - RUN + 1 runs fit in a window
#: Words that a match is extended by at most on each side. Beyond, another shared anchor goes on.
EXTENT = WINDOW
#: Bits of the filter that keeps the texts of documents without shared anchors from being moved.
FILTER_BITS = 1 << 24
#: A key that more than one in HOT rows hold is joined by broadcast; there are fewer than HOT of these.
HOT = 2000


def anchors_of(runs: np.ndarray, span: int) -> np.ndarray:
    """Places of the least of any `span` successive run hashes, leftmost of equals."""
    if len(runs) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))


def digest(words: Iterator[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])]
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _two_runs(words: _words.Words) -> tuple[np.ndarray, _words.Runs, _words.Runs]:
    """Hashes of the words, and both kinds of hashes of runs of them."""
    first, second = _words.hashes(words)
    return first, _words.Runs(first), _words.Runs(second, _words.Runs.STEPS[1])


def _parse(docs: DataFrame) -> DataFrame:
    """id, mark (hash of the text), n_words, sha256 of all words, anchors' hashes and places."""
    names = ["id", "mark", "n_words", "whole", "hashes", "checks", "places"]

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in chunks(texts, 1_000_000):
                own = texts[part]
                words = _words.split(own)
                ends = np.cumsum(words.counts)
                _, runs, more = _two_runs(words)
                found, second, at = [], [], []
                for a, b in zip((ends - words.counts).tolist(), ends.tolist(), strict=True):
                    h = runs.of(np.arange(a, max(a, b - RUN + 1)), RUN) if b - a >= WINDOW else np.zeros(0, np.uint64)
                    p = anchors_of(h, WINDOW - RUN + 1)
                    found.append(h[p].view(np.int64))
                    second.append(more.of(p + a, RUN).view(np.int64))
                    at.append(p)
                whole = [digest(t.encode().split()) for t in own]
                n = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, n), batch.column(1).slice(part.start, n),
                     pa.array(words.counts, pa.int64()), pa.array(whole), _lists(found, pa.int64()), _lists(second, pa.int64()), _lists(at, pa.int32())],
                    names=names,
                )

    id_type = dict(docs.dtypes)["id"]
    schema = f"id {id_type}, mark bigint, n_words bigint, whole string, hashes array<bigint>, checks array<bigint>, places array<int>"
    return docs.mapInArrow(run, schema)


def chains(row: np.ndarray, place: np.ndarray, ref: np.ndarray, ref_mark: np.ndarray, ref_place: np.ndarray) -> np.ndarray:
    """Matches before they are extended, from anchors that stand in smaller documents: a line for each with
    the row, first word, end, and the reference's id, mark, first word and end.

    Anchors of a row follow each other in a match if they stand in one document at the same distance and
    leave no word between them.
    """
    order = np.lexsort((place, row))
    row, place, ref, ref_mark, shift = (x[order] for x in (row, place, ref, ref_mark, place - ref_place))
    same = np.ones(max(0, len(row) - 1), bool)
    for x in (row, ref, ref_mark, shift):
        same &= x[1:] == x[:-1]
    first = np.flatnonzero(np.r_[True, ~(same & (np.diff(place) <= RUN))]) if len(row) else np.zeros(0, np.int64)
    last = np.r_[first[1:] - 1, len(row) - 1] if len(row) else first
    begin, end = place[first], place[last] + RUN
    return np.c_[row[first], begin, end, ref[first], ref_mark[first], begin - shift[first], end - shift[first]]


def _numbers(column: pa.Array) -> np.ndarray:
    """Lengths of the lists of a column, 0 for null."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _chained(occ: DataFrame) -> DataFrame:
    """One row per match of a document: `id`, `mark`, places there and in its reference."""
    names = ["begin", "end", "ref", "ref_mark", "ref_begin", "ref_end"]

    def run(batches):
        for batch in batches:
            cells, ids = batch.column(2).flatten(), batch.column(0).to_numpy()
            row = np.repeat(np.arange(len(batch)), _numbers(batch.column(2)))
            place, ref, ref_mark, ref_place = (cells.field(c).to_numpy().astype(np.int64) for c in ("place", "ref", "ref_mark", "ref_place"))
            copied = ref < ids[row]
            found = chains(*(x[copied] for x in (row, place, ref, ref_mark, ref_place)))
            own = batch.select([0, 1]).take(pa.array(found[:, 0]))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(found[:, k]) for k in range(1, 7))], names=["id", "mark", *names])

    return occ.select("id", "mark", "occ").mapInArrow(run, "id bigint, mark bigint, " + ", ".join(f"{c} bigint" for c in names))


def _contexts(wanted: DataFrame) -> DataFrame:
    """Hashes of the words around places of the reference blocks: those before a match's first word
    (`after` false) or from its end on. `wanted` holds `id`, `mark`, `text` and `edges`."""
    names = ["ref", "ref_mark", "at", "after", "words"]

    def run(batches):
        for batch in batches:
            texts, edges = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for part in chunks(texts, 1_000_000):
                words = _words.split(texts[part])
                ends = np.cumsum(words.counts)
                flat = _words.hashes(words, _words.SEEDS[:1])[0].view(np.int64)
                row, at, after, found = [], [], [], []
                for k, (end, n, es) in enumerate(zip(ends.tolist(), words.counts.tolist(), edges[part], strict=True)):
                    own = flat[end - n : end]
                    for e in es:
                        row.append(part.start + k)
                        at.append(e["at"])
                        after.append(e["after"])
                        found.append(own[e["at"] : e["at"] + EXTENT] if e["after"] else own[max(0, e["at"] - EXTENT) : e["at"]])
                home = batch.select([0, 1]).take(pa.array(np.array(row, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [home.column(0), home.column(1), pa.array(at, pa.int64()), pa.array(after, pa.bool_()), _lists(found, pa.int64())], names=names
                )

    return wanted.select("id", "mark", "text", "edges").mapInArrow(run, "ref bigint, ref_mark bigint, at bigint, after boolean, words array<bigint>")


def extended(own: np.ndarray, begin: int, end: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """A match as long as the words before and behind it agree with those of its reference."""
    mine, theirs = own[max(0, begin - len(left)) : begin][::-1], left[::-1]
    n = min(len(mine), len(theirs))
    differ = np.flatnonzero(mine[:n] != theirs[:n])
    begin -= int(differ[0]) if len(differ) else n
    mine, theirs = own[end : end + len(right)], right
    n = min(len(mine), len(theirs))
    differ = np.flatnonzero(mine[:n] != theirs[:n])
    return begin, end + (int(differ[0]) if len(differ) else n)


def boundary_windows(places: np.ndarray, factors: np.ndarray, n: int) -> np.ndarray:
    """First words of the windows that hold an anchor and are inside no factor, of `n` words."""
    look = np.unique((places[:, None] - np.arange(WINDOW - RUN + 1)[None, :]).ravel())
    look = look[(look >= 0) & (look + WINDOW <= n)]
    step = np.zeros(n + 2, np.int64)
    long = factors[factors[:, 1] - factors[:, 0] >= WINDOW]
    np.add.at(step, long[:, 0], 1)
    np.add.at(step, long[:, 1] - WINDOW + 1, -1)
    return look[np.cumsum(step)[look] == 0]


def _check(docs: DataFrame) -> DataFrame:
    """Per document with shared anchors: its long factors and the windows to look up."""
    names = ["id", "mark", "text", "begins", "ends", "starts", "keys", "checks"]

    def run(batches):
        for batch in batches:
            texts, occs = batch.column(2).to_pylist(), batch.column(3)
            # the matches of all rows end to end, as arrays: their words are never Python objects
            first = np.r_[0, np.cumsum(_numbers(batch.column(4)))]
            cells = batch.column(4).flatten()
            begins, ends = (cells.field(c).to_numpy().astype(np.int64) for c in ("begin", "end"))
            sides = []
            for c in ("left", "right"):
                lists = cells.field(c)
                sides.append((np.r_[0, np.cumsum(_numbers(lists))], lists.flatten().to_numpy(zero_copy_only=False)))
            around = lambda k, m: sides[k][1][sides[k][0][m] : sides[k][0][m + 1]]
            for part in chunks(texts, 1_000_000):
                words = _words.split(texts[part])
                stop = np.cumsum(words.counts)
                flat, runs, more = _two_runs(words)
                flat = flat.view(np.int64)
                spans, starts, keys, checks = [], [], [], []
                for k, (n, end) in enumerate(zip(words.counts.tolist(), stop.tolist(), strict=True), part.start):
                    own = flat[end - n : end]
                    rows = [extended(own, int(begins[m]), int(ends[m]), around(0, m), around(1, m)) for m in range(first[k], first[k + 1])]
                    factors = np.array(sorted(set(rows)), np.int64).reshape(-1, 2)
                    look = boundary_windows(occs[k].values.to_numpy().astype(np.int64), factors, n)
                    starts.append(look)
                    keys.append(runs.of(look + (end - n), WINDOW).view(np.int64))
                    checks.append(more.of(look + (end - n), WINDOW).view(np.int64))
                    spans.append(factors[factors[:, 1] - factors[:, 0] >= WINDOW])
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(part.start, size) for k in range(3)]
                    + [_lists([s[:, 0] for s in spans], pa.int32()), _lists([s[:, 1] for s in spans], pa.int32()),
                       _lists(starts, pa.int32()), _lists(keys, pa.int64()), _lists(checks, pa.int64())],
                    names=names,
                )

    schema = (
        "id bigint, mark bigint, text string, begins array<int>, ends array<int>, starts array<int>, keys array<bigint>, checks array<bigint>"
    )
    return docs.select("id", "mark", "text", F.transform("occ", lambda o: o["place"]).alias("places"), "matches").mapInArrow(run, schema)


def _remove(docs: DataFrame) -> DataFrame:
    """Apply spans and found windows to the texts."""
    names = ["id", "mark", "n_removed", "kept", "removed"]

    def run(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            n_removed, kept, removed = [], [], []
            for text, begins, ends, starts in zip(*cols[2:], strict=True):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, begins, 1)
                np.add.at(step, ends, -1)
                if starts:
                    np.add.at(step, starts, 1)
                    np.add.at(step, np.array(starts) + WINDOW, -1)
                gone = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
                removed.append([{"first": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone)]).decode())
            spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, spans)],
                names=names,
            )

    id_type = dict(docs.dtypes)["id"]
    return docs.select("id", "mark", "text", "begins", "ends", "found").mapInArrow(
        run, f"id {id_type}, mark bigint, n_removed bigint, kept string, removed array<struct<first:bigint,end:bigint>>"
    )


def _present(ids: DataFrame, key: str) -> np.ndarray:
    """A bit set of FILTER_BITS over the hashes of `key`: 2 MB on the driver and in each task at any scale."""
    at = F.pmod(F.col(key), F.lit(FILTER_BITS))
    rows = (
        ids.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS + (1 << 16), bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        begin = (r["part"] - 1) * len(bits) + 1 if r["part"] > 0 else 0
        out[begin : begin + len(bits)] |= bits[: len(out) - begin].astype(bool)
    return np.packbits(out[:FILTER_BITS], bitorder="little")


def _filtered(src: DataFrame, present: np.ndarray) -> DataFrame:
    """Rows whose `mark` may be in the bit set; all rows that are there pass."""

    def may_matter(batches):
        for batch in batches:
            at = np.mod(batch.column(1).to_numpy(), FILTER_BITS)
            yield batch.filter(pa.array((present[at >> 3] >> (at & 7) & 1).astype(bool)))

    return src.mapInArrow(may_matter, src.schema)


def _shared_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join whose right side has a row per key with `n`, the rows of the left that hold it.

    Keys that more than total / HOT rows hold, fewer than HOT, are joined by broadcast, so none
    of the rest has more than that share of a shuffle.
    """
    hot = F.broadcast(right.filter(F.col("n") * HOT > total))
    cold = right.filter(F.col("n") * HOT <= total)
    rest = left.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    return left.join(hot, keys).unionByName(rest).drop("n")


def remove_duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_words`, `n_removed`, `removed` spans, `kept` (null where nothing was removed)
    and `whole` (sha256 of all words joined by one space).

    A word goes if a window of 50 words of its document that covers it also starts in a document
    with a smaller id. Null and empty texts have no words; repeated rows get the same result
    each and do not remove each other; rows with a null id lose nothing and take nothing; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    parsed = settle(_parse(src), columnar=True)
    zipped = parsed.filter("id is not null").select("id", "mark", F.explode(F.arrays_zip("hashes", "checks", "places")).alias("z"))
    anchors = zipped.select("id", "mark", F.col("z.hashes").alias("hash"), F.col("z.checks").alias("check"), F.col("z.places").alias("place"))
    refs = settle(
        anchors.groupBy("hash", "check")
        .agg(F.min(F.struct("id", "place", "mark")).alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        .filter("last > first.id")
        .select("hash", "check", F.col("first.id").alias("ref"), F.col("first.mark").alias("ref_mark"), F.col("first.place").alias("ref_place"), "n"),
        columnar=True,
    )
    held = refs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    occ = settle(
        _shared_join(anchors, refs, ["hash", "check"], held)
        .groupBy("id", "mark")
        .agg(F.collect_set(F.struct("place", "ref", "ref_mark", "ref_place")).alias("occ")),  # bounded by the document
        columnar=True,
    )
    # the matches' ends and what stands there in the reference blocks
    chained = found = settle(_chained(occ), columnar=True)
    edge = lambda at, after: F.struct(F.col(at).alias("at"), F.lit(after).alias("after"))
    asked = found.select("ref", "ref_mark", F.explode(F.array(edge("ref_begin", False), edge("ref_end", True))).alias("e"))
    edges = settle(asked.groupBy("ref", "ref_mark", "e").agg(F.count("*").alias("n")), columnar=True)
    blocks = edges.groupBy(F.col("ref").alias("id"), F.col("ref_mark").alias("mark")).agg(F.collect_list("e").alias("edges"))  # bounded by the document
    sources = _filtered(src, _present(blocks, "mark")).dropDuplicates(["id", "mark"]).join(blocks, ["id", "mark"])
    words_around = around = settle(_contexts(sources), columnar=True)
    counted = edges.select("ref", "ref_mark", F.col("e.at").alias("at"), F.col("e.after").alias("after"), "n")
    around = around.join(counted, ["ref", "ref_mark", "at", "after"])
    total = found.count()
    for after, name, at in ((False, "left", "ref_begin"), (True, "right", "ref_end")):
        words = around.filter(F.col("after") == after).select("ref", "ref_mark", F.col("at").alias(at), F.col("words").alias(name), "n")
        found = _shared_join(found, words, ["ref", "ref_mark", at], total)
    matches = found.groupBy("id", "mark").agg(F.collect_list(F.struct("begin", "end", "left", "right")).alias("matches"))  # bounded by the document
    wanted = _filtered(src, _present(occ, "mark")).dropDuplicates(["id", "mark"])
    checked = settle(_check(wanted.join(occ, ["id", "mark"]).join(matches, ["id", "mark"], "left")), columnar=True)
    release(refs, occ, chained, edges, words_around)
    zipped = checked.select("id", "mark", F.explode(F.arrays_zip("starts", "keys", "checks")).alias("z"))
    windows = zipped.select("id", "mark", F.col("z.starts").alias("start"), F.col("z.keys").alias("key"), F.col("z.checks").alias("check"))
    shared = settle(
        windows.groupBy("key", "check")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        .filter("last > first")
        .select("key", "check", "first", "n"),
        columnar=True,
    )
    held = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    again = _shared_join(windows, shared, ["key", "check"], held).filter("id > first").groupBy("id", "mark").agg(F.collect_set("start").alias("found"))
    spans = checked.select("id", "mark", "text", "begins", "ends").join(again, ["id", "mark"], "left")
    changed = _remove(
        spans.filter((F.size("begins") > 0) | F.col("found").isNotNull()).withColumn(
            "found", F.coalesce("found", F.array().cast("array<int>"))
        )
    )
    return (
        parsed.select("id", "mark", "n_words", "whole")
        .join(changed, ["id", "mark"], "left")
        .select(
            F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), "removed", "kept", "whole"
        )
    )
