"""Byte-pair encoding and decoding by speculation and verification.

A text is cut into pre-tokens (the byte-level pattern of the vocabulary). For every pre-token
not met before, greedy longest match *proposes* tokens; one vectorised pass then checks every
adjacent pair of every proposal, and only pre-tokens with an incompatible pair are merged step
by step. A token sequence is what the merges produce exactly when each token is what they make
of its own bytes and no merge crosses a boundary between neighbours, so the result is exact.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vigilark.llm._arrow import map_texts

#: Fixed value: how byte-level BPE vocabularies cut a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept by the memo of a task; it is emptied when full.
MEMO_ENTRIES = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, inverted.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, get the code
    points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Lookup:
    """A read-only map from non-negative integers to integers, looked up a whole array at a time.

    Keys that share a slot of one table go on to the next, so a few gathers answer any array.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int) -> None:
        self.absent, self.layers = absent, []
        odd = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(len(keys)))) + 2)
            slot = self._slot(keys, odd, bits)
            _, first = np.unique(slot, return_index=True)
            table_k = np.full(1 << bits, -1, np.int64)
            table_v = np.full(1 << bits, absent, np.int64)
            table_k[slot[first]], table_v[slot[first]] = keys[first], values[first]
            self.layers.append((odd, bits, table_k, table_v))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, odd = keys[rest], values[rest], (odd * 5 + 2) % (1 << 64) | 1

    @staticmethod
    def _slot(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.absent, np.int64)
        for odd, bits, table_k, table_v in self.layers:
            slot = self._slot(keys, odd, bits)
            hit = table_k[slot] == keys
            out[hit] = table_v[slot[hit]]
        return out


class Codec:
    """A byte-level BPE vocabulary with the tables that verification needs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.token_bytes[i] = b
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.vocab = vocab
        self.size = size
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank[i, j], self.made[i, j] = r, k
            if self.born[k] < 0:
                self.born[k], self.left[k], self.right[k] = r, i, j
        pairs = np.array([i * size + j for i, j in self.rank], np.int64)
        none = 1 << 60
        self.rank_of = Lookup(pairs, np.array(list(self.rank.values()), np.int64), none)
        self.made_of = Lookup(pairs, np.array(list(self.made.values()), np.int64), -1)
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self._plant(vocab)
        self.pre = regex.compile(PRE_TOKEN)
        self.split_special = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        #: No unit of ordinary text begins with a special token's string, so a mark tells them apart.
        self.special_units = {"\0" + t: np.int32(i).tobytes() for t, i in self.special.items()}
        self.memo: dict[str, bytes] = dict(self.special_units)

    # -- exact merging -------------------------------------------------------------------
    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and token counts of words given as bytes laid end to end.

        Every round merges, in each word, the pair of best rank wherever it stands, leftmost
        first; words without a mergeable pair leave.
        """
        ids, owner = self.byte_id[flat], np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            r = np.full(len(ids), 1 << 60, np.int64)
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            r[inner] = self.rank_of(ids[inner] * self.size + ids[inner + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(r, starts)
            spread = np.repeat(best, np.diff(np.r_[starts, len(ids)]))
            over = spread == 1 << 60
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            at = np.flatnonzero((r == spread) & ~over)
            if len(at):  # of overlapping places, as in "aaa", every second one
                run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
                first = np.flatnonzero(np.r_[True, np.diff(run) != 0])
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            ids = ids.copy()
            ids[at] = self.made_of(ids[at] * self.size + ids[at + 1])
            keep = ~over
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(sizes))

    # -- speculation ---------------------------------------------------------------------
    def _plant(self, vocab: dict[bytes, int]) -> None:
        """The vocabulary as a trie: `step` gives the next node, `ends` the token at a node."""
        nodes: dict[bytes, int] = {b"": 0}
        keys, values = [], []
        for b in sorted(vocab):
            for k in range(1, len(b) + 1):
                if b[:k] not in nodes:
                    nodes[b[:k]] = len(nodes)
                    keys.append(nodes[b[: k - 1]] * 256 + b[k - 1])
                    values.append(nodes[b[:k]])
        self.step = Lookup(np.array(keys, np.int64), np.array(values, np.int64), -1)
        self.ends = np.full(len(nodes), -1, np.int64)
        for b, i in vocab.items():
            if len(b) == 1 or self.born[i] >= 0:
                self.ends[nodes[b]] = i

    def propose(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: tokens and token counts of words laid end to end.

        All words walk the trie in lockstep, one byte a step; a word that can go no further
        takes the longest token met and begins anew behind it.
        """
        stop = np.cumsum(sizes)
        begin = stop - sizes
        live = np.flatnonzero(sizes > 0)
        at, node, look = begin.copy(), np.zeros(len(sizes), np.int64), begin.copy()
        token, reach = np.full(len(sizes), -1, np.int64), begin.copy()
        out_ids, out_owner = [], []
        while len(live):
            pos = look[live]
            inside = pos < stop[live]
            nxt = np.full(len(live), -1, np.int64)
            nxt[inside] = self.step(node[live[inside]] * 256 + flat[pos[inside]])
            go = live[nxt >= 0]
            node[go] = nxt[nxt >= 0]
            look[go] += 1
            end = self.ends[node[go]]
            hit = go[end >= 0]
            token[hit], reach[hit] = end[end >= 0], look[hit]
            halt = live[nxt < 0]
            out_ids.append(token[halt])
            out_owner.append(halt)
            at[halt] = reach[halt]
            look[halt], node[halt] = at[halt], 0
            live = live[at[live] < stop[live]]
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        ids, owner = np.concatenate(out_ids), np.concatenate(out_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(sizes))

    # -- verification --------------------------------------------------------------------
    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: no merge ever crosses the boundary between them.

        Time runs backwards over the ranks. What touches the boundary is the right spine of `a`
        and the left spine of `b`; a crossing merge happens if its rank comes before both
        neighbours are swallowed by their own parents (a tie goes to the left).
        """
        ok = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        x_until = np.full(len(a), 1 << 59, np.int64)
        y_until = x_until.copy()
        live = np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            r = self.rank_of(xs * self.size + ys)
            crossed = (r < x_until[live]) & (r <= y_until[live])
            ok[live[crossed]] = False
            bx, by = self.born[xs], self.born[ys]
            go = ~crossed & ((bx >= 0) | (by >= 0))
            live, xs, ys, bx, by = live[go], xs[go], ys[go], bx[go], by[go]
            down = by >= bx
            i = live[down]
            y_until[i], y[i] = by[down], self.left[ys[down]]
            i = live[~down]
            x_until[i], x[i] = bx[~down], self.right[xs[~down]]
        return ok

    def words(self, words: list[bytes]) -> list[bytes]:
        """Exact tokens of pre-tokens, given as UTF-8 bytes; the ids of each as packed int32."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = self.propose(flat, sizes)
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        keys, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        ok = self.compatible(keys // self.size, keys % self.size)[back]
        bad = np.unique(owner[inner[~ok]])
        out = self._cut(ids, counts)
        if len(bad):
            failing = np.isin(np.arange(len(words)), bad)
            merged = self._cut(*self.merge(flat[np.repeat(failing, sizes)], sizes[bad]))
            for k, tokens in zip(bad.tolist(), merged, strict=True):
                out[k] = tokens
        return out

    @staticmethod
    def _cut(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        packed, ends = ids.astype(np.int32).tobytes(), np.cumsum(counts) * 4
        return [packed[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]

    # -- texts ---------------------------------------------------------------------------
    #: A cut here never falls inside a pre-token: one space between two other characters
    #: always begins the next one.
    unit_cut = re.compile(r" (?=\S)")

    def learn(self, units: set[str]) -> None:
        """Enter the tokens of `units` in the memo, each distinct pre-token handled once."""
        units = list(units)
        cut = [self.pre.findall(u) for u in units]
        index: dict[str, int] = {}
        for words in cut:
            for w in words:
                index.setdefault(w, len(index))
        tokens = self.words([w.encode() for w in index])
        memo = self.memo
        for u, words in zip(units, cut, strict=True):
            if len(words) == 1:
                memo[u] = tokens[index[words[0]]]
            else:
                memo[u] = b"".join([tokens[index[w]] for w in words])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, and how many each has.

        Strings of special tokens become those tokens, whatever stands around them.
        """
        cut: list[list[str]] = []
        for text in texts:
            parts = self.split_special.split(text) if self.split_special else [text]
            units: list[str] = []
            for k, part in enumerate(parts):
                if k % 2:
                    units.append("\0" + part)  # in the memo from the start
                elif part:
                    rest = self.unit_cut.split(part)
                    if rest[0]:
                        units.append(rest[0])
                    units += [" " + u for u in rest[1:]]
            cut.append(units)
        memo = self.memo
        todo = set(chain.from_iterable(cut)).difference(memo)
        if len(memo) + len(todo) > MEMO_ENTRIES:
            memo.clear()
            memo.update(self.special_units)
            todo = set(chain.from_iterable(cut)).difference(memo)
        if todo:
            self.learn(todo)
        packed = [b"".join([memo[u] for u in units]) for units in cut]
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        return np.frombuffer(b"".join(packed), np.int32), counts

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of token ids; bytes that are not UTF-8 become replacement characters."""
        table, ends = self.token_bytes, np.cumsum(counts)
        return [
            b"".join([table[i] for i in ids[a:b].tolist()]).decode("utf-8", "replace")
            for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)
        ]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The vocabulary at `path`, read once per worker process."""
    return Codec(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """`id_col`, `ids array<int>` and, with `decode`, `decoded` (the text of these ids again).

    Null and empty texts get no ids and decode to the empty text; repeated rows are encoded
    each; a text of any length is encoded whole; an empty table gives an empty result. Only the
    two named columns of `docs` are used, so others may be called `ids` or `decoded`.
    """

    def make():
        c = codec(path)

        def work(texts: list[str]) -> list[pa.Array]:
            ids, counts = c.encode_batch(texts)
            offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
            out = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
            return [*out, pa.array(c.decode_batch(ids, counts), pa.string())] if decode else out

        return work

    return map_texts(docs, make, "ids array<int>" + ", decoded string" * decode, id_col, text_col)


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and `text` of token ids; null or empty id lists give the empty text."""
    src = rows.select(id_col, ids_col)
    id_type = dict(src.dtypes)[id_col]

    def run(batches):
        c = codec(path)
        for batch in batches:
            rows = [ids or [] for ids in batch.column(1).to_pylist()]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            texts = c.decode_batch(np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {id_type}, text string")
