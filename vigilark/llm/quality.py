"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A text is one sparse vector: hashed words by term frequency, standardised statistics of its
structure (case, signs, repetition, word lengths, lines) and its size as metadata. The machine
has a weight for each feature and a low-rank weight for each pair of features; the pair term is
computed in linear time as half the squared sum less the sum of squares, factor by factor.

No labelled text is empty or made of signs alone, so the machine would only extrapolate there. Such
texts are put into the training as low in quality: the empty one, and training texts with all letters
and digits taken out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from vigilark.llm._arrow import map_texts
from vigilark.llm._labelled import labelled_sample

BUCKET_BITS, RANK = 12, 6
#: Bound of the training sample, in documents of each class.
MAX_DOCS = 1500
#: Training texts of each class that are also shown without their letters, and the weight of all these.
BLANKS, BLANK_SHARE = 60, 0.05
STATISTICS = (
    "upper", "digit", "sign", "shout", "bar", "scribble", "white", "line", "non_ascii", "word_mean", "word_spread",
    "repeated_next", "distinct", "commonest", "sentence_ends", "log_words", "log_chars", "is_empty",
)

_WHITE, _UPPER, _DIGIT, _LETTER, _SIGN = (np.zeros(256, bool) for _ in range(5))
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN[33:127] = ~(_LETTER | _DIGIT)[33:127]
_BASE = np.uint64(0x100000001B3)
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)


def _power_table(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


@dataclass
class Rows:
    """Sparse rows: for each entry its row, hashed-word feature and value; and dense statistics."""

    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def featurise(texts: list[str]) -> Rows:
    raw = [t.encode() for t in texts]
    n = len(raw)
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    size = np.fromiter(map(len, raw), np.int64, n)
    end = np.cumsum(size + 1)
    begin = end - size - 1
    counted = lambda mask: np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)[end - 1]])
    chars = np.maximum(size, 1)
    white = _WHITE[flat]
    word_at = np.flatnonzero(~white & np.r_[True, white[:-1]])
    word_end = np.flatnonzero(white & np.r_[False, ~white[:-1]])
    doc = np.searchsorted(end, word_at, side="right")
    length = word_end - word_at
    # polynomial hash of each lower-cased word, summed back to front so that its place cancels
    hashed = np.zeros(len(word_at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(min(length.max(initial=0), 24))):
            inside = length > k
            hashed[inside] = hashed[inside] * _BASE + _FOLD[flat[word_at[inside] + k]] + np.uint64(1)
        for k in np.flatnonzero(length > 24).tolist():  # long words are rare
            rest = _FOLD[flat[word_at[k] + 24 : word_end[k]]] + np.uint64(1)
            hashed[k] = hashed[k] * _BASE + (rest * _power_table(len(rest))).sum(dtype=np.uint64)
        mixed = hashed * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    key, count = np.unique((doc << BUCKET_BITS) | bucket, return_counts=True)
    row = key >> BUCKET_BITS
    same_next = np.r_[(hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1]), False] if len(doc) else np.zeros(0, bool)
    last = flat[word_end - 1]
    most = np.zeros(n)
    np.maximum.at(most, row, count)
    mean = np.bincount(doc, weights=length, minlength=n) / some
    square = np.bincount(doc, weights=length.astype(float) ** 2, minlength=n) / some
    signs = _SIGN[flat]
    non_ascii = flat >= 0xC0
    dense = np.c_[
        counted(_UPPER[flat]) / chars,
        counted(_DIGIT[flat]) / chars,
        counted(signs) / chars,
        counted(flat == 33) / some,
        counted(flat == 124) / some,
        counted(np.isin(flat, np.frombuffer(b"#$%&*", np.uint8))) / some,
        counted(white) / chars,
        counted(flat == 10) / some,
        counted(non_ascii) / chars,
        np.minimum(mean, 40),
        np.sqrt(np.clip(square - mean**2, 0, 1600)),
        np.bincount(doc, weights=same_next, minlength=n) / some,
        np.bincount(row, minlength=n) / np.minimum(some, 1 << BUCKET_BITS),
        most / some,
        np.bincount(doc, weights=np.isin(last, np.frombuffer(b".!?", np.uint8)), minlength=n) / some,
        np.log1p(words),
        np.log1p(size),
        words == 0,
    ]
    value = np.log1p(count)  # damped term frequency, of unit length in each text
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
    return Rows(row, key & ((1 << BUCKET_BITS) - 1), value / np.maximum(norm, 1e-12)[row], dense)


_WORDY = re.compile(r"[^\W_]+")


def blanks(texts: list[str]) -> list[str]:
    """Texts without words: nothing, white space, and the signs of `texts`: whole, a few of them, and one
    over and over."""
    bare = [_WORDY.sub("", t) for t in texts]
    few = [b.split()[: 1 + k % 7] for k, b in enumerate(bare)]
    return ["", " ", "\n\n", *bare, *map(" ".join, few), *[" ".join(f[:1] * 4 ** (1 + k % 5)) for k, f in enumerate(few)]]


@dataclass
class Factorisation:
    """Bias, weights and factors; hashed words come first, statistics follow."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.spread, -4, 4)

    def parts(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decision values, per-factor sums, and the scaled statistics."""
        words, n = 1 << BUCKET_BITS, len(rows.dense)
        x = self.scaled(rows.dense)
        gather = lambda v: np.bincount(rows.row, weights=v, minlength=n)
        linear = self.bias + gather(rows.value * self.weight[rows.bucket]) + x @ self.weight[words:]
        sums, squares = x @ self.factor[words:], (x**2) @ (self.factor[words:] ** 2)
        for f in range(self.factor.shape[1]):
            v = rows.value * self.factor[rows.bucket, f]
            sums[:, f] += gather(v)
            squares[:, f] += gather(v * v)
        return linear + 0.5 * (sums**2 - squares).sum(1), sums, x

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.parts(featurise(texts))[0], -30, 30)))


def fit_factorisation(
    rows: list[tuple[str, int]], totals: dict[int, int] | None = None, epochs: int = 150, seed: int = 11
) -> Factorisation:
    """Logistic loss with weight decay, by Adam over the whole (bounded) sample.

    Each class weighs what it stands for in `totals`, tempered by a square root. With a class
    missing, every text gets the score of the class there is.
    """
    words, width = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + len(STATISTICS)
    labels = np.array([label for _, label in rows], float)
    blank = Factorisation(0.0, np.zeros(width), np.zeros((width, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if len(set(labels.tolist())) < 2:
        blank.bias = 3.0 if len(labels) and labels[0] else -3.0 if len(labels) else 0.0
        return blank
    some = [[t for t, label in rows if label == k][:BLANKS] for k in (0, 1)]
    empty = blanks(some[0] + some[1])
    data = featurise([t for t, _ in rows] + empty)
    real = data.dense[: len(rows)]
    rng = np.random.default_rng(seed)
    spread = real.std(0)
    m = Factorisation(
        float(np.log(labels.mean() / (1 - labels.mean()))),
        np.zeros(width),
        rng.normal(0, 0.01, (width, RANK)),
        real.mean(0),
        np.where(spread > 1e-9, spread, 1.0),
    )
    drawn = {k: float((labels == k).sum()) for k in (0, 1)}
    stands = {k: ((totals or drawn).get(k, drawn[k]) / drawn[k]) ** 0.5 for k in (0, 1)}
    share = np.where(labels > 0, stands[1], stands[0])
    share = np.r_[share * (1 - BLANK_SHARE) / share.sum(), np.full(len(empty), BLANK_SHARE / len(empty))]
    labels = np.r_[labels, np.zeros(len(empty))]
    params = [np.zeros(1), m.weight, m.factor]
    params[0][0] = m.bias
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, epochs + 1):
        m.bias = float(params[0][0])
        z, sums, x = m.parts(data)
        err = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        spread_err = err[data.row] * data.value
        g_weight = np.r_[np.bincount(data.bucket, weights=spread_err, minlength=words), x.T @ err]
        g_factor = np.empty_like(m.factor)
        own = np.bincount(data.bucket, weights=spread_err * data.value, minlength=words)
        for f in range(RANK):
            g_factor[:words, f] = np.bincount(data.bucket, weights=spread_err * sums[data.row, f], minlength=words)
        g_factor[:words] -= own[:, None] * m.factor[:words]
        g_factor[words:] = x.T @ (err[:, None] * sums) - (x**2).T @ err[:, None] * m.factor[words:]
        grads = [np.array([err.sum()]), g_weight + 1e-4 * m.weight, g_factor + 1e-4 * m.factor]
        for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    m.bias = float(params[0][0])
    return m


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", max_docs: int = MAX_DOCS) -> Factorisation:
    """Fit on at most `max_docs` documents of each class whose labels are `usable`."""
    return fit_factorisation(*labelled_sample(docs, labels, label_col, usable, max_docs))


def score_quality(docs: DataFrame, machine: Factorisation, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `score` (0 to 1) of every whole text.

    A null text counts as empty; empty texts and those of signs alone score low; repeated rows are
    scored each; an empty table gives an empty result; no other column is read.
    """

    def make():
        return lambda texts: [pa.array(machine.score(texts), pa.float64())]

    return map_texts(docs, make, "score double", id_col, text_col)
