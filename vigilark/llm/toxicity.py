"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel.

The kernel of two words counts the letter triples that both hold in the same order, letters in
between allowed: an occurrence that spans `s` letters weighs DECAY ** s, up to MAX_SPAN; it is divided
by the root of each word's kernel with itself. So an insult keeps most of its triples when letters or
signs are put in or a letter is changed. Words
are runs without white space (signs inside do not count) and single letters set apart by white
space are read as one word. Nyström landmarks stand for the training words; after the linear
machine on the Nyström features is fitted, its landmark expansion is folded into one weight per
triple, which gives the same decision values in time linear in the text.

Sentences of labelled documents train it. A toxic label says that a sentence holds an insult,
not which word it is: words that many different sentences of toxic documents share and clean
ones do not are the first guess, then each round takes the words that the machine itself finds
worst in toxic sentences (multiple-instance learning).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from vigilark.llm._arrow import chunks, handing_back, map_texts, text_parts
from vigilark.llm._labelled import labelled_sample
from vigilark.llm._words import SEEDS, byte_hashes

DECAY, MAX_SPAN, LETTERS = 0.7, 6, 32
#: Bounds of the training: labelled documents of each class, distinct words of each class that the
#: machine is fitted on (of more candidates those that tell the classes apart least are left out), landmarks.
MAX_DOCS, MAX_WORDS, LANDMARKS, ROUNDS = 1000, 2000, 128, 2

#: Characters scored together, letters whose norms are made together, and letters of a long word.
SCORE_CHARS, NORM_LETTERS, LONG_WORD = 500_000, 50_000, 4096
MOST_KNOWN = 500_000

_CODES = np.zeros(256, np.uint16)  # 0: neither letter nor white space
for _c in range(26):
    _CODES[97 + _c] = _CODES[65 + _c] = 1 + _c
for _b in range(0x80, 0xC0):  # last bytes of letters beyond ASCII
    _CODES[_b] = 27 + _b % 4
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """Letters of texts, laid end to end, with the word each belongs to."""

    codes: np.ndarray
    owner: np.ndarray  # per letter: word
    doc: np.ndarray  # per word: text
    sizes: np.ndarray  # per word: letters


def words_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    code = _CODES[flat]
    at = np.flatnonzero(code)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint16), empty, empty, empty)
    run = np.cumsum(_WHITE[flat], dtype=np.int32)[at]
    doc_end = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    new = np.r_[True, run[1:] != run[:-1]]
    begin = np.flatnonzero(new)
    sizes = np.diff(np.r_[begin, len(at)])
    doc = np.searchsorted(doc_end, at[begin], side="right")
    # single letters in a row are one word
    single = sizes == 1
    joined = np.r_[False, single[1:] & single[:-1] & (doc[1:] == doc[:-1])]
    word = np.cumsum(~joined) - 1
    return Words(
        code[at], np.repeat(word, sizes), doc[~joined], np.bincount(word, weights=sizes).astype(np.int64)
    )


def some_words(w: Words, kept: np.ndarray) -> Words:
    sizes = w.sizes[kept]
    return Words(w.codes[kept[w.owner]], np.repeat(np.arange(len(sizes)), sizes), w.doc[kept], sizes)


def distinct(w: Words) -> tuple[Words, np.ndarray, np.ndarray]:
    """Each different word once, the 64-bit hash of each, and for every word its place among these."""
    begin = np.cumsum(w.sizes) - w.sizes
    (key,) = byte_hashes(w.codes.astype(np.uint8), begin, w.sizes, SEEDS[:1])
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(first)  # in the order of the text
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    kept = np.zeros(len(w.sizes), bool)
    kept[first] = True
    return some_words(w, kept), key[kept], rank[place]


def self_norm(w: Words) -> np.ndarray:
    """Root of the kernel of each word with itself: equal triples of a word are added up, then squared.

    Words are taken some at a time, a long one alone with a sum for each triple there is.
    """
    out = np.full(len(w.sizes), DECAY**3)  # words without triples have no weight to divide
    begin = np.cumsum(w.sizes) - w.sizes
    long = w.sizes > LONG_WORD
    for k in np.flatnonzero(long).tolist():
        codes, sums = w.codes[begin[k] : begin[k] + w.sizes[k]], np.zeros(LETTERS**3)
        for _, code, weight in triples(codes, np.zeros(len(codes), np.int8)):
            sums += weight * np.bincount(code, minlength=LETTERS**3)
        out[k] = max(out[k], float(np.linalg.norm(sums)))
    short = np.flatnonzero(~long & (w.sizes >= 3))
    part = np.cumsum(w.sizes[short]) // NORM_LETTERS
    for which in np.split(short, np.flatnonzero(np.diff(part)) + 1):
        sizes = w.sizes[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        codes = w.codes[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[which][owner]]
        keys, weights = zip(*((owner[at] * LETTERS**3 + code, np.full(len(at), weight)) for at, code, weight in triples(codes, owner)), strict=True) if len(codes) >= 3 else ([], [])
        if not keys:
            continue
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate(weights))
        total = np.bincount(key // LETTERS**3, weights=sums**2, minlength=len(which))
        out[which] = np.sqrt(np.maximum(total, DECAY**6))
    return out


def triples(codes: np.ndarray, owner: np.ndarray):
    """For every letter and gap pattern inside a word: places, triple codes and weight."""
    wide = codes.astype(np.int32)
    for span in range(3, MAX_SPAN + 1):
        if len(codes) < span:
            return
        n = len(codes) - span + 1
        at = np.flatnonzero(owner[:n] == owner[span - 1 :])
        ends = wide[at] * (LETTERS * LETTERS) + wide[at + span - 1]
        for mid in range(1, span - 1):
            yield at, ends + wide[at + mid] * LETTERS, DECAY**span


def decisions(w: Words, weights: np.ndarray) -> np.ndarray:
    """Decision value of each word, without the bias."""
    total = np.zeros(len(w.codes))
    for at, code, weight in triples(w.codes, w.owner):
        total[at] += weight * weights[code]
    out = np.bincount(w.owner, weights=total, minlength=len(w.sizes)) if len(w.sizes) else np.zeros(0)
    return out / self_norm(w)


def kernel_rows(w: Words, maps: np.ndarray) -> np.ndarray:
    """Kernel of each word with each row of `maps` (explicit feature maps)."""
    norm, out = self_norm(w), np.zeros((len(w.sizes), len(maps)))
    for at, code, weight in triples(w.codes, w.owner):
        for k, m in enumerate(maps):
            out[:, k] += np.bincount(w.owner[at], weights=weight * m[code], minlength=len(w.sizes))
    return out / norm[:, None]


def feature_maps(w: Words) -> np.ndarray:
    out = np.zeros((len(w.sizes), LETTERS**3), np.float32)
    for at, code, weight in triples(w.codes, w.owner):
        np.add.at(out, (w.owner[at], code), weight)
    return out / self_norm(w)[:, None]


@dataclass
class Machine:
    """Weights of the letter triples, the bias, and the logistic curve over what a text shows."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray
    #: Hashes, in order, and decision values of words scored before; a task keeps at most MOST_KNOWN.
    known: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0)), repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": (np.zeros(0, np.uint64), np.zeros(0))}  # each task starts anew

    def word_values(self, w: Words) -> np.ndarray:
        """Decision value of each word without the bias; a word seen before is looked up."""
        once, key, place = distinct(w)
        keys, values = self.known
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        fresh = keys[at] != key if len(keys) else np.ones(len(key), bool)
        out = np.zeros(len(key))
        out[~fresh] = values[at[~fresh]] if len(keys) else 0.0
        if fresh.any():
            out[fresh] = decisions(some_words(once, fresh), self.weights)
            if len(keys) + fresh.sum() <= MOST_KNOWN:
                keys, values = np.r_[keys, key[fresh]], np.r_[values, out[fresh]]
                order = np.argsort(keys)
                self.known = keys[order], values[order]
        return out[place]

    def shown(self, texts: list[str]) -> np.ndarray:
        """Per text: its three largest decision values, share and number of words beyond 0."""
        parts = [self._shown(texts[part]) for part in chunks(texts, SCORE_CHARS)]
        return np.concatenate(parts) if parts else np.zeros((0, 6))

    def _shown(self, texts: list[str]) -> np.ndarray:
        w = words_of(texts)
        out = np.full((len(texts), 6), -2.0)
        out[:, 3:] = 0
        out[:, 5] = 1
        if len(w.sizes):
            value = self.word_values(w) + self.bias
            order = np.lexsort((-value, w.doc))
            doc = w.doc[order]
            begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            place = np.arange(len(doc)) - np.repeat(begin, np.diff(np.r_[begin, len(doc)]))
            top = place < 3
            out[doc[top], place[top]] = value[order[top]]
            n = np.bincount(w.doc, minlength=len(texts))
            hits = np.bincount(w.doc, weights=value > 0, minlength=len(texts))
            out[:, 3] = np.sqrt(hits / np.maximum(n, 1)) * 10
            out[:, 4] = np.log1p(hits)
        return np.clip(out, -2, 10)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shown(texts) @ self.curve, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge support vector machine, by Newton steps on the margin set."""
    x1 = np.c_[x, np.ones(len(x))]
    beta, reg = np.zeros(x1.shape[1]), np.eye(x1.shape[1]) * ridge
    reg[-1, -1] = 0
    for _ in range(30):
        inside = y * (x1 @ beta) < 1
        xa = x1[inside] * weight[inside, None]
        h = xa.T @ x1[inside] + reg + np.eye(len(beta)) * 1e-9
        nxt = np.linalg.solve(h, xa.T @ y[inside])
        if np.allclose(nxt, beta, atol=1e-7):
            break
        beta = nxt
    return beta[:-1], float(beta[-1])


_SENTENCE = re.compile(r"[.!?\n|]+\s*")
_LETTER = re.compile(r"[^\W\d_]+")


def fit_machine(rows: list[tuple[str, int]], totals: dict[int, int] | None = None, seed: int = 7) -> Machine:
    """A machine from (text, label) rows, a sample of `totals` rows of each class; without both classes, or without any word that tells
    them apart, it gives every text a score near 0."""
    silent = Machine(np.zeros(LETTERS**3), -1.0, np.array([0, 0, 0, 0, 0, -4.0]))
    if len({label for _, label in rows}) < 2:
        return silent
    sentences: dict[str, int] = {}
    for text, label in rows:
        for s in _SENTENCE.split(text):
            if s.strip():  # a sentence that stands in a clean document is clean
                sentences[s] = min(label, sentences.get(s, 1))
    share = {0: Counter(), 1: Counter()}
    for s, label in sentences.items():
        share[label].update({w for w in map(_letters, s.split()) if len(w) >= 3})
    rate = sum(sentences.values()) / len(sentences)
    telling: dict[str, float] = {}
    for w, c in share[1].items():
        n = c + share[0][w]
        if c >= 3 and c * (1 - rate) > 5 * (n - c + 0.5) * rate:  # odds, and their likelihood ratio
            g = c * math.log(c / (n * rate)) + (n - c) * math.log(max(n - c, 1e-9) / (n * (1 - rate)))
            if g > math.log(len(share[1])) + 1:
                telling[w] = g
    guess = sorted(telling, key=lambda w: (-telling[w], w))
    rng = np.random.default_rng(seed)
    # clean words: those that toxic sentences do not favour, the common ones first
    even = [w for w, c in share[0].items() if share[1][w] * (1 - rate) <= 1.5 * c * rate]
    even.sort(key=lambda w: (-share[0][w], w))
    common, rare = even[: MAX_WORDS // 4], sorted(even[MAX_WORDS // 4 :])
    all_clean = common + [rare[k] for k in rng.permutation(len(rare))]
    clean = all_clean
    toxic = sorted(share[1])
    if not guess or not clean:
        return silent
    machine = silent
    for _ in range(ROUNDS):
        guess, picked = guess[:MAX_WORDS], set(guess)
        clean = [w for w in clean if w not in picked][:MAX_WORDS]
        marks = [sorted(guess)[k] for k in rng.permutation(len(guess))[: LANDMARKS // 2]]
        marks += clean[: LANDMARKS - len(marks)]
        maps = feature_maps(words_of(marks))
        value, vector = np.linalg.eigh((maps @ maps.T).astype(float))
        good = value > 1e-6 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        y = np.r_[np.ones(len(guess)), -np.ones(len(clean))]
        weight = np.where(y > 0, 0.5 / len(guess), 0.5 / len(clean))
        beta, bias = fit_linear(kernel_rows(words_of(guess + clean), maps) @ root, y, weight)
        machine = Machine((root @ beta) @ maps, bias, silent.curve)
        # toxic sentences' words beyond the margin join; clean words that come near it replace others
        beyond = _values(machine, toxic)
        worst = dict(zip(toxic, beyond.tolist(), strict=True))
        joined = {w for w, v in worst.items() if v >= 1 and share[0][w] * rate <= 0.2 * share[1][w] * (1 - rate)}
        guess = sorted(joined | picked, key=lambda w: (-telling.get(w, 0.0), -worst[w], w))
        near = _values(machine, all_clean)
        clean = [all_clean[k] for k in np.argsort(-near, kind="stable")[: MAX_WORDS // 2]] + clean
        clean = list(dict.fromkeys(clean))
    truth = np.array([label for _, label in rows], float)
    drawn = {k: float((truth == k).sum()) for k in (0, 1)}
    stands_for = {k: (totals or drawn).get(k, drawn[k]) / drawn[k] for k in (0, 1)}
    weight = np.where(truth > 0, stands_for[1], stands_for[0])
    machine.curve = _calibrate(machine.shown([t for t, _ in rows]), truth, weight / weight.mean())
    return machine


def _letters(word: str) -> str:
    return "".join(_LETTER.findall(word)).lower()


def _values(machine: Machine, words: list[str]) -> np.ndarray:
    """Decision value of each word, given one by one."""
    w = words_of(words)
    value = np.full(len(words), -2.0)
    if len(w.sizes):
        np.maximum.at(value, w.doc, decisions(w, machine.weights) + machine.bias)
    return value


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A ridge logistic curve with softened targets (Platt); the last column is constant."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (weight * (p - t)) + 0.1 * beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Machine:
    """Fit on at most `max_docs` documents of each class whose labels are `usable`."""
    return fit_machine(*labelled_sample(docs, labels, label_col, usable, max_docs))


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `score` (0 to 1) of every whole text.

    A null or empty text, or one without letters, gets the lowest score; repeated rows are
    scored each; an empty table gives an empty result; no other column is read.
    """

    def make():
        return lambda texts: [pa.array(machine.score(texts), pa.float64())]

    return map_texts(docs, make, "score double", id_col, text_col)


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `threshold`; nothing is joined.

    Null and empty texts score lowest and stay.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part, texts in text_parts(batch.column(at)):
                scores = machine.score([t or "" for t in texts])
                yield batch[part.start : part.stop].filter(pa.array(scores < threshold))

    return docs.mapInArrow(handing_back(run), docs.schema)
