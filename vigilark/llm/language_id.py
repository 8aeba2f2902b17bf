"""Language identification of documents that may mix languages.

A document is taken as words drawn from a mixture of languages. A language gives a word the geometric
mean, over n-gram lengths, of the likelihoods of its letter n-grams (with marks where the word begins
and ends). Expectation-maximisation finds each document's proportions; languages are added in the
order of their proportions as long as the likelihood, less a penalty for each language, grows.

The n-gram counts are those of all documents with a language, made in the tasks and added up per
language; they are hashed into a fixed number of places, so the model is as large as the number of
languages, not of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm._arrow import chunks, map_texts

#: Lengths of the n-grams in bytes of UTF-8, places of their counts, and added to each count.
LENGTHS, PLACES, ADDED = (2, 3, 4), 1 << 16, 0.05
#: A language costs this many times the logarithm of the document's words; more languages than this are refused.
PENALTY, MAX_LANGUAGES, ROUNDS = 2.0, 200, 20
#: Different words whose counts or likelihoods a task keeps, and the longest of them, in letters.
KEPT_WORDS, KEPT_LETTERS = 200_000, 40
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """Lower-case runs of letters and how often they stand in the text."""
    return Counter(_WORD.findall(text.lower()))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of the words, and the word each belongs to."""
    raw = [b"\x01" + w.encode() + b"\x02" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), sizes)
    at, of = [], []
    for n in LENGTHS:
        if len(flat) < n:
            break
        code = np.full(len(flat) - n + 1, np.uint64(n))
        for k in range(n):
            code = code * np.uint64(257) + flat[k : len(flat) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        code = (code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        at.append(code.astype(np.int64) % PLACES)
        of.append(owner[: len(inside)][inside])
    return (np.concatenate(at), np.concatenate(of)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def add_counts(counts: np.ndarray, words: Counter) -> None:
    """Add the n-grams of words, each as often as it stands there."""
    at, of = ngrams(list(words))
    often = np.fromiter(words.values(), np.int64, len(words))
    counts += np.bincount(at, weights=often[of], minlength=PLACES).astype(np.int64)


@dataclass
class Languages:
    """Names, and logarithms of the n-grams' likelihoods, `logs[place, language]`."""

    names: list[str]
    logs: np.ndarray
    #: Words met before and the row of each in `table`; a task keeps about KEPT_WORDS, then starts anew.
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)), repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": np.zeros((0, 0))}

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language; words met before are looked up."""
        if len(self.table) > KEPT_WORDS or not len(self.table):
            self.known, self.table = {}, np.zeros((0, len(self.names)))
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, *(self._score(new[part]) for part in chunks(new))])
        out = self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        for w in new:
            if len(w) > KEPT_LETTERS:
                del known[w]
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        at, of = ngrams(words)
        rows = [np.bincount(of, weights=self.logs[at, k], minlength=len(words)) for k in range(len(self.names))]
        return np.stack(rows, axis=1) / len(LENGTHS)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Proportion of every language in each text; those outside the chosen set are 0, and all are
        0 for a text without letters."""
        bags = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        out = np.zeros((len(texts), len(self.names)))
        if not self.names or not sizes.sum():
            return out
        like = self.likelihoods([w for b in bags for w in b])
        often = np.fromiter((n for b in bags for n in b.values()), np.float64, len(like))
        some = np.flatnonzero(sizes)
        out[some] = choose(like, often, sizes[some])
        return out


def mixture(like: np.ndarray, often: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the `allowed` languages of each document, and its log-likelihood, by expectation-maximisation.

    `like` holds a row per word of each document, `often` its occurrences, `sizes` the documents' words.
    """
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    top = np.where(allowed[owner], like, -np.inf).max(1, keepdims=True)
    near = np.where(allowed[owner], np.exp(like - top), 0.0)
    total = np.add.reduceat(often, starts)[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        held = near * share[owner]
        held *= (often / held.sum(1))[:, None]
        new = np.add.reduceat(held, starts) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    value = np.add.reduceat(often * (np.log((near * share[owner]).sum(1)) + top[:, 0]), starts)
    return share, value


def choose(like: np.ndarray, often: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions of each document's chosen set of languages.

    Sets are those of the first languages in the order of the proportions among all. The first is
    compared with the others alone by likelihood; one more is taken while the likelihood less the
    penalty grows.
    """
    n, languages = len(sizes), like.shape[1]
    starts = np.cumsum(sizes) - sizes
    share, _ = mixture(like, often, sizes, np.ones((n, languages), bool))
    alone = np.add.reduceat(like * often[:, None], starts)
    best = alone.argmax(1)
    share[np.arange(n), best] += 1  # the best single language comes first
    order = np.argsort(-share, axis=1, kind="stable")
    out = np.zeros((n, languages))
    out[np.arange(n), best] = 1
    value = alone.max(1)
    cost = PENALTY * np.log1p(np.add.reduceat(often, starts))
    live = np.arange(n)
    for k in range(2, languages + 1):
        rows = np.isin(np.repeat(np.arange(n), sizes), live)
        allowed = np.zeros((len(live), languages), bool)
        allowed[np.arange(len(live))[:, None], order[live, :k]] = True
        new, got = mixture(like[rows], often[rows], sizes[live], allowed)
        better = got - cost[live] > value[live]
        out[live[better]], value[live[better]] = new[better], got[better] - cost[live][better]
        live = live[better]
        if not len(live):
            break
    return out


def train_languages(docs: DataFrame, usable: Column, lang_col: str = "lang", text_col: str = "text") -> Languages:
    """Count the n-grams of all `usable` documents with a language and a text.

    Without any such document there are no languages. More than MAX_LANGUAGES different values are a
    ValueError: such a column does not hold languages, and the model would not be small.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def flush() -> None:
            for lang, own in words.items():
                add_counts(counts.setdefault(lang, np.zeros(PLACES, np.int64)), own)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, words.values())) > KEPT_WORDS:
                    flush()
        flush()
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "place", "n"])

    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = rows.mapInArrow(count, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most PLACES rows a language
    counts = np.zeros((PLACES, len(names)))
    where = {name: k for k, name in enumerate(names)}
    lang = np.array([where[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[table.column("place").to_numpy(), lang] = table.column("n").to_numpy()
    seen = np.flatnonzero(counts.sum(1))
    # what no language has shown is as unlikely under each
    logs = np.log(counts + ADDED) - np.log(counts.sum(0) + ADDED * (len(seen) + 1))
    return Languages(names, logs.astype(np.float32))


def identify_languages(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `lang_pred`, `score` and `languages` of every whole text.

    `languages` lists the chosen set with its proportions (`name`, `share`, largest first, equal shares by
    name); `lang_pred` is the first of these and `score` its proportion. A text that is null or has no letter is
    `und` with score 0 and an empty list, as is any if nothing was learned. Repeated rows are judged each; an
    empty table gives an empty result; no other column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)  # at most MAX_LANGUAGES times PLACES numbers

    def make():
        model = sent.value

        def work(texts: list[str]) -> list[pa.Array]:
            shares = model.shares(texts)
            order = np.argsort(-shares, axis=1, kind="stable")
            chosen = [[k for k in o if s[k] > 0] for o, s in zip(order.tolist(), shares, strict=True)]
            first = [model.names[c[0]] if c else UNKNOWN for c in chosen]
            score = [min(1.0, float(s[c[0]])) if c else 0.0 for c, s in zip(chosen, shares, strict=True)]
            sets = [[{"name": model.names[k], "share": float(s[k])} for k in c] for c, s in zip(chosen, shares, strict=True)]
            return [pa.array(first, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.struct([("name", pa.string()), ("share", pa.float64())])))]

        return work

    return map_texts(docs, make, "lang_pred string, score double, languages array<struct<name: string, share: double>>", id_col, text_col)
