"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Seeds of the two hashes of a word, and the longest word, in bytes, that is hashed with others at once.
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SHORT = 32


@dataclass
class Words:
    """White-space separated words of texts laid end to end, each text followed by a line end."""

    flat: np.ndarray
    doc: np.ndarray  # per word: text
    begin: np.ndarray  # per word: first byte in `flat`
    end: np.ndarray  # per word: byte after its last
    counts: np.ndarray  # per text: words


def split(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    stops = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    white = _WHITE[flat]
    begin = np.flatnonzero(~white & np.r_[True, white[:-1]])
    end = np.flatnonzero(white & np.r_[False, ~white[:-1]])
    doc = np.searchsorted(stops, begin, side="right")
    return Words(flat, doc, begin, end, np.bincount(doc, minlength=len(raw)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_hashes(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, seeds: tuple[int, ...] = SEEDS) -> list[np.ndarray]:
    """64-bit hashes of runs of bytes, one array for each seed.

    Eight bytes at a time go into a state that is spread over all its bits before the next eight, so no
    sum over places can cancel out, as it can in polynomials modulo 2**64. Longer runs are hashed by xxh3.
    """
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = [mix(length.astype(np.uint64) + np.uint64(seed)) for seed in seeds]
    for k in range(0, int(min(length.max(initial=0), _SHORT)), 8):
        at = np.flatnonzero((length > k) & (length <= _SHORT))
        lane = np.ascontiguousarray(view[begin[at] + k]).view("<u8").ravel().astype(np.uint64)
        beyond = np.maximum(8 - (length[at] - k), 0).astype(np.uint64) * np.uint64(8)
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> beyond
        for own, seed in zip(out, seeds, strict=True):
            own[at] = mix((own[at] ^ lane) * np.uint64(seed | 1))
    long = np.flatnonzero(length > _SHORT).tolist()  # few words are this long
    for k in long:
        data = flat[begin[k] : begin[k] + length[k]].tobytes()
        for own, seed in zip(out, seeds, strict=True):
            own[k] = xxhash.xxh3_64_intdigest(data, seed)
    return out


def hashes(words: Words, seeds: tuple[int, ...] = SEEDS) -> list[np.ndarray]:
    """Hashes of the bytes of each word, one array for each seed."""
    return byte_hashes(words.flat, words.begin, words.end - words.begin, seeds)


class Runs:
    """Hashes of runs of consecutive words of one text, from prefix sums of a polynomial.

    Runs are of some dozens of words; only far longer ones could cancel out whatever their words' hashes.
    """

    STEPS = (0xD1342543DE82EF95, 0xDA942042E4DD58B5)  # odd, so they have an inverse modulo 2**64

    def __init__(self, word_hashes: np.ndarray, step: int = STEPS[0]) -> None:
        n = len(word_hashes)
        self.n = n
        self.up = self._powers(step, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * self.up[:n], out=self.sums[1:], dtype=np.uint64)
        self.down = self._powers(pow(step, -1, 1 << 64), n + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hash of the `size` words from each start."""
        return mix((self.sums[starts + size] - self.sums[starts]) * self.down[starts] + np.uint64(size))
