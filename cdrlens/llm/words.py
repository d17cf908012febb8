"""Words as numbers: a bounded table from distinct words to computed values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import xxhash

#: Distinct words remembered at once in a worker; beyond it the table starts anew (results are the same).
TABLE_WORDS = 300_000
#: Hashes remembered: they are cheap to make again.
HASHED_WORDS = 100_000
#: The same for the remembered words' bytes together.
TABLE_BYTES = 16 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class HashTable:
    """64-bit hashes of words; a word is hashed once as long as the table remembers it."""

    def __init__(self, capacity: int = HASHED_WORDS):
        self.capacity = capacity
        self.known: dict[bytes, int] = {}
        self.size = 0

    def __call__(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self.known) > self.capacity or self.size > TABLE_BYTES:
            self.known, self.size = {}, 0
        known = self.known
        out = np.fromiter(map(known.get, words, repeat(0)), np.uint64, len(words))
        missing = np.nonzero(out == 0)[0].tolist()
        if missing:
            new = [words[i] for i in missing]
            for w in set(new):
                known[w] = xxhash.xxh64_intdigest(w)
                self.size += len(w)
            out[missing] = [known[w] for w in new]
        return out


class RaggedTable:
    """Number sequences of words (their token ids), gathered for many words at once.

    ``compute`` takes distinct words and gives all their numbers in one array and how many each has. When
    the table is full, the words that came up ``KEEP_FROM`` times or more stay, if they are at most half.
    """

    KEEP_FROM = 3

    def __init__(self, compute: Callable[[list], tuple], dtype, capacity: int = TABLE_WORDS):
        self.compute, self.dtype, self.capacity = compute, dtype, capacity
        self._start({}, np.zeros(0, dtype), np.zeros(0, np.int64))

    def _start(self, index: dict, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.index, self.flat = index, flat
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.seen = np.zeros(len(index), np.int64)
        self.size = sum(map(len, index))

    def _shrink(self) -> None:
        often = np.nonzero(self.seen >= self.KEEP_FROM)[0]
        if 2 * len(often) > len(self.index):
            often = often[:0]
        lengths = np.diff(self.starts)[often]
        flat = self._gather(often)[0]
        words = list(self.index)
        index = dict(zip([words[i] for i in often.tolist()], range(len(often)), strict=True))
        self._start(index, flat, lengths)
        if 2 * self.size > TABLE_BYTES:
            self._start({}, np.zeros(0, self.dtype), np.zeros(0, np.int64))

    def _learn(self, words: list) -> None:
        flat, lengths = self.compute(words)
        self.size += sum(map(len, words))
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, np.asarray(flat, self.dtype)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.starts[at]
        lengths = self.starts[at + 1] - begin
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(begin - (ends - lengths), lengths)], lengths

    def __call__(self, words: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """All words' numbers in one array, and how many each word has."""
        if len(self.index) > self.capacity or self.size > TABLE_BYTES:
            self._shrink()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.nonzero(at < 0)[0].tolist()
        if missing:
            self._learn(list(dict.fromkeys([words[i] for i in missing])))
            at[missing] = [self.index[words[i]] for i in missing]
        self.seen += np.bincount(at, minlength=len(self.seen))
        return self._gather(at)


def ragged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as one array and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum())), lengths


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words (of all texts laid end to end)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = acc * _MULTIPLIER + hashes[k : k + n]
    return mix64(acc)


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a short word sequence as a whole, apart from all window hashes."""
    acc = len(hashes)
    for h in hashes.tolist():
        acc = (acc * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return int(mix64(np.array([acc ^ 0x5851F42D4C957F2D], np.uint64))[0])
