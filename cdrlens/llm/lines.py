"""Per-line features of many texts at once, and linear-chain decoding over the lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import HashTable, mix64, windows

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def _lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_IS_SPACE, _IS_SYMBOL = _lut(SPACES), _lut(SYMBOLS)
_IS_UPPER, _IS_LOWER = _lut(bytes(range(65, 91))), _lut(bytes(range(97, 123)))
_IS_DIGIT, _IS_BANG, _IS_PIPE, _IS_PUNCT, _IS_END = _lut(b"0123456789"), _lut(b"!"), _lut(b"|"), _lut(b".,;:?"), _lut(b".?!\"')")
_STARTS_CHAR = np.array([not 128 <= c < 192 for c in range(256)])

#: Words from which a line without a sentence's end is no fragment.
FRAGMENT_WORDS = 8
#: Names of a line's own features; all are between 0 and about 2.
FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "symbols_a_word", "bangs_a_word",
    "pipes_a_word", "punctuation_a_word", "ends_sentence", "duplicate", "repeated_words", "blank", "short_words", "fragment",
)


@dataclass
class Lines:
    """Lines of texts laid end to end: text k has the lines first[k] to first[k + 1]."""

    first: np.ndarray
    chars: np.ndarray
    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    duplicate: np.ndarray
    repeated: np.ndarray
    features: np.ndarray

    def per_text(self, x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return c[self.first[1:]] - c[self.first[:-1]]


def lines_of(texts: list, hashes: HashTable) -> Lines:
    """Lines (parted by \\n) of UTF-8 texts; a null text is an empty one, which has one blank line."""
    texts = [t or b"" for t in texts]
    joined = b"\n".join(texts)
    x = np.frombuffer(joined, np.uint8)
    newline = np.nonzero(x == 10)[0]
    begin, end = np.concatenate([[0], newline + 1]), np.concatenate([newline, [len(x)]])
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=c[1:])
        return (c[end] - c[begin]).astype(np.int64)

    space, starts_char = _IS_SPACE[x], _STARTS_CHAR[x]
    chars = total(starts_char)
    before = np.concatenate([[True], space[:-1]]) if len(x) else space
    word_at = np.nonzero(~space & before)[0]
    after = np.concatenate([space[1:], [True]]) if len(x) else space
    word_end = np.nonzero(~space & after)[0] + 1
    line_of_word = np.searchsorted(begin, word_at, "right") - 1
    words = np.bincount(line_of_word, minlength=len(begin)).astype(np.int64)
    short = np.bincount(line_of_word, (word_end - word_at) <= 3, minlength=len(begin))
    word_chars, symbols = total(starts_char & ~space), total(_IS_SYMBOL[x])
    upper, lower = total(_IS_UPPER[x]), total(_IS_LOWER[x])

    duplicate = np.zeros(len(begin), bool)
    for k, t in enumerate(texts):
        if counts[k] > 1:
            own = t.split(b"\n")
            if len(set(own)) < len(own):
                seen = set()
                for i, line in enumerate(own):
                    if line in seen:
                        duplicate[first[k] + i] = words[first[k] + i] > 0
                    seen.add(line)

    h = hashes(joined.split())
    text_of_word = np.searchsorted(first, line_of_word, "right") - 1
    keys = windows(h, 3)
    repeated = np.zeros(len(h), bool)
    if len(keys):
        inside = text_of_word[2:] == text_of_word[:-2]
        where = np.nonzero(inside)[0]
        keys = mix64(keys[where] + text_of_word[where].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = where[twice]
        for k in range(3):
            repeated[hit + k] = True
    repeated = np.bincount(line_of_word, repeated, minlength=len(begin)).astype(np.int64)

    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    last = np.zeros(len(begin), bool)
    some = np.nonzero(words)[0]
    if len(some):
        final = np.searchsorted(line_of_word, some, "right") - 1
        last[some] = _IS_END[x[word_end[final] - 1]]
    features = np.stack(
        [
            np.log1p(chars) / 6, np.log1p(words) / 4, word_chars / w / 8, upper / np.maximum(upper + lower, 1), total(_IS_DIGIT[x]) / c,
            np.minimum(symbols / w, 2), np.minimum(total(_IS_BANG[x]) / w, 2), np.minimum(total(_IS_PIPE[x]) / w, 1),
            np.minimum(total(_IS_PUNCT[x]) / w, 1), last, duplicate, repeated / w, words == 0, short / w,
            np.where(last | (words == 0), 0, np.maximum(1 - words / FRAGMENT_WORDS, 0)),
        ], axis=1,
    )
    return Lines(first, chars, words, word_chars, symbols, duplicate, repeated, np.minimum(features, 2.0))


def _steps(first: np.ndarray):
    """Texts by falling number of lines, and for each step the number of texts that still have a line."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    longest = int(n[order[0]]) if len(n) else 0
    active = np.searchsorted(-n[order], -np.arange(longest), "left")
    return first[:-1][order], n[order], active


def viterbi(scores: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label (0 or 1) of each line of each text, given line scores (lines, 2) and transitions."""
    start, n, active = _steps(first)
    best = np.zeros((len(start), 2))
    back = np.zeros((len(scores), 2), np.int8)
    for t, k in enumerate(active):
        at = start[:k] + t
        if t:
            paths = best[:k, :, None] + transition
            back[at] = paths.argmax(axis=1)
            best[:k] = paths.max(axis=1)
        best[:k] += scores[at]
    label = np.zeros(len(scores), np.int8)
    state = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        label[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return label


def marginals(scores: np.ndarray, transition: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Forward-backward: each line's probabilities (lines, 2); with ``pairs`` also the expected number of
    each transition and the sum of the log partition functions."""
    start, _, active = _steps(first)
    add, t = np.logaddexp, transition
    forward, backward = scores.T.copy(), np.zeros((2, len(scores)))
    bad, good = forward
    for step, k in enumerate(active):
        if step:
            at = start[:k] + step
            from_bad, from_good = bad[at - 1], good[at - 1]
            bad[at] += add(from_bad + t[0, 0], from_good + t[1, 0])
            good[at] += add(from_bad + t[0, 1], from_good + t[1, 1])
    for step in range(len(active) - 2, -1, -1):
        at = start[: active[step + 1]] + step
        to_bad, to_good = scores[at + 1, 0] + backward[0, at + 1], scores[at + 1, 1] + backward[1, at + 1]
        backward[0, at] = add(t[0, 0] + to_bad, t[0, 1] + to_good)
        backward[1, at] = add(t[1, 0] + to_bad, t[1, 1] + to_good)
    last = first[1:] - 1
    total = add(bad[last], good[last])
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.exp(forward + backward - total[of]).T
    if not pairs:
        return p
    inner = np.ones(len(scores), bool)
    inner[last] = False
    i = np.nonzero(inner)[0]
    after = scores[i + 1].T + backward[:, i + 1]
    both = [[np.exp(forward[x, i] + t[x, y] + after[y] - total[of[i]]).sum() for y in (0, 1)] for x in (0, 1)]
    return p, np.array(both), float(total.sum())


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after (0 at a text's ends), and a constant."""
    n = len(features)
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([features, before, after, np.ones((n, 1))], axis=1)
