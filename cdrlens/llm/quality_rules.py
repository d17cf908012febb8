"""Quality rules: a linear-chain conditional random field labels lines content or boilerplate.

The field's weights are fixed rules, stated below. Viterbi decoding gives the best sequence of labels;
a document stays if content lines hold ``CONTENT_SHARE`` of its word characters and the base rules pass.

A line alone often doesn't tell: a few words without a sentence's end are a heading between paragraphs and
a menu's entry among others of their kind. Their own score is a little below zero, so the lines around
decide: to leave a run of content costs what two changes of label cost, which one fragment doesn't outweigh
and several do; likewise a short sentence amid boilerplate is boilerplate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .lines import FEATURES, lines_of, viterbi
from .runtime import with_text_columns
from .words import HashTable

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
CONTENT_SHARE = 0.5
#: What speaks for content (positive) or boilerplate (negative) in a line.
BIAS = 1.0
WEIGHTS = {
    "symbols_a_word": -5.0,
    "bangs_a_word": -3.0,
    "pipes_a_word": -8.0,
    "upper_share": -2.0,
    "digit_share": -4.0,
    "duplicate": -2.5,
    "repeated_words": -1.5,
    "ends_sentence": 1.0,
    "punctuation_a_word": 1.0,
    "short_words": 0.5,
    "fragment": -3.2,
}
#: Score of passing from one label to the next line's: [boilerplate, content] to [boilerplate, content].
TRANSITION = ((0.8, -0.8), (-0.8, 0.8))

_WEIGHTS = np.array([WEIGHTS.get(f, 0.0) for f in FEATURES])


def judge(texts: list, hashes: HashTable) -> dict:
    lines = lines_of(texts, hashes)
    score = lines.features @ _WEIGHTS + BIAS
    content = viterbi(np.stack([np.zeros_like(score), score], axis=1), np.array(TRANSITION), lines.first) == 1
    n_words, word_chars = lines.per_text(lines.words), lines.per_text(lines.word_chars)
    n_repeat = lines.per_text(lines.repeated)
    share = lines.per_text(lines.word_chars * content) / np.maximum(word_chars, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": lines.per_text(lines.symbols),
        "n_dup_lines": lines.per_text(lines.duplicate), "n_repeat_words": n_repeat,
        "content_share": share, "base_failed": failed, "kept": ~failed & (share >= CONTENT_SHARE),
    }


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def _maker():
    hashes = HashTable()
    return lambda texts: judge(texts, hashes)


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the counts and the verdict of each row (columns of the same names are
    replaced). A null or empty text has no words, so it fails the base rules and is not kept; its content
    share is 0. Each row is judged alone: repeated rows get equal verdicts."""
    return with_text_columns(docs, _maker, _FIELDS, drop_text=True)


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    def make():
        hashes = HashTable()
        return lambda texts: {"_kept": judge(texts, hashes)["kept"]}

    return with_text_columns(docs, make, "_kept boolean", keep="_kept")
