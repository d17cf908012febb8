"""Quality classifier: a linear-chain conditional random field over lines, trained on document labels.

The field sees a line's features and its neighbours'; a document's score is the mean of its lines' marginal
probabilities of being good, weighted by their lengths. It is fitted in two steps: first to sequences in
which each line has its document's label, then to the documents' scores themselves. The second step's
gradient goes through the forward-backward pass, so a line of a bad document may be good, and the
transitions learn what a line tells of lines farther off than its neighbours.

Weights are fitted to a bounded sample: of the labelled documents, in the order of their ids' hashes, as
many as stay within ``SAMPLE`` documents, ``SAMPLE_LINES`` lines and ``SAMPLE_BYTES`` bytes of text, each
whole. What is gathered for fitting doesn't grow with the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import FEATURES, lines_of, marginals, with_neighbours
from .runtime import with_text_columns
from .words import HashTable

#: Labelled documents that the weights are fitted to, at most, and their lines and bytes together.
SAMPLE, SAMPLE_LINES, SAMPLE_BYTES = 4000, 100_000, 32 << 20
HELD_OUT = 2
PREDICT_AT = 0.7
#: Steps, rate and ridge of fitting to lines, then to documents.
LINE_STEPS, LINE_RATE, LINE_RIDGE = 120, 0.08, 2e-3
STEPS, RATE, RIDGE = 100, 0.03, 1e-5
#: How far line scores are moved, at most, to differentiate the marginals.
NUDGE = 1e-3


def _ascend(params: np.ndarray, gradient, steps: int, rate: float, ridge: float) -> np.ndarray:
    """Adam; the ridge pulls all weights to zero but the constant."""
    m, v = np.zeros_like(params), np.zeros_like(params)
    pull = np.full(len(params), ridge)
    pull[-5] = 0
    for t in range(1, steps + 1):
        g = gradient(params[:-4], params[-4:].reshape(2, 2)) - pull * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params


def _scores(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    s = x @ weight
    return np.stack([-s / 2, s / 2], axis=1)


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions. features and chars: of each line; first: where each document's lines begin."""
    x = with_neighbours(features, first)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    gold = labels[of] == 1
    steps = np.array([[(n - 1)[labels == 0].sum(), 0], [0, (n - 1)[labels == 1].sum()]], float)

    def of_lines(weight, transition):
        p, pairs, _ = marginals(_scores(x, weight), transition, first, pairs=True)
        return np.concatenate([x.T @ (gold - p[:, 1]), (steps - pairs).ravel()]) / len(x)

    share = chars + 1.0
    share = share / np.add.reduceat(share, first[:-1])[of]

    def of_documents(weight, transition):
        # d score / d parameter is a covariance under the field: the change of its expected features when line
        # scores are moved a little along the weights that the lines have in their documents' loss
        s = _scores(x, weight)
        score = np.clip(np.add.reduceat(share * marginals(s, transition, first)[:, 1], first[:-1]), 1e-6, 1 - 1e-6)
        slope = ((labels - score) / (score * (1 - score)) / len(n))[of] * share
        step = NUDGE / max(np.abs(slope).max(), 1e-12)
        (up, up_pairs, _), (down, down_pairs, _) = (marginals(s + sign * step * np.stack([0 * slope, slope], axis=1), transition, first, pairs=True) for sign in (1, -1))
        return np.concatenate([x.T @ (up - down)[:, 1], (up_pairs - down_pairs).ravel()]) / (2 * step)

    params = _ascend(np.zeros(x.shape[1] + 4), of_lines, LINE_STEPS, LINE_RATE, LINE_RIDGE)
    params = _ascend(params, of_documents, STEPS, RATE, RIDGE)
    return params[:-4], params[-4:].reshape(2, 2)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def _chosen(docs: DataFrame, labels: DataFrame, sample: int, lines: int, size: int) -> DataFrame:
    """``doc_id, text_key, label`` of the documents to fit to, one text of each."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("label"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    of_text = F.struct(F.xxhash64("text").alias("key"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("lines"), F.octet_length(text).alias("size"))
    own = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").groupBy("doc_id").agg(F.min(of_text).alias("t"), F.first("label").alias("label"))
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over ``sample`` rows at most
    own = own.select("doc_id", F.col("t.key").alias("text_key"), "label", F.sum("t.lines").over(before).alias("lines"), F.sum("t.size").over(before).alias("size"))
    return own.filter((F.col("lines") <= lines) & (F.col("size") <= size)).select("doc_id", "text_key", "label")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray] | None:
    """Fitted weights, or ``None`` if the labels outside the held-out part aren't of both kinds.

    Labels that are null, or that are not 0 or 1, don't count; of several for one doc_id the smallest does,
    and of several texts the one with the smallest hash, so the weights don't depend on partitions.
    """
    chosen = _chosen(docs, labels, sample, sample_lines, sample_bytes)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    own = keyed.join(F.broadcast(chosen), ["doc_id", "text_key"])

    def make():
        hashes = HashTable()

        def call(texts):
            lines = lines_of(texts, hashes)
            spans = list(zip(lines.first, lines.first[1:], strict=False))
            return {"line_features": [lines.features[a:b].astype(np.float32).ravel() for a, b in spans], "line_chars": [lines.chars[a:b] for a, b in spans]}

        return call

    rows = with_text_columns(own, make, "line_features array<float>, line_chars array<int>", drop_text=True)
    table = rows.dropDuplicates(["doc_id"]).select("doc_id", "label", "line_features", "line_chars").toArrow().sort_by("doc_id").combine_chunks()
    label = table["label"].to_numpy().astype(np.int64)
    if not len(label) or label.min() == label.max():
        return None
    features, chars = (table[c].chunk(0).flatten().to_numpy().astype(float) for c in ("line_features", "line_chars"))
    first = np.concatenate([[0], np.cumsum(table["line_chars"].chunk(0).value_lengths().to_numpy())])
    return fit(features.reshape(-1, len(FEATURES)), first, label, chars)


def score_texts(texts: list, model, hashes: HashTable) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    lines = lines_of(texts, hashes)
    p = marginals(_scores(with_neighbours(lines.features, lines.first), model[0]), model[1], lines.first)[:, 1]
    weight = lines.chars + 1.0
    add = np.add.reduceat
    return np.clip(add(p * weight, lines.first[:-1]) / add(weight, lines.first[:-1]), 0.0, 1.0)


def scored(docs: DataFrame, model) -> DataFrame:
    """``docs`` without its text, with ``score`` of each row (an existing column of that name is replaced).

    A null or empty text is one blank line and is scored as such; rows are scored one by one. Without a
    model every score is 0.5.
    """

    def make():
        hashes = HashTable()
        return lambda texts: {"score": score_texts(texts, model, hashes)}

    return with_text_columns(docs, make, "score double", drop_text=True)
