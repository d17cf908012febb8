"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

Compiled from a model file: the normaliser (a blank in front, blanks as U+2581), a trie of pieces with
their weights, and byte fallback for characters that no piece holds. Composition with an input gives a
lattice whose arcs are the pieces found in it; its states also carry the last piece, because a merge
model lets two pieces stand side by side only if merging their joint text gives just these two. The ids
are those of the path of least weight in the tropical semiring (min, +), which the model's own merge
order makes the only path but for ties.

No piece joins what stands before a U+2581 to it, and none holds a newline, so a text's path is that of
its units (blanks and the word after them) in turn; each distinct unit is solved once as long as a
bounded table remembers it.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .runtime import unused, with_text_columns
from .words import RaggedTable, ragged

BLANK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5
#: Weight of a character that goes to bytes, and pairs remembered.
FALLBACK, PAIRS = 20.0, 500_000
#: Units remembered.
UNITS = 300_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = data[at]
        at += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, at


def _message(data: bytes):
    """Field number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Model:
    """Pieces and normaliser of a SentencePiece model file of kind BPE with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, self.strip_blanks, self.charsmap, kind, fallback = True, True, b"", 1, 0
        for number, value in _message(data):
            if number == 1:
                fields = dict(_message(value))
                self.pieces.append(fields[1].decode())
                self.scores.append(float(np.frombuffer(fields.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(fields.get(3, _NORMAL))
            elif number == 2:
                fields = dict(_message(value))
                kind, fallback = fields.get(3, 1), fields.get(35, 0)
            elif number == 3:
                fields = dict(_message(value))
                self.charsmap = fields.get(2, b"")
                self.dummy_prefix, self.strip_blanks = bool(fields.get(3, 1)), bool(fields.get(4, 1))
        if _USER in self.kinds:
            raise ValueError("the model has user-defined pieces, which are matched before all merges: not compiled")
        if kind != 2 or not fallback or self.charsmap or self.strip_blanks or not self.dummy_prefix:
            raise ValueError("only BPE models with byte fallback and an identity normaliser that adds a blank in front are compiled")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        self.vocabulary = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _NORMAL}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.vocabulary):
            raise ValueError("a piece crosses units")


class Transducer:
    """The compiled model; composes with one unit at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = model.vocabulary
        # arcs by character; under 0 the piece that ends in a state
        self.trie: dict = {}
        for piece, k in self.vocabulary.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[0] = k
        low = min(s for s in model.scores if s > -1e8)
        self.weight = {i: min(-model.scores[i] / -low, 2.0) + 1.0 for i in self.vocabulary.values()}
        self.pairs: dict[int, bool] = {}
        self.width = len(model.pieces)

    def _merged(self, text: str) -> list[str]:
        """The model's merges on a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.vocabulary.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.model.scores[k] > best):
                    best, at = self.model.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _judge(self, a: int, b: int) -> bool:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        x, y = self.model.pieces[a], self.model.pieces[b]
        known = self.pairs[a * self.width + b] = self._merged(x + y) == [x, y]
        return known

    def adjacent(self, a: int, b: int) -> bool:
        known = self.pairs.get(a * self.width + b)
        return self._judge(a, b) if known is None else known

    def solve(self, unit: str) -> list[int]:
        """Ids of the shortest path through the unit's lattice.

        As long as one state at most is reached at each place there is one path to it, and weights decide
        nothing; :meth:`shortest` takes over as soon as a second state turns up.
        """
        n, root, pairs, width = len(unit), self.trie, self.pairs, self.width
        last, back = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for s in range(n):
            p = last[s]
            if p == -2:
                continue
            node = root.get(unit[s])
            if node is None or 0 not in node:
                if last[s + 1] != -2:
                    return self.shortest(unit)
                last[s + 1], back[s + 1] = -1, s
                continue
            e = s
            while node is not None:
                e += 1
                k = node.get(0)
                if k is not None:
                    ok = p < 0 or pairs.get(p * width + k)
                    if ok is None:
                        ok = self._judge(p, k)
                    if ok:
                        if last[e] != -2:
                            return self.shortest(unit)
                        last[e], back[e] = k, s
                if e == n:
                    break
                node = node.get(unit[e])
        if last[n] == -2:
            return self.shortest(unit)
        out: list[int] = []
        place = n
        while place:
            before = back[place]
            if last[place] < 0:
                out += [self.model.bytes[b] for b in reversed(unit[before:place].encode())]
            else:
                out.append(last[place])
            place = before
        return out[::-1]

    def shortest(self, unit: str) -> list[int]:
        """The same by relaxing every arc: states are places with the last piece (-1 after bytes and at the
        start), each with its least weight and where that came from."""
        n = len(unit)
        states: list[dict] = [{} for _ in range(n + 1)]
        states[0][-1] = (0.0, 0, -1)

        def relax(place: int, state: int, weight: float, before: int, last: int) -> None:
            old = states[place].get(state)
            if old is None or weight < old[0]:
                states[place][state] = (weight, before, last)

        for s in range(n):
            for last, (w, _, _) in states[s].items():
                node = self.trie.get(unit[s])
                if node is None or 0 not in node:
                    relax(s + 1, -1, w + FALLBACK, s, last)
                    continue
                e = s
                while node is not None:
                    e += 1
                    piece = node.get(0)
                    if piece is not None and (last < 0 or self.adjacent(last, piece)):
                        relax(e, piece, w + self.weight[piece], s, last)
                    node = node.get(unit[e]) if e < n else None
        out: list[int] = []
        place, piece = n, min(states[n], key=lambda k: states[n][k][0])
        while place:
            _, before, last = states[place][piece]
            if piece < 0:
                out += [self.model.bytes[b] for b in reversed(unit[before:place].encode())]
            else:
                out.append(piece)
            place, piece = before, last
        return out[::-1]


_UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|\n|{BLANK}+")


class Codec:
    """Encodes and decodes many texts at once."""

    def __init__(self, model_file: str):
        self.model = Model(model_file)
        self.transducer = Transducer(self.model)
        self.table = RaggedTable(lambda units: ragged([self.transducer.solve(u) for u in units]), np.int32, UNITS)
        self.output = [b"" if k in (_CONTROL, _UNKNOWN) else p.replace(BLANK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        for value, i in self.model.bytes.items():
            self.output[i] = bytes([value])

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and how many each text has; a null or empty text has none."""
        units, counts = [], []
        for t in texts:
            own = _UNIT.findall(BLANK + t.replace(" ", BLANK)) if t else []
            units += own
            counts.append(len(own))
        ids, lengths = self.table(units)
        ends = np.cumsum(np.array(counts, np.int64))
        total = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return ids, total[ends] - total[ends - np.array(counts, np.int64)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; broken bytes become U+FFFD, the blank that encoding adds in front goes."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def codec_of(model_file: str) -> Codec:
    """A worker's codec: what it remembers serves all tasks that the worker runs."""
    return Codec(model_file)


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` without its text, with ids (array), n_tokens, ids_crc32 and lossless for each row.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers; lossless says
    that decoding the ids gives the text again (a literal U+2581 comes back as a blank, as in the model's
    own library). A null or empty text has no ids and is lossless. Columns of the same names are
    replaced; rows are treated one by one.
    """

    def make():
        codec = codec_of(model_file)

        def call(texts):
            import pyarrow as pa

            plain = [None if t is None else t.decode() for t in texts]
            ids, counts = codec.encode(plain)
            ends = np.concatenate([[0], np.cumsum(counts)])
            whole = ids.astype("<u4").tobytes()
            listed = ids.tolist()
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            return {
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                "n_tokens": counts,
                "ids_crc32": [zlib.crc32(whole[4 * a : 4 * b]) for a, b in spans],
                "lossless": [codec.decode(listed[a:b]) == (t or "").replace(BLANK, " ") for (a, b), t in zip(spans, plain, strict=True)],
            }

        return call

    return with_text_columns(docs, make, "ids array<int>, n_tokens long, ids_crc32 long, lossless boolean", drop_text=True)


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids`` (null ids: null text)."""
    from pyspark.sql import functions as F

    ids, joined_ids = F.transform("ids", lambda i: i.cast("string")), unused(rows, "joined_ids")
    joined = rows.withColumn(joined_ids, F.concat_ws(" ", F.when(F.col("ids").isNotNull(), ids)))

    def make():
        codec = codec_of(model_file)
        return lambda lists: {"text": [codec.decode([int(i) for i in x.split()]) for x in lists]}

    out = with_text_columns(joined, make, "text string", joined_ids, drop_text=True)
    return out.withColumn("text", F.when(F.col("ids").isNotNull(), F.col("text")))
