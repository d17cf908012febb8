"""Token-id shards with a minimal perfect hash index from document key to payload place.

A shard is one file, written by Spark's writer as rows that each end with one byte 0x0A:

    payload blocks  raw little-endian ids of consecutive documents, in ascending key order
    index block     keys, hash levels, then for each slot fingerprint, payload place and id count
    trailer         magic, length of the index block, number of documents, bytes of an id

The hash is a cascade of bit arrays: at each level a key that falls on a place of its own owns it, the
others go on to the next level; a key's slot is the number of owned places before its own. Keys that
aren't in the shard are told by a stored 32-bit fingerprint. Looking a key up takes constant time.

Beside the shards lies their map, a table of a row a shard: its number, file, least and greatest key,
documents, ids, and ids before it. A look-up reads the map and then only the shards that may hold a key.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import Scratch, _slices, ship
from .words import RaggedTable, mix64, ragged

END_ID = 2
#: Text bytes of a shard, about; a shard is read as a whole. Small inputs are cut finer, down to ``LEAST_BYTES``, so
#: that each core has ``SHARDS_A_CORE``.
SHARD_BYTES, LEAST_BYTES, SHARDS_A_CORE = 128 << 20, 12 << 20, 8
#: Shards whose ids are summed up together on the way to the ids before each shard.
SUM_BLOCK = 1024
#: Text bytes encoded at once, and texts of joined words that the tokenizer gets at once.
SLICE_BYTES, JOINED_TEXTS = 2 << 20, 64
LOAD, LEVELS = 2.0, 64
_TRAILER = struct.Struct("<8sQQI")
_MAGIC = b"TOKSHRD1"
#: Stands for the end of a document among words; no word holds a blank.
_END_WORD = b" end"
#: A full stop or comma between an ASCII letter or digit and a blank or newline.
_STOP, _COMMA = re.compile(rb"\.(?=[ \n])(?<=[A-Za-z0-9].)"), re.compile(rb",(?=[ \n])(?<=[A-Za-z0-9].)")


def key_hashes(ids: np.ndarray, null: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Hashes of keys: a document id (or null), and its how-manieth occurrence in the shard it is."""
    base = mix64(ids.astype(np.int64).view(np.uint64) ^ np.where(null, np.uint64(0xA5A5A5A55A5A5A5A), np.uint64(0)))
    return mix64(base + copies.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.bits = [np.unpackbits(x).astype(bool) for x in levels]
        self.before, total = [], 0
        for b in self.bits:
            self.before.append(total + np.cumsum(b) - b)
            total += int(b.sum())
        self.owned = total

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels = []
        while len(h) and len(levels) < LEVELS:
            at = cls._place(h, len(levels), size := -(-max(64, int(LOAD * len(h))) // 8) * 8)
            counts = np.bincount(at, minlength=size)
            levels.append(np.packbits(counts == 1))
            h = h[counts[at] > 1]
        return cls(levels, np.sort(h))

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slots of known keys; of others some slot, or -1."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            at = self._place(h[left], level, len(bits))
            own = bits[at]
            out[left[own]] = before[at[own]]
            left = left[~own]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h[left]), len(self.rest) - 1)
            found = self.rest[at] == h[left]
            out[left[found]] = self.owned + at[found]
        return out


def occurrences(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many equal ids stand before each, where equal ids stand together."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.arange(n) - head


def pack_index(ids: np.ndarray, null: np.ndarray, place: np.ndarray, count: np.ndarray, width: int) -> bytes:
    h = key_hashes(ids, null, occurrences(ids, null))
    mph = PerfectHash.build(h)
    slot = mph.slots(h)
    fingerprint, at, n = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u8"), np.zeros(len(h), "<u8")
    fingerprint[slot], at[slot], n[slot] = (mix64(~h) >> np.uint64(32)).astype("<u4"), place, count
    parts = [struct.pack("<QQ", len(mph.levels), len(mph.rest)), np.array([len(x) for x in mph.levels], "<u8").tobytes()]
    parts += [x.tobytes() for x in mph.levels]
    parts += [mph.rest.astype("<u8").tobytes(), ids.astype("<i8").tobytes(), np.packbits(null).tobytes(), fingerprint.tobytes(), at.tobytes(), n.tobytes()]
    body = b"".join(parts)
    return body + _TRAILER.pack(_MAGIC, len(body), len(ids), width)


class Shard:
    """A shard's bytes, with keyed access to the ids of its documents."""

    def __init__(self, content):
        self.content = memoryview(content)
        end = len(self.content) - 1 - _TRAILER.size
        magic, size, n, width = _TRAILER.unpack(self.content[end : end + _TRAILER.size])
        if magic != _MAGIC:
            raise ValueError("no token shard")
        at = end - size
        levels, rest = struct.unpack_from("<QQ", self.content, at)
        at += 16

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.content, dtype, count, at)
            at += out.nbytes
            return out

        sizes = take("<u8", levels)
        bits = [take("u1", int(s)) for s in sizes]
        self.hash = PerfectHash(bits, take("<u8", rest))
        self.ids = take("<i8", n)
        self.null = np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(bool)
        self.fingerprint, self.place, self.count = take("<u4", n), take("<u8", n), take("<u8", n)
        self.dtype = f"<u{width}"

    def find(self, ids: np.ndarray, null: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Slots of keys, or -1 for a key that isn't here."""
        h = key_hashes(ids, null, copies)
        slot = self.hash.slots(h)
        known = slot >= 0
        known[known] = self.fingerprint[slot[known]] == (mix64(~h[known]) >> np.uint64(32)).astype("<u4")
        return np.where(known, slot, -1)

    def tokens(self, slot: int) -> np.ndarray:
        return np.frombuffer(self.content, self.dtype, int(self.count[slot]), int(self.place[slot]))

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of a document, or ``None``."""
        slot = int(self.find(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([copy]))[0])
        return None if slot < 0 else self.tokens(slot)


#: What a tokenizer file must say for :class:`WordEncoder` to give its ids.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def is_word_tokenizer(tokenizer_file: str) -> bool:
    """Whether the file puts text in lower case, splits it at white space and before a full stop or comma after a
    letter or digit, adds nothing, and has the separator as a special token: what :class:`WordEncoder` rests on."""
    with open(tokenizer_file, encoding="utf-8") as f:
        parts = json.load(f)
    special = [t for t in parts["added_tokens"] if t["content"] == WordEncoder.SEPARATOR and t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"])]
    return parts["normalizer"] == WORD_NORMALIZER and parts["pre_tokenizer"] == WORD_SPLITTER and parts["post_processor"] is None and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout") and len(special) == 1 and all(t["content"].startswith("<|") for t in parts["added_tokens"])


class TextEncoder:
    """Ids of whole texts, each followed by ``END_ID``, by any tokenizer, text by text."""

    def __init__(self, tokenizer_file: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(tokenizer_file), np.dtype(dtype)

    def __call__(self, texts: Sequence) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = ragged([[*self.tokenizer.encode(t.decode() if t else "", add_special_tokens=False).ids, END_ID] for t in texts])
        return ids.astype(self.dtype), counts


class WordEncoder:
    """Ids of whole texts, each followed by ``END_ID``, by a tokenizer that never joins across white space
    and puts text in lower case (see :func:`is_word_tokenizer`).

    Such a tokenizer's ids of a text are those of its words in turn, so each distinct word (a run without
    ASCII white space, A-Z lowered) is encoded once as long as a bounded table remembers it. Full stops
    and commas that end a word after an ASCII letter or digit are words of their own, as they are to the
    tokenizer. Words go to the tokenizer many at once, joined by its end-of-text token, whose id parts
    them again; words that hold a ``<|`` might hold such a token and are encoded alone, as they are.
    """

    SEPARATOR = "<|endoftext|>"
    JOINED = 100

    def __init__(self, tokenizer_file: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.table = RaggedTable(self._encode, np.dtype(dtype))
        self.table([_END_WORD])

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = b"\0".join(words)
        if b"<|" in whole or _END_WORD in whole or whole.count(b"\0") >= len(words):
            return ragged([[END_ID] if w == _END_WORD else self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words])
        joined = whole.decode().split("\0")
        texts = [self.SEPARATOR.join(joined[i : i + self.JOINED]) + self.SEPARATOR for i in range(0, len(joined), self.JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for i in range(0, len(texts), JOINED_TEXTS) for e in self.tokenizer.encode_batch_fast(texts[i : i + JOINED_TEXTS], add_special_tokens=False)])
        cuts = np.nonzero(ids == self.separator)[0]
        return ids[ids != self.separator], np.diff(cuts, prepend=-1) - 1

    def __call__(self, texts: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and how many each text has."""
        words, counts = [], []
        for t in texts:
            own = []
            if t:
                own = _COMMA.sub(b" ,", _STOP.sub(b" .", t if b"<|" in t else t.lower())).split()
            words += own
            words.append(_END_WORD)
            counts.append(len(own) + 1)
        ids, lengths = self.table(words)
        counts = np.array(counts, np.int64)
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[ends] - total[ends - counts]


@functools.cache
def encoder_of(tokenizer_file: str, dtype: str) -> WordEncoder | TextEncoder:
    """A worker's encoder: what it remembers serves all tasks that the worker runs."""
    return (WordEncoder if is_word_tokenizer(tokenizer_file) else TextEncoder)(tokenizer_file, dtype)


def id_bytes(tokenizer_file: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else 4


def shard_count(total: int, cores: int, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for so many bytes of text: as large as ``shard_bytes`` lets them be, but for a few a core."""
    fine = -(-total // min(LEAST_BYTES, shard_bytes))
    return max(1, -(-total // shard_bytes), min(fine, SHARDS_A_CORE * cores))


def write(docs: DataFrame, path: str, tokenizer_file: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode the whole texts of ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    Keys are whole numbers; another kind of doc_id is refused. Null ids come first; equal ids are ordered by
    their texts' hashes. A null text is an empty one.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    ship(docs.sparkSession)
    width = id_bytes(tokenizer_file)
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("k"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shard_count(total, docs.sparkSession.sparkContext.defaultParallelism, shard_bytes)
    rows = slim.repartitionByRange(shards, "doc_id", "k").sortWithinPartitions("doc_id", "k").select("doc_id", "text")

    def work(batches):
        import pyarrow as pa

        encoder = encoder_of(tokenizer_file, f"<u{width}")
        keys, nulls, counts, places, at = [], [], [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for a, b in _slices(texts, SLICE_BYTES):
                ids, n = encoder(texts.slice(a, b - a).to_pylist())
                own = batch.column("doc_id").slice(a, b - a)
                keys.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                nulls.append(np.asarray(own.is_null()))
                counts.append(n)
                places.append(at + (np.cumsum(n) - n) * width)
                block = ids.tobytes()
                at += len(block) + 1
                yield pa.record_batch([pa.array([block], pa.binary())], ["block"])
        if keys:
            index = pack_index(*(np.concatenate(x) for x in (keys, nulls, places, counts)), width)
            yield pa.record_batch([pa.array([index], pa.binary())], ["block"])

    out = rows.mapInArrow(work, "block binary").select(F.col("block").cast("string").alias("value"))
    out.write.option("lineSep", "\n").option("compression", "none").text(path)


def shard_number(file: Column) -> Column:
    """A shard's number from its file's name. The writer pads it to five digits only, so names don't sort."""
    return F.regexp_extract(file, r"part-([0-9]+)", 1).cast("long")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    file = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).filter("length > 0").select(shard_number(file).alias("shard"), file.alias("file"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``shard, file, doc_id, start_in_shard, n_tokens, ids_crc32`` of each document, found by its key.

    The keys of a shard are looked up in its index; ids_crc32 is taken over the ids as unsigned 32-bit
    little-endian numbers.
    """
    ship(spark)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for number, file, content in zip(*[batch.column(k).to_pylist() for k in (0, 1)], batch.column(2), strict=True):
                shard = Shard(content.as_buffer())
                slots = shard.find(shard.ids, shard.null, occurrences(shard.ids, shard.null))
                n = shard.count[slots].astype(np.int64)
                crc = np.array([zlib.crc32(shard.tokens(s).astype("<u4").tobytes()) for s in slots.tolist()], np.int64)
                yield pa.record_batch(
                    [pa.array([number] * len(n), pa.int64()), pa.array([file] * len(n), pa.string()), pa.array(shard.ids, pa.int64(), mask=shard.null), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc)],
                    ["shard", "file", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"],
                )

    return _files(spark, path).mapInArrow(work, "shard long, file string, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long")


def with_starts(totals: DataFrame) -> DataFrame:
    """``totals`` (shard, tokens and more) with ``start``: the tokens of all shards of smaller numbers.

    Shards are summed in blocks of ``SUM_BLOCK``, the blocks' sums are carried on, and each block is then summed
    within: what one task sees is a block, or a row a block.
    """
    blocked = totals.withColumn("block", F.floor(F.col("shard") / SUM_BLOCK))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocked.groupBy("block").agg(F.sum("tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    within = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(carried, "block")
    return out.withColumn("start", F.col("carried") + F.col("within")).drop("block", "within", "carried")


def map_path(path: str) -> str:
    return f"{path.rstrip('/')}-map"


def write_map(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """Write and return the shards' map (from ``rows``, if :func:`read` was done already)."""
    rows = read(spark, path) if rows is None else rows
    totals = rows.groupBy("shard", "file").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    with_starts(totals).write.mode("overwrite").parquet(map_path(path))
    return spark.read.schema("shard long, file string, least long, greatest long, documents long, tokens long, start long").parquet(map_path(path))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of those of the given documents that the shards hold (first occurrences in each).

    The map tells which shards' key ranges hold one of the documents; only these files are opened. It is
    written first if it isn't there.
    """
    ship(spark)
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    made = spark.read.parquet(map_path(path)) if _exists(spark, f"{map_path(path)}/_SUCCESS") else write_map(spark, path)
    asked = F.array(*[F.lit(int(i)) for i in wanted]).cast("array<long>")
    files = [r.file for r in made.filter(F.exists(asked, lambda i: i.between(F.col("least"), F.col("greatest")))).select("file").collect()]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(2):
                shard = Shard(content.as_buffer())
                slots = shard.find(wanted, np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64))
                hit = np.nonzero(slots >= 0)[0]
                ids = [shard.tokens(s).astype(np.int64) for s in slots[hit].tolist()]
                yield pa.record_batch([pa.array(wanted[hit]), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return _files(spark, [f"{path.rstrip('/')}/{f}" for f in files]).mapInArrow(work, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer_file: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` written as shards in the shared folder and read back by key: one row per document.

    doc_id, start (ids of all documents before it in the files' order), n_tokens (with the end id) and
    ids_crc32. Null and empty texts have the end id alone. Rows of one doc_id follow each other, in an
    order fixed by their texts; other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = scratch.path("shards")
    write(docs, path, tokenizer_file, shard_bytes)
    rows = scratch.save(read(spark, path), "read")
    out = rows.join(write_map(spark, path, rows).select("shard", F.col("start").alias("base")), "shard")
    return out.select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
