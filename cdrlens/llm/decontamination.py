"""Benchmark decontamination by suffix arrays over the training texts.

The texts are taken in shards of a few megabytes. A shard's suffix array holds, in order, every place
where a match can begin at all: a run of at least the shortest window's number of words that all occur
in the benchmark (a suffix elsewhere is smaller than no match needs). Each distinct test window is searched
in it by bisection, which gives all places of matches. How far a match goes on is found by bisection too: the
text's suffix there is searched among the item's suffixes in their full order, whose neighbours have the
longest prefix in common with it. Of the matches of a text and an item those stay that don't lie in the one
that begins a word before, so a text has a match a place and item at most, however often words repeat.

The benchmark is a stated query set: it is sent to the shards in blocks of at most ``BLOCK_WORDS`` words
(or of one longer item). If it has several, one pass over the texts keeps those that hold a window's hash,
and only these, written to the shared folder, are searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, unused, with_text_columns
from .words import HashTable, mix64, windows

WINDOW = 10
#: Bits a benchmark window has in the sieve, about, and the least and most bits (as powers of two) it has in all.
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST = 16, 20, 30
#: Benchmark words that are broadcast at once, at most; at 44 bytes a word this is 11 MB.
BLOCK_WORDS = 250_000

#: Word characters, after lower-casing A-Z: digits, a-z and all beyond ASCII. All others become blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Block:
    """Some benchmark items: their distinct windows as keys for bisection, and their suffixes in order."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.window = [name for name, _ in items], window
        known = self.vocabulary
        texts = [[known.setdefault(w, len(known) + 1) for w in words] for _, words in items]
        self.text = np.array([i for t in texts for i in (*t, 0)], np.int64)
        length = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
        self.ends = self.starts + length
        item = np.repeat(np.arange(len(texts)), length + 1)
        size = np.minimum(window, length)
        begin = np.nonzero(np.arange(len(self.text)) + size[item] <= self.ends[item])[0]
        item = item[begin]
        steps, size = np.arange(window), size[item]
        rows = np.where(steps < size[:, None], self.text[np.minimum(begin[:, None] + steps, len(self.text) - 1)], 0)
        high = np.where(steps < size[:, None], rows, 0xFFFFFFFF)
        both = np.concatenate([_keys(rows), _keys(high)]).reshape(2, -1).T
        # a window that several places or items have is searched once
        order = np.lexsort((item, both[:, 1], both[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (both[order][1:] != both[order][:-1]).any(axis=1)
        self.low, self.high = both[order][new].T
        key = np.cumsum(new) - 1
        of = np.unique(np.stack([key, item[order]], axis=1), axis=0)
        self.items_from, self.items = np.searchsorted(of[:, 0], np.arange(len(self.low) + 1)), of[:, 1]
        self.shortest = int(size.min())
        rank = _suffix_ranks(self.text, int(length.max()))[begin]
        order = np.lexsort((rank, item))
        self.suffixes, self.suffixes_from = begin[order], np.searchsorted(item[order], np.arange(len(texts) + 1))
        self.hashes, self.powers = _prefix_hashes(self.text)


def _suffix_ranks(x: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` numbers, by doubling; 0 ends a text and is the smallest."""
    rank, step = x, 1
    while step < depth:
        after = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
        after = np.where(rank == 0, 0, after)
        rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1] + (rank.min() > 0)
        step *= 2
    return rank


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _prefix_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of mixed numbers times powers of a factor, from which any stretch's hash follows, and the powers."""
    powers = np.full(len(x) + 1, _FACTOR)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(mix64(x.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)]), powers


class Shard:
    """A shard's words, to be compared with a block's from any place on."""

    def __init__(self, x: np.ndarray, run: np.ndarray, block: Block):
        self.x, self.run, self.block = x, run, block
        self.hashes, self.powers = _prefix_hashes(x)

    def common(self, place: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many words agree from places of the shard and of the benchmark on."""
        b = self.block
        low, high = np.zeros(len(place), np.int64), np.minimum(self.run[place], b.ends[item] - at)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            # each side's sum carries its own first power: multiply by the other's
            own = (self.hashes[place + middle] - self.hashes[place]) * b.powers[at]
            other = (b.hashes[at + middle] - b.hashes[at]) * self.powers[place]
            same = own == other
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def longest(self, place: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and place in the benchmark of the longest match of each place with an item."""
        b = self.block
        first, last = b.suffixes_from[item], b.suffixes_from[item + 1]
        low, high = first.copy(), last.copy()
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(b.suffixes) - 1)
            at = b.suffixes[middle]
            n = self.common(place, at, item)
            own = np.where(n < self.run[place], self.x[np.minimum(place + n, len(self.x) - 1)], 0)
            other = np.where(at + n < b.ends[item], b.text[np.minimum(at + n, len(b.text) - 1)], 0)
            right = open_ & (other < own)
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for k in (np.maximum(low - 1, first), np.minimum(low, last - 1)):
            n = self.common(place, b.suffixes[k], item)
            where, best = np.where(n > best, b.suffixes[k], where), np.maximum(n, best)
        return best, where - b.starts[item]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings that compare like the rows."""
    rows = np.ascontiguousarray(rows, ">u4")
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def blocks(benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    items, total = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row.text.encode()) if row.text else []
        if not words:
            continue
        if items and total + len(words) > limit:
            yield Block(items, window)
            items, total = [], 0
        items.append((row.item_id, words))
        total += len(words)
    if items:
        yield Block(items, window)


def matches(texts: list[list[bytes]], block: Block) -> list[list[tuple]]:
    """The longest verbatim matches of each text: (item_id, item_begin, begin, length), all in words."""
    get = block.vocabulary.get
    starts, parts, at = [], [], 0
    for ws in texts:
        starts.append(at)
        parts += [get(w, 0) for w in ws]
        parts.append(0)
        at = len(parts)
    x = np.array(parts, np.int64)
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(x):
        return out
    zeros = np.nonzero(x == 0)[0]
    run = zeros[np.searchsorted(zeros, np.arange(len(x)))] - np.arange(len(x))
    place = np.nonzero(run >= block.shortest)[0]
    if not len(place):
        return out
    steps = np.arange(block.window)
    keys = _keys(np.where(steps < run[place, None], x[np.minimum(place[:, None] + steps, len(x) - 1)], 0))
    order = np.argsort(keys, kind="stable")
    keys, suffixes = keys[order], place[order]
    first = np.searchsorted(keys, block.low, "left")
    last = np.searchsorted(keys, block.high, "right")
    found = np.nonzero(last > first)[0]
    if not len(found):
        return out
    # places of each window found, then the items that have it: a place and item meet once
    where, key = _spread(suffixes, first[found], last[found], found)
    item, where = _spread(block.items, block.items_from[key], block.items_from[key + 1], where)
    order = np.lexsort((where, item))
    item, where = item[order], where[order]
    length, begin = Shard(x, run, block).longest(where, item)
    tail = np.zeros(len(item), bool)
    tail[1:] = (item[1:] == item[:-1]) & (where[1:] == where[:-1] + 1) & (length[1:] == length[:-1] - 1)
    item, where, length, begin = item[~tail], where[~tail], length[~tail], begin[~tail]
    text = np.searchsorted(starts, where, "right") - 1
    for t, i, b, w, n in zip(text.tolist(), item.tolist(), begin.tolist(), where.tolist(), length.tolist(), strict=True):
        out[t].append((block.names[i], b, w - starts[t], n))
    return out


def _spread(values: np.ndarray, first: np.ndarray, last: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values from each first to before its last, and with each what it is of."""
    many = last - first
    ends = np.cumsum(many)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - many), many)], np.repeat(of, many)


_SPAN = "array<struct<item_id:string,item_begin:long,begin:long,length:long>>"


def _searched(docs: DataFrame, block: Block) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        own = sent.value

        def call(texts):
            words = [words_of(t) for t in texts]
            found = matches(words, own)
            spans = [[{"item_id": None if n is None else str(n), "item_begin": i, "begin": b, "length": k} for n, i, b, k in f] for f in found]
            return {"n_words": [len(w) for w in words], "spans": spans}

        return call

    return with_text_columns(docs, make, f"n_words long, spans {_SPAN}", drop_text=True)


class Sieve:
    """Tells of a text whether it may hold a window of the benchmark: a bit for each window's hash."""

    def __init__(self, benchmark: DataFrame, window: int):
        counts = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        power = min(max(int(np.log2(max(counts // 6, 1) * SIEVE_BITS)) + 1, SIEVE_LEAST), SIEVE_MOST)
        self.bits, self.mask, self.sizes, self.window = np.zeros(1 << power - 3, np.uint8), np.uint64((1 << power) - 1), [], window
        hashes, sizes = HashTable(), set()
        for row in benchmark.select("text").toLocalIterator():
            words = words_of(row.text.encode()) if row.text else []
            if words:
                size = min(window, len(words))
                sizes.add(size)
                at = self._places(hashes(words), size)
                np.bitwise_or.at(self.bits, at >> np.uint64(3), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        self.sizes = sorted(sizes)

    def _places(self, hashes: np.ndarray, size: int) -> np.ndarray:
        return mix64(windows(hashes, size) + np.uint64(size)) & self.mask

    def passes(self, words: list[bytes], hashes: HashTable) -> bool:
        h = hashes(words)
        for size in self.sizes:
            at = self._places(h, size)
            if len(at) and (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).any():
                return True
        return False


def _two(benchmark: DataFrame, window: int, limit: int) -> tuple[Block | None, bool]:
    """The first block, and whether there are more."""
    made = blocks(benchmark, window, limit)
    first = next(made, None)
    return first, next(made, None) is not None


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, spans`` of each row of ``docs`` (doc_id, text): all longest verbatim matches
    of ``window`` words or more with an item of ``benchmark`` (item_id, text), or with a whole shorter
    item; an array of item_id (as string), item_begin, begin and length, counted in words.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. A null or
    empty text has no words and no spans; an item without words matches nothing. Items that share an
    item_id are one item to those who count ids; a null item_id stays null in the spans. Repeated rows
    give repeated results, other columns are ignored; an empty benchmark gives empty spans everywhere.
    """
    docs = docs.select("doc_id", "text")
    first, more = _two(benchmark, window, limit)
    if not more:
        return _searched(docs, first or Block([(None, [b" "])], window))
    spark = docs.sparkSession
    scratch = Scratch(spark, "benchmark")
    sent = spark.sparkContext.broadcast(Sieve(benchmark, window))

    def make():
        hashes = HashTable()

        def call(texts):
            words = [words_of(t) for t in texts]
            return {"n_words": [len(w) for w in words], "kept": [t.decode() if w and sent.value.passes(w, hashes) else None for t, w in zip(texts, words, strict=True)]}

        return call

    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    sieved = scratch.save(with_text_columns(keyed, make, "n_words long, kept string", drop_text=True), "sieved")
    sent.destroy()
    # rows alike have the same spans: each is searched once
    left = scratch.save(sieved.filter("kept is not null").select("doc_id", "text_key", F.col("kept").alias("text")).dropDuplicates(["doc_id", "text_key"]), "left")
    hits = None
    for block in blocks(benchmark, window, limit):
        found = scratch.save(_searched(left, block).filter(F.size("spans") > 0).select("doc_id", "text_key", "spans"), "hits")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.flatten(F.collect_list("spans")).alias("m"))
    out = sieved.join(hits, sieved.doc_id.eqNullSafe(hits.d) & sieved.text_key.eqNullSafe(hits.k), "left")
    return out.select("doc_id", "n_words", F.coalesce("m", F.array().cast(_SPAN)).alias("spans"))


def hit_words(spans: str = "spans") -> Column:
    """How many words the spans cover together."""
    ranges = F.sort_array(F.transform(spans, lambda s: F.struct(s.begin.alias("b"), (s.begin + s.length).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))

    def add(acc, r):
        end = F.greatest(acc.e, r.e)
        return F.struct((acc.n + end - F.greatest(acc.e, F.least(r.b, end))).alias("n"), end.alias("e"))

    return F.aggregate(ranges, start, add, lambda acc: acc.n)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any match as :func:`benchmark_spans` finds them, all columns kept."""
    first, more = _two(benchmark, window, limit)
    if first is None:
        return docs
    if more:
        bad = benchmark_spans(docs.withColumn("doc_id", F.xxhash64("text")).select("doc_id", "text"), benchmark, window, limit)
        key = unused(docs, "text_key")
        bad = bad.filter(F.size("spans") > 0).select(F.col("doc_id").alias(key)).distinct()
        return docs.withColumn(key, F.xxhash64("text")).join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def make():
        return lambda texts: {"_clean": [not m for m in matches([words_of(t) for t in texts], sent.value)]}

    return with_text_columns(docs, make, "_clean boolean", keep="_clean")
