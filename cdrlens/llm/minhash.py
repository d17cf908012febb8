"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters a shingle to one of ``SPACE`` places, the
second orders the places, and coordinate k is the minimum after a circular shift by k. Documents that
agree on a whole band of coordinates are candidates; a link counts only if the full shingle sets say so.

Everything is done on *classes*, the distinct shingle sets, so copies cost one row each. A class is
named by 12 bytes of its set's hash and 4 bytes of its set's size. In a bucket first all members are compared
with two leaders and the links are joined to components; then, once, members that a bucket still holds in
different components are compared with one another, those of its largest component with the others only.
Thus no link that would join two components is lost inside a bucket. A bucket of n near copies costs about
2 n comparisons.

Classes that share a band but aren't linked, as pages of one template, would cost n * n / 2 comparisons.
Where a bucket has more than ``HOT_PAIRS`` of them, its members meet by rare shingles instead: two sets with
a similarity of t have one of their n - ceil(t * n) + 1 rarest shingles in common (n: the set's size), which
for pages of a template are those of the page itself. That is exact: each link of the bucket is still met.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, unused, with_text_columns
from .words import HashTable, mix64, sequence_hash, windows

SHINGLE_WORDS = 5
#: Places that the first permutation scatters shingles to.
SPACE_BITS = 20
SPACE = 1 << SPACE_BITS
#: Coordinates of a band, and the chance at most of missing a pair just at the threshold.
BAND_ROWS = 6
MISS = 1e-5
#: Coordinates of a signature; the bands take the first, estimates take all.
COORDINATES = 512
#: A candidate whose estimated similarity is so many standard deviations under the threshold is no link
#: (a chance of 4e-6 for a pair just at the threshold). Infinite: each candidate's full sets are compared.
ESTIMATE_DEVIATIONS = 4.5
#: Parts that each band's members are dealt into where they meet the band's own row.
SALTS = 32
#: Members of a bucket that are compared with one another at once.
CHUNK = 256
#: Comparisons that a bucket may cost before its members meet by rare shingles.
HOT_PAIRS = 4_000_000
#: Shingles whose windows are gathered at once: what a processor's cache holds.
GATHER = 512
SEED = 20_011


def band_count(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold shares none with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _order(coordinates: int, seed: int) -> np.ndarray:
    """The second permutation, continued past its end so that each shift is one plain window."""
    order = np.random.default_rng(seed).permutation(SPACE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)


def shingle_sets(texts: list, hashes: HashTable, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles (ASCII lower case; white space parts words)."""
    words = [t.lower().split() if t else [] for t in texts]
    counts = [len(w) for w in words]
    flat = hashes([w for ws in words for w in ws])
    shingles = windows(flat, size)
    out, at = [], 0
    for n in counts:
        if n >= size:
            own = np.sort(shingles[at : at + n - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            out.append(np.array([sequence_hash(flat[at : at + n])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """One row of minima a set; empty sets get the largest value everywhere."""
    out = np.full((len(sets), order.shape[1]), np.iinfo(np.int32).max, np.int32)
    place = [(mix64(s) >> np.uint64(64 - SPACE_BITS)).astype(np.int64) for s in sets]
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(place[j]) <= GATHER):
            total += len(place[j])
            j += 1
        if j == i + 1:
            for a in range(0, len(place[i]), GATHER):
                np.minimum(out[i], order[place[i][a : a + GATHER]].min(axis=0), out=out[i])
        else:
            full = [k for k in range(i, j) if len(place[k])]
            if full:
                starts = np.cumsum([0] + [len(place[k]) for k in full[:-1]])
                out[full] = np.minimum.reduceat(order[np.concatenate([place[k] for k in full])], starts, axis=0)
        i = j
    return out


def class_name(s: np.ndarray) -> bytes | None:
    """Name of a shingle set: 12 bytes of its hash, then its size in 4; ``None`` if empty."""
    if not len(s):
        return None
    return xxhash.xxh3_128_digest(s.tobytes())[:12] + len(s).to_bytes(4, "big")


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, k = sig.shape
    parts = sig.reshape(n, k // rows, rows).astype(np.uint64)
    acc = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) + np.uint64(1), (n, k // rows)).copy()
    for r in range(rows):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return acc.view(np.int64)


def signed(docs: DataFrame, threshold: float, rows: int = BAND_ROWS, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, text_key, class, n_shingles, bands and an 8-bit sketch."""
    bands = band_count(threshold, rows)
    coordinates = max(COORDINATES, bands * rows)

    def make():
        hashes, order = HashTable(), _order(coordinates, SEED)

        def call(texts):
            sets = shingle_sets(texts, hashes, size)
            sig = signatures(sets, order)
            keys, sketch = _band_keys(sig[:, : bands * rows], rows), sig.astype(np.uint8)
            return {
                "class": [class_name(s) for s in sets],
                "n_shingles": [len(s) for s in sets],
                "bands": [k if len(s) else [] for k, s in zip(keys, sets, strict=True)],
                "sketch": [k.tobytes() if len(s) else None for k, s in zip(sketch, sets, strict=True)],
            }

        return call

    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return with_text_columns(slim, make, "class binary, n_shingles long, bands array<long>, sketch binary", drop_text=True)


def _class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``class, shingles`` of the classes in ``wanted`` (class, doc_id, text_key: where a text of it is)."""
    keyed = docs.select(F.col("doc_id").alias("d"), "text", F.xxhash64("text").alias("k"))
    found = keyed.join(wanted, keyed.d.eqNullSafe(wanted.doc_id) & (keyed.k == wanted.text_key)).select("class", "text")

    def make():
        hashes = HashTable()

        def call(texts):
            sets = shingle_sets(texts, hashes, size)
            return {"shingles": [s.view(np.int64) for s in sets], "own": [class_name(s) for s in sets]}

        return call

    found = with_text_columns(found, make, "shingles array<long>, own binary", drop_text=True)
    return found.filter("own = class").drop("own")


def _size(name: str) -> F.Column:
    return F.conv(F.hex(F.substring(name, 13, 4)), 16, 10).cast("long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return both.filter(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def _fits(percent: int) -> F.Column:
    """Sizes alone allow the link: the smaller set has ``percent`` of the larger at least."""
    small, large = F.least(_size("a"), _size("b")), F.greatest(_size("a"), _size("b"))
    return 100 * small >= percent * large


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``class, component``: the smallest class reachable over ``links`` (a, b), for linked classes.

    Each round takes the smallest label around and then the label's own label, until nothing changes.
    """
    edges = scratch.save(links.union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("class"), F.least("u", "m").alias("component")), "labels")
    while True:
        around = edges.join(labels, edges.v == labels["class"]).groupBy("u").agg(F.min("component").alias("m"))
        near = labels.join(around, labels["class"] == around.u).select("class", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("class").alias("c"), F.col("component").alias("cc"))
        after = near.join(up, "c", "left").select("class", "old", F.least("c", F.coalesce("cc", "c")).alias("component"))
        saved = scratch.save(after, "labels")
        changed = saved.filter("old != component").limit(1).count()
        scratch.drop(labels)
        labels = saved
        if not changed:
            scratch.drop(edges)
            return labels.select("class", "component")


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _open(labelled: DataFrame) -> DataFrame:
    """``band, all, main, parts`` of buckets of three or more that hold several components: members, the
    largest component with its members, and components."""
    sizes = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1 and all > 2")


def _rare(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``class, band``: buckets by the rarest shingles of each of ``members`` (class), as many as a link needs."""
    each = sets.join(members, "class").select("class", F.size("shingles").alias("size"), F.explode("shingles").alias("band"))
    often = each.groupBy("band").agg(F.count("*").alias("often"))
    order = Window.partitionBy("class").orderBy("often", "band")
    ranked = each.join(often, "band").withColumn("place", F.row_number().over(order))
    # whole numbers, so that no rounding makes the prefix too short
    least = F.ceil(F.lit(round(100 * threshold)) * F.col("size") / 100)
    return ranked.filter(F.col("place") <= F.col("size") - least + 1).select("class", "band")


def _rest_pairs(labelled: DataFrame, nodes: DataFrame, open_: DataFrame, threshold: float, deviations: float, bands: bool = True) -> DataFrame:
    """Pairs (a, b) of different components that some bucket in ``open_`` holds, as far as their sketches allow a
    link; with ``bands`` each pair comes from the first band that it shares.

    Members of a bucket's largest component are compared with the others only, never among themselves, so
    a large group with a few outliers costs its size times the outliers. Members are dealt into chunks of
    ``CHUNK`` and each pair of chunks is a group of its own: no task holds a whole bucket of any size.
    """
    percent = round(100 * threshold)
    chunks = [F.ceil(n / CHUNK).cast("int").alias(c) for n, c in ((F.col("all") - F.col("main.n"), "small"), (F.col("main.n"), "large"))]
    open_ = open_.select("band", F.col("main.component").alias("main"), *chunks)
    # a hot band's members meet its row in SALTS tasks
    salted = labelled.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    open_ = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # exchanges, never a broadcast: a table's size on disk says nothing of its rows times SALTS
    held = salted.join(open_.hint("merge"), ["band", "salt"]).join(nodes.select("class", "bands", "sketch"), "class")
    in_main, dice = F.col("component") == F.col("main"), F.xxhash64("class", "band")
    own = F.when(in_main, F.col("small") + F.pmod(dice, F.col("large"))).otherwise(F.pmod(dice, F.col("small"))).cast("int")
    others = F.sequence(F.lit(0), F.when(in_main, F.col("small")).otherwise(F.col("small") + F.col("large")) - 1)
    dealt = held.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "component", "bands", "sketch")
    cut = threshold - deviations * math.sqrt(threshold * (1 - threshold) / COORDINATES)

    def compare(key, table):
        import pyarrow as pa

        band, i, j = (k.as_py() for k in key)
        name = table["class"].to_pylist()
        n, own = len(name), table["own"].to_numpy()
        component = np.unique(np.array(table["component"].to_pylist(), dtype=object), return_inverse=True)[1]
        keys = np.array(table["bands"].to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, -1)
        size = np.array([int.from_bytes(x[12:], "big") for x in name], np.int64)
        at = int(np.nonzero(keys[0] == band)[0][0]) if bands else 0
        out_a, out_b = [], []
        for k in range(n):
            later = np.arange(k + 1, n)
            ok = component[later] != component[k]
            if i != j:
                ok &= own[later] != own[k]
            ok &= 100 * np.minimum(size[later], size[k]) >= percent * np.maximum(size[later], size[k])
            later = later[ok]
            if at and len(later):
                later = later[~(keys[later, :at] == keys[k, :at]).any(axis=1)]
            if len(later):
                later = later[(sketch[later] == sketch[k]).mean(axis=1) >= cut]
            for m in later.tolist():
                x, y = sorted((name[k], name[m]))
                out_a.append(x)
                out_b.append(y)
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return dealt.groupBy("band", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, rows: int = BAND_ROWS, size: int = SHINGLE_WORDS, deviations: float = ESTIMATE_DEVIATIONS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked whose sets of distinct ``size``-word shingles have a Jaccard similarity of
    ``threshold`` or more (whole percents); component_id is the smallest doc_id reachable over links.
    Words are parted by ASCII white space, after lower-casing A-Z; fewer than ``size`` words are one
    shingle. Null or empty texts, or texts of white space, have no shingle and are linked with nothing:
    their component_id is their own doc_id. A null doc_id is never a component_id unless all of its
    component are null; kept is then true for each of its rows. Rows repeated whole give repeated
    results. Rows of one doc_id with different texts are linked only as their texts are. Other columns of
    ``docs`` are ignored; an empty table gives an empty result. With ``deviations`` infinite no candidate is left
    out by its estimate. text_key is Spark's xxhash64 of the text.
    """
    spark = docs.sparkSession
    percent = round(100 * threshold)
    scratch = Scratch(spark, "minhash")
    docs = docs.select("doc_id", "text")
    sig = scratch.save(signed(docs, threshold, rows, size), "signed")

    one = sig.filter("class is not null").groupBy("class")
    nodes = scratch.save(one.agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    buckets = nodes.select("class", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo != hi")
    held = scratch.save(buckets.join(shared, "band"), "buckets")
    stars = held.select("class", F.explode(F.array("lo", "hi")).alias("leader")).filter("class != leader")
    stars = stars.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct().filter(_fits(percent))
    stars = scratch.save(stars, "stars")

    def where(pairs: DataFrame) -> DataFrame:
        names = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        return names.join(nodes.select("class", "at.doc_id", "at.text_key"), "class")

    sets = scratch.save(_class_sets(docs, where(held.select(F.col("class").alias("a"), F.col("lo").alias("b"))), size), "sets")
    links = scratch.save(_verified(stars, sets, percent), "links")
    labels = components(links, scratch)
    labelled = scratch.save(_labelled(held.select("class", "band"), labels), "labelled")
    open_ = scratch.save(_open(labelled), "open")
    costly = (F.col("all") - F.col("main.n")) * F.col("all") > HOT_PAIRS
    rest = _rest_pairs(labelled, nodes, open_.filter(~costly), threshold, deviations)
    if open_.filter(costly).limit(1).count():
        members = labelled.join(open_.filter(costly).select("band"), "band", "left_semi").select("class").distinct()
        rare = scratch.save(_labelled(_rare(members, sets, threshold), labels), "rare")
        rest = rest.unionByName(_rest_pairs(rare, nodes, _open(rare), threshold, deviations, bands=False))
    rest = scratch.save(rest.distinct().join(stars, ["a", "b"], "left_anti"), "rest")
    more = scratch.save(_verified(rest, sets, percent), "links")
    scratch.drop(sets, rest, stars, held, labelled, open_)
    labels = components(links.union(more), scratch)

    of = nodes.select("class", "least").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # as a table of its own, so that the join below is one of plain exchanges, which can split a hot component
    least = scratch.save(of.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    of = scratch.save(of.join(least, "component").select("class", "component_id"), "of")
    out = sig.select("doc_id", "text_key", "n_shingles", "class").join(of, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all columns; of repeated rows one."""
    d, k, own_key = (unused(docs, n) for n in ("kept_doc", "kept_key", "own_key"))
    kept = near_duplicates(docs, threshold).filter("kept").select(F.col("doc_id").alias(d), F.col("text_key").alias(k)).distinct()
    own = docs.withColumn(own_key, F.xxhash64("text"))
    out = own.join(kept, own.doc_id.eqNullSafe(kept[d]) & (own[own_key] == kept[k]), "left_semi")
    return out.dropDuplicates(["doc_id", own_key]).drop(own_key)
