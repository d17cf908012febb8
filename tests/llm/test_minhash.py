import random

import numpy as np
import pytest

from cdrlens.llm import minhash
from cdrlens.llm.words import HashTable

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent):
    """doc_id to the smallest doc_id reachable, by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(s), min(groups[find(i)])) for i, (d, s) in enumerate(sets))


def variants(n, seed=3):
    """A base text and copies with more and more words changed, shuffled: chains of links near the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(len(words))] = f"x{k}{rng.randrange(99)}"
        out.append(" ".join(words))
    return out


def pages_of_a_template(n, seed=4):
    """Texts that share most of their words and are not linked, but for some that are."""
    rng = random.Random(seed)
    head, tail = ([f"t{k}" for k in range(a, a + 70)] for a in (0, 100))
    out = []
    for k in range(n):
        own = [f"p{k if k % 6 else k - k % 12}x{j}" for j in range(36)] + [f"z{k}"] * (k % 6 == 0)
        out.append(" ".join(head + own + tail))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("threshold", [0.85])
def test_pages_of_a_template(spark, threshold, monkeypatch):
    """Members of costly buckets meet by rare shingles: the same components, and few pairs."""
    rows = list(enumerate(pages_of_a_template(72) + variants(30)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(minhash, "HOT_PAIRS", 20)
    made, real = [], minhash._rest_pairs

    def seen(*args, bands=True, **kwargs):
        out = real(*args, bands=bands, **kwargs)
        made.append((bands, args[2].agg({"all": "max"}).first()[0]))
        return out

    monkeypatch.setattr(minhash, "_rest_pairs", seen)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, threshold).collect())
    assert got == brute(rows, round(100 * threshold)) and len({g[2] for g in got}) > 50
    assert [b for b, _ in made] == [True, False]


@pytest.mark.parametrize(("threshold", "hot"), [(0.8, 5), (0.85, minhash.HOT_PAIRS)])
def test_components_like_brute_force(spark, threshold, hot, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_PAIRS", hot)
    rng = random.Random(1)
    texts = variants(120) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    texts += texts[:30] + ["a b", "A  b", "b a", "one"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(minhash, "CHUNK", 16)  # buckets in several chunks
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, threshold).collect())
    assert got == brute(rows, round(100 * threshold))


def test_given_documents_like_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 0.85).collect())
    assert got == brute(rows, 85)


def test_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(3, text, "a", 1), (3, text, "a", 1), (1, text.upper(), None, None), (None, text, "c", 2), (5, None, "d", 3), (6, "", "e", 4), (7, " \n\t ", "f", 5), (None, "", "g", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string, bands int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 0.85).collect()), key=str)
    assert got == sorted([(3, 3, 1, False)] * 2 + [(1, 3, 1, True), (None, 3, 1, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, True)], key=str)
    kept = minhash.keep_one(df, 0.85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5, 6, 7, None], key=str)
    assert minhash.near_duplicates(df.limit(0), 0.85).count() == 0
    named = df.withColumn("own_key", df.bands).withColumn("_own_key", df.bands).withColumn("kept_doc", df.bands).withColumn("_d", df.bands)
    kept = minhash.keep_one(named, 0.85)
    assert kept.columns == named.columns and all(r.own_key == r._own_key == r.kept_doc == r._d == r.bands for r in kept.collect())


def pairs_just_over(n, seed=9):
    """Texts in pairs with a similarity of 0.85 to 0.90, and the similarities."""
    rng, rows, found = random.Random(seed), [], []
    while len(found) < n:
        k = rng.randrange(120, 400)
        words = [f"w{rng.randrange(10**7)}" for _ in range(k)]
        other = list(words)
        at, cut = rng.randrange(k // 4, k // 2), round(k * rng.uniform(0.04, 0.09))
        other[at : at + cut] = [f"x{rng.randrange(10**7)}" for _ in range(cut)]
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        j = len(a & b) / len(a | b)
        if 0.85 <= j < 0.9:
            rows += [(2 * len(found), " ".join(words)), (2 * len(found) + 1, " ".join(other))]
            found.append(j)
    return rows, found


def test_recall_just_over_the_threshold(spark):
    rows, _ = pairs_just_over(500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for deviations in (minhash.ESTIMATE_DEVIATIONS, float("inf")):
        of = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 0.85, deviations=deviations).collect()}
        assert sum(of[2 * k] == of[2 * k + 1] for k in range(500)) == 500
        assert all(of[d] // 2 == d // 2 for d in of)


def test_long_text(spark):
    words = " ".join(f"w{i % 9973}" for i in range(60_000))
    df = spark.createDataFrame([(1, words), (2, words + " tail")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 0.85).collect()} == {1: 1, 2: 1}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    order = minhash._order(512, 1)
    for share in (0.3, 0.6, 0.85):
        both, alone = int(800 * share), 800 - int(800 * share)
        a = rng.integers(0, 2**63, both, dtype=np.uint64)
        sets = [np.unique(np.concatenate([a, rng.integers(0, 2**63, alone // 2, dtype=np.uint64)])) for _ in range(2)]
        sig = minhash.signatures(sets, order)
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.08


def test_signatures_in_parts_agree():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 2000, 1, 700, 40)] + [np.zeros(0, np.uint64)]
    order = minhash._order(64, 1)
    whole = minhash.signatures(sets, order)
    assert all(np.array_equal(minhash.signatures([s], order)[0], w) for s, w in zip(sets, whole, strict=True))


def test_bands_reach_the_stated_recall():
    for t in (0.8, 0.85):
        n = minhash.band_count(t)
        assert (1 - t**minhash.BAND_ROWS) ** n <= minhash.MISS
    assert minhash.shingle_sets([b"A b", b"a  B\n"], HashTable())[0] == minhash.shingle_sets([b"a  B\n"], HashTable())[0]
