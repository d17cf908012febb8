import re
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdrlens.llm import decontamination as dc


def words(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]


def brute(text, items, window):
    """Words hit and items found, by looking at every window at every place."""
    ws, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(window, len(iw))
        for a in range(len(iw) - n + 1 if iw else 0):
            for b in range(len(ws) - n + 1):
                if ws[b : b + n] == iw[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(name)
    return len(ws), len(hit), found


ALPHABET = st.text("abA1é ,\n", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4), st.lists(ALPHABET, min_size=1, max_size=4))
def test_matches_like_brute_force(texts, items):
    items = list(enumerate(items))
    usable = [(n, dc.words_of(i.encode())) for n, i in items if words(i)]
    if not usable:
        return
    found = dc.matches([dc.words_of(t.encode()) for t in texts], dc.Block(usable, 3))
    for text, spans in zip(texts, found, strict=True):
        n, hit, names = brute(text, items, 3)
        covered = {k for _, _, b, size in spans for k in range(b, b + size)}
        assert len(covered) == hit and {s[0] for s in spans} == names and len(dc.words_of(text.encode())) == n


def test_matches_are_longest_and_placed():
    item = [f"i{k}".encode() for k in range(40)]
    text = [b"x", *item[5:30], b"y", *item[:12]]
    assert sorted(dc.matches([text], dc.Block([("b", item)], 10))[0]) == [("b", 0, 27, 12), ("b", 5, 1, 25)]


def brute_longest(text, items, window):
    """For each place and item the longest match there, without those that lie in the match a word before."""
    ws, out = words(text), set()
    for name, item in items:
        iw = words(item)
        if not iw:
            continue
        best = []
        for b in range(len(ws)):
            n = [next((k for k in range(min(len(iw) - a, len(ws) - b)) if ws[b + k] != iw[a + k]), min(len(iw) - a, len(ws) - b)) for a in range(len(iw))]
            best.append(max(n) if max(n) >= min(window, len(iw)) else 0)
        out |= {(name, b, n) for b, n in enumerate(best) if n and not (b and best[b - 1] == n + 1)}
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc ", max_size=60), min_size=1, max_size=3), st.lists(st.text("abc ", max_size=60), min_size=1, max_size=4))
def test_longest_matches_like_brute_force(texts, items):
    items = list(enumerate(items))
    usable = [(n, dc.words_of(i.encode())) for n, i in items if words(i)]
    if usable:
        split = dict(usable)
        for text, spans in zip(texts, dc.matches([dc.words_of(t.encode()) for t in texts], dc.Block(usable, 3)), strict=True):
            assert {(i, b, n) for i, _, b, n in spans} == brute_longest(text, items, 3)
            assert all(dc.words_of(text.encode())[b : b + n] == split[i][a : a + n] for i, a, b, n in spans)


def test_repeated_words_and_very_long_texts():
    tracemalloc.start()
    for n in (20_000, 200_000):
        spans = dc.matches([[b"a"] * n], dc.Block([(1, [b"a"] * 200), (2, [b"a"] * 150 + [b"b"] * 50)], 10))[0]
        assert max(s[3] for s in spans) == 200 and {s[0] for s in spans} == {1, 2} and len(spans) <= 2 * n
    assert tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.stop()
    item = [f"i{k}".encode() for k in range(3000)]
    text = [f"w{k}".encode() for k in range(300_000)] + item + [f"v{k}".encode() for k in range(100_000)]
    assert dc.matches([text], dc.Block([("b", item)], 10))[0] == [("b", 0, 300_000, 3000)]


def test_the_sieve_loses_nothing(spark):
    items = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(3 + k % 20))) for k in range(60)]
    sieve = dc.Sieve(spark.createDataFrame([*items, (99, None)], "item_id long, text string"), 10)
    hashes = dc.HashTable()
    for k in range(200):
        text = " ".join(f"w{(k * 11 + j * (1 + k % 3)) % 60}" for j in range(40))
        if brute(text, items, 10)[1]:
            assert sieve.passes(dc.words_of(text.encode()), hashes)
    assert not sieve.passes([b"none", b"of", b"these"] * 10, hashes)


def tables(spark):
    long = " ".join(f"q{k}" for k in range(30))
    docs = [(1, f"Intro words. {long.upper()} end", "a"), (2, "nothing here", "b"), (2, "nothing here", "b"), (None, None, None), (4, "", "d"), (5, "short ITEM", "e"), (6, " ".join(f"q{k}" for k in range(9)), "f")]
    items = [(10, long), (2, "short, item!"), (7, None), (8, "..."), (2, "q3 q4 q5")]
    return spark.createDataFrame(docs, "doc_id long, text string, spans string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_tables_and_blocks(spark):
    docs, bench, rows, items = tables(spark)
    for limit in (dc.BLOCK_WORDS, 5):  # one block, several
        got = dc.benchmark_spans(docs, bench, 10, limit).select("doc_id", "n_words", dc.hit_words("spans").alias("hit"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s.item_id))).alias("items")).collect()
        want = []
        for d, t, _ in rows:
            n, hit, found = brute(t, items, 10)
            want.append((d, n, hit, sorted(map(str, found))))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        clean = dc.remove_contaminated(docs, bench, 10, limit)
        assert clean.columns == docs.columns
        assert sorted(str(r.doc_id) for r in clean.collect()) == ["2", "2", "4", "None"]


def test_empty_tables(spark):
    docs, bench, _, _ = tables(spark)
    assert dc.benchmark_spans(docs.limit(0), bench).count() == 0
    assert dc.benchmark_spans(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert dc.remove_contaminated(docs, bench.limit(0)).count() == docs.count()
