import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cdrlens.llm import lines as ln
from cdrlens.llm import quality_classifier as qc
from cdrlens.llm import quality_rules as qr
from cdrlens.llm.queries import op4_quality_rules, op5_quality_classifier
from cdrlens.llm.words import HashTable


def brute_counts(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé# \n\t!日", max_size=40), min_size=1, max_size=4))
def test_counts_like_brute_force(texts):
    got = qr.judge([t.encode() for t in texts], HashTable())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[k][i]) for k in names) for i in range(len(texts))] == [brute_counts(t) for t in texts]
    for i, t in enumerate(texts):
        n, _, _, _, rep = brute_counts(t)
        assert bool(got["base_failed"][i]) == (n < 50 or 100 * rep > 50 * n)
        assert not (got["base_failed"][i] and got["kept"][i])


FIELDS = st.lists(st.lists(st.tuples(st.floats(-3, 3), st.floats(-3, 3)), min_size=1, max_size=5), min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(FIELDS, st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_decoding_like_enumeration(sequences, t):
    transition = np.array(t).reshape(2, 2)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    scores = np.array([x for s in sequences for x in s])
    best = ln.viterbi(scores, transition, first)
    p, pairs, logz = ln.marginals(scores, transition, first, pairs=True)
    want_pairs, want_z = np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(first):
        own = scores[a:b]
        paths = list(itertools.product((0, 1), repeat=len(own)))
        value = np.array([sum(own[i][y] for i, y in enumerate(path)) + sum(transition[x, y] for x, y in itertools.pairwise(path)) for path in paths])
        got = tuple(best[a:b].tolist())
        assert value[paths.index(got)] >= value.max() - 1e-9
        share = np.exp(value - value.max())
        want_z += value.max() + np.log(share.sum())
        share /= share.sum()
        for i in range(len(own)):
            assert abs(p[a + i, 1] - sum(s for s, path in zip(share, paths, strict=True) if path[i])) < 1e-9
        for s, path in zip(share, paths, strict=True):
            for x, y in itertools.pairwise(path):
                want_pairs[x, y] += s
    assert np.allclose(pairs, want_pairs) and abs(logz - want_z) < 1e-9


def brute_features(text):
    """A text's line features by their definitions, one line at a time."""
    rows, words_before, all_words, seen = [], 0, [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], set()
    windows = [tuple(all_words[i : i + 3]) for i in range(len(all_words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    for line in text.split("\n"):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
        w, c = max(len(ws), 1), max(len(line), 1)
        count = lambda chars, line=line: sum(x in chars for x in line)
        upper, lower = sum("A" <= x <= "Z" for x in line), sum("a" <= x <= "z" for x in line)
        ends = bool(ws) and ws[-1][-1] in ".?!\"')"
        rows.append([
            math.log1p(len(line)) / 6, math.log1p(len(ws)) / 4, sum(map(len, ws)) / w / 8, upper / max(upper + lower, 1), count("0123456789") / c,
            count("#*$%&|<>") / w, count("!") / w, min(count("|") / w, 1), min(count(".,;:?") / w, 1), ends, bool(ws) and line in seen,
            len([i for i in range(words_before, words_before + len(ws)) if i in repeated]) / w, not ws, sum(len(x.encode()) <= 3 for x in ws) / w,
            0 if ends or not ws else max(1 - len(ws) / 8, 0),
        ])
        seen.add(line)
        words_before += len(ws)
    return [[min(float(x), 2.0) for x in r] for r in rows]


def brute_viterbi(scores, transition):
    """Best labels by comparing prefixes that end in each label; a tie goes to the smaller label before."""
    best = [(scores[0][y], [y]) for y in (0, 1)]
    for s in scores[1:]:
        best = [max(((best[x][0] + transition[x][y] + s[y], [*best[x][1], y]) for x in (0, 1)), key=lambda b: b[0]) for y in (0, 1)]
    return max(best, key=lambda b: b[0])[1]


def brute_marginals(scores, transition):
    """Chances of label 1 by sums over prefixes and suffixes, in plain numbers scaled a line."""
    forward, backward = [], [[1.0, 1.0]]
    for i, s in enumerate(scores):
        f = [math.exp(s[y]) * (sum(forward[-1][x] * math.exp(transition[x][y]) for x in (0, 1)) if i else 1) for y in (0, 1)]
        forward.append([v / sum(f) for v in f])
    for s in scores[:0:-1]:
        b = [sum(math.exp(transition[x][y] + s[y]) * backward[0][y] for y in (0, 1)) for x in (0, 1)]
        backward.insert(0, [v / sum(b) for v in b])
    return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]


def brute_kept(text, transition=None):
    n, _, _, _, rep = brute_counts(text)
    rows = brute_features(text)
    scores = [(0.0, qr.BIAS + sum(qr.WEIGHTS.get(f, 0.0) * x for f, x in zip(ln.FEATURES, r, strict=True))) for r in rows]
    labels = brute_viterbi(scores, transition or qr.TRANSITION)
    chars = [len(re.sub(r"[\x20\x09-\x0D]+", "", line)) for line in text.split("\n")]
    share = sum(c for c, y in zip(chars, labels, strict=True) if y) / max(sum(chars), 1)
    return not (n < 50 or 100 * rep > 50 * n) and share >= qr.CONTENT_SHARE


def brute_score(text, model):
    weight, transition = model
    rows = brute_features(text)
    none = [0.0] * len(ln.FEATURES)
    scores = []
    for i, r in enumerate(rows):
        x = [*r, *(rows[i - 1] if i else none), *(rows[i + 1] if i + 1 < len(rows) else none), 1.0]
        s = sum(a * b for a, b in zip(x, weight, strict=True))
        scores.append((-s / 2, s / 2))
    p, size = brute_marginals(scores, transition), [len(line) + 1 for line in text.split("\n")]
    return sum(a * b for a, b in zip(p, size, strict=True)) / sum(size)


def test_whole_queries_like_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_quality_rules(spark, sf).collect()
    assert len(got) == len(texts) and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id]) and r.kept == brute_kept(texts[r.doc_id]) for r in got)
    model = qc.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for r in op5_quality_classifier(spark, sf).collect():
        assert abs(r.score - brute_score(texts[r.doc_id], model)) < 1e-6 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@settings(max_examples=100, deadline=None)
@given(st.text("aB1.!|# \n\té日", max_size=200))
def test_features_like_brute_force(text):
    assert np.allclose(ln.lines_of([text.encode()], HashTable()).features, brute_features(text))


def _invented(rng, n):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(4, 9, n)]


def _sentence(rng, n=12):
    return " ".join(_invented(rng, n)).capitalize() + "."


def test_the_chain_decides_verdicts(monkeypatch):
    rng = np.random.default_rng(5)
    title = lambda n: " ".join(_invented(rng, n)).title()
    headed = "\n".join(line for _ in range(14) for line in (title(6), _sentence(rng, 5)))  # headings longer than their sentences
    teasers = "\n".join(line for _ in range(12) for line in (title(1), title(1), _sentence(rng, 5)))  # a page of entries and teasers
    texts = [headed, teasers]
    verdicts = lambda: [bool(k) for k in qr.judge([t.encode() for t in texts], HashTable())["kept"]]
    assert verdicts() == [True, False] == [brute_kept(t) for t in texts]
    monkeypatch.setattr(qr, "TRANSITION", ((0, 0), (0, 0)))
    assert verdicts() == [False, True]


def test_the_chain_decides_scores():
    """Documents whose lines are alike but for the first: what it tells reaches the rest by the chain alone."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(6, 12, 200)
    first = np.concatenate([[0], np.cumsum(sizes)])
    labels = np.arange(200) % 2
    features = np.zeros((first[-1], len(ln.FEATURES)))
    features[:, 0] = 0.8
    features[first[:-1], 5] = np.where(labels == 1, 0.0, 2.0)
    model = qc.fit(features, first, labels, np.full(first[-1], 100))

    def right(transition):
        s = qc._scores(ln.with_neighbours(features, first), model[0])
        p = np.add.reduceat(ln.marginals(s, transition, first)[:, 1], first[:-1]) / sizes
        return ((p >= qc.PREDICT_AT) == (labels == 1)).mean()

    assert right(model[1]) == 1.0 and right(np.zeros((2, 2))) < 0.6


GOOD = "The thing that was here is of the kind, and it was good for all of them. " * 6
JUNK = "Stuff### buy$$$ now%%% more&&& offers### cheap*** deals$$$ today%%% only&&& here### " * 8
SHOUT = "\n".join(" ".join(f"WORD{i}{k}!!" for k in range(10)) for i in range(8))
LIST = " | ".join(f"item{k}name" for k in range(80))


def test_verdicts():
    got = qr.judge([t.encode() for t in (re.sub(r"(\w+)", lambda m: m[0], GOOD), JUNK, SHOUT, LIST)], HashTable())
    rng = np.random.default_rng(2)
    pick = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(2, 8, n)]
    varied = " ".join(" ".join(pick(9)).capitalize() + "." for _ in range(12))
    assert qr.judge([varied.encode()], HashTable())["kept"].tolist() == [True]
    assert got["kept"].tolist() == [False] * 4 and not got["base_failed"][2] and not got["base_failed"][3]


def test_rules_on_tables(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "few words", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = qr.judged(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == [("1", 0, False), ("2", 0, False), ("2", 0, False), ("None", 2, False)]
    assert qr.kept(df).count() == 0 and qr.kept(df).columns == df.columns and qr.judged(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = np.random.default_rng(3)
    text = "\n".join(f"{_sentence(rng, 2)[:-1]} {k} of the lines that are here, and so on it goes." for k in range(10_000))
    got = qr.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_words == 15 * 10_000 and got.kept


def test_the_sample_does_not_depend_on_partitions(spark):
    rows = [(k % 40, f"{_sentence(np.random.default_rng(k))}\n" * (k % 3 + 1)) for k in range(120)]  # three texts a doc_id
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    frames = [spark.createDataFrame(x, "doc_id long, text string").repartition(n) for x, n in ((rows, 1), (rows[::-1], 7))]
    one, other = (sorted(map(tuple, qc._chosen(f, labels, 20, 1000, 1 << 20).collect())) for f in frames)
    assert one == other and len(one) == 20
    assert len(qc._chosen(frames[0], labels, 20, 5, 1 << 20).collect()) <= 5


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = qr.judged(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in judged}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = qc.train(docs, labels)
    rows = qc.scored(docs, model).withColumn("held_out", qc.held_out()).join(labels, "doc_id").filter("held_out").collect()
    right = sum((r.score >= qc.PREDICT_AT) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    again = qc.train(docs, labels.withColumn("quality", 1 - labels.quality).filter(qc.held_out()).unionByName(labels.filter(~qc.held_out())))
    assert np.allclose(model[0], again[0])  # held-out labels have no part in it


def test_classifier_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "Good text here.", 0.0), (3, "Good text here.", 0.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None), (3, 7)], "doc_id long, quality int")
    assert qc.train(docs, labels) is None
    assert {r.score for r in qc.scored(docs, None).collect()} == {0.5}
    rng = np.random.default_rng(0)
    model = (rng.normal(size=3 * len(ln.FEATURES) + 1), rng.normal(size=(2, 2)))
    assert all(0 <= r.score <= 1 for r in qc.scored(docs, model).collect()) and qc.scored(docs.limit(0), model).count() == 0
    many = "\n".join(["a line of words."] * 5000)
    assert 0 <= qc.score_texts([many.encode(), b""], model, HashTable())[0] <= 1
