import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cdrlens.llm import token_index as ti

FILE = public_tokenizers.path("word_bpe_49k.json")
SIZES = "doc_id long, text string, shard string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=400, unique=True), st.integers(-(2**63), 2**63 - 1))
def test_hash_is_minimal_and_perfect(keys, other):
    ids = np.array(sorted(keys))
    h = ti.key_hashes(ids, np.zeros(len(ids), bool), np.zeros(len(ids), int))
    assert sorted(ti.PerfectHash.build(h).slots(h).tolist()) == list(range(len(ids)))
    index = ti.pack_index(ids, np.zeros(len(ids), bool), np.arange(len(ids)), np.ones(len(ids)), 2) + b"\n"
    shard = ti.Shard(index)
    assert [int(shard.place[shard.find(np.array([k]), np.array([False]), np.array([0]))[0]]) for k in ids] == list(range(len(ids)))
    if other not in keys:
        assert shard.get(other) is None


def test_many_keys():
    ids = np.arange(50_000) * 7 - 1000
    h = ti.key_hashes(ids, np.zeros(len(ids), bool), np.zeros(len(ids), int))
    assert np.array_equal(np.sort(ti.PerfectHash.build(h).slots(h)), np.arange(len(ids)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_words_encode_like_whole_texts(texts):
    encoder = _encoder()
    ids, counts = encoder([t.encode() for t in texts])
    whole = [x.ids + [ti.END_ID] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, whole))
    assert ids.tolist() == [i for r in whole for i in r]


_made = []


def _encoder():
    if not _made:
        _made.append(ti.WordEncoder(FILE, "<u2"))
    return _made[0]


def test_round_trip(spark, tokenizer):
    rows = [(5, "Some words here, it's 5.", "a"), (None, "null id", None), (3, None, "b"), (3, "", "b"), (9, "x " * 5000, "c"), (5, "Other text", "d"), (-4, "é <|endoftext|> ö", "")]
    df = spark.createDataFrame(rows, SIZES).repartition(3)
    got = ti.round_trip(df, FILE, shard_bytes=2000).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, -4, 3, 3, 5, 5, 9]
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order[:-1]]).tolist()

    def expected(text):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(expected(t) for _, t, _ in rows)
    assert ti.round_trip(df.limit(0), FILE).count() == 0


def test_shards_are_ordered_by_number(spark):
    """Beyond 99,999 files names no longer sort as their numbers do."""
    n = 100_020
    rows = spark.range(n).select(F.format_string("part-%05d-x-c000.txt", "id").alias("file"), (F.col("id") % 7 + 1).alias("tokens")).repartition(8)
    got = dict(ti.with_starts(rows.withColumn("shard", ti.shard_number(F.col("file")))).filter("shard > 99990 or shard < 5 or shard % 1024 < 2").select("shard", "start").collect())
    want = np.cumsum([0] + [k % 7 + 1 for k in range(n)])
    assert len(got) > 200 and all(got[k] == want[k] for k in got)


def test_shard_counts():
    assert ti.shard_count(0, 8) == 1 and ti.shard_count(800 << 20, 6) == 48 and ti.shard_count(30 << 20, 8) == 3
    assert ti.shard_count(100 << 40, 1000) == (100 << 40) // ti.SHARD_BYTES


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "changed"])
def test_another_tokenizer(tmp_path, name):
    """A file that the word encoder's facts don't hold for is used text by text."""
    file = public_tokenizers.path(name) if name != "changed" else str(tmp_path / "t.json")
    if name == "changed":
        parts = json.loads(open(FILE, encoding="utf-8").read())
        parts["normalizer"]["normalizers"].pop()
        (tmp_path / "t.json").write_text(json.dumps(parts))
    assert ti.is_word_tokenizer(FILE) and not ti.is_word_tokenizer(file)
    texts = ["Some Words, here.", "", "A  b\n\nC"]
    ids, counts = ti.encoder_of(file, "<u2")([t.encode() for t in texts])
    whole = [x.ids + [ti.END_ID] for x in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, whole)) and ids.tolist() == [i for r in whole for i in r]


def test_keys_are_whole_numbers(spark, tmp_path):
    with pytest.raises(TypeError, match="whole number"):
        ti.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "t"), FILE)
    got = ti.round_trip(spark.createDataFrame([(1, "b")], "doc_id int, text string"), FILE).first()
    assert got.doc_id == 1


def test_lookup_opens_only_the_shards_that_may_hold_a_key(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "doc_id long, text string")
    path = str(tmp_path / "t")
    ti.write(df, path, FILE, shard_bytes=300)
    made = ti.write_map(spark, path).orderBy("shard").collect()
    assert len(made) > 5 and sum(r.documents for r in made) == 200 and [r.start for r in made] == np.cumsum([0] + [r.tokens for r in made[:-1]]).tolist()
    keep = next(r.file for r in made if r.least <= 77 <= r.greatest)
    for f in (tmp_path / "t").glob("part-*"):
        if f.name != keep:
            f.unlink()
    assert [r.doc_id for r in ti.lookup(spark, path, [77]).collect()] == [77]
    assert ti.lookup(spark, path, [5000]).count() == 0


def test_lookup(spark, tmp_path, tokenizer):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(100)], "doc_id long, text string")
    ti.write(df, str(tmp_path / "t"), FILE, shard_bytes=300)
    got = {r.doc_id: r.ids for r in ti.lookup(spark, str(tmp_path / "t"), [3, 77, 500]).collect()}
    assert got == {i: [*tokenizer.encode(f"text number {i}", add_special_tokens=False).ids, 2] for i in (3, 77)}
