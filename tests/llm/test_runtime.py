"""Word tables, slices of texts, scratch tables."""

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from cdrlens.llm import words
from cdrlens.llm.runtime import Scratch, shared_folder, with_text_columns


@given(st.lists(st.lists(st.sampled_from([b"a", b"bb", b"ccc", b"d", b"e", b"f", b"g"]), max_size=12), max_size=12))
def test_tables_that_fill_up_give_the_same(batches):
    ragged = words.RaggedTable(lambda ws: words.ragged([[len(w)] * len(w) for w in ws]), np.int32, capacity=3)
    hashes = words.HashTable(capacity=2)
    for batch in batches:
        flat, lengths = ragged(batch)
        assert flat.tolist() == [len(w) for w in batch for _ in w] and lengths.tolist() == [len(w) for w in batch]
        assert hashes(batch).tolist() == [xxhash.xxh64_intdigest(w) for w in batch]


def test_windows_tell_order_and_length():
    h = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    w = words.windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 3 and len(words.windows(h[:2], 3)) == 0
    assert len({words.sequence_hash(h[:n]) for n in range(5)}) == 5


def test_columns_pass_and_are_replaced(spark):
    df = spark.createDataFrame([(1, "abc", "x", 7.0), (2, None, None, None), (3, "", "z", 1.0), (4, "é" * 10, "w", 2.0)], "id long, text string, Size string, other double")

    def make():
        return lambda texts: {"size": [-1 if t is None else len(t) for t in texts], "keep": [t is not None for t in texts]}

    for limit in (1, 5, 1 << 20):
        out = with_text_columns(df, make, "size long, keep boolean", limit=limit)
        assert out.columns == ["id", "text", "other", "size", "keep"]
        assert sorted((r.id, r.text, r.size) for r in out.collect()) == [(1, "abc", 3), (2, None, -1), (3, "", 0), (4, "é" * 10, 20)]
        kept = with_text_columns(df, make, "size long, keep boolean", keep="keep", limit=limit)
        assert kept.columns == df.columns and sorted(r.id for r in kept.collect()) == [1, 3, 4]
    assert with_text_columns(df, make, "size long, keep boolean", drop_text=True).columns == ["id", "other", "size", "keep"]


def test_scratch_tables(spark):
    scratch = Scratch(spark, "test")
    saved = scratch.save(spark.range(10), "numbers")
    assert saved.count() == 10 and saved._scratch_path.startswith(shared_folder(spark))
    scratch.drop(saved)
    scratch.close()
