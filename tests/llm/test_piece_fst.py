import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cdrlens.llm import piece_fst

FILE = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
CODEC = piece_fst.Codec(FILE)


def both(texts):
    ids, counts = CODEC.encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == LIBRARY.encode(t or ""), t
        at += n


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=3))
def test_like_the_library(texts):
    both(texts)


@settings(max_examples=600, deadline=None)
@given(st.text("abtheinrsé \n1▁._", max_size=40))
def test_like_the_library_on_dense_merges(text):
    both([text])


def test_documents_like_the_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    both(texts)
    for t in texts[:100]:
        ids, _ = CODEC.encode([t])
        assert CODEC.decode(ids.tolist()) == t


@settings(max_examples=300, deadline=None)
@given(st.text("abtheinrsé1▁._", min_size=1, max_size=30))
def test_both_solvers_agree(unit):
    assert CODEC.transducer.solve(unit) == CODEC.transducer.shortest(unit)


def test_long_unit_and_blanks():
    both(["ab" * 5000, " " * 100, "a" + " " * 37 + "b", "\n\n x\n"])


def test_tables(spark):
    rows = [(1, "Hello  world\n", 9), (1, "Hello  world\n", 9), (None, None, 1), (2, "", 2), (3, "日本 é ▁x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = piece_fst.encoded(df, FILE)
    got = out.collect()
    assert len(got) == 5 and all(r.lossless for r in got)
    assert sorted(r.ids for r in got) == sorted(LIBRARY.encode(t or "") for _, t, _ in rows)
    back = {(r.doc_id, r.text) for r in piece_fst.decoded(out, FILE).collect()}
    assert back == {(1, rows[0][1]), (None, ""), (2, ""), (3, "日本 é  x")}
    assert piece_fst.encoded(df.limit(0), FILE).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        piece_fst.Model(str(tmp_path / "m"))
