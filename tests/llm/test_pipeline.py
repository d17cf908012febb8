import public_tokenizers
import sentencepiece

import corpus_pipeline
from cdrlens.llm import pii, quality_rules
from cdrlens.llm.words import HashTable
from tests.llm import test_decontamination, test_minhash

SF = "/root/testdata/sf0.001"


def test_like_a_plain_version(spark):
    """Every stage by a plain loop over its own input: rules, all pairs, all windows, spans, the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = quality_rules.judge([(d.text or "").encode() for d in docs], HashTable())["kept"]
    docs = [d for d, k in zip(docs, kept, strict=True) if k]
    first = {d for d, _, c in test_minhash.brute([(d.doc_id, d.text) for d in docs], 80) if d == c}
    docs = [d for d in docs if d.doc_id in first and not test_decontamination.brute(d.text, items, 10)[1]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d.doc_id: library.encode(pii.redact(d.text, pii.find(d.text))) for d in docs}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) > 50
    assert all(r.lossless for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), SF).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.tokenize(spark, docs.limit(0), SF).count() == 0


def test_null_columns(spark):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(80)) + "."
    rows = [(1, text, None, None, None), (None, text + " more", "en", "s", 3), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
