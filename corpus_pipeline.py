"""From raw documents to token ids in five stages, each one operator of ``cdrlens.llm``.

Each stage works on all rows that the one before kept and wrote as Parquet. All but the last return the
columns of ``documents``; empty tables, null columns and repeated rows pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrlens.llm import decontamination, minhash, pii, piece_fst, quality_rules
from cdrlens.llm.queries import vocabulary
from cdrlens.llm.runtime import Scratch

#: Near duplicates: five-word shingles, this Jaccard similarity or more.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return minhash.keep_one(docs, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind; n_chars follows the new text."""
    clear = pii.redacted(docs)
    return clear.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clear


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (where there are such columns) with the text's SentencePiece ids, their number,
    checksum and losslessness."""
    return piece_fst.encoded(docs.select(*[c for c in ("doc_id", "lang", "source", "text") if c in docs.columns]), vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", hide_pii),
    ("sentencepiece", tokenize),
]

#: Viterbi decoding, span redaction and piece encoding are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
