"""The registered queries of the text operators, and the same results in SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, htmltext, licenses, minhash, pii, piece_fst, quality_classifier, quality_rules, token_index, warc

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


_OP8_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s.item_id)))
    n_hit = decontamination.hit_words("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), items AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0
), iw AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS w FROM items
), sizes AS (
  SELECT DISTINCT n FROM items
), dw AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM d, sizes WHERE len(ws) >= n
), hits AS (
  SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.w = array_to_string(dw.ws[dw.p:dw.p + dw.n - 1], ' ')
), hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))

    base = F.filter("spans", lambda s: s.kind.isin(*pii.KINDS[:4]))
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    scores = F.concat_ws(",", F.transform("spans", lambda s: F.format_string("%.2f", s.score)))
    return found.select(
        "doc_id", *counts[:4], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        scores.alias("scores"), *counts[4:], F.size("spans").cast("long").alias("n_spans"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    out = quality_classifier.scored(docs, model)
    predicted = (F.col("score") >= quality_classifier.PREDICT_AT).cast("int")
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matched(_table(spark, sf_dir, "documents"))


def op2_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.noticed(_table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CANONICAL = (
    "list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), "
    + _quoted(r"(?im)^[ \t]*(?:copyright[ \t]|\(c\)|©|all rights reserved)[^\n]*") + r", ' ', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: CASE w "
    + " ".join(f"WHEN {_quoted(a)} THEN {_quoted(b)}" for a, b in licenses.SPELLINGS) + " ELSE w END)"
)

_OP2_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.KNOWN)}),
k AS (SELECT min(license_id) AS license_id, sha256(array_to_string({_CANONICAL}, ' ')) AS digest FROM known GROUP BY 2),
d AS (SELECT doc_id, {_CANONICAL} AS w FROM documents)
SELECT doc_id, len(w) AS n_words, sha256(array_to_string(w, ' ')) AS digest, k.license_id
FROM d LEFT JOIN k ON k.digest = sha256(array_to_string(w, ' '))
"""

def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM f
"""

def op6_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op10_sentencepiece": op10_sentencepiece,
    "op6_token_index": op6_token_index,
    "op1_warc_reassembly": op1_warc_reassembly,
    "op2_license_scan": op2_license_scan,
    "op2_license_lines": op2_license_lines,
    "op9_html_extraction": op9_html_extraction,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op3_pii": op3_pii,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
}

SQL = {
    "op1_warc_reassembly": _OP1_SQL,
    "op2_license_scan": _OP2_SQL,
    "op7_benchmark_decontamination": _OP7_SQL,
    "op8_minhash_near_dedup": _OP8_SQL,
}
