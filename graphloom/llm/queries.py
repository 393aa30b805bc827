"""The opN_<name> queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, ftrl, jaccard, langid, multiprobe, repeats, secrets, tokenfile
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file on this machine; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}/tokens"
    files = tokenfile.write(_table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return tokenfile.read(spark, files)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"), ["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(_table(spark, sf_dir, "documents"), ["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of

    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ftrl.classified(docs, ftrl.toxicity_model(docs, _table(spark, sf_dir, "labels")), 3, 1)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"), ["doc_id"])
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.array_join(spans, ",").alias("spans"), F.coalesce(F.array_max(F.transform("secrets", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ftrl.classified(docs, ftrl.quality_model(docs, _table(spark, sf_dir, "labels")), 4, 2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_multiprobe_ann, op2_token_files, op3_ngram_jaccard, op4_bpe, op5_substring_dedup,
        op6_decontaminate, op7_language_id, op8_toxicity, op9_secret_scan, op10_quality,
    )
}

_SUBSTRING_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT r, i, word, string_agg(word, ' ') OVER span AS run, count(*) OVER span AS n FROM x WINDOW span AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
z AS (SELECT r, i, word, n = 35 AND count(*) OVER (PARTITION BY n, run) > 1 AS again FROM y),
k AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM z),
g AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)
"""

_DECONTAMINATE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::varchar AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS run, least(8, len(w)) AS size FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
sizes AS (SELECT DISTINCT size FROM win),
y AS (SELECT r, i, 8 AS size, string_agg(word, ' ') OVER span AS run, count(*) OVER span AS n FROM x WINDOW span AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
 UNION ALL SELECT r, i, size, array_to_string(w[i:i + size - 1], ' '), least(size, len(w) - i + 1) FROM x JOIN d USING (r), sizes WHERE size < 8),
h AS (SELECT DISTINCT r, i, size, item FROM y JOIN win USING (run, size) WHERE n = size),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM h) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

ORACLES: dict[str, str] = {"op5_substring_dedup": _SUBSTRING_DEDUP, "op6_decontaminate": _DECONTAMINATE}
