"""Queries over the driver's tables, one for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import chroma, divergence, embeddings, language, minhash, packing, pieces, quality, seeds, suffixes, surrogates, token_counts, variants
from tracewright.llm.sql import OP9_SQL, OP11_SQL, OP12_SQL, OP13_SQL

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g, len(sh) AS n FROM s),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int) -> Column:
    """The crc32 of the id as text modulo n; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % n


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, whose bytes are taken as 8-bit samples, and alignments of each fiftieth."""
    recordings = documents(spark, sf_dir).select("doc_id", F.encode("text", "utf-8").alias("samples"))
    return chroma.align(chroma.fingerprints(recordings))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles at a similarity of 0.8."""
    return minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents whose crc32 modulo 4 is 2 are held out of the profiles."""
    docs = documents(spark, sf_dir).withColumn("held_out", _remainder(4) == 2)
    profiles = language.train(docs.where("not held_out"))
    found = language.predict(docs, profiles, keep=["held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels whose crc32 modulo 3 is 1 are held out."""
    held_out = _remainder(3) == 1
    docs = documents(spark, sf_dir).withColumn("held_out", held_out)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = quality.train(docs.where("not held_out"), labels)
    return quality.score(docs, model, keep=["held_out"])


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u),
c AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n FROM link GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings of equal label at a cosine of 0.98."""
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


#: A fixed key, so that runs agree; a real one is a secret.
SURROGATE_KEY = "tracewright"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace_private(docs, SURROGATE_KEY).select("doc_id", "n_entities", "text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that an earlier document has."""
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens; the ranks file gives the ids of byte_bpe_50k.json."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and the fifty terms that mark each source most."""
    return divergence.audit(documents(spark, sf_dir), min_docs=30, top_terms=50)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of twenty-word stretches that start earlier, too."""
    found = seeds.remove_repeats(documents(spark, sf_dir), length=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters and more that occur five times, with one planted slip in 199, and their common forms."""
    return variants.group_variants(variants.dictionary(documents(spark, sf_dir), slips=199, least_length=6, least_count=5), ratio=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chroma_fingerprints": op1_chroma_fingerprints,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_language_id": op4_language_id,
        "op5_quality": op5_quality,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_packing": op10_packing,
        "op11_divergence": op11_divergence,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_near_dedup": OP2_SQL,
        "op6_embedding_near_dedup": OP6_SQL,
        "op9_suffix_dedup": OP9_SQL,
        "op11_divergence": OP11_SQL,
        "op12_substring_dedup": OP12_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
