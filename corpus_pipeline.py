"""A training corpus from ``documents``: language ID, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the docs of
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language, minhash, packing, suffixes, surrogates
from tracewright.llm.common import owned, remove, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A fixed key, so that runs agree; a real one is a secret.
SURROGATE_KEY = "tracewright"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found; documents in which none can be told (null or empty text, or no letter in it) go.

    Rows are judged one by one, so ids may be null or repeated. Where no row has a language to learn from, rows with a letter stay as they are.
    """
    docs = docs.select(*COLUMNS)
    profiles = language.train(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, profiles, keep=["source", "n_chars", F.col("text").alias("body")])
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select("doc_id", F.col("body").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more) the document of the smallest id stays.

    Rows that share an id are judged each by its own text; of rows alike in id and text one stays. Rows with a null id, and those without words, all stay.
    """
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs)
    gone = found.where("not kept and doc_id is not null").select("doc_id", "text_hash").distinct()
    known = docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    left = known.join(gone, ["doc_id", "text_hash"], "left_anti").dropDuplicates(["doc_id", "text_hash", "text"])
    return left.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of smaller id has are cut out; documents of which nothing is left go.

    A null text counts as empty and stays; rows with a null id are left whole, and rows that share an id lose nothing to each other.
    """
    found = suffixes.remove_repeats(docs.select(*COLUMNS), with_text=True, carry=["lang", "source"])
    left = found.where("n_removed = 0 or length(kept) > 0")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to keyed surrogates; a null text stays null, and every row stays."""
    found = surrogates.replace_private(docs.select(*COLUMNS), SURROGATE_KEY)
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, with the ids of each piece; a null or empty text has its end id alone, and null or repeated ids are packed row by row."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("PII", private_data),
    ("packing", pack),
]

#: Sketches, surrogates and tokens have no DuckDB form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; an empty table gives an empty result.

    Each stage's table goes once the next one is written, and what a stage kept once it is written; the table of the last stage is the result.
    Tables that other results read stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        with owned(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(f"{base}/{number}")
        docs = spark.read.schema(found.schema).parquet(f"{base}/{number}")
        if number:
            remove(spark, f"{base}/{number - 1}")
    return docs
