"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram (centred on a letter, with a word boundary as a possible
neighbour) binds the permuted vectors of its three symbols by their product; the permutation is a rotation by the distance
from the end. A text bundles the vectors of its trigrams by their sum, a language those of its training texts. A text gets the
language whose profile has the highest cosine with it.

Bundles are computed as trigram counts times trigram vectors, in blocks of documents. Profiles are summed by Spark from one
bundle per task and language; only the profiles (languages x DIMENSIONS numbers) reach the driver and go back to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices

DIMENSIONS = 512
SYMBOLS = 64
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, 1 to 26 for a to z, the rest by a fixed hash."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table = np.where(letters, 27 + (np.arange(0x110000, dtype=np.uint64) * 2654435761 >> np.uint64(7)) % np.uint64(SYMBOLS - 27), 0).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


@lru_cache(maxsize=1)
def _letter_vectors() -> np.ndarray:
    return (np.random.default_rng(4).integers(0, 2, (SYMBOLS, DIMENSIONS)) * 2 - 1).astype(np.int8)


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams coded as base-64 digits."""
    letters = _letter_vectors()
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[trigrams >> 12] * second[trigrams >> 6 & 63] * letters[trigrams & 63]


def trigram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams present, and how often each text (row) has each of them (column)."""
    joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _symbols()[points].astype(np.int64)
    centre = np.flatnonzero(codes)
    owner = np.cumsum(points == 0)[centre] - 1
    trigrams = codes[centre - 1] << 12 | codes[centre] << 6 | codes[centre + 1]
    present = np.flatnonzero(np.bincount(trigrams, minlength=SYMBOLS**3))
    column = np.zeros(SYMBOLS**3, np.int64)
    column[present] = np.arange(len(present))
    counts = np.bincount(owner * len(present) + column[trigrams], minlength=len(texts) * len(present))
    return present, counts.reshape(len(texts), len(present))


def bundles(texts: list[str | None]) -> np.ndarray:
    """One bundled vector per text; zero where a text has no letter."""
    present, counts = trigram_counts(texts)
    return counts.astype(np.float32) @ trigram_vectors(present).astype(np.float32)


def _sum_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", 1 << 20, 256):
        lang = np.array(batch.column("lang").to_pylist(), object)
        present, counts = trigram_counts(batch.column("text").to_pylist())
        vectors = trigram_vectors(present).astype(np.float64)
        for name in set(lang):
            sums[name] = sums.get(name, 0.0) + counts[lang == name].sum(axis=0) @ vectors
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "bundle"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[float]]:
    """Language to profile, from all rows with a text and a language.

    Rows without either, and texts without letters, add nothing; an empty table gives no profile.
    """
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = source.mapInArrow(_sum_by_language, "lang string, bundle array<double>").select("lang", F.posexplode("bundle"))
    sums: dict[str, list[float]] = {}
    for lang, pos, value in parts.groupBy("lang", "pos").agg(F.sum("col")).collect():
        sums.setdefault(lang, [0.0] * DIMENSIONS)[pos] = value
    return {lang: sums[lang] for lang in sorted(sums) if any(sums[lang])}


def _predict(names: list[str], profiles: np.ndarray):
    unit = profiles / np.linalg.norm(profiles, axis=1, keepdims=True) if len(names) else profiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20, 256):
            vectors = bundles(batch.column("text").to_pylist()).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ unit.T / np.where(norms, norms, 1)[:, None]
            some = norms > 0 if len(names) else np.zeros(len(norms), bool)
            best = cosines.argmax(axis=1) if len(names) else np.zeros(len(norms), int)
            pred = [names[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
            score = np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1) if len(names) else 0.0, 0.0)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, the columns of ``keep``, lang_pred, score.

    The prediction reads the text alone. A null text or one without letters is ``und`` with score 0, as is every text when
    there are no profiles; ties go to the language first in order of name. Repeated rows and ids are judged row by row.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(keep or []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    names = list(profiles)
    return source.mapInArrow(_predict(names, np.array([profiles[n] for n in names], float).reshape(-1, DIMENSIONS)), f"{schema}, lang_pred string, score double")
