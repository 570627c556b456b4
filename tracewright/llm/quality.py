"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its hashed lower-case words, its hashed trigrams of character classes (letters by case, digits, white space,
each ASCII sign of its own) and how often a word repeats its predecessor or any earlier word. Frequencies are taken as
log(1 + tf), weighted by the entropy of the term over the training texts and scaled to unit length; the leading singular vectors of the
training texts span the latent space.

Training takes at most ``per_class`` labelled texts of either class, those of least id hash: a bounded sample, which is also what
makes the broadcast bounded (2 * per_class latent vectors). Every document is compared with all of them by exact cosine products,
block by block. The ``NEIGHBOURS`` nearest vote with their similarity to the power of ``SHARPNESS``; a class's votes are scaled by how many labelled texts
each of its training texts stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices

WORD_BINS, SHAPE_BINS, REPEATS = 2048, 2048, 18
TERMS = WORD_BINS + SHAPE_BINS + REPEATS
LATENT, NEIGHBOURS, SHARPNESS, PER_CLASS = 64, 16, 4, 1024


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point to character class; 2 to 4 are letters."""
    table = np.full(0x110000, 1, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = 2 if x.islower() else 3 if x.isupper() else 4
        elif x.isdigit():
            table[c] = 5
        elif x.isspace():
            table[c] = 7 if x in "\r\n" else 6
        elif c < 128:
            table[c] = 8 + c % 56
    table[0] = 0
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Frequencies of the terms (columns) of texts (rows)."""
    n = len(texts)
    joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    small = small if len(small) == len(points) else points  # a letter whose lower case is two
    classes = _classes()[points].astype(np.int64)
    owner = np.cumsum(points == 0) - 1
    centre = np.flatnonzero(classes)
    shape = _mix((classes[centre - 1] << 12 | classes[centre] << 6 | classes[centre + 1]).astype(np.uint64)) % np.uint64(SHAPE_BINS)
    out = np.zeros((n, TERMS))
    out[:, WORD_BINS : WORD_BINS + SHAPE_BINS] = np.bincount(owner[centre] * SHAPE_BINS + shape.astype(np.int64), minlength=n * SHAPE_BINS).reshape(n, SHAPE_BINS)
    letter = (classes >= 2) & (classes <= 4)
    at = np.flatnonzero(letter)
    if not len(at):
        return out
    first = np.flatnonzero(letter[at] & ~letter[at - 1])
    begin = np.repeat(at[first], np.diff(np.append(first, len(at))))
    word = np.add.reduceat(_mix(small[at].astype(np.uint64) << np.uint64(20) | (at - begin).astype(np.uint64)), first)
    doc = owner[at[first]]
    out[:, :WORD_BINS] = np.bincount(doc * WORD_BINS + (_mix(word) % np.uint64(WORD_BINS)).astype(np.int64), minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((word, doc))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    total, distinct, repeated = np.bincount(doc, minlength=n), np.bincount(doc[order][new], minlength=n), np.bincount(doc[again], minlength=n)
    some = np.flatnonzero(total)
    base = WORD_BINS + SHAPE_BINS
    out[some, base + np.minimum(7, 8 * repeated[some] // total[some])] = total[some]
    out[some, base + 8 + np.minimum(7, 8 * distinct[some] // total[some])] = total[some]
    out[:, base + 16], out[:, base + 17] = repeated, total - distinct
    return out


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20, 256):
        counts = term_counts(batch.column("text").to_pylist()).astype(np.float32)
        found = [np.flatnonzero(c).astype(np.uint16) for c in counts]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([f.tobytes() for f in found]), pa.array([c[f].tobytes() for c, f in zip(counts, found, strict=True)])], names=["label", "terms", "counts"])


class Model:
    """Term weights, projection, and the labelled latent vectors with the weights of their votes."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, totals: dict[int, int]):
        self.prior = totals.get(1, 0) / total if (total := sum(totals.values())) else 0.5
        share = counts / np.maximum(counts.sum(axis=0), 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.where(share > 0, share * np.log(share), 0).sum(axis=0)
        self.weights = np.maximum(0.0, 1 - entropy / np.log(max(2, len(counts)))) if len(counts) else np.zeros(TERMS)
        rows = self.scaled(counts)
        if len(rows):
            values, vectors = np.linalg.eigh(rows @ rows.T)
            top = [i for i in np.argsort(-values, kind="stable")[:LATENT] if values[i] > 1e-9]
            self.projection = (rows.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
        else:
            self.projection = np.zeros((TERMS, 0), np.float32)
        self.vectors = self.latent(counts)
        self.labels = labels.astype(np.float32)
        self.votes = np.array([totals[int(x)] / np.count_nonzero(labels == x) for x in labels], np.float32)

    def scaled(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts) * self.weights
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        rows = self.scaled(counts).astype(np.float32) @ self.projection
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        counts = term_counts(texts)
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        cosine = self.latent(counts) @ self.vectors.T
        vote = np.where(nearest(cosine, NEIGHBOURS), np.maximum(cosine, 0), 0).astype(float) ** SHARPNESS * self.votes
        total = vote.sum(axis=1)
        return np.where(total > 0, np.clip((vote * self.labels).sum(axis=1) / np.where(total > 0, total, 1), 0, 1), self.prior)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Which columns are the k largest of each row; of those equal to the last one the first columns. Columns stand in order of label and terms."""
    if cosine.shape[1] <= k:
        return np.ones(cosine.shape, bool)
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, equal = cosine > last, cosine == last
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """A model from the texts of ``docs`` with a label of 0 or 1 in ``labels``.

    Ids with several labels count if they agree, and of the texts of an id the least counts. Null ids, texts and labels are left out. Without labelled texts every score is
    the share of label 1, or 0.5 where there is none.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("high"))
    known = known.where("label = high").select("id", "label")
    totals = {int(x): n for x, n in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = None
    for value in sorted(totals):
        part = known.where(F.col("label") == value).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return Model(np.zeros((0, TERMS)), np.zeros(0), totals)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # One text for each of at most 2 * per_class ids, however many rows an id has.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select(F.col("label").cast("int").alias("label"), "text")
    rows = sample.mapInArrow(_term_rows, "label int, terms binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r.label, bytes(r.terms), bytes(r.counts)))
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, row in enumerate(rows):
        counts[i, np.frombuffer(row.terms, np.uint16)] = np.frombuffer(row.counts, np.float32)
    return Model(counts, np.array([r.label for r in rows], int), totals)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, the columns of ``keep``, score in 0 to 1, predicted (1 where score >= 0.5).

    A score reads the text alone. Of labelled texts at equal cosines those of label 0 are nearer, and among these the ones whose terms come first in order. Texts without any known term, null and empty ones among them, score the share of label 1.
    Repeated rows and ids are judged row by row; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(keep or []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20, 256):
            scores = shared.value.scores(batch.column("text").to_pylist())
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*(n for n, _ in kept), "score", "predicted"])

    return source.mapInArrow(run, f"{schema}, score double, predicted int")
