"""Token counts of documents without their token ids.

A byte-level BPE splits a text into pre-tokens and each pre-token into pieces, so a document has as many tokens as the pieces of
its pre-tokens times their frequencies. Tasks cut their documents into slices and count pre-tokens in each document. Those that
are a single entry of the vocabulary (a fixed, bounded table) are one piece and summed at once. The others are packed by a hash
of the pre-token, many slices to a row of a bucket, and shuffled by bucket: there each distinct pre-token is split into
pieces once, joined to its frequencies, and summed by document. Slices then add up the sums.

A pre-token of several pieces that many documents of a slice have goes to another bucket for each slice, so that one that every document has is
dealt over all of them, at the price of being split once in each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, slices

#: The pre-token pattern of byte-level BPE, with the white space of Unicode spelt out.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

SLICE_ROWS = 4096
_SLICE_BYTES = 4 << 20
#: Distinct pre-tokens whose counts a task holds, and entries of sums before it passes them on.
_HELD = 2_000_000

#: Documents of a slice, and the share of them, from which a pre-token is dealt by slices; bytes of packed frequencies that a task gathers into rows.
COMMON, COMMON_SHARE, _GATHERED = 64, 1 / 8, 16 << 20

PACKED = "slice long, bucket int, doc_ids array<long>, n_bytes array<long>, base array<long>, parts array<struct<slice: long, size: int, packed: binary>>"


class _Splitter:
    """Pre-tokens of a text, and pieces of a pre-token, as the tokenizer at ``path`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PRE_TOKEN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of special tokens among them."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.pattern.findall(part)], len(parts) - 1

    def pieces(self, words: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    @lru_cache(maxsize=1)  # noqa: B019
    def single(self) -> frozenset[str]:
        """The pre-tokens that are one entry of the vocabulary."""
        words = sorted({self.tokenizer.decode([i]) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=False))})
        words = [w for w in words if self.pattern.findall(w) == [w]]
        return frozenset(w for w, n in zip(words, self.pieces(words), strict=True) if n == 1)


@lru_cache(maxsize=2)
def _splitter(path: str) -> _Splitter:
    return _Splitter(path)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _squeeze(blobs: list[bytes]) -> tuple[int, bytes]:
    """Several byte strings as one, compressed, and its size before."""
    whole = np.array([len(blobs), *map(len, blobs)], np.uint32).tobytes() + b"".join(blobs)
    return len(whole), pa.compress(whole, codec="zstd", asbytes=True)


def _unsqueeze(size: int, packed: bytes) -> list[bytes]:
    whole = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    sizes = np.frombuffer(whole, np.uint32, 1 + int(np.frombuffer(whole, np.uint32, 1)[0]))[1:]
    ends = 4 * (len(sizes) + 1) + np.cumsum(sizes, dtype=np.int64)
    return [whole[end - size : end] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _pack(path: str, buckets: int):
    part = pa.struct([("slice", pa.int64()), ("size", pa.int32()), ("packed", pa.binary())])
    schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int32())] + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_bytes", "base")] + [("parts", pa.list_(part))])

    def rows_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(path)
        number = TaskContext.get().partitionId() << 33
        gathered: dict[int, list[dict]] = {}
        held = 0
        for batch in slices(batches, "text", _SLICE_BYTES, SLICE_ROWS):
            codes = _Codes()
            docs, words, base = [], [], np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                found, base[i] = split.pre_tokens(text) if text else ([], 0)
                words.append(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)))
                docs.append(np.full(len(found), i, np.int64))
            distinct = sorted(codes)  # neighbours in order compress well
            rank = np.empty(len(codes), np.int64)
            rank[np.fromiter(map(codes.__getitem__, distinct), np.int64, len(distinct))] = np.arange(len(distinct))
            single = np.fromiter(map(split.single().__contains__, distinct), bool, len(distinct))
            pairs, freqs = np.unique(rank[np.concatenate(words)] * SLICE_ROWS + np.concatenate(docs), return_counts=True)
            word, doc = pairs // SLICE_ROWS, pairs % SLICE_ROWS
            known = single[word]
            base += np.bincount(doc[known], freqs[known], batch.num_rows).astype(np.int64)
            yield rows_of([{"slice": number, "bucket": -1, "doc_ids": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "base": base}])
            word, doc, freqs = word[~known], doc[~known], freqs[~known]
            common = np.bincount(word, minlength=len(distinct)) > max(COMMON, COMMON_SHARE * batch.num_rows)
            bucket = np.fromiter((-1 if s else xxhash.xxh32_intdigest(w) for w, s in zip(distinct, single, strict=True)), np.int64, len(distinct))
            bucket = np.where(single, -1, (bucket + np.where(common, number % buckets, 0)) % buckets)
            order = np.argsort(bucket[word], kind="stable")
            word, doc, freqs = word[order], doc[order], freqs[order]
            for part in np.split(np.arange(len(word)), np.flatnonzero(np.diff(bucket[word])) + 1) if len(word) else []:
                own, entries = np.unique(word[part], return_counts=True)
                texts = [distinct[w] for w in own]
                blobs = [
                    "".join(texts).encode(),
                    np.fromiter(map(len, texts), np.uint32, len(texts)).tobytes(),
                    entries.astype(np.uint32).tobytes(),
                    doc[part].astype(np.uint16).tobytes(),
                    freqs[part].astype(np.uint32).tobytes(),
                ]
                size, packed = _squeeze(blobs)
                gathered.setdefault(int(bucket[own[0]]), []).append({"slice": number, "size": size, "packed": packed})
                held += len(packed)
            number += 1
            if held > _GATHERED:
                yield rows_of([{"bucket": b, "parts": parts} for b, parts in gathered.items()])
                gathered, held = {}, 0
        if gathered:
            yield rows_of([{"bucket": b, "parts": parts} for b, parts in gathered.items()])

    return run


class _Pieces(dict):
    """Pre-token to its number of pieces, for the pre-tokens of a task's buckets."""

    def __init__(self, split: _Splitter):
        super().__init__()
        self.split = split

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > _HELD:
            self.clear()
        new = [w for w in words if w not in self]
        self.update(zip(new, self.split.pieces(new), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _sum(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(_splitter(path))
        sums: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            some = {k: np.flatnonzero(v) for k, v in sums.items()}
            arrays = [pa.array(list(sums), pa.int64()), pa.array([some[k].astype(np.uint16).tobytes() for k in sums], pa.binary()), pa.array([v[some[k]].tobytes() for k, v in sums.items()], pa.binary())]
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["slice", "docs", "sums"])

        for batch in batches:
            for row in (r for parts in batch.column("parts") for r in parts.as_py()):
                words, sizes, entries, docs, freqs = _unsqueeze(row["size"], row["packed"])
                text, ends = words.decode(), np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
                n = pieces.of([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
                weights = np.repeat(n, np.frombuffer(entries, np.uint32)) * np.frombuffer(freqs, np.uint32)
                got = np.bincount(np.frombuffer(docs, np.uint16), weights, SLICE_ROWS).astype(np.int64)
                sums[row["slice"]] = sums[row["slice"]] + got if row["slice"] in sums else got
                if len(sums) * SLICE_ROWS > _HELD:
                    yield out()
        if sums:
            yield out()

    return run


def _finish(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["base"], np.int64)
                for docs, sums in zip(row["docs"] or [], row["sums"] or [], strict=True):
                    n[np.frombuffer(docs, np.uint16)] += np.frombuffer(sums, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, for a byte-level BPE file of ``tokenizers``.

    A null or empty text has no tokens and no bytes. Repeated and null ids are counted row by row; an empty table gives an
    empty result. Only the id and text columns are read. Special strings inside a text count as one token each.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    # Written once: the slices of the frequencies and of their documents have to be the same.
    packed = Scratch(spark).keep(source.mapInArrow(_pack(tokenizer, partitions), PACKED), "frequencies")
    sums = packed.where("bucket >= 0").select("bucket", "parts").repartition(partitions, "bucket").mapInArrow(_sum(tokenizer), "slice long, docs binary, sums binary")
    sums = sums.groupBy("slice").agg(F.collect_list("docs").alias("docs"), F.collect_list("sums").alias("sums"))
    heads = packed.where("bucket < 0").select("slice", "doc_ids", "n_bytes", "base")
    joined = heads.join(sums, "slice", "left").select("doc_ids", "n_bytes", "base", "docs", "sums")
    return joined.mapInArrow(_finish(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
