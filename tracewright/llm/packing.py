"""Cost-balanced packing of documents into training sequences.

A document is its token ids and a closing end id. Training cost of a piece of n tokens is estimated as ``LINEAR * n + n * n``:
the matrix products of a layer grow with n, attention inside the piece with its square. Pieces are assigned in descending
order of cost, each to the sequence of lowest cost so far that still has room for it; a piece that fits nowhere whole is cut
at the remaining capacity of the lowest-cost sequence that has any. As many sequences are opened as the tokens need, so
only the last of a window is padded.

Windows of about ``window`` tokens are packed inside the task that reads them: nothing is shuffled, memory is bounded by the
window and the longest document, and a retried task gives the same sequences. Sequence ids hold the partition in their upper
bits.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import encoder, slices

#: Cost of a token relative to that of one attention product: 6 times a model width of 1024.
LINEAR = 6 * 1024
#: Token ids that are packed together.
WINDOW = 2 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], capacity: int, linear: float = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; every token of every item is in exactly one."""
    n_sequences = -(-sum(lengths) // capacity)
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # by remaining capacity: (cost, sequence)
    rooms[capacity] = [(0.0, s) for s in range(n_sequences)]
    least = np.full(capacity + 1, np.inf)
    if n_sequences:
        least[capacity] = 0.0
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[item]
        while left:
            room = 0
            if left <= capacity:
                room = left + int(least[left:].argmin())
            if not room or least[room] == np.inf:
                room = 1 + int(least[1:].argmin())
            take = min(left, room)
            cost, sequence = heapq.heappop(rooms[room])
            least[room] = rooms[room][0][0] if rooms[room] else np.inf
            pieces.append((item, start, take, sequence, capacity - room))
            if rest := room - take:
                heapq.heappush(rooms[rest], (cost + linear * take + take * take, sequence))
                least[rest] = rooms[rest][0][0]
            start, left = start + take, left - take
    return pieces


def _packer(capacity: int, path: str, end_id: int, window: int, with_ids: bool):
    def flush(docs: list, ids: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        pieces = assign([len(x) for x in ids], capacity)
        parts = [ids[item][start : start + length] for item, start, length, _, _ in pieces]
        columns = {
            "doc_id": pa.array([docs[p[0]] for p in pieces], pa.int64()),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
            "doc_tokens": pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([first + p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(columns), first + 1 + max((p[3] for p in pieces), default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], np.uint32)
        first = TaskContext.get().partitionId() << 33
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(doc)
                ids.append(np.concatenate([encode(text), end]) if text else end)
                held += len(ids[-1])
                if held >= window:
                    out, first = flush(docs, ids, first)
                    yield out
                    docs, ids, held = [], [], 0
        if docs:
            yield flush(docs, ids, first)[0]

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``with_ids``.

    A null or empty text has only the end id. Repeated and null ids are packed row by row. An empty table gives an empty
    result. Only the id and text columns are read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_packer(capacity, tokenizer, end_id, window, with_ids), SCHEMA + ", ids array<long>" * with_ids)
