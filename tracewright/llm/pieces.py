"""SentencePiece encoding and decoding as the shortest path through a weighted finite-state transducer.

The transducer is compiled from a .model file: its normaliser turns spaces into the word mark and puts one in front, its pieces
are arcs over the normalised text, and byte fallback gives an arc over every character that no piece has. Composed with a text
it is a lattice whose states are a position and the piece that ends there; the encoding is its shortest path in the tropical
semiring (weights add along a path, the least path wins).

The arcs of a unigram model weigh the negated score. A merge (BPE) model does not minimise a sum of scores, but its encoding is
the only sequence of pieces in which every piece, and every pair of neighbours, is what merging their own characters gives:
a merge across two neighbours depends on nothing but those two. So a pair that merging keeps apart weighs 0 and any other
infinity, and the only finite path is the encoding. As all finite paths weigh the same, the search goes depth first with the longest piece first.

Pieces never reach over the start of a word, nor over a character that no piece has, so words are composed one by one, and
the paths of recent words are kept in a bounded table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices

MARK = "▁"
#: Words whose paths a task keeps, and pairs of pieces whose weights it keeps.
WORDS, PAIRS = 1_000_000, 2_000_000
#: Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
#: The weight of an unknown character below the least score, in a unigram model.
_PENALTY = 10.0


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normaliser, trainer = model.normalizer_spec, model.trainer_spec
        if normaliser.precompiled_charsmap or normaliser.remove_extra_whitespaces or not normaliser.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisers that mark the start of words are supported")
        if trainer.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.merges = trainer.model_type == _BPE
        self.prefix = normaliser.add_dummy_prefix
        self.names = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN), 0)
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type not in (_NORMAL, _BYTE, _UNKNOWN)}
        self.longest: dict[str, int] = {}  # of the pieces that start with three characters
        for piece in self.ids:
            self.longest[piece[:3]] = max(self.longest.get(piece[:3], 0), len(piece))
        self.crosses = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.floor = min(self.score.values(), default=0.0) - _PENALTY
        self._pairs: dict[tuple[str | None, str], bool] = {}
        self._ends: dict[str, tuple[bool, list[str], list[str]]] = {}

    def normalise(self, text: str) -> str:
        return (MARK * self.prefix + text.replace(" ", MARK)) if text else ""

    def _merge(self, symbols: list[str]) -> Iterator[list[str]]:
        """The symbols after each merge: of the neighbours that form a piece those of the best score first, then the leftmost."""
        score = self.score
        while True:
            best, at = -math.inf, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            yield symbols

    def _spine(self, piece: str) -> tuple[bool, list[str], list[str]]:
        """Whether merging a piece's characters gives the piece, and the symbols that stood first and last meanwhile."""
        found = self._ends.get(piece)
        if found is None:
            steps = [list(piece), *self._merge(list(piece))]
            found = self._ends[piece] = (len(steps[-1]) == 1, list(dict.fromkeys(s[0] for s in steps)), list(dict.fromkeys(s[-1] for s in steps)))
        return found

    def apart(self, a: str | None, b: str) -> bool:
        """Whether merging gives the piece ``b`` and keeps it apart from a piece before it: weight 0, or else infinity."""
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        score = self.score
        found = self._spine(b)[0]
        if found and a is not None and any(x + y in score for x in self._spine(a)[2] for y in self._spine(b)[1]):
            last = list(a + b)
            for symbols in self._merge(last):
                last = symbols
            found = last == [a, b]
        self._pairs[a, b] = found
        return found

    def arcs(self, text: str, i: int) -> Iterator[tuple[int, str | None]]:
        """The (end, piece) that start at a position of the lattice, the longest first; no piece for a fallback."""
        ids = self.ids
        for j in range(min(len(text), i + self.longest.get(text[i : i + 3], 2)), i, -1):
            if (piece := text[i:j]) in ids:
                yield j, piece
        if text[i] not in ids:
            yield i + 1, None

    def path(self, text: str) -> list[str | None]:
        """The pieces of the shortest path over normalised text; None stands for one character in fallback."""
        n = len(text)
        if not self.merges:
            return self._least([list(self.arcs(text, i)) for i in range(n)], n)
        if not n:
            return []
        pairs, apart, arcs = self._pairs, self.apart, self.arcs
        dead: set[tuple[int, str | None]] = set()
        trail: list[str | None] = []
        at, last, rest = 0, None, arcs(text, 0)
        stack = []
        while True:
            for end, piece in rest:
                if piece is not None:
                    good = pairs.get((last, piece))
                    if good is None:
                        good = apart(last, piece)
                    if not good:
                        continue
                if dead and (end, piece) in dead:
                    continue
                trail.append(piece)
                if end == n:
                    return trail
                stack.append((at, last, rest))
                at, last, rest = end, piece, arcs(text, end)
                break
            else:
                dead.add((at, last))
                if not stack:
                    return []
                at, last, rest = stack.pop()
                trail.pop()

    def _least(self, lattice: list[list[tuple[int, str | None]]], n: int) -> list[str | None]:
        weight: list[float] = [0.0] + [math.inf] * n
        back: list[tuple[int, str | None]] = [(0, None)] * (n + 1)
        for i in range(n):
            for end, piece in lattice[i]:
                w = weight[i] - (self.floor if piece is None else self.score[piece])
                if w < weight[end]:
                    weight[end], back[end] = w, (i, piece)
        out = []
        while n:
            begin, piece = back[n]
            out.append(piece)
            n = begin
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        out, at = [], 0
        for piece in self.path(word):
            if piece is None:
                out += [self.byte[b] for b in word[at].encode()] if self.byte else [self.unknown]
                at += 1
            else:
                out.append(self.ids[piece])
                at += len(piece)
        return out

    def words(self, text: str) -> list[str]:
        """Normalised text cut where no piece reaches over: before a mark that follows none, and around line ends without a piece."""
        text = self.normalise(text)
        if self.crosses:
            return [text] if text else []
        pattern = _WORDS if "\n" in self.ids else _LINES
        return pattern.findall(text)

    def raw(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for, with word marks; those of a text are the bytes of its parts."""
        return b"".join(self.byte_of[i] if i in self.byte_of else b"" if i in self.hidden else " ⁇ ".encode() if i == self.unknown else self.names[i].encode() for i in ids)

    def readable(self, raw: bytes) -> str:
        """Bytes as text: what is no UTF-8 becomes U+FFFD, marks become spaces, the first one goes."""
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.readable(self.raw(ids))


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LINES = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


class _Paths(dict):
    """Word to the bytes of its ids, and the bytes that these decode to."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        if len(self) > WORDS:
            self.clear()
        ids = self.transducer.encode_word(word)
        found = self[word] = np.array(ids, np.uint32).tobytes(), self.transducer.raw(ids)
        return found


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        paths = _Paths(machine)
        for batch in slices(batches, "text"):
            ids = [np.frombuffer(b"".join([paths[w][0] for w in machine.words(t)]), np.int32) if t is not None else None for t in batch.column("text").to_pylist()]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(ids, pa.list_(pa.int32()))], names=[*(n for n, _ in kept), "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [machine.decode(x) if x is not None else None for x in batch.column("ids").to_pylist()]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(texts, pa.string())], names=[*(n for n, _ in kept), "text"])

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row; a null text has null ids, an empty one none. No row depends on another, an empty table gives an empty result.

    The first task raises a ``ValueError`` for a model that is neither unigram nor BPE, has user-defined pieces, or whose normaliser does more than mark the start of words.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row; null ids give a null text. Control pieces have no text, unknown ones a double question mark. An empty table gives an empty result; models as in ``encode``."""
    source = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(_decode(model), "doc_id long, text string")


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        paths = _Paths(machine)
        is_byte = np.zeros(len(machine.names), bool)
        is_byte[list(machine.byte_of)] = True
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                found = [paths[w] for w in machine.words(text or "")]
                packed, back = b"".join([p for p, _ in found]), b"".join([r for _, r in found])
                ids = np.frombuffer(packed, np.uint32)
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(packed), machine.readable(back) == (text or "").replace(MARK, " ")))
            n, fallback, crc, same = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "n_bytes_fallback", "ids_crc32", "round_trip"])

    return run


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_pieces, n_bytes_fallback, ids_crc32 (of little-endian 32-bit ids) and whether decoding gives the text.

    A null text counts as empty. Repeated and null ids are judged row by row; an empty table gives an empty result. A word
    mark in a text decodes to a space, which counts as the same.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_round_trip(model), "doc_id long, n_pieces long, n_bytes_fallback long, ids_crc32 long, round_trip boolean")
