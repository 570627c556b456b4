"""Removal of long byte strings that repeat an earlier document, with a logarithmic family of sparse suffix arrays.

A byte goes when a ``WINDOW``-byte string that covers it also starts in a document with a smaller id. Every window belongs to one
of its ``GRAM``-byte grams: the one of least hash, the leftmost of equals. Windows in a row that belong to the same gram form
a cell, so equal windows lie in cells of the same gram, at the same distance from it, in whichever document they are. A sparse suffix
array holds one suffix for each cell: the text from the gram on, as far as the cell goes, in lexicographic order, and beside it the text
before the gram. About one position in seventeen is kept; arrays of all positions would take several times the disk of the texts.

Suffixes are shuffled once with their bytes, packed by a hash of the gram. Inside a bucket they arrive in batches. Each batch is sorted
into a suffix array, merge-scanned against the levels of the index, and added to it, where levels of equal rank merge, so that a bucket
of n batches has log n levels. In a merged order the longest common prefixes of neighbours tell which suffixes agree over the
part of a window behind the gram; of those the bytes before it are compared. All comparisons are of bytes; hashes only choose grams and buckets.

The number of buckets follows from the bytes of the texts. A gram that very many different cells share (found in a sample, which
decides on routes and on nothing else) would fill one bucket: its cells are cut into single windows, which are dealt by their own hash. Equal suffixes of the
documents that a task reads together are matched there and then, so a passage in very many documents is one suffix for each such slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.llm.common import Scratch, slices

WINDOW, GRAM = 50, 16
BACK = WINDOW - GRAM
#: Suffixes of a batch, and bytes of text that are hashed at once.
BATCH, SEGMENT = 1 << 15, 1 << 20
#: Bytes of text that a task reads together, and of the texts whose suffixes make a bucket on average.
SLICE, BUCKET = 3 << 20, 6 << 20
#: Different cells from which a gram is dealt by windows, but at most ``MOST_HOT`` grams are; bytes of the sample (and a 64th of the texts).
HOT, MOST_HOT, SAMPLE = 1 << 16, 100_000, 16 << 20

_LOW24 = np.uint64((1 << 24) - 1)
#: A suffix in an array: the bytes from the gram on, their number, the bytes before the gram from right to left, their number and one.
_RIGHT, _LEFT = slice(0, WINDOW), slice(WINDOW + 1, WINDOW + 1 + BACK)
_WIDTH = WINDOW + 1 + BACK + 1
_NONE = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", 3).compress(data, asbytes=True)


def _stretched(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def _segment_cells(buffer: bytes, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start in [first, last): (start of each run of windows with the same gram, where that gram is, its hash)."""
    data = buffer[first : last + WINDOW - 1]
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    grams = _mix(words[: len(data) - GRAM + 1] * np.uint64(0x165667B19E3779F9) + words[GRAM - 8 :])
    least = (grams & ~_LOW24) | np.arange(len(grams), dtype=np.uint64)
    width, span = BACK + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    place = (least & _LOW24).astype(np.int64)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    return starts + first, place[starts] + first, grams[place[starts]]


def cells(texts: list[bytes], segment: int = SEGMENT) -> tuple[bytes, dict[str, np.ndarray]]:
    """The joined bytes of some texts, and their cells: doc (index of the text), at, gram (places in the joined bytes), n (windows), begin (of the text), key."""
    buffer = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n_windows = max(0, len(buffer) - WINDOW + 1)
    # Runs that a segment's end cuts in two stay so: every window still has its gram.
    parts = [_segment_cells(buffer, first, min(first + segment, n_windows)) for first in range(0, n_windows, segment)]
    at, gram, key = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.uint64)))
    stop = np.append(at[1:], n_windows)[: len(at)]
    # Windows may not cross documents: cut runs at the first window of each document and drop those that run over its end.
    fresh = np.setdiff1d(begins[begins < ends], at)
    run = np.searchsorted(at, fresh, side="right") - 1
    inside = (run >= 0) & (fresh < stop[run]) if len(at) else np.zeros(len(fresh), bool)
    run = run[inside]
    at, gram, key, stop = (np.concatenate([a, b]) for a, b in ((at, fresh[inside]), (gram, gram[run]), (key, key[run]), (stop, stop[run])))
    order = np.argsort(at, kind="stable")
    at, gram, key, stop = at[order], gram[order], key[order], stop[order]
    doc = np.searchsorted(ends, at, side="right")
    stop = np.minimum(stop, np.append(at[1:], stop[-1:]))
    stop = np.minimum(stop, ends[doc] - WINDOW + 1)
    good = stop > at
    at, gram, key, stop, doc = at[good], gram[good], key[good], stop[good], doc[good]
    return buffer, {"doc": doc, "at": at, "gram": gram, "n": stop - at, "begin": begins[doc], "key": key}


def _singles(buffer: bytes, found: dict[str, np.ndarray], hot: np.ndarray) -> dict[str, np.ndarray]:
    """The cells, where those with a gram in ``hot`` (ascending hashes) are cut into windows, whose key is a hash of all their bytes."""
    if not len(hot) or not len(found["key"]):
        return found
    many = hot[np.minimum(np.searchsorted(hot, found["key"]), len(hot) - 1)] == found["key"]
    n = np.where(many, found["n"], 1)
    out = {c: np.repeat(v, n) for c, v in found.items()}
    many = np.repeat(many, n)
    out["at"] += np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
    out["n"][many] = 1
    if many.any():
        bytes_ = np.zeros((np.count_nonzero(many), 56), np.uint8)
        bytes_[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer, np.uint8), WINDOW)[out["at"][many]]
        key = np.zeros(len(bytes_), np.uint64)
        for word in bytes_.view("<u8").T:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
        out["key"][many] = key
    return out


def records(buffer: bytes, gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The suffixes at ``gram`` as rows of ``_WIDTH`` bytes, with ``left`` bytes before it and ``right`` from it on."""
    padded = np.frombuffer(b"\0" * BACK + buffer + b"\0" * WINDOW, np.uint8)
    out = np.zeros((len(gram), _WIDTH), np.uint8)
    out[:, _RIGHT] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[gram + BACK]
    out[:, _LEFT] = np.lib.stride_tricks.sliding_window_view(padded, BACK)[gram][:, ::-1]
    out[:, _RIGHT][np.arange(WINDOW) >= right[:, None]] = 0
    out[:, _LEFT][np.arange(BACK) >= left[:, None]] = 0
    out[:, WINDOW], out[:, -1] = right, left + 1
    return out


def _ordered(rows: np.ndarray) -> np.ndarray:
    """The lexicographic order of suffixes; sorted runs among them are merged."""
    return np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")


def _firsts(same: np.ndarray) -> np.ndarray:
    """Where runs begin, if ``same`` says of all rows but the first that they belong to the run of the one before."""
    return np.flatnonzero(np.append(True, ~same))


def _groups(rows: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin, among ordered rows."""
    named = rows.view(f"S{rows.shape[1]}").ravel()
    return _firsts(named[1:] == named[:-1]) if len(rows) else np.zeros(0, np.int64)


def _spread(values: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(begins, n)))


def _least(docs: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each row the smallest document of its run."""
    return _spread(np.minimum.reduceat(docs, begins), begins, len(docs)) if len(docs) else docs


class Suffixes:
    """Rows of ``records`` in lexicographic order with doc, mark and start (of the cell's first window) of each."""

    def __init__(self, rows: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray):
        self.rows, self.doc, self.mark, self.start = rows, doc, mark, start
        #: The first eight bytes, to find grams by.
        self.head = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)

    @staticmethod
    def of(rows: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> Suffixes:
        order = _ordered(rows)
        return Suffixes(rows[order], doc[order], mark[order], start[order])

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.rows[at], self.doc[at], self.mark[at], self.start[at])

    @staticmethod
    def join(parts: list[Suffixes]) -> Suffixes:
        return Suffixes.of(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("rows", "doc", "mark", "start")))

    def n(self) -> np.ndarray:
        """The windows of each cell."""
        return self.rows[:, WINDOW].astype(np.int64) + self.rows[:, -1] - WINDOW

    def settle(self) -> tuple[Suffixes, np.ndarray]:
        """Those that no equal suffix of a smaller document is beside, and the places of the others, which are matched as a whole."""
        late = self.doc > _least(self.doc, _groups(self.rows))
        return self.take(~late), np.flatnonzero(late)


class Family:
    """Suffix arrays of geometrically growing ranks; each holds the smallest document of every different suffix it has."""

    def __init__(self):
        self.levels: list[tuple[int, Suffixes]] = []

    def near(self, heads: np.ndarray) -> list[Suffixes]:
        """The suffixes of each level that begin with one of the eight bytes in ``heads``."""
        out = []
        for _, level in self.levels:
            low, high = np.searchsorted(level.head, heads, side="left"), np.searchsorted(level.head, heads, side="right")
            n = high - low
            some = n > 0
            low, n = low[some], n[some]
            out.append(level.take(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())))
        return out

    def add(self, batch: Suffixes) -> None:
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            batch = Suffixes.join([self.levels.pop()[1], batch]).settle()[0]
            rank += 1
        self.levels.append((rank, batch))

    def scan(self, batch: Suffixes) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc, mark, start, windows) of what a smaller document matches, of the batch and, where the batch holds that document, of the index.

        The batch is added to the index.
        """
        own, late = batch.settle()
        yield batch.doc[late], batch.mark[late], batch.start[late], batch.n()[late]
        heads = np.unique(own.head)
        known = self.near(heads)
        count = np.bincount(np.searchsorted(heads, own.head), minlength=len(heads))
        for part in known:
            count += np.bincount(np.searchsorted(heads, part.head), minlength=len(heads))
        shared = np.flatnonzero(count[np.searchsorted(heads, own.head)] > 1)
        dead = np.zeros(len(own.doc), bool)
        if len(shared):
            parts = [own.take(shared), *known]
            fresh = np.concatenate([np.full(len(p.doc), i == 0) for i, p in enumerate(parts)])
            rows = np.concatenate([p.rows for p in parts])
            order = _ordered(rows)
            rows, fresh = rows[order], fresh[order]
            doc, mark, start = (np.concatenate([getattr(p, c) for p in parts])[order] for c in ("doc", "mark", "start"))
            begins = _groups(rows)
            whole = _matched(doc, fresh, begins)
            n = rows[:, WINDOW].astype(np.int64) + rows[:, -1] - WINDOW
            yield doc[whole], mark[whole], start[whole], n[whole]
            keep = doc == _least(doc, begins)
            dead[shared[order[fresh & ~keep]]] = True
            rows, doc, mark, start, fresh = rows[keep], doc[keep], mark[keep], start[keep], fresh[keep]
            place, first, n = windows(rows, doc, fresh)
            yield doc[place], mark[place], start[place] + first, n
            del rows, parts, known
        self.add(own.take(~dead))


def _matched(doc: np.ndarray, fresh: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The rows that a smaller document of their run matches: the fresh ones, and others if a fresh one is smaller than all that were known."""
    least, known = _least(doc, begins), _least(np.where(fresh, _NONE, doc), begins)
    return np.flatnonzero((doc > least) & (fresh | (least < known)))


def _several(some: np.ndarray, run: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Those of the rows ``some`` whose run (neighbours of equal ``run``) has several documents."""
    if not len(some):
        return some
    begins = _firsts(run[some[1:]] == run[some[:-1]])
    return some[_spread(np.minimum.reduceat(doc[some], begins) < np.maximum.reduceat(doc[some], begins), begins, len(some))]


def windows(rows: np.ndarray, doc: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window in its cell, windows) of the runs of windows in ordered suffixes that a smaller document has too.

    Windows are taken by their distance before the gram. Those that agree from the gram on are runs in the order of suffixes, between
    neighbours whose longest common prefix is long enough; in a run the bytes before the gram decide.
    """
    agree = rows[1:, _RIGHT] == rows[:-1, _RIGHT]
    common = np.where(agree.all(axis=1), WINDOW, np.argmin(agree, axis=1)) if len(rows) > 1 else np.zeros(0, np.int64)
    # Only grams with several documents and a fresh suffix.
    begins = _firsts(common >= GRAM)
    use = (np.minimum.reduceat(doc, begins) < np.maximum.reduceat(doc, begins)) & np.maximum.reduceat(fresh, begins) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(_spread(use, begins, len(rows)))
    common = np.append(common, 0)[at]  # to the next row, where it is of the same gram
    rows, doc, fresh = rows[at], doc[at], fresh[at]
    left, right = rows[:, -1].astype(np.int64) - 1, rows[:, WINDOW].astype(np.int64)
    hits: list[np.ndarray] = []
    for back in range(BACK + 1):
        run = np.cumsum(np.append(0, common[:-1] < WINDOW - back)) if len(at) else np.zeros(0, np.int64)
        some = np.flatnonzero((left >= back) & (right >= WINDOW - back))
        some = _several(some, run, doc)
        if back and len(some):
            key = np.empty((len(some), 4 + back + 1), np.uint8)
            key[:, :4] = run[some].astype(">u4").view(np.uint8).reshape(-1, 4)
            key[:, 4:-1] = rows[some, _LEFT.start : _LEFT.start + back]
            key[:, -1] = 1
            order = _ordered(key)
            some, begins = some[order], _groups(key[order])
            run[some] = _spread(np.arange(len(begins)), begins, len(some))
            some = _several(some, run, doc)
        if len(some):
            begins = _firsts(run[some[1:]] == run[some[:-1]])
            found = some[_matched(doc[some], fresh[some], begins)]
            hits.append(np.stack([found, left[found] - back]))
    if not hits:
        return (np.zeros(0, np.int64),) * 3
    row, first = np.concatenate(hits, axis=1)
    order = np.lexsort((first, row))
    row, first = row[order], first[order]
    begins = _firsts((row[1:] == row[:-1]) & (first[1:] == first[:-1] + 1)) if len(row) else row
    return at[row[begins]], first[begins], np.diff(np.append(begins, len(row)))


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, mark, offset, bytes) of about ``most`` bytes at a time; longer texts are cut so that each window lies in one piece."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        doc, mark, offset, texts = zip(*held, strict=True)
        return np.array(doc, np.int64), np.array(mark, np.int64), np.array(offset, np.int64), list(texts)

    for batch in slices(batches, "text", most):
        for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for offset in range(0, len(text) - WINDOW + 1, most):
                piece = text[offset : offset + most + WINDOW - 1]
                held.append((doc, mark, offset, piece))
                size += len(piece)
                if size >= most:
                    yield packed()
                    held, size = [], 0
    if held:
        yield packed()


def _joined(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows, with those that follow one another in a document made one."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start, n = doc[order], mark[order], start[order], n[order]
    if not len(doc):
        return doc, mark, start, n
    begins = _firsts((doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (start[1:] == start[:-1] + n[:-1]))
    return doc[begins], mark[begins], start[begins], np.add.reduceat(n, begins)


SUFFIXES = "bucket int, n int, size int, meta binary, body binary"
HITS = "doc_id long, mark long, start long, n long"


def _hits(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in found], names=["doc_id", "mark", "start", "n"])


def _packed_slice(doc: np.ndarray, mark: np.ndarray, offset: np.ndarray, texts: list[bytes], buckets: int, hot: np.ndarray, segment: int) -> pa.RecordBatch:
    """The suffixes of a slice packed by bucket, and what its own smaller documents match, as packed hits without a body."""
    buffer, found = cells(texts, segment)
    found = _singles(buffer, found, hot)
    piece, left = found["doc"], found["gram"] - found["at"]
    right = found["n"] + WINDOW - 1 - left
    docs, marks, start = doc[piece], mark[piece], found["at"] - found["begin"] + offset[piece]
    rows = records(buffer, found["gram"], left, right)
    order = _ordered(rows)
    late = np.zeros(len(order), bool)
    late[order] = docs[order] > _least(docs[order], _groups(rows[order]))
    del rows, order
    out: list[tuple] = []
    if late.any():
        hits = _joined(docs[late], marks[late], start[late], found["n"][late])
        meta = b"".join(np.asarray(x, "<i8").tobytes() for x in hits)
        out.append((int(_mix(doc[:1].astype(np.uint64))[0] % np.uint64(buckets)), len(hits[0]), 0, _squeezed(meta), None))
    keep = np.flatnonzero(~late)
    bucket = (_mix(found["key"][keep]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # in a bucket by document, which compresses best
    keep, bucket = keep[order], bucket[order]
    whole = np.frombuffer(buffer, np.uint8)
    begins = _firsts(bucket[1:] == bucket[:-1]) if len(bucket) else bucket
    for a, b in zip(begins, np.append(begins[1:], len(bucket)), strict=True):
        i = keep[a:b]
        meta = docs[i].astype("<i8").tobytes() + marks[i].astype("<u4").tobytes() + start[i].astype("<u4").tobytes() + left[i].astype(np.uint8).tobytes() + right[i].astype(np.uint8).tobytes()
        size = left[i] + right[i]
        part = whole[np.repeat(found["at"][i] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        out.append((int(bucket[a]), len(i), len(part), _squeezed(meta), _squeezed(part.tobytes())))
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "n", "size", "meta", "body"])


def _suffix_batches(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, SLICE):
            yield _packed_slice(*piece, buckets, hot, SEGMENT)

    return run


def _unpack(n: int, size: int, meta: bytes, body: bytes) -> tuple[np.ndarray, ...]:
    data = _stretched(meta, 18 * n)
    doc, mark, start, left, right = (np.frombuffer(data, kind, n, at * n).astype(np.int64) for kind, at in (("<i8", 0), ("<u4", 8), ("<u4", 12), (np.uint8, 16), (np.uint8, 17)))
    begin = np.cumsum(left + right) - (left + right)
    return records(_stretched(body, size), begin + left, left, right), doc, mark, start


def _scan_bucket(most: int):
    """What a smaller document matches among the suffixes of one bucket, in batches of about ``most`` suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        held: list[tuple[np.ndarray, ...]] = []

        def scanned() -> Iterator[pa.RecordBatch]:
            batch = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for found in family.scan(Suffixes.of(*batch)):
                if len(found[0]):
                    yield _hits(found)

        for batch in batches:
            for n, size, meta, body in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "meta", "body")), strict=True):
                if body is None:
                    yield _hits(tuple(np.frombuffer(_stretched(meta, 32 * n), "<i8").reshape(4, n)))
                    continue
                held.append(_unpack(n, size, meta, body))
                if sum(len(h[1]) for h in held) >= most:
                    yield from scanned()
        if held:
            yield from scanned()
        yield _hits((np.zeros(0),) * 4)

    return run


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram hash, different cells in a slice) of grams with several, and all cells under the null hash."""
    for _, _, _, texts in _pieces(batches, SLICE):
        buffer, found = cells(texts)
        left = found["gram"] - found["at"]
        rows = records(buffer, found["gram"], left, found["n"] + WINDOW - 1 - left)
        order = _ordered(rows)
        key = found["key"][order[_groups(rows[order])]]
        keys, count = np.unique(key, return_counts=True)
        many = count > 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys[many].view(np.int64).tolist()], pa.int64()), pa.array([len(key), *count[many].tolist()], pa.int64())], names=["gram", "n"])


def _hot_grams(known: DataFrame, size: int, scratch: Scratch) -> np.ndarray:
    """Hashes of the grams that so many different cells share that they are dealt by windows; at most ``MOST_HOT``."""
    share = max(1, size // (SAMPLE + size // 64))
    sample = known.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(share)) == 0)
    counts = sample.mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg((F.sum("n") * share).alias("n"))
    counts = scratch.cut(counts, "grams")
    total = counts.where("gram is null").agg(F.max("n")).first()[0] or 0
    # No more than MOST_HOT grams can have that share of all cells each.
    rows = counts.where(F.col("gram").isNotNull() & (F.col("n") > max(HOT, total // MOST_HOT))).select("gram").collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def _outcome(text: bytes, start: np.ndarray, n: np.ndarray, with_text: bool) -> tuple:
    spans = 0
    kept = text
    if len(start):
        order = np.argsort(start, kind="stable")
        start = start[order]
        reach = np.maximum.accumulate(start + n[order] + WINDOW - 1)
        begins = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
        spans = len(begins)
        ends = reach[np.append(begins[1:], len(start)) - 1]
        kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*start[begins].tolist(), len(text)], strict=True))
    out = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return (*out, kept.decode("utf-8", "ignore")) if with_text else out


def _finish(with_text: bool, carried: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hits = batch.column("hits")
            lengths = np.nan_to_num(pc.list_value_length(hits).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            ends = np.cumsum(lengths)
            flat = hits.flatten()
            start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            rows = [_outcome(text, start[b - k : b], n[b - k : b], with_text) for text, b, k in zip(batch.column("text").cast(pa.binary()).to_pylist(), ends, lengths, strict=True)]
            found = [pa.array(list(c), schema.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found, *(batch.column(c) for c in carried)], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; the remaining text as ``kept`` if ``with_text``; the columns of ``carry``.

    Texts are UTF-8 bytes and a null text is empty; ``kept`` leaves out characters of which a part was removed. Ids are
    integers. A document with a null id is left whole and matches nothing. Rows that share an id never match each other, and
    each loses what its own text has in common with smaller ids. Texts of less than ``WINDOW`` bytes stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    carry = carry or []
    carried = [f"carry_{i}" for i in range(len(carry))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.crc32(F.encode(text, "utf-8")).alias("mark"), *[docs[c].alias(a) for c, a in zip(carry, carried, strict=True)])
    known = source.where("doc_id is not null")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    ddl = result + "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in carried)
    with Scratch(spark) as scratch:
        size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
        hot = _hot_grams(known, size, scratch)
        suffixes = known.select("doc_id", "mark", "text").mapInArrow(_suffix_batches(buckets, hot), SUFFIXES)
        hits = suffixes.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_scan_bucket(BATCH), HITS)
        hits = scratch.keep(hits, "hits")
        scratch.release()
    by_document = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    joined = known.join(by_document, ["doc_id", "mark"], "left").select("doc_id", "text", "hits", *carried)
    names = [c.split()[0] for c in result.split(", ")] + carried
    found = joined.mapInArrow(_finish(with_text, carried, to_arrow_schema(spark.createDataFrame([], ddl).schema)), ddl)
    nowhere = source.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if with_text else []), *carried)
    found = found.unionByName(nowhere.select(*names))
    return found.select(*[c for c in names if c not in carried], *[F.col(a).alias(b) for a, b in zip(carried, carry, strict=True)])
