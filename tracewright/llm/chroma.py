"""Chroma fingerprints of audio columns, and their alignment.

A recording is cut into overlapping frames; the spectrum of each is folded into the energies of the twelve pitch classes. Over
the integral image of these, ``FILTERS`` compare two rectangles of pitch classes and frames each; the logarithm of the ratio is
quantised to two bits in Gray code, and the sixteen filters at a frame pack into one 32-bit item.

To align a query with a recording, equal items vote for their offset. The offset with most votes (the least of equals) is tested: the
bits that differ over the overlap, as a share, is the bit error. A recording matches with at least ``VOTES`` votes, ``OVERLAP`` items and a bit
error of at most ``BIT_ERROR``.

A recording of less than ``WHOLE`` samples would have fewer than ``OVERLAP`` items. ``SILENCE`` at its own level goes before and after it, so that its first
item hears its first ``HOP`` samples, its last one the last, and every recording but the empty one has ``OVERLAP`` items. ``EDGE`` of its items come from the
silence; the least number of votes is the number of its others where that is smaller than ``VOTES``, and never below one. As silence equals silence, a pair with a short recording may
differ in half of ``BIT_ERROR`` only.

Besides, every offset with enough votes is tested for a passage: the run of items along it for which the sum of ``BIT_ERROR`` less the bit error
is greatest. It counts with at least ``OVERLAP`` items (``EDGE`` more if one of the two is padded) and enough equal items in it, so recordings that
share one passage only meet as well.

Recordings with equal items are one class, searched once. Queries are a stated set: they meet all classes in blocks of bounded
size, and a block sends on one row for each query with every class that it matches there. In a block the votes of a query are sorted by
recording and offset; of the offsets with enough, only those are compared item by item that may match by the bits in the middle of their overlap.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, slices

RATE, FRAME, HOP = 8000, 512, 64
#: Frames that an item looks at.
SPAN = 16
VOTES, OVERLAP, BIT_ERROR = 3, 8, 0.15
#: Samples from which a recording is taken as it is; silence on either side of a shorter one, and the items which that adds.
WHOLE, SILENCE = FRAME + (SPAN + OVERLAP - 2) * HOP, FRAME + (SPAN - 2) * HOP
EDGE = (2 * SILENCE - FRAME) // HOP - SPAN + 2
#: Items in a block, frames transformed at once, votes counted at once.
BLOCK, FRAMES, COUNTED = 1 << 20, 128, 1 << 21
#: Items looked up or compared at once, offsets tested at once.
SOUGHT, TESTED = 1 << 16, 1 << 15
#: Items after the last that windows may reach.
BEYOND = 2 * (OVERLAP + EDGE) + 16
#: Samples whose items are computed at once: those of many short recordings, or of one long one.
TOGETHER = 1 << 17
#: (kind, first pitch class, pitch classes, frames) of each filter, by a rule that spreads them.
FILTERS = [(i % 6, (5 * i) % 12 % (13 - h), h, (4, 8, 12, 16)[i % 4]) for i, h in ((i, 2 + 2 * (i % 5)) for i in range(16))]
_THRESHOLD = 0.2


@lru_cache(maxsize=1)
def _pitch_classes() -> np.ndarray:
    """Spectrum bin to pitch class, for tones from 100 to 3500 Hz."""
    out = np.zeros((FRAME // 2 + 1, 12))
    for k in range(1, FRAME // 2 + 1):
        tone = k * RATE / FRAME
        if 100 <= tone <= 3500:
            out[k, round(12 * math.log2(tone / 440)) % 12] = 1
    return out


@lru_cache(maxsize=1)
def _window() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def _energies(part: np.ndarray) -> np.ndarray:
    """Pitch-class energies (12 columns) of frames, a row of samples each; of unit length or zero."""
    part = part.astype(np.float32)
    spectrum = np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _window(), axis=1)
    energy = (spectrum.real**2 + spectrum.imag**2) @ _pitch_classes()
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.where(norm > 1e-6, norm, 1), 0)


def _frames(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(frames, n): the pitch-class energies of the frames of all recordings, one after the other, and the number of frames of each."""
    sizes = np.array([len(r) for r in recordings])
    n = np.where(sizes >= FRAME, 1 + (sizes - FRAME) // HOP, 0)
    out = np.zeros((n.sum(), 12))
    if len(out):
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(recordings), FRAME)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + HOP * (np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n))
        for first in range(0, len(out), FRAMES):
            out[first : first + FRAMES] = _energies(windows[at[first : first + FRAMES]])
    return out, n


def pitch_frames(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energies (12 columns) of the frames of a recording, each of unit length or zero."""
    return _frames([samples])[0]


def _items(frames: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The packed items of each of the recordings whose frames, ``sizes`` of each, follow one another.

    Their integral images lie side by side, so that a filter is computed for all of them at once; what it gives across the border of two is dropped.
    """
    image = np.zeros((len(frames) + len(sizes), 13))
    ends = np.cumsum(sizes)
    begins = ends - sizes + np.arange(len(sizes))
    for row, first, last in zip(begins.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        np.cumsum(frames[first:last], axis=0, out=image[row + 1 : row + 1 + last - first, 1:])
    image = np.ascontiguousarray(image.cumsum(axis=1).T)
    n = max(0, image.shape[1] - SPAN)

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        return image[y + h, x + w : x + w + n] - image[y + h, x : x + n] - image[y, x + w : x + w + n] + image[y, x : x + n]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, h)
        half_w, half_h, third_w, third_h = w // 2, h // 2, max(1, w // 3), max(1, h // 3)
        if kind == 0:
            one, two = whole, area(0, w, 0, 12) - whole
        elif kind == 1:
            one, two = area(0, half_w, y, h), area(half_w, w - half_w, y, h)
        elif kind == 2:
            one, two = area(0, w, y, half_h), area(0, w, y + half_h, h - half_h)
        elif kind == 3:
            one = area(0, half_w, y, half_h) + area(half_w, w - half_w, y + half_h, h - half_h)
            two = whole - one
        elif kind == 4:
            one = area(third_w, third_w, y, h)
            two = whole - one
        else:
            one = area(0, w, y + third_h, third_h)
            two = whole - one
        ratio = np.log((1 + np.maximum(one, 0)) / (1 + np.maximum(two, 0)))
        level = (ratio > -_THRESHOLD).astype(np.uint32) + (ratio > 0) + (ratio > _THRESHOLD)
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return [out[row : row + max(0, size - SPAN + 1)] for row, size in zip(begins.tolist(), sizes.tolist(), strict=True)]


def items(frames: np.ndarray) -> np.ndarray:
    """The packed items of a recording's pitch-class frames."""
    return _items(frames, np.array([len(frames)]))[0]


def padded(samples: np.ndarray) -> np.ndarray:
    """A recording with silence around it, if it is short and not empty."""
    if not 0 < len(samples) < WHOLE:
        return samples
    silence = np.full(SILENCE, round(samples.mean()), samples.dtype)
    return np.concatenate([silence, samples, silence])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Once memory of this size has been freed, the C library keeps that of smaller arrays, and the system need not map and clear it for each anew.
    np.empty(1 << 24, np.uint8)
    for batch in slices(batches, "samples"):
        rows, held, heard = [], [], 0
        raw = batch.column("samples").to_pylist()
        for i, samples in enumerate(raw, 1):
            held.append(np.frombuffer(samples or b"", np.uint8))
            heard += len(held[-1])
            # Recordings of TOGETHER samples or more are computed together, as most have few.
            if heard >= TOGETHER or len(held) >= TOGETHER // WHOLE or i == len(raw):
                frames, sizes = _frames([padded(r) for r in held])
                rows += [(len(r), n, len(found), found.astype("<u4").tobytes()) for r, n, found in zip(held, sizes.tolist(), _items(frames, sizes), strict=True)]
                held, heard = [], 0
        n_samples, n_frames, n_items, packed = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_samples, pa.int64()), pa.array(n_frames, pa.int64()), pa.array(n_items, pa.int64()), pa.array(packed, pa.binary()), pa.array([zlib.crc32(p) for p in packed], pa.int64())], names=["doc_id", "n_samples", "n_frames", "n_items", "items", "items_crc32"])


def fingerprints(recordings: DataFrame, id_col: str = "doc_id", samples_col: str = "samples") -> DataFrame:
    """doc_id, n_samples, n_frames, n_items, items (little-endian 32-bit), items_crc32 of each row of unsigned 8-bit samples at RATE.

    Null and empty recordings have no items; frames and items of short ones are those of the padded recording. No row depends on another.
    """
    source = recordings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(samples_col).cast("binary").alias("samples"))
    return source.mapInArrow(_fingerprints, "doc_id long, n_samples long, n_frames long, n_items long, items binary, items_crc32 long")


class _Postings:
    """The items of some recordings, numbered one after the other, by their value. Between two recordings lie ``gap`` free numbers, so that number less query position tells recording and offset."""

    def __init__(self, parts: list[np.ndarray], docs: np.ndarray, least: np.ndarray):
        self.docs, self.least = docs, int(least[docs].min()) if len(docs) else VOTES
        self.sizes = np.array([len(parts[d]) for d in docs], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        items = np.concatenate([parts[d] for d in docs]) if len(docs) else np.zeros(0, np.uint32)
        self.order = np.argsort(items, kind="stable")
        self.values = items[self.order]
        self.owner = np.repeat(np.arange(len(docs), dtype=np.int32), self.sizes)[self.order]

    def spread(self, gap: int) -> None:
        """Takes ``gap``, a power of two, which no query that follows exceeds."""
        kind = np.int32 if len(self.order) + (len(self.docs) + 2) * gap < 1 << 31 else np.int64
        self.gap, self.places = gap, self.order.astype(kind)
        self.places += (self.owner.astype(kind) + kind(1)) * kind(gap)
        #: Each recording's keys are above its own of these, and not above the next one's. No two lie between multiples of gap.
        self.bounds = (self.begins + np.arange(len(self.docs)) * gap).astype(kind)
        self.next = np.append(self.bounds[1:], np.iinfo(kind).max)[: len(self.docs)]
        self.first = np.cumsum(np.bincount(-(-self.bounds // gap), minlength=len(self.docs) + len(self.order) // gap + 2)) - 1

    def found(self, keys: np.ndarray) -> np.ndarray:
        """The recordings of keys, by their place in docs."""
        at = self.first[keys >> (self.gap.bit_length() - 1)]
        return at + (keys > self.next[at])

    def votes(self, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, votes), by key, of the recordings and offsets with ``least`` votes; low, high: the postings of each item of the query."""
        if (high - low).sum() <= COUNTED:
            return _equal(self.places, low, high, least)
        parts, todo = [], [(low, high, 0, len(self.docs))]
        while todo:
            low, high, first, last = todo.pop()
            if (high - low).sum() <= COUNTED:
                parts.append(_equal(self.places, low, high, least))
            elif last - first == 1:
                parts.append(_piled(self.places, low, high, least))
            else:
                middle = (first + last) // 2
                cut = np.array([i + np.searchsorted(self.places[i:j], self.bounds[middle], side="right") for i, j in zip(low.tolist(), high.tolist(), strict=True)])
                todo += [(cut, high, middle, last), (low, cut, first, middle)]
        keys, votes = zip(*parts, strict=True)
        return np.concatenate(keys), np.concatenate(votes)


def _keys(places: np.ndarray, low: np.ndarray, high: np.ndarray, first: int = 0) -> np.ndarray:
    """Place less query position of each posting; the first of the lists is that of position ``first``."""
    some = np.flatnonzero(high > low)
    low, high = low[some], high[some]
    n = high - low
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    some += first
    if total < 100 * len(n):
        return places[np.repeat(low - (ends - n), n) + np.arange(total)] - np.repeat(some.astype(places.dtype), n)
    keys = np.empty(total, places.dtype)
    for i, a, b, end in zip(some.tolist(), low.tolist(), high.tolist(), ends.tolist(), strict=True):
        np.subtract(places[a:b], i, out=keys[end - (b - a) : end])
    return keys


def _equal(places: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    keys = _keys(places, low, high)
    keys.sort()
    later = keys[least - 1 :]
    keys = later[later == keys[: len(later)]]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys))) + least - 1


def _piled(places: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_equal``, for one recording with more votes than are counted at once."""
    some = high > low
    base, top = int(places[low[some]].min()) - len(low), int(places[high[some] - 1].max())
    votes, ends, begin = np.zeros(top - base + 1, np.int64), np.cumsum(high - low), 0
    while begin < len(low):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COUNTED, side="right")))
        votes += np.bincount(_keys(places, low[begin:end], high[begin:end], begin).astype(np.int64) - base, minlength=len(votes))
        begin = end
    keys = np.flatnonzero(votes >= least)
    return (keys + base).astype(places.dtype), votes[keys]


def _runs(bits: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first item, items, differing bits, equal items) of the best run in each of the segments of ``widths`` items in ``bits``."""
    good = round(3200 * BIT_ERROR)
    ends = np.cumsum(widths)
    starts = ends - widths
    worth = good - 100 * bits
    sums = worth.copy()
    # Each segment lies below all earlier ones, so that one running minimum serves all.
    sums[starts] -= good * int(widths.max()) + 1
    np.cumsum(sums, out=sums)
    low = np.minimum.accumulate(sums - worth)
    sums -= low
    gain = np.maximum.reduceat(sums, starts)
    top = np.flatnonzero(sums == np.repeat(gain, widths))
    last = top[np.searchsorted(top, starts)]
    falls = np.flatnonzero(np.append(True, low[1:] < low[:-1]))
    first = falls[np.searchsorted(falls, last, side="right") - 1]
    n = last + 1 - first
    equal = np.append(0, np.cumsum(bits == 0))
    some = gain > 0
    return tuple(np.where(some, x, 0) for x in (first - starts, n, (good * n - gain) // 100, equal[last + 1] - equal[first]))


class _Joined:
    """Recordings one after the other, and their windows of eight and of sixteen items."""

    def __init__(self, parts: list[np.ndarray], short: np.ndarray):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.shortest = OVERLAP + EDGE * short.astype(np.int64)
        self.items = np.concatenate([*parts, np.zeros(BEYOND, np.uint32)])
        self.windows = {n: np.ndarray(len(self.items) - n + 1, f"V{4 * n}", self.items, strides=(4,)) for n in (8, 16)}


def _differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The bits in which windows differ, in each four of their items."""
    bits = np.bitwise_count(one.view(np.uint64) ^ two.view(np.uint64)).view(np.uint32)
    return ((bits & 0xFF00FF) + (bits >> 8 & 0xFF00FF)).view(np.uint16).reshape(len(one), one.itemsize // 16)


def _hopeful(queries: _Joined, recordings: _Joined, at: np.ndarray, to: np.ndarray, overlap: np.ndarray, shortest: np.ndarray) -> np.ndarray:
    """The numbers of the overlaps, from ``at`` in the queries and ``to`` in the recordings, that may match as a whole or with a run of ``shortest`` items.

    Both contain the middle of an overlap of less than twice as many items, which alone must not have more differing bits than all of it may have. Both
    contain fours of items in a row, and at most three items before and after these.
    """
    good = np.where(shortest > OVERLAP, round(1600 * BIT_ERROR), round(3200 * BIT_ERROR))
    middle = np.where(overlap < shortest, overlap, 2 * shortest - overlap)
    hopeful = middle < 8
    for n, rows in ((8, np.flatnonzero((middle >= 8) & (middle < 16))), (16, np.flatnonzero(middle >= 16))):
        at_n, to_n, overlap_n, good_n = (x[rows] for x in (at, to, overlap, good))
        first = (overlap_n - n) // 2
        bits = sum(_differing(queries.windows[n][at_n + first], recordings.windows[n][to_n + first]).T)
        left = np.flatnonzero(100 * bits.astype(np.int64) <= good_n * overlap_n)
        if not len(left):
            continue
        rows, at_n, to_n, overlap_n, good_n = (x[left] for x in (rows, at_n, to_n, overlap_n, good_n))
        fours = np.minimum(overlap_n // 4, (shortest[rows] - 3) // 4)
        for least in np.unique(fours).tolist():
            same = np.flatnonzero(fours == least)
            n_fours = overlap_n[same] // 4
            wide = -(-int(n_fours.max()) // 4)
            step = 16 * np.arange(wide)
            bits = _differing(queries.windows[16][(at_n[same][:, None] + step).ravel()], recordings.windows[16][(to_n[same][:, None] + step).ravel()]).reshape(len(same), -1)
            worth = np.zeros((bits.shape[1] + 1, len(same)), np.int32)
            np.subtract(4 * good_n[same], 100 * bits.T.astype(np.int32), out=worth[1:], casting="unsafe")
            worth[1:][np.arange(bits.shape[1])[:, None] >= n_fours] = -(1 << 20)
            np.cumsum(worth, axis=0, out=worth)
            gain = (worth[least:] - np.minimum.accumulate(worth[: len(worth) - least], axis=0)).max(axis=0)
            hopeful[rows[same[gain >= -6 * good_n[same]]]] = True
    return np.flatnonzero(hopeful)


def _align(recordings: pa.Table, queries: pa.Table) -> pa.Table:
    ids, members, least = (recordings.column(c).to_numpy() for c in ("rep", "members", "least"))
    own, asks = (queries.column(c).to_numpy() for c in ("rep", "least"))
    short, brief = (t.column("short").to_numpy() for t in (recordings, queries))
    parts, wanted = ([np.frombuffer(x, "<u4") for x in t.column("items").to_pylist()] for t in (recordings, queries))
    rows: list[tuple[np.ndarray, ...]] = []
    if parts and wanted:
        known, asked = _Joined(parts, short), _Joined(wanted, brief)
        # Nearly all pairs need VOTES; where fewer are enough, more offsets are to be tested.
        postings = [_Postings(parts, np.flatnonzero(few), least) for few in (least >= VOTES, least < VOTES)]
        turn = np.argsort(asked.sizes, kind="stable")
        gaps = 64 << 2 * np.ceil(np.log2(np.maximum(asked.sizes[turn] / 64, 1)) / 2).astype(np.int64)
        for gap in np.unique(gaps).tolist():
            for index in postings:
                index.spread(gap)
            same = turn[gaps == gap]
            held, waiting = defaultdict(list), 0
            batches = np.cumsum(asked.sizes[same]) // SOUGHT
            for batch in np.split(same, np.flatnonzero(np.diff(batches)) + 1):
                distinct, back = np.unique(np.concatenate([wanted[q] for q in batch]), return_inverse=True)
                bounds = [[np.searchsorted(index.values, distinct, side=side)[back] for side in ("left", "right")] for index in postings]
                end = 0
                for q in batch.tolist():
                    begin, end = end, end + len(wanted[q])
                    for index, (low, high) in zip(postings, bounds, strict=True):
                        enough = min(index.least, int(asks[q]))
                        keys, votes = index.votes(low[begin:end], high[begin:end], enough)
                        if len(keys):
                            held[index, enough >= VOTES].append((q, keys, votes))
                            waiting += len(keys)
                    if waiting >= TESTED:
                        rows.append(_tested(known, asked, held, ids, own, least, asks))
                        held, waiting = defaultdict(list), 0
            rows.append(_tested(known, asked, held, ids, own, least, asks))
    return _matches(rows, ids, members, own)


def _tested(known: _Joined, asked: _Joined, held: dict[tuple[_Postings, bool], list], ids: np.ndarray, own: np.ndarray, least: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, recording, first item, offset, items, bit error, whole) of the matches among the (query, keys, votes) held."""
    some = [[np.zeros(0, kind) for kind in (np.int64,) * 6 + (bool,)]]
    for (index, long), found in held.items():
        n = np.array([len(keys) for _, keys, _ in found])
        keys, votes = (np.concatenate([x[k] for x in found]) for k in (1, 2))
        at = index.found(keys)
        head = np.append(True, at[1:] != at[:-1])
        head[np.cumsum(n) - n] = True
        # The offset with most votes, the first of equals, of each query and recording.
        best = -np.maximum.reduceat((votes << 32) - np.arange(len(keys)), np.flatnonzero(head)) & 0xFFFFFFFF
        query = np.repeat(np.array([q for q, _, _ in found]), n)
        if long:
            top = np.zeros(len(keys), bool)
            top[best] = True
        else:
            # One of the two is too short for a passage.
            keys, at, query, top = keys[best], at[best], query[best], np.ones(len(best), bool)
        offset = keys.astype(np.int64) - index.bounds[at] - index.gap
        start = np.maximum(0, -offset)
        overlap = np.minimum(asked.sizes[query], index.sizes[at] - offset) - start
        doc = index.docs[at]
        shortest = np.maximum(known.shortest[doc], asked.shortest[query])
        good = overlap >= np.where(top, OVERLAP, shortest)
        if index.least < VOTES:
            good &= votes[best] >= np.minimum(least[doc], asks[query])
        good = np.flatnonzero(good)
        good = good[ids[doc[good]] != own[query[good]]]
        some.append([x[good] for x in (query, doc, offset, start, overlap, shortest, top)])
    query, doc, offset, start, overlap, shortest, top = map(np.concatenate, zip(*some, strict=True))
    at, to = asked.begins[query] + start, known.begins[doc] + start + offset
    left = _hopeful(asked, known, at, to, overlap, shortest)
    query, doc, offset, start, overlap, shortest, top, at, to = (x[left] for x in (query, doc, offset, start, overlap, shortest, top, at, to))
    limit, enough = np.where(shortest > OVERLAP, BIT_ERROR / 2, BIT_ERROR), np.minimum(least[doc], asks[query])
    error, run = np.zeros(len(doc)), np.zeros((4, len(doc)), np.int64)
    ends = np.cumsum(overlap)
    i = 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SOUGHT, side="right")))
        w = overlap[i:j]
        begin = np.cumsum(w) - w
        step = np.arange(w.sum())
        bits = np.bitwise_count(asked.items[np.repeat(at[i:j] - begin, w) + step] ^ known.items[np.repeat(to[i:j] - begin, w) + step]).astype(np.int64)
        error[i:j] = np.add.reduceat(bits, begin) / (32 * w)
        run[:, i:j] = _runs(bits, w)
        i = j
    whole = top & (error <= limit)
    passage = (run[1] >= shortest) & (run[3] >= enough) & (run[2] <= limit * 32 * run[1])
    found = np.flatnonzero(whole | passage)
    begin = np.where(whole, start, start + run[0])[found]
    length = np.where(whole, overlap, run[1])[found]
    wrong = np.where(whole, error, run[2] / np.maximum(32 * run[1], 1))[found]
    query, doc, offset, whole = query[found], doc[found], offset[found], whole[found]
    # One match for each class: the whole overlap, or else the longest passage.
    order = np.lexsort((offset, wrong, -length, ~whole, doc, query))
    order = order[np.append(True, (doc[order][1:] != doc[order][:-1]) | (query[order][1:] != query[order][:-1]))[: len(order)]]
    return tuple(x[order] for x in (query, doc, begin, offset, length, wrong, whole))


def _matches(rows: list[tuple[np.ndarray, ...]], ids: np.ndarray, members: np.ndarray, own: np.ndarray) -> pa.Table:
    """One row for each query in rows of (query, recording, start, offset, overlap, bit error, whole)."""
    empty = [np.zeros(0, kind) for kind in (np.int64,) * 5 + (np.float64, bool)]
    query, doc, start, offset, overlap, error, whole = map(np.concatenate, zip(empty, *rows, strict=True))
    order = np.argsort(query, kind="stable")
    query, doc, start, offset, overlap, error, whole = (x[order] for x in (query, doc, start, offset, overlap, error, whole))
    heads = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    n = np.add.reduceat(np.where(whole, members[doc], 0), heads) if len(heads) else heads
    best = np.flatnonzero(whole)
    best = best[np.lexsort((ids[doc[best]], -overlap[best], error[best], query[best]))]
    best = best[np.append(True, query[best][1:] != query[best][:-1])[: len(best)]]
    none = np.isin(query[heads], query[best], invert=True)
    place = np.zeros(len(heads), np.int64)
    place[~none] = best
    listed = pa.StructArray.from_arrays([pa.array(ids[doc]), *map(pa.array, (start, offset, overlap, error, whole))], names=["class_id", "start", "offset", "overlap", "bit_error", "whole"])
    columns = {"query": pa.array(own[query[heads]]), "n": pa.array(n, pa.int64())}
    columns |= {c: pa.array(x[place], mask=none) for c, x in (("bit_error", error), ("overlap", overlap), ("rep", ids[doc]), ("offset", offset))}
    return pa.table(columns | {"matches": pa.ListArray.from_arrays(pa.array(np.append(heads, len(query)), pa.int32()), listed)})


MATCHES = "array<struct<class_id: bigint, start: bigint, offset: bigint, overlap: bigint, bit_error: double, whole: boolean>>"


def align(prints: DataFrame, every: int = 50) -> DataFrame:
    """One row per row of ``prints`` (of ``fingerprints``): its columns but n_samples and items, its class, and for queries their matches.

    class_id is the least id of the recordings with equal items (null without items, and where all their ids are null). ``matches`` holds all classes that a
    query matches, first its own if others are in it and then by id: class_id, start (the query's first item in the match), offset, overlap (items), bit_error,
    and whole, which is false where only a passage matches. Recordings of a class are those with its class_id. The other columns sum up whole matches.

    Queries are the rows whose id is divisible by ``every``, with items; others have null in all of these: n_matches (recordings that match, itself
    not), match_id (the one of least bit error, then longest overlap, then least id), match_offset (items of the match before the
    query's first), match_overlap and bit_error. Null ids neither query nor match. Rows that repeat an id are recordings of their own.
    """
    spark = prints.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.keep(prints, "prints")
        votes = F.when(F.col("n_samples") < WHOLE, F.greatest(F.lit(1), F.least(F.lit(VOTES), F.col("n_items") - EDGE))).otherwise(VOTES)
        some = rows.where("n_items > 0 and doc_id is not null").withColumn("least", votes.cast("long")).withColumn("short", F.col("n_samples") < WHOLE)
        classes = scratch.keep(some.groupBy("items").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.max((F.col("doc_id") % every == 0).cast("int")).alias("asked"), F.min("least").alias("least"), F.max("short").alias("short")), "classes")
        n_items, n_asked = (x or 0 for x in classes.agg(F.sum(F.length("items") / 4), F.sum(F.when(F.col("asked") == 1, F.length("items") / 4))).first())
        # With blocks as large as the queries, copies of these are no more than the recordings.
        n_blocks = max(1, math.ceil(n_items / min(max(BLOCK, n_asked), 8 * BLOCK)))
        n_asking = max(1, math.ceil(n_asked / (4 * BLOCK)))
        block = lambda k, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(k))
        each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
        left = classes.select(block(n_blocks, 1).alias("b"), each(n_asking).alias("q"), "rep", "members", "least", "short", "items")
        right = classes.where("asked = 1").select(each(n_blocks).alias("b"), block(n_asking, 2).alias("q"), "rep", "least", "short", "items")
        found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(_align, f"query long, n long, bit_error double, overlap long, rep long, offset long, matches {MATCHES}")
        best = F.min(F.when(F.col("bit_error").isNotNull(), F.struct("bit_error", (-F.col("overlap")).alias("less"), "rep", "offset"))).alias("m")
        listed = F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")
        found = scratch.keep(found.groupBy("query").agg(F.sum("n").alias("n"), best, listed).select("query", "n", "matches", "m.*"), "found")
    asking = some.where(F.col("doc_id") % every == 0).select("doc_id", "items", "n_items").distinct()
    twins = some.join(classes.where("members > 1").select("items", "rep"), "items").where("doc_id > rep").groupBy("rep").agg(F.min("doc_id").alias("next"))
    other = F.when(F.col("members") > 1, F.when(F.col("doc_id") == F.col("rep"), F.coalesce("next", "rep")).otherwise(F.col("rep")))
    known = asking.join(classes, "items").join(twins, "rep", "left").withColumn("twin", other).select("doc_id", "items", F.col("n_items").alias("length"), "rep", "members", "twin")
    known = known.join(found.select("query", "n", "matches", F.col("bit_error").alias("e"), "less", F.col("rep").alias("found"), "offset"), F.col("rep") == F.col("query"), "left")
    twin = F.col("twin").isNotNull()
    own = F.struct(F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("overlap"), F.lit(0.0).alias("bit_error"), F.lit(True).alias("whole"))
    known = known.select(
        "doc_id",
        "items",
        (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_matches"),
        F.when(twin, F.col("twin")).otherwise(F.col("found")).alias("match_id"),
        F.when(twin, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("match_offset"),
        F.when(twin, F.col("length")).otherwise(-F.col("less")).alias("match_overlap"),
        F.when(twin, F.lit(0.0)).otherwise(F.col("e")).alias("bit_error"),
        F.concat(F.when(twin, F.array(own)).otherwise(F.array().cast(MATCHES)), F.coalesce("matches", F.array().cast(MATCHES))).alias("matches"),
    )
    asked = F.coalesce((F.col("doc_id") % every == 0) & (F.col("n_items") > 0), F.lit(False))
    base = ["doc_id", "n_frames", "n_items", "items_crc32", "class_id"]
    extra = {"n_matches": "long", "match_id": "long", "match_offset": "long", "match_overlap": "long", "bit_error": "double", "matches": MATCHES}
    rows = rows.join(classes.select("items", F.col("rep").alias("class_id")), "items", "left")
    queries = rows.where(asked).join(known, ["doc_id", "items"]).select(*base, *extra)
    rest = rows.where(~asked).select(*base, *[F.lit(None).cast(kind).alias(c) for c, kind in extra.items()])
    return queries.unionByName(rest)
