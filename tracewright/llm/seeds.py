"""Repeated passages by winnowed seeds that are extended both ways.

A document's words are the runs of bytes other than ASCII white space. A seed is ``GRAM`` consecutive words; of the seeds in ``length`` consecutive words the one of least hash (the
first of equal ones) is the anchor, so equal passages of that length have the same anchor at the same place. An anchor carries its extensions: the hash of
each stretch of ``length`` words whose anchor it is, which reaches some words to its left and the rest to its right. Where two documents share an anchor, equal extensions are
equal stretches, told by 128 bits (anchor and stretch). A stretch that also starts earlier, in a document of smaller id or before it in its own, is a repeat of the first such place;
stretches in a row whose first places are in a row too are one maximal repeat.

Documents first meet on their anchors alone, and only anchors that occur twice are extended. Their stretches meet by a shuffle on the anchor's hash, and the members of one are never paired: the least id of each stretch decides. Of a stretch that a task
sees again only the earliest place is sent, so that a stretch of all documents arrives about once a task. Anchors that very many documents hold within different words, told by a sample of
documents, are dealt by their stretches instead. The sample changes only the way, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.common import Scratch, mix64, slices

#: Words of a seed.
GRAM = 5
#: One document in so many is sampled for anchors that have to be split; an anchor of more than HOT sampled places is split in any case.
SAMPLE, HOT = 32, 1 << 14
_PRIME = np.uint64(0x9E3779B97F4A7C15)
RUN_SCHEMA = "doc_id long, text_hash int, start int, n int, first_doc long, first_start int"
SEED_SCHEMA = f"anchor long, stretches array<long>, {RUN_SCHEMA}"


class _WordHash(dict):
    """Word to 64-bit hash, emptied when it grows beyond a quarter of a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Splits on space, tab, LF, VT, FF and CR."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` consecutive items, put together from powers of two."""
    parts, power, offset, out = h, 1, 0, None
    while True:
        if width & power:
            piece = parts[offset:]
            if out is None:
                out = mix64(piece * _PRIME + np.uint64(power))
            else:
                n = min(len(out), len(piece))
                out = mix64(out[:n] * _PRIME + piece[:n])
            offset += power
        power *= 2
        if power > width:
            return out[: max(0, len(h) - width + 1)]
        half = power // 2
        n = max(0, len(parts) - half)
        parts = mix64(parts[:n] * _PRIME + parts[half : half + n])


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values the index of the first least one."""

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    rest = width - span
    return better(at[: len(at) - rest], at[rest:]) if rest else at


class Passages:
    """All stretches of ``length`` words of several documents: their document, start, and the anchor's hash and place; of those whose anchor is ``shared``, also the hash."""

    def __init__(self, documents: list[list[bytes]], length: int, hashes: _WordHash, shared: np.ndarray | None = None):
        sizes = np.array([len(d) for d in documents], np.int64)
        h = np.fromiter((hashes[w] for d in documents for w in d), np.uint64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        grams = _joined(h, GRAM)
        counts = np.maximum(sizes - length + 1, 0)
        self.doc = np.repeat(np.arange(len(documents)), counts)
        self.start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begin[self.doc] + self.start
        self.place = _first_least(grams, length - GRAM + 1)[at] if len(at) else at
        self.anchor = grams[self.place] if len(at) else np.zeros(0, np.uint64)
        if shared is not None:
            kept = np.isin(self.anchor, shared)
            self.doc, self.start, self.place, self.anchor = (x[kept] for x in (self.doc, self.start, self.place, self.anchor))
            self.stretch = _joined(h, length)[at[kept]]


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """The first index of each run of rows that are alike in all columns."""
    change = np.ones(len(columns[0]), bool)
    if len(change):
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(change)


def _runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, first_doc: np.ndarray, first_start: np.ndarray) -> list[np.ndarray]:
    """Repeats in a row as (doc, mark, start, n, first_doc, first_start); rows stand in order of document and start."""
    cut = _cuts(doc, mark, start - np.arange(len(start)), first_doc, first_start - start)
    n = np.diff(np.append(cut, len(start)))
    return [doc[cut], mark[cut], start[cut], n, first_doc[cut], first_start[cut]]


RUN_NAMES, RUN_TYPES = ["doc_id", "text_hash", "start", "n", "first_doc", "first_start"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]


def _told(runs: list[np.ndarray]) -> pa.RecordBatch:
    """Repeats as rows of the seeds' schema, without stretches; their anchor only spreads them."""
    n = len(runs[0])
    none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))
    spread = mix64(runs[0].astype(np.uint64) * _PRIME + runs[2].astype(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), none, *map(pa.array, runs, RUN_TYPES)], names=["anchor", "stretches", *RUN_NAMES])


class _Seen:
    """The earliest places of up to ``MOST`` stretches that repeat within a task, by which later ones are told at once."""

    MOST = 1 << 17

    def __init__(self):
        self.rows = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]  # stretch, anchor, id, mark, start

    def add(self, rows: list[np.ndarray]) -> None:
        """Takes newer places first: of equal stretches the smaller id stays, and once there are too many the oldest go."""
        both = [np.concatenate(x)[: self.MOST] for x in zip(rows, self.rows, strict=True)]
        by = np.lexsort((both[4], both[2], both[1], both[0]))
        keep = np.sort(by[_cuts(both[0][by], both[1][by])])
        self.rows = [x[keep] for x in both]


MEET_SCHEMA = "key long, anchor long, doc_id long, text_hash int, state int"
ASKS, SHOWS, TOLD = 0, 1, 2


def _anchors(length: int):
    """Documents to their anchors: those that the task has seen twice are told to be shared and shown to other tasks once, the others ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = _WordHash(), np.zeros(0, np.uint64)
        for batch in slices(batches, "text", 2 << 20):
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash"))
            found = Passages([words_of(t) for t in batch.column("text").to_pylist()], length, hashes)
            at = _cuts(found.place)
            anchor, first, of, n = np.unique(found.anchor[at], return_index=True, return_inverse=True, return_counts=True)
            shown = np.isin(anchor, known)
            twice = (n > 1) | shown
            some = at[first[~shown]]
            told = np.unique(np.stack([found.doc[at][twice[of]], of[twice[of]]]), axis=1)
            rows = [
                (anchor[~shown], anchor[~shown], found.doc[some], np.where(n[~shown] > 1, SHOWS, ASKS)),
                (mix64(told[0].astype(np.uint64) * _PRIME + anchor[told[1]]), anchor[told[1]], told[0], np.full(told.shape[1], TOLD)),
            ]
            for key, value, doc, state in rows:
                if len(key):
                    columns = [pa.array(key.view(np.int64)), pa.array(value.view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(marks[doc], pa.int32()), pa.array(state, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "anchor", "doc_id", "text_hash", "state"])
            known = np.unique(np.concatenate([anchor[(n > 1) & ~shown], known[: _Seen.MOST]]))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, anchor) of the anchors that others have, too, from rows sorted by key."""
    names = ["doc_id", "text_hash", "anchor"]
    held: pa.RecordBatch | None = None  # the last row, and whether its key was there before
    before = False
    for batch in batches:
        told = pc.equal(batch.column("state"), TOLD)
        yield batch.filter(told).select(names)
        batch = batch.filter(pc.invert(told))
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, asks = rows.column("key").to_numpy(), rows.column("state").to_numpy() == ASKS
        same = key[1:] == key[:-1]
        met = np.concatenate([[before], same]) | np.concatenate([same, [False]])
        yield rows.slice(0, len(key) - 1).filter(pa.array((met & asks)[:-1])).select(names)
        before = bool(same[-1]) if len(same) else before
        held = rows.slice(len(key) - 1)
    if held is not None and before and held.column("state")[0].as_py() == ASKS:
        yield held.select(names)


def _plant(length: int):
    """Documents to anchors with the stretches that no earlier place of the task has, and to the repeats that are told already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHash(), _Seen()
        codec = pa.Codec("zstd")
        for batch in slices(batches, "body", 1 << 20):
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash"))
            order = np.lexsort((marks, ids))
            sizes, bodies = batch.column("size").to_pylist(), batch.column("body")
            shared = np.unique(batch.column("shared").flatten().to_numpy().view(np.uint64))
            found = Passages([codec.decompress(bodies[int(i)].as_buffer(), sizes[i], asbytes=True).split() if sizes[i] else [] for i in order], length, hashes, shared)
            if not len(found.doc):
                continue
            known = len(seen.rows[0])
            row = np.concatenate([np.full(known, -1), found.doc])
            stretch, anchor, doc, mark, start = (np.concatenate(x) for x in zip(seen.rows, (found.stretch, found.anchor, ids[order][found.doc], marks[order][found.doc], found.start), strict=True))
            # Equal stretches stand in order: what was seen before, then by id, text and start, since the sort is stable.
            by = np.argsort(stretch, kind="stable")
            cut = _cuts(stretch[by], anchor[by])
            sizes = np.diff(np.append(cut, len(by)))
            second = np.minimum(cut + 1, len(by) - 1)
            first = np.where((row[by[cut]] < 0) & (sizes > 1) & (doc[by[second]] < doc[by[cut]]), second, cut)
            head = np.repeat(by[first], sizes)
            later = doc[by] > doc[head]
            inside = np.zeros(len(by), bool)
            inside[1:] = (row[by][1:] == row[by][:-1]) & (row[by][1:] >= 0)
            inside[cut] = False
            # Among rows that share their id with the first place, only a row's own earlier places count.
            own = by[np.flatnonzero(~inside)[np.cumsum(~inside) - 1]]
            source = np.empty(len(by), np.int64)
            source[by] = np.where(later, head, own)
            told = np.empty(len(by), bool)
            told[by] = (later | inside) & (row[by] >= 0)
            at = np.flatnonzero(told)
            if len(at):
                yield _told(_runs(doc[at], mark[at], start[at], doc[source[at]], start[source[at]]))
            some = np.unique(head[told[by]])
            at = np.flatnonzero(~told[known:]) + known
            if len(at):
                cut = _cuts(found.place[at - known], start[at] - np.arange(len(at)), row[at])
                ends = np.append(cut, len(at))
                rows = at[cut]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(stretch[at].view(np.int64)))
                columns = [pa.array(x[rows], t) for x, t in ((doc, pa.int64()), (mark, pa.int32()), (start, pa.int32()))]
                columns += [pa.array(np.diff(ends), pa.int32()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[rows].view(np.int64)), lists, *columns], names=["anchor", "stretches", *RUN_NAMES])
            seen.add([x[some] for x in (stretch, anchor, doc, mark, start)])

    return run


def _sampled(length: int):
    """The anchors of documents, each as often as it is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in slices(batches, "text", 2 << 20):
            found = Passages([words_of(t) for t in batch.column("text").to_pylist()], length, hashes)
            anchor, n = np.unique(found.anchor[_cuts(found.place)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])

    return run


def _settle(table: pa.Table) -> pa.RecordBatch:
    """Repeats among whole groups of anchors: every stretch that a smaller id has, too."""
    anchor, doc, mark, start, n = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "text_hash", "start", "n"))
    stretch = table.column("stretches").combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(doc)), n)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    by = np.lexsort((at, doc[owner], anchor[owner], stretch))
    cut = _cuts(stretch[by], anchor[owner[by]])
    head = np.repeat(by[cut], np.diff(np.append(cut, len(by))))
    later = doc[owner[by]] > doc[owner[head]]
    again, source = by[later], head[later]
    order = np.lexsort((at[again], mark[owner[again]], doc[owner[again]]))
    again, source = again[order], source[order]
    runs = _runs(doc[owner[again]], mark[owner[again]], at[again], doc[owner[source]], at[source])
    return pa.RecordBatch.from_arrays(list(map(pa.array, runs, RUN_TYPES)), names=RUN_NAMES)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles the seeds of a task, which arrive sorted by anchor; repeats that are told already pass."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        passing = pc.is_valid(batch.column("first_doc"))
        yield batch.filter(passing).select(RUN_NAMES)
        batch = batch.filter(pc.invert(passing))
        if not batch.num_rows:
            continue
        key = batch.column("anchor").to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0  # the last anchor may go on in the next batch
        if held and (last or held[-1].column("anchor")[0].as_py() != key[0]):
            yield _settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield _settle(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield _settle(pa.Table.from_batches(held))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int"))


def _found(rows: DataFrame, packed: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Repeats in a row: doc_id, text_hash, start, n (stretches), first_doc, first_start."""
    if length < GRAM:
        raise ValueError(f"a repeat has at least {GRAM} words")
    rows = rows.where("doc_id is not null").select("doc_id", "text_hash", "text")
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SAMPLE)) == 0).mapInArrow(_sampled(length), "anchor long, n long")
    counts = scratch.keep(sample.groupBy("anchor").agg(F.sum("n").alias("n")).where("n >= 8"), "anchors")
    even = (counts.agg(F.sum("n")).first()[0] or 0) // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = counts.where(F.col("n") >= min(HOT, max(8, even))).select("anchor", F.lit(True).alias("hot"))
    met = rows.mapInArrow(_anchors(length), MEET_SCHEMA).repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "doc_id long, text_hash int, anchor long")
    shared = met.groupBy("doc_id", "text_hash").agg(F.collect_list("anchor").alias("shared"))
    seeds = packed.join(shared, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "size", "body", "shared").mapInArrow(_plant(length), SEED_SCHEMA)
    if not hot.isEmpty():
        # A hot anchor gives way to the hash of itself and one stretch, row by row.
        singly = F.transform("stretches", lambda h, i: F.struct(F.xxhash64("anchor", h).alias("anchor"), F.array(h).alias("stretches"), (F.col("start") + i).alias("start"), F.lit(1).alias("n")))
        whole = F.array(F.struct("anchor", "stretches", "start", "n"))
        seeds = seeds.join(hot, "anchor", "left").withColumn("part", F.explode(F.when(F.col("hot") & F.col("first_doc").isNull(), singly).otherwise(whole)))
        seeds = seeds.select("part.anchor", "part.stretches", "doc_id", "text_hash", "part.start", "part.n", "first_doc", "first_start")
    return seeds.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_extend, RUN_SCHEMA)


def _compressed(rows: DataFrame) -> DataFrame:
    """The texts of rows with an id. Joins of it ask for both keys, so that the plan has one shuffle of it however many there are."""
    packed = rows.where("doc_id is not null").select("doc_id", "text_hash", "text").mapInArrow(_packed, PACKED_SCHEMA)
    return packed.where("doc_id is not null and text_hash is not null")


def repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats: doc_id, text_hash, start (a word's number from 0), n_words, first_doc, first_start.

    Every stretch of ``length`` words of a repeat also starts earlier, in a document of smaller id or before it in its own; first_doc and first_start
    tell the place that the earliest of these give. Repeats of a document overlap where their first places part. Rows with a null id have none and give none;
    rows that share an id (told apart by ``text_hash``, the low 31 bits of the text's ``xxhash64``) give none to each other. Null texts and texts of fewer words have none, an empty table gives no rows,
    and other columns are not read. A document is held whole by the task that reads it.
    """
    rows = _identified(docs, id_col, text_col)
    found = _found(rows, _compressed(rows), length, Scratch(docs.sparkSession)).distinct()
    line = Window.partitionBy("doc_id", "text_hash", "first_doc", F.col("start") - F.col("first_start")).orderBy("start")
    begins = F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("n")).over(line), F.lit(True)).cast("int")
    grouped = found.withColumn("begins", begins).withColumn("part", F.sum("begins").over(line))
    ends = F.max(F.col("start") + F.col("n"))
    merged = grouped.groupBy("doc_id", "text_hash", "first_doc", (F.col("start") - F.col("first_start")).alias("shift"), "part").agg(F.min("start").alias("start"), ends.alias("end"), F.min("first_start").alias("first_start"))
    return merged.select("doc_id", "text_hash", "start", (F.col("end") - F.col("start") + (length - 1)).alias("n_words"), "first_doc", "first_start")


PACKED_SCHEMA = "doc_id long, text_hash int, size long, body binary"
CUT_SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept string"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed UTF-8, in which form they are shuffled."""
    codec = pa.Codec("zstd", 3)
    for batch in slices(batches, "text", 4 << 20):
        texts = [t.as_buffer() for t in batch.column("text").cast(pa.binary())]
        bodies = [codec.compress(t, asbytes=True) if t.size else b"" for t in texts]
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([t.size for t in texts], pa.int64()), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "size", "body"])


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches, "body", 1 << 20):
            out: list[list] = [[], [], [], []]
            for size, body, runs in zip(batch.column("size").to_pylist(), batch.column("body"), batch.column("runs"), strict=True):
                words = codec.decompress(body.as_buffer(), size, asbytes=True).split() if size else []
                gone = np.zeros(len(words) + 1, np.int32)
                if runs.is_valid:
                    starts, n = (runs.values.field(i).to_numpy() for i in (0, 1))
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + n + (length - 1), -1)
                keep = np.cumsum(gone)[:-1] == 0
                spans = int((np.diff(keep.astype(np.int8), prepend=1) < 0).sum())
                left = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if spans else b" ".join(words)
                for values, x in zip(out, (len(words), len(words) - int(keep.sum()), spans, left.decode("utf-8", "surrogatepass")), strict=True):
                    values.append(x)
            columns = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, n_spans (runs of removed words), kept (the words left, joined by one space).

    The words of all ``repeats`` go, so that of each passage the earliest copy stays. Rows with a null id are left whole. A null text has no words. Edge cases as in ``repeats``.
    """
    rows = _identified(docs, id_col, text_col)
    # The texts are shuffled once, for the stretches of shared anchors and for the cuts.
    texts = _compressed(rows)
    found = _found(rows, texts, length, Scratch(docs.sparkSession))
    runs = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    known = texts.join(runs, ["doc_id", "text_hash"], "left").select("doc_id", "size", "body", "runs")
    unnamed = rows.where("doc_id is null").select("doc_id", "text_hash", "text").mapInArrow(_packed, PACKED_SCHEMA)
    without = unnamed.select("doc_id", "size", "body", F.lit(None).cast("array<struct<start:int,n:int>>").alias("runs"))
    return known.unionByName(without).mapInArrow(_cut(length), CUT_SCHEMA)
