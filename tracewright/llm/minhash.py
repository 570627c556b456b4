"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's words are the runs of bytes other than ASCII white space after A-Z is lower-cased; its set holds its distinct
``words``-word shingles. A document with fewer words has its whole word sequence as the only shingle; one without words or
with null text has the empty set and is linked with nothing.

The sketch has ``T`` coordinates. In round i < T every shingle throws a hashed value into a hashed bin, in round i >= T into
bin i - T, and later rounds never displace earlier ones; a document stops once every bin is filled, at most after 2T rounds.
The share of equal coordinates concentrates around the Jaccard similarity, so 42 bands of 6 coordinates miss a pair at
similarity 0.8 with a probability of about 3e-6 (4e-9 at 0.85), and fewer than 0.71 T equal coordinates at 0.8 have one of about 3e-7.

Documents with equal sets are one class: a class is named by the SHA-256 digest of all its shingles in order, so that its members
agree on the full set. Candidates are verified on the full word sets. To find components without making every pair of a bucket, members are first
compared with the bucket's smallest document. Buckets that still hold several components are then compared in tiles by their sketches,
which gives clusters of documents that may be linked but not their pairs; a cluster's texts are brought together, in tiles where it is large,
and their exact intersections give the links that join its components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, connected_components, forest, mix64, slices

T, BANDS, BAND_ROWS = 512, 42, 6
LEAST_EQUAL = int(0.71 * T)
#: Members of a tile of a bucket, and of a cluster.
TILE, CLUSTER_TILE = 1024, 512
#: Members of small buckets, and shingles of small clusters or of a tile, that a group brings together; how many groups there are follows from the data.
GROUP_MEMBERS, GROUP_SHINGLES = 4096, 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

SKETCH_SCHEMA = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary"


class _WordHash(dict):
    """Word to 64-bit hash, emptied when it grows beyond a quarter of a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits on space, tab, LF, VT, FF and CR."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    """The exact set that links are confirmed on."""
    found = words_of(text)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(words)), strict=False))


def full_set(text: str | None, words: int) -> tuple[int, bytes]:
    """The size of a document's set, and a digest of all of it; white space parts words, so that joined shingles are unambiguous."""
    found = words_of(text)
    shingles = {b" ".join(found)} if len(found) < words else set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    return (len(shingles), hashlib.sha256(b"\n".join(sorted(shingles))).digest()) if found else (0, b"")


def _shingle_hashes(text: str | None, words: int, hashes: _WordHash) -> np.ndarray:
    found = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of non-empty sets of 64-bit shingle hashes, one row each."""
    n = len(sets)
    out = np.full(n * T, _EMPTY, np.uint64)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    for i in range(2 * T):
        if not len(items):
            break
        x = mix64(items ^ _SEEDS[i])
        bins = (x & np.uint64(T - 1)).astype(np.int64) if i < T else i - T
        np.minimum.at(out, owner * T + bins, (x >> np.uint64(11)) | (np.uint64(i) << np.uint64(53)))
        left = (out.reshape(n, T) == _EMPTY).any(axis=1)[owner]
        items, owner = items[left], owner[left]
    return out.reshape(n, T)


def _sketch_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            sets = [_shingle_hashes(t, words, hashes) for t in texts]
            sizes, digests = zip(*(full_set(t, words) for t in texts), strict=True)
            some = np.flatnonzero(sizes)
            rows = sketch([sets[i] for i in some])
            band = np.full((len(some), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for c in range(BAND_ROWS):
                band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + rows[:, c : BANDS * BAND_ROWS : BAND_ROWS])
            bands: list = [[]] * len(texts)
            marks: list = [b""] * len(texts)
            low = rows.astype(np.uint8)
            for j, i in enumerate(some):
                bands[i], marks[i] = band[j].view(np.int64), low[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch"],
            )

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, sketch_a, sketch_b) whose sketches may belong to linked documents."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, T) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= LEAST_EQUAL))


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if last[0] != (a, text_a):
                    last = ((a, text_a), shingle_set(text_a, words))
                one, two = last[1], shingle_set(text_b, words)
                both = len(one & two)
                keep.append(bool(both) and 100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(percent: int):
    """Joins the members of buckets that may be linked: (document, smallest of those it is joined to), of whole small buckets or two tiles of a large one."""

    def run(table: pa.Table) -> pa.Table:
        band, doc, comp, size, tile = (table.column(c).to_numpy() for c in ("band", "rep", "comp", "n_shingles", "tile"))
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, T)
        order = np.argsort(band, kind="stable")
        out: list[np.ndarray] = []
        for members in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            members = members[np.argsort(doc[members], kind="stable")]
            same = len(np.unique(tile[members])) == 1
            left, right = (members, members) if same else (members[tile[members] == tile[members].min()], members[tile[members] == tile[members].max()])
            pairs = []
            for i in left:
                rest = right[doc[right] > doc[i]] if same else right
                rest = rest[(comp[rest] != comp[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
                if len(rest):
                    rest = rest[(marks[rest] == marks[i]).sum(axis=1) >= LEAST_EQUAL]
                if len(rest):
                    pairs.append(np.stack([np.full(len(rest), i), rest]))
            if pairs:
                i, j = np.concatenate(pairs, axis=1)
                nodes, at = np.unique(np.concatenate([doc[i], doc[j]]), return_inverse=True)
                out.append(np.stack([nodes, nodes[forest(len(nodes), at[: len(i)], at[len(i) :])]]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def spanning_links(texts: list[str], comp: np.ndarray, side: np.ndarray, words: int, percent: int, hashes: _WordHash) -> list[tuple[int, int]]:
    """Links that join all documents that links join, found on hashed shingles and confirmed on the full sets.

    Only documents of different components are compared; with two sides, only those of different sides.
    """
    sets = [_shingle_hashes(t, words, hashes) for t in texts]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # a shingle of one document is in no intersection
    keep = count[code] > 1
    owner, code = owner[keep], shared[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        part = slice(*np.searchsorted(code, [first, first + 4096]))
        incidence = np.zeros((len(sets), 4096), np.float32)
        incidence[owner[part], code[part] - first] = 1
        both += incidence @ incidence.T
    both = both.astype(np.int64)
    link = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (comp[:, None] != comp[None, :])
    if side.any() and not side.all():
        link &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(link, 1))
    root, found, exact = np.arange(len(sets)), [], {}
    while len(i):
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        # One link for each root at a time, confirmed before it joins.
        chosen = np.unique(root[i], return_index=True)[1]
        wrong = []
        for k in chosen:
            x, y = int(i[k]), int(j[k])
            if root[x] == root[y]:
                continue
            one, two = (exact.setdefault(n, shingle_set(texts[n], words)) for n in (x, y))
            common = len(one & two)
            if common and 100 * common >= percent * (len(one) + len(two) - common):
                found.append((x, y))
                root[root == max(root[x], root[y])] = min(root[x], root[y])
            else:
                wrong.append(k)
        i, j = np.delete(i, wrong), np.delete(j, wrong)
    return found


def _cluster_links(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        hashes = _WordHash()
        cluster, doc, comp, tile = (table.column(c).to_numpy() for c in ("cluster", "rep", "comp", "tile"))
        out = []
        order = np.lexsort((doc, cluster))
        for members in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            texts = table.column("text").take(pa.array(members)).to_pylist()
            side = tile[members] != tile[members].min()
            out += [(int(doc[members[i]]), int(doc[members[j]])) for i, j in spanning_links(texts, comp[members], side, words, percent, hashes)]
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_hash (``xxhash64`` of the text, to find the row by if its id repeats).

    Links join documents with 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable (the document's own without links) and kept marks the document that stays. Ids should be unique: repeated
    rows get equal results, and rows that share an id but not the text are judged each by its own text. A null id is
    linked with nothing and gives a null component_id and kept = false. An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(spark)
    with scratch:
        full = scratch.cut(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch_batches(words), SKETCH_SCHEMA), "sketches")
        rows = scratch.keep(full.select("doc_id", "text_hash", "n_shingles", "digest"), "rows")
        some = full.where("n_shingles > 0 and doc_id is not null")
        reps = scratch.keep(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        classes = scratch.cut(some.join(reps.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch").dropDuplicates(["rep", "n_shingles", "sketch"]), "reps")
        scratch.spend("sketches")
        texts = source.where("doc_id is not null")

        def verified(pairs: DataFrame) -> DataFrame:
            """Links among candidate pairs; only the texts that some pair needs are kept, so that texts are shuffled once."""
            pairs = scratch.cut(pairs, "pairs")
            ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            needed = scratch.cut(texts.join(ends, "doc_id", "left_semi"), "texts")
            scratch.release()
            one = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
            two = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
            return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "a long, b long")

        scratch.release()
        banded = classes.select("rep", "n_shingles", F.explode("bands").alias("band"))
        hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
        stars = banded.join(hubs, "band").where("rep <> hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.first("n_shingles").alias("nb"))
        one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sketch_a"))
        two = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
        likely = stars.join(one, "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").join(two, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_near, "a long, b long").distinct()
        links = scratch.cut(verified(likely), "links")
        parts = scratch.cut(connected_components(links, scratch), "parts")

        labelled = classes.join(parts, F.col("rep") == F.col("id"), "left").select("rep", "n_shingles", "sketch", "bands", F.coalesce("component", "rep").alias("comp"))
        labelled = scratch.cut(labelled, "labelled")
        scratch.spend("reps")
        scratch.spend("texts")
        scratch.release()
        spread = labelled.select("comp", F.explode("bands").alias("band")).groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"))
        mixed = scratch.cut(spread.where("members > 2 and low < high").select("band", "members", F.ceil(F.col("members") / TILE).alias("tiles")), "mixed")
        few = (mixed.where("tiles = 1").agg(F.sum("members")).first()[0] or 0) // GROUP_MEMBERS + 1
        mixed = mixed.drop("members")
        # Sketches join the few members of mixed buckets, not every band.
        within = labelled.select("rep", F.explode("bands").alias("band")).join(mixed, "band")
        rest = within.join(labelled.select("rep", "n_shingles", "comp", "sketch"), "rep")
        rest = rest.withColumn("tile", F.pmod(F.xxhash64("rep", "band"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        groups = F.when(F.col("tiles") == 1, F.pmod("band", F.lit(few))).otherwise(F.col("band"))
        rest = rest.select("band", "rep", "comp", "n_shingles", "sketch", "tile", groups.alias("g"), F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
        likely = scratch.cut(rest.groupBy("g", "lo", "hi").applyInArrow(_likely(percent), "a long, b long"), "likely")
        clusters = scratch.cut(connected_components(likely, scratch), "clusters").select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
        scratch.release()
        weighed = clusters.join(labelled.select("rep", "n_shingles"), "rep").groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
        tiles = F.greatest(F.ceil(F.col("members") / CLUSTER_TILE), F.least(F.ceil(F.col("shingles") / GROUP_SHINGLES), F.col("members")))
        sizes = scratch.cut(weighed.select("cluster", "shingles", tiles.alias("tiles")), "sizes")
        few = (sizes.where("tiles = 1").agg(F.sum("shingles")).first()[0] or 0) // GROUP_SHINGLES + 1
        sizes = sizes.drop("shingles")
        held = clusters.join(labelled.select("rep", "comp"), "rep").join(sizes, "cluster").join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
        held = held.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        groups = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("cluster"), F.lit(few))).otherwise(-1 - F.col("cluster").cast("long"))
        held = held.select("cluster", "rep", "comp", "text", "tile", groups.alias("g"), F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
        more = scratch.cut(held.groupBy("g", "lo", "hi").applyInArrow(_cluster_links(words, percent), "a long, b long"), "links")
        if not more.isEmpty():
            parts = connected_components(links.union(more), scratch)
        parts = scratch.keep(parts, "components")
    member = reps.join(parts, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    found = rows.join(member, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_hash")
