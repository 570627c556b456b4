"""Near-duplicate vectors of equal label by PCA-ordered tiled comparison.

Unit vectors are rotated to the principal axes of all vectors, in order of variance. Cosines of a pair of tiles are accumulated
over blocks of leading dimensions; what is left is at most the product of the norms of the two suffixes, and a pair stops when
it cannot reach the threshold with that. Cosines that come within a rounding error of the threshold are computed again from the vectors as given.

Equal vectors are one class, compared once. Vectors of cosine c are at most sqrt(2 - 2c) apart, also along every axis, so the leading ``AXES``
axes are cut into cells of that width, and a class meets only those of its label in its own cell and the neighbouring ones. Cells of very many
classes are cut into tiles along the next axis, with the range that each tile covers there and on ``BOXES`` more axes; pairs of tiles whose boxes are
too far apart are dropped before any vector is copied to them. Every other pair of tiles is a group of its own and gives the number of links of each class
and a spanning forest of them, never the pairs themselves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, connected_components, forest

#: Classes in a tile, rows of a tile compared at once, dimensions added at a time.
TILE, ROWS, BLOCK = 4096, 512, 16
#: Axes that are cut into cells, and axes of the boxes by which pairs of tiles are dropped.
AXES, BOXES = 3, 8
_ERROR = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, for each vector length in it."""
    vectors = batch.column("embedding")
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(size))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector length the sum of the outer products of the unit vectors, row by row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, vectors in _by_size(batch):
            unit = _unit(vectors)
            sums[unit.shape[1]] = sums.get(unit.shape[1], 0.0) + unit.T @ unit
    for size, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["size", "i", "row"])


def _add_rows(table: pa.Table) -> pa.Table:
    rows = np.stack([np.frombuffer(r) for r in table.column("row").to_pylist()])
    return pa.table([table.column("size")[:1], table.column("i")[:1], pa.array([rows.sum(axis=0).tobytes()], pa.binary())], names=["size", "i", "row"])


def _rotate(axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_size(batch):
                turned = _unit(vectors) @ axes[vectors.shape[1]]
                lead = np.zeros((len(at), AXES + BOXES))
                lead[:, : min(turned.shape[1], AXES + BOXES)] = turned[:, : AXES + BOXES]
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("rep", "label", "members")), pa.array([vectors.shape[1]] * len(at), pa.int32()), pa.array(list(lead), pa.list_(pa.float64())), pa.array([t.tobytes() for t in turned], pa.binary()), pa.array([v.tobytes() for v in vectors], pa.binary())],
                    names=["rep", "label", "members", "size", "lead", "turned", "given"],
                )

    return run


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of unit vectors in PCA order whose cosine may reach the threshold."""
    left, right = [], []
    ends = [*range(BLOCK, a.shape[1], BLOCK), a.shape[1]]
    rest_a, rest_b = (np.sqrt(np.maximum(np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1], 0)) for x in (a, b))

    def bound(rest: np.ndarray, end: int) -> np.ndarray:
        return rest[:, end] if end < rest.shape[1] else np.zeros(len(rest))

    for first in range(0, len(a), ROWS):
        part = a[first : first + ROWS]
        begin, dots, i, j = 0, np.zeros((len(part), len(b))), None, None
        for end in ends:
            if i is None:
                dots += part[:, begin:end] @ b[:, begin:end].T
                alive = dots + np.outer(bound(rest_a[first : first + ROWS], end), bound(rest_b, end)) >= threshold - _ERROR
                if end == ends[-1] or np.count_nonzero(alive) < alive.size // 8:
                    i, j = np.nonzero(alive)
                    dots = dots[i, j]
            else:
                dots = dots + np.einsum("nd,nd->n", part[i, begin:end], b[j, begin:end])
                alive = dots + bound(rest_a, end)[first + i] * bound(rest_b, end)[j] >= threshold - _ERROR
                i, j, dots = i[alive], j[alive], dots[alive]
            begin = end
            if i is not None and not len(i):
                break
        left.append(i + first)
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _tile_links(threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, members = table.column("rep").to_numpy(), table.column("members").to_numpy()
        turned, given = (np.frombuffer(b"".join(table.column(c).to_pylist())).reshape(len(rep), -1) for c in ("turned", "given"))
        same = table.column("same")[0].as_py()
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        i, j = linked(turned[a], turned[b], threshold)
        i, j = a[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            # Whole products only decide where rounding could; those of the given vectors have the last word.
            cosine = np.einsum("nd,nd->n", turned[i], turned[j])
            close = np.flatnonzero(np.abs(cosine - threshold) <= _ERROR)
            x, y = given[i[close]], given[j[close]]
            cosine[close] = np.einsum("nd,nd->n", x, y) / (np.sqrt(np.einsum("nd,nd->n", x, x)) * np.sqrt(np.einsum("nd,nd->n", y, y)))
            i, j = i[cosine >= threshold], j[cosine >= threshold]
        links = np.bincount(i, members[j], len(rep)) + np.bincount(j, members[i], len(rep))
        some = np.flatnonzero(links)
        root = forest(len(rep), i, j)
        return pa.table([rep[some], links[some].astype(np.int64), rep[root[some]]], schema=schema)

    return run


def _tiles(turned: DataFrame, scratch: Scratch) -> DataFrame:
    """``turned`` with the tile of each class in its cell: an even share of the range that the cell's classes have on the next axis."""
    key = ["label", "size", "cell"]
    spread = turned.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"), F.min(F.col("lead")[AXES]).alias("low"), F.max(F.col("lead")[AXES]).alias("high"))
    share = F.when(F.col("high") > F.col("low"), F.floor((F.col("lead")[AXES] - F.col("low")) / (F.col("high") - F.col("low")) * F.col("tiles"))).otherwise(0)
    strip = F.least(share, F.col("tiles") - 1)
    dealt = turned.join(spread.where("tiles > 1"), key, "left").withColumn("strip", F.coalesce(strip, F.lit(0)).cast("long")).drop("tiles", "low", "high")
    # Strips that still hold too many classes are dealt by hash.
    crowded = dealt.groupBy(*key, "strip").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")), F.lit(0))
    return scratch.cut(dealt.join(crowded, [*key, "strip"], "left").withColumn("tile", F.struct("strip", part.alias("part"))).drop("strip", "parts"), "tiled")


def _meetings(tiled: DataFrame, width: float, scratch: Scratch) -> DataFrame:
    """(label, size, cell, tile, pair, side, same): the pairs of tiles that each tile is in; cells differ by one at most along each axis."""
    axes = range(AXES, AXES + BOXES)
    box = tiled.groupBy("label", "size", "cell", "tile").agg(F.array(*[F.min(F.col("lead")[i]) for i in axes]).alias("low"), F.array(*[F.max(F.col("lead")[i]) for i in axes]).alias("high"))
    box = scratch.cut(box, "boxes")
    steps = [F.array(*[F.lit(x).cast("long") for x in step]) for step in itertools.product((-1, 0, 1), repeat=AXES) if step >= (0,) * AXES]
    near = box.select("label", "size", F.col("cell").alias("home"), F.col("tile").alias("first"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.explode(F.array(*steps)).alias("step"))
    near = near.withColumn("cell", F.zip_with("home", "step", lambda x, y: x + y)).join(box, ["label", "size", "cell"])
    once = F.exists("step", lambda x: x != 0) | (F.col("first") <= F.col("tile"))
    gaps = F.transform(F.arrays_zip("a_low", "a_high", "low", "high"), lambda b: F.greatest(b["low"] - b["a_high"], b["a_low"] - b["high"], F.lit(0.0)))
    close = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap) <= width * width
    pairs = near.where(once & close).select("label", "size", "home", "first", "cell", "tile")
    same = (F.col("home") == F.col("cell")) & (F.col("first") == F.col("tile"))
    pair = F.struct("label", "size", "home", "first", "cell", "tile")
    pairs = scratch.cut(pairs.select(pair.alias("pair"), same.alias("same")), "pairs")
    end = lambda cell, tile, side: pairs.select("pair.label", "pair.size", F.col(f"pair.{cell}").alias("cell"), F.col(f"pair.{tile}").alias("tile"), "pair", F.lit(side).alias("side"), "same")
    return end("home", "first", 0).unionByName(end("cell", "tile", 1).where("not same"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links join vectors of equal, non-null label and equal length with cosine >= threshold. Vectors that are null, empty, zero
    or hold a null or non-finite component, and rows with a null id or label, are linked with nothing. Repeated rows are vectors of
    their own. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    width = math.sqrt(2 - 2 * threshold) + 1e-6
    with Scratch(spark) as scratch:
        good = rows.where(usable)
        classes = scratch.keep(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
        # One packed row for each dimension reaches the driver, from one partial sum per task.
        moments = classes.select("embedding").mapInArrow(_moments, "size int, i int, row binary").groupBy("size", "i").applyInArrow(_add_rows, "size int, i int, row binary")
        rows_of: dict[int, dict[int, np.ndarray]] = {}
        for size, i, row in moments.collect():
            rows_of.setdefault(size, {})[i] = np.frombuffer(row)
        axes = {size: np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]) for size, by_row in rows_of.items() for m in [np.stack([by_row[i] for i in range(size)])]}
        turned = classes.mapInArrow(_rotate(axes), "rep long, label string, members long, size int, lead array<double>, turned binary, given binary")
        cell = F.array(*[F.floor(F.col("lead")[i] / width) for i in range(AXES)])
        turned = scratch.cut(turned.withColumn("cell", cell), "turned")
        tiled = _tiles(turned, scratch)
        meets = _meetings(tiled, width, scratch)
        sides = tiled.join(meets, ["label", "size", "cell", "tile"]).select("rep", "members", "turned", "given", "pair", "side", "same")
        found = sides.groupBy("pair").applyInArrow(_tile_links(threshold), "rep long, links long, root long")
        found = scratch.keep(found, "links")
        parts = scratch.keep(connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch), "components")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = good.join(known, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
