"""Shared helpers: tables in the cluster's shared folder, connected components, Arrow batches."""

from __future__ import annotations

import base64
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark runs in one process (tests), a new local one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(found)
    return found


#: Where the results built just now note the tables that they will read; None outside ``owned``.
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end the tables that results built inside it keep, once these have been written, and no others.

    Results built outside keep theirs, below ``spark.checkpoint.dir``, for as long as that folder lasts.
    """
    paths: list[str] = []
    before = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(before)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    ``with Scratch(spark) as scratch`` removes the tables of ``cut`` at the end; those of ``keep`` stay,
    since a lazy result still reads them, until the end of the ``owned`` around it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/tw-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self.drop(path)

    def _write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        table, path = self._write(df, name)
        self.paths.append(path)
        return table

    def spend(self, name: str) -> None:
        """Removes the tables of ``cut`` by that name, which nothing reads any more."""
        for path in [p for p in self.paths if p.rpartition("/")[2].startswith(f"{name}-")]:
            self.drop(path)
            self.paths.remove(path)

    def release(self) -> None:
        """Lets Spark remove the shuffle files behind tables that were cut, which it does when the driver collects its garbage.

        The first collection frees the plan of the last job, the second one what only that plan held.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.25)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        table, path = self._write(df, name)
        if (owner := _OWNER.get()) is not None:
            owner.append(path)
        return table

    def drop(self, path: str) -> None:
        remove(self.spark, path)


#: Edges that one task reduces to stars in memory.
CHUNK = 1 << 20


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0 to n - 1 and edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (root[i], root[j], i, j):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) among the edges of a task."""
    edges = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = edges.column("u").to_numpy(), edges.column("v").to_numpy()
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = nodes[forest(len(nodes), at[: len(u)], at[len(u) :])]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b); component is the smallest id reachable.

    Tasks of at most ``CHUNK`` edges first reduce theirs to stars by themselves; where that takes one task, it is all. The
    stars of several tasks are joined by alternating large-star and small-star steps. Every step is a partially aggregated minimum and an equi-join, so a
    vertex with very many neighbours is a skewed join that Spark splits, never a collected group. Vertices without
    edges are not returned. Null ends and self-loops are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = scratch.cut(pairs.where("u <> v").distinct(), "edges")
    tasks = -(-current.count() // CHUNK)
    stars = (current.repartition(tasks) if tasks > 1 else current.coalesce(1)).mapInArrow(_stars, "u long, v long")
    if tasks <= 1:
        return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    current = scratch.cut(stars.where("u <> v"), "edges")
    seen = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = scratch.cut(small, "edges")
        state = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    found = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return found.union(current.select("v", F.col("v").alias("component")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``max_bytes`` of ``column`` and at most ``max_rows`` rows, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(sizes.astype(float)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0.0
            stop = max(start + 1, min(start + max_rows, int(np.searchsorted(ends, before + max_bytes, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to token ids, for a ``tokenizers`` file (.json) or byte-pair ranks (.tiktoken) at ``path``.

    Special strings inside a text become their special token, as in the ``tokenizers`` library by default. The ranks file
    gives the ids of the .json file of the same name several times faster.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
