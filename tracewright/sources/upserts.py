"""Tables with keys on plain Parquet: rows replaced or changed by key, in versions that are switched at once.

Rows lie in buckets by the hash of their key. A change writes the buckets that it touches anew and then a manifest that names, for every bucket, the folder that holds it; readers see the
former version until the manifest is there. A batch of a stream is remembered with the version that it made, so that its repetition changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` with rows of ``schema``, one for each value of ``keys``; ``buckets`` is fixed once there are rows and bounds the manifest's size."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    def versions(self) -> list[int]:
        """The versions there are, in order."""
        _, fs = self._files()
        if not fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The version, the last batch of each stream, and the folder of each bucket that has rows."""
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "batches": {}, "folders": {}}
        _, fs = self._files()
        stream = fs.open(self._at("manifests", f"{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; without any version the table is empty."""
        return self._rows(self.manifest(version)["folders"].values()).drop("bucket")

    def _rows(self, folders) -> DataFrame:
        schema = f"{self.schema}, bucket int"
        paths = [f"{self.path.rstrip('/')}/{f}" for f in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(self.schema).parquet(*paths).withColumn("bucket", self._bucket())

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _latest(self, changes: DataFrame, order: str) -> DataFrame:
        """Of each key the change that is last in ``order``."""
        last = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in self.keys]), order).alias("__row"))
        return last.select(*self.keys, "__row.*").withColumn("bucket", self._bucket())

    def upsert(self, changes: DataFrame, order: str, stream: str = "", batch: int | None = None) -> int:
        """Puts rows in place of those of the same key, or beside them; the last of a key in ``order`` counts. Returns the version then."""
        return self._change(changes, order, stream, batch, None)

    def update(self, changes: DataFrame, order: str, columns: list[str], stream: str = "", batch: int | None = None) -> int:
        """Sets ``columns`` of the rows that are there already, also to null; changes of other keys do nothing (``missing`` tells them). Returns the version then."""
        return self._change(changes.select(*dict.fromkeys([*self.keys, order, *columns])), order, stream, batch, columns)

    def missing(self, changes: DataFrame) -> DataFrame:
        """The keys of ``changes`` that no row has."""
        return changes.select(*self.keys).distinct().join(self.read(), list(self.keys), "left_anti")

    def _change(self, changes: DataFrame, order: str, stream: str, batch: int | None, columns: list[str] | None) -> int:
        now = self.manifest()
        if batch is not None and batch <= now["batches"].get(stream, -1):
            return now["version"]
        latest = self._latest(changes, order)
        touched = [r.bucket for r in latest.select("bucket").distinct().collect()]  # at most one for each bucket
        old = self._rows([now["folders"][str(b)] for b in touched if str(b) in now["folders"]])
        names = [c for c in old.columns if c != "bucket"]
        if columns is None:
            rest = old.join(latest, list(self.keys), "left_anti")
            merged = rest.unionByName(latest.select(*old.columns))
        else:
            set_to = latest.select(*self.keys, F.struct(*columns).alias("__to"))
            merged = old.join(set_to, list(self.keys), "left").select(*[F.when(F.col("__to").isNotNull(), F.col(f"__to.{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in names], "bucket")
        folder = f"data/{now['version'] + 1}-{uuid.uuid4().hex}"
        merged.select(*names, F.col("bucket").alias("part")).repartition("part").write.partitionBy("part").parquet(f"{self.path.rstrip('/')}/{folder}")
        _, fs = self._files()
        made = {int(s.getPath().getName()[5:]) for s in fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part=")}
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | {str(b): f"{folder}/part={b}" for b in made}
        batches = now["batches"] | ({stream: batch} if batch is not None else {})
        self._publish({"version": now["version"] + 1, "batches": batches, "folders": folders})
        return now["version"] + 1

    def _publish(self, manifest: dict) -> None:
        """Writes the manifest beside its place and moves it there; if another writer made that version first, this fails and nothing has changed."""
        jvm, fs = self._files()
        draft = self._at("manifests", f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context.rename(fs.makeQualified(draft), fs.makeQualified(self._at("manifests", f"{manifest['version']}.json")), option)

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions and the folders that only these held."""
        _, fs = self._files()
        known = self.versions()
        gone, stay = known[:-keep], {f.rpartition("/")[0] for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for version in gone:
            folders = {f.rpartition("/")[0] for f in self.manifest(version)["folders"].values()}
            fs.delete(self._at("manifests", f"{version}.json"), False)
            for folder in folders - stay:
                fs.delete(self._at(folder), True)


def upsert_stream(rows: DataFrame, table: KeyedTable, order: str, name: str):
    """A writer of a stream whose micro-batches are put into ``table``; ``name`` tells this stream's batches from those of others."""
    return rows.writeStream.outputMode("update").foreachBatch(lambda batch, number: table.upsert(batch, order, name, number))
