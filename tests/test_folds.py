"""Folds over rows in order, in batch and as streams, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import rows
from tracewright.operators import reports, revisions, rollups
from tracewright.operators.chains import nearest, reached
from tracewright.streaming import folds

WRITE = "scope string, scope_id string, seq long, expected_revision long, note string"


def settled(writes, stored=()):
    current, out = dict(stored), []
    for scope, scope_id, seq, expected, note in sorted(writes, key=lambda w: w[2]):
        now = current.get((scope, scope_id or ""), 0)
        taken = expected == now
        if taken:
            current[scope, scope_id or ""] = now + 1
        out.append((scope, scope_id or "", seq, expected, note, now, taken, now + 1 if taken else None))
    return sorted(out, key=str)


def some_writes(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["system", "project"]), rng.choice(["a", "", None]), i, rng.choice([None, *range(min(12, 1 + i // 20))]), f"n{i}") for i in range(n)]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_writes_equal_a_loop(spark, block):
    writes = some_writes(400)
    found = revisions.settle_writes(spark.createDataFrame(writes, WRITE).repartition(3), block=block)
    columns = ["scope", "scope_id", "seq", "expected_revision", "note", "current_revision", "accepted", "revision"]
    assert rows(found, *columns) == settled(writes)
    assert sum(r.accepted for r in found.collect()) > 20
    stored = {("system", ""): 3, ("project", "a"): 1, ("other", "z"): 9}
    current = spark.createDataFrame([("system", None, 3), ("project", "a", 1), ("other", "z", 9)], "scope string, scope_id string, revision long")
    assert rows(revisions.settle_writes(spark.createDataFrame(writes, WRITE), current, block), *columns) == settled(writes, stored.items())
    assert revisions.settle_writes(spark.createDataFrame([], WRITE)).count() == 0


def test_a_long_chain_in_one_scope(spark):
    """Every write counts, so that the chain is as long as the table, but rounds are few."""
    writes = spark.range(3000).select(F.lit("s").alias("scope"), F.lit(None).cast("string").alias("scope_id"), F.col("id").alias("seq"), F.col("id").alias("expected_revision"))
    found = revisions.settle_writes(writes, block=256)
    assert found.where("accepted and revision = seq + 1 and current_revision = seq").count() == 3000


def test_nearest_and_reached(spark):
    points = spark.createDataFrame([("a", 1, "x"), ("a", 9, "y"), ("b", 4, "z")], "k string, at long, v string").select("k", "at", F.struct("v").alias("hit"))
    asking = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 10), ("b", 4), ("c", 1)], "k string, at long")
    found = lambda before: [(*r[:2], r[2].v if r[2] else None) for r in rows(nearest(asking, points, ["k"], "at", F.floor(F.col("at") / 3), "hit", before), "k", "at", "hit")]
    assert sorted(found(False), key=str) == [("a", 0, "x"), ("a", 1, "x"), ("a", 10, None), ("a", 2, "y"), ("b", 4, "z"), ("c", 1, None)]
    assert sorted(found(True), key=str) == [("a", 0, None), ("a", 1, "x"), ("a", 10, "y"), ("a", 2, "x"), ("b", 4, "z"), ("c", 1, None)]
    links = spark.createDataFrame([(i, i + 3 if i < 90 else None) for i in range(100)], "id long, next long")
    assert rows(reached(links, spark.createDataFrame([(0,), (1,)], "id long"))) == sorted([(i,) for i in range(100) if i % 3 < 2 and i < 93], key=str)


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


CALL = "key string, at timestamp, seq long, failed boolean, cacheable boolean, message string"


def some_calls(n, seed=2):
    rng = random.Random(seed)
    return [(rng.choice("ab"), at(rng.randrange(0, 300)), i, rng.choice([True, True, False, None]), rng.choice([True, True, None]), f"m{i}") for i in range(n)]


def answered(calls, ttl):
    entries, out = {}, []
    for key, when, seq, failed, cacheable, message in sorted(calls, key=lambda c: (c[1], c[2])):
        since, text = entries.get(key, (None, None))
        if since is not None and when < since + dt.timedelta(seconds=ttl):
            out.append((key, seq, "cached", text))
            continue
        if failed and cacheable:
            entries[key] = (when, message)
        out.append((key, seq, "failed" if failed else "passed", message if failed else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 3600])
def test_failures_equal_a_loop(spark, block):
    calls = some_calls(300)
    found = revisions.cached_failures(spark.createDataFrame(calls, CALL).repartition(3), 20, block)
    assert rows(found, "key", "seq", "outcome", "message") == answered(calls, 20)
    assert set(found.columns) == {"key", "at", "seq", "failed", "cacheable", "message", "outcome"}
    assert revisions.cached_failures(spark.createDataFrame([], CALL), 20).count() == 0


def test_a_hit_prolongs_nothing(spark):
    calls = [("k", at(s), i, True, True, f"m{i}") for i, s in enumerate([0, 9, 10, 19, 20])]
    found = revisions.cached_failures(spark.createDataFrame(calls, CALL), 10)
    assert rows(found, "seq", "outcome", "message") == [(0, "failed", "m0"), (1, "cached", "m0"), (2, "failed", "m2"), (3, "cached", "m2"), (4, "failed", "m4")]


def test_keys_of_failures(spark):
    df = spark.createDataFrame([(" OpenX ", " M1", "HTTP://Host/v1// ", "planner"), (None, None, None, None)], "p string, m string, u string, a string")
    assert [tuple(r[0]) for r in df.select(revisions.failure_key(*map(F.col, "pmua"))).collect()] == [("openx", "M1", "http://host/v1", "planner"), ("", "", "", "")]


def test_revisions_by_number(spark):
    held = spark.createDataFrame([("system", None, 1, "x"), ("system", "", 2, "y"), ("project", "a", 1, "z")], "scope string, scope_id string, revision long, settings string")
    wanted = spark.createDataFrame([("system", None, 2), ("project", "a", 1), ("project", "b", 1)], "scope string, scope_id string, revision long")
    assert rows(revisions.revision_of(held, wanted), "settings") == [("y",), ("z",)]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, batches, schema, build):
    """The rows that a stream makes of tables that arrive one after the other, over two runs."""
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    for start in (0, len(batches) // 2):
        for i in range(start, len(batches) // 2 if start == 0 else len(batches)):
            spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("append").parquet(source)
            stream = build(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


def test_stream_of_writes_equals_the_batch(rocks, tmp_path):
    writes = some_writes(60, 5)
    found = streamed(rocks, tmp_path, [writes[:20], writes[20:45], writes[45:]], WRITE, folds.settle_writes)
    assert rows(found, "scope", "scope_id", "seq", "current_revision", "accepted", "revision") == sorted([(w[0], w[1], w[2], *w[5:]) for w in settled(writes)], key=str)


def test_stream_of_failures_equals_the_batch(rocks, tmp_path):
    calls = sorted(some_calls(90, 4), key=lambda c: (c[1], c[2]))
    found = streamed(rocks, tmp_path, [calls[:30], calls[30:70], calls[70:]], CALL, lambda df: folds.cached_failures(df, 20, "1 hour"))
    assert rows(found, "key", "seq", "outcome", "message") == answered(calls, 20)


def test_late_calls_find_and_cache_nothing(rocks, tmp_path):
    first = [("k", at(100), 0, True, True, "m0"), ("k", at(105), 1, True, True, "m1")]
    late = [("k", at(97), 2, True, True, "late"), ("k", at(109), 3, True, True, "m3"), ("k", at(10), 4, True, True, "too late")]
    found = streamed(rocks, tmp_path, [first, late], CALL, lambda df: folds.cached_failures(df, 10, "20 seconds"))
    assert rows(found, "seq", "outcome", "message") == [(0, "failed", "m0"), (1, "cached", "m0"), (2, "failed", "late"), (3, "cached", "m0")]


# Operators whose rules were wrong.


def test_source_candidates_are_normal_paths(spark):
    data = [("m/x.map", "b/x.js", None, "../lib/x.ts"), ("m/x.map", "b/x.js", "webpack:///r", "webpack:///./src/y.ts"), ("x.map", "x.js", "", "../../z.ts"), ("m/x.map", "b/x.js", None, "https://h/z.ts"), ("m/x.map", "b/x.js", None, None)]
    found = reports.source_candidates(spark.createDataFrame(data, "map_path string, bundle_path string, source_root string, source string"))
    assert [r.candidate for r in found.where("source like '%lib%'").orderBy("position").collect()] == ["lib/x.ts", "../lib/x.ts"]
    assert [r.candidate for r in found.where("source like '%src%'").orderBy("position").collect()] == ["m/src/y.ts", "b/src/y.ts", "r/src/y.ts", "src/y.ts"]
    assert [r.candidate for r in found.where("source like '%z.ts'").collect()] == ["../../z.ts"]


def test_only_failed_records_are_observations(spark):
    data = [("a", "k", 1, "skipped", "1"), ("b", "k", 1, "unknown", "2"), ("c", "k", 1, None, "3"), ("d", "k", 1, "fail", "4"), ("d", "l", 1, "pass", "5")]
    found = rollups.completion(spark.createDataFrame(data, "group string, key string, attempt int, status string, id string"))
    assert rows(found) == [("a", "completed", 0), ("b", "completed", 0), ("c", "completed", 0), ("d", "completed_best_effort", 1)]


def test_viewport_labels_and_scopes(spark):
    data = [("s", "wide", 10, 20), (None, "", 10, 0), ("", None, 7, 9), ("s", None, None, None)]
    df = spark.createDataFrame(data, "s string, n string, w int, h int")
    found = [r[0] for r in df.select(reports.scope_key(F.col("s"), reports.viewport_label(F.col("n"), F.col("w"), F.col("h")))).collect()]
    assert found == ["s::wide 10x20", "unknown::默认视口", "unknown::7x9", "s::默认视口"]


def test_status_totals(spark):
    df = spark.createDataFrame([("k", "pass"), ("k", ""), ("k", None), ("k", "pass")], "k string, status string")
    assert rows(reports.status_totals(df, ["k"])) == [("k", "pass", 2), ("k", "unknown", 2)]
