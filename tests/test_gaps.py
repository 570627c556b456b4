"""Unique paths, keyed tables, diagnostics line by line, references and limited outputs against plain loops."""

import posixpath
import random
import re

from pyspark.sql import functions as F

from tests.test_operators import rows
from tracewright.functions import text
from tracewright.operators import builds, inventory, paths
from tracewright.operators.chains import running
from tracewright.sources.upserts import KeyedTable, upsert_stream


def probed(names):
    seen, out = set(), []
    for seq, name in sorted(names):
        stem, end = posixpath.splitext(name)
        found, number = name, 2
        while found in seen:
            found, number = f"{stem}-{number}{end}", number + 1
        seen.add(found)
        out.append((seq, found))
    return out


def unique(spark, names, block=16):
    df = spark.createDataFrame(names, "seq long, path string").repartition(3)
    return sorted(tuple(r) for r in paths.unique_paths(df, "path", "seq", block=block).select("seq", "unique_path").collect())


def test_unique_paths_equal_probing(spark):
    for seed in range(6):
        rng = random.Random(seed)
        pool = ["a.ts", "a-2.ts", "a-3.ts", "a-5.ts", "a-2-2.ts", "a-2-3.ts", "a-02.ts", "a-1.ts", "b/a.ts", "a", "a-2", "x.y-2", ".e", ".e-2", "a-2.b-3.ts"]
        names = [(i, rng.choice(pool[: 4 + seed * 2])) for i in range(90)]
        rng.shuffle(names)
        found = unique(spark, names)
        assert found == probed(names) and len({p for _, p in found}) == 90


def test_numbers_that_others_took_first(spark):
    names = [(i, f"a-{i}.ts") for i in range(2, 40)] + [(100 + i, "a.ts") for i in range(60)] + [(300 + i, f"a-{i}.ts") for i in range(30, 70)]
    assert unique(spark, names) == probed(names)


def test_a_path_of_very_many_rows(spark):
    df = spark.range(100_000).select(F.col("id").alias("seq"), F.lit("m.ts").alias("path")).union(spark.createDataFrame([(-1, "m-7.ts"), (500_000, "m-9.ts"), (500_001, None)], "seq long, path string"))
    found = paths.unique_paths(df, "path", "seq", block=4096)
    assert found.where("path is not null").select("unique_path").distinct().count() == 100_002 and found.where("unique_path is null").count() == 1
    assert rows(found.where("seq in (-1, 5, 6, 99999, 500000)"), "seq", "unique_path") == [(-1, "m-7.ts"), (5, "m-6.ts"), (500000, "m-9-2.ts"), (6, "m-8.ts"), (99999, "m-100001.ts")]


def test_running_sums(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    found = {r.at: r.n for r in running(df, ["k"], "at", F.floor(F.col("at") / 7), F.col("at"), "n").collect()}
    assert found == {i: sum(range(i % 3, i + 1, 3)) for i in range(50)}


def test_module_paths(spark):
    cases = [("webpack:///./src/a b.js", "src/a_b.js", "src/a_b.ts"), ("..\\x/../y.tsx", "x/y.tsx", "x/y.tsx"), ("/", "module", "module.ts"), ("a/.env", "a/.env", "a/.env.ts"), ("k.d.mjs", "k.d.mjs", "k.d.ts")]
    df = spark.createDataFrame(cases, "p string, path string, typed string")
    assert all((r[0], r[1]) == (r[2], r[3]) for r in df.select(paths.module_path(F.col("p")), paths.typed_path(F.col("path")), "path", "typed").collect())


BEAT = "role string, id long, at long, v string"


def test_upserts_by_key(spark, tmp_path):
    kept = KeyedTable(spark, f"{tmp_path}/t", BEAT, ("role", "id"), 4)
    assert kept.read().count() == 0 and kept.versions() == []
    make = lambda *r: spark.createDataFrame(list(r), BEAT)
    assert kept.upsert(make(("w", 1, 1, "a"), ("w", 1, 3, "b"), ("w", 2, 1, "c"), (None, 1, 1, "n")), "at", "s", 0) == 1
    assert rows(kept.read()) == [("w", 1, 3, "b"), ("w", 2, 1, "c"), (None, 1, 1, "n")] or len(rows(kept.read())) == 3
    before = sorted(map(str, rows(kept.read())))
    assert kept.upsert(make(("w", 9, 9, "again")), "at", "s", 0) == 1 and sorted(map(str, rows(kept.read()))) == before  # a batch that comes twice
    assert kept.upsert(make(("w", 2, 0, "d"), ("x", 5, 5, None)), "at", "s", 1) == 2
    assert rows(kept.read().where("role is not null")) == [("w", 1, 3, "b"), ("w", 2, 0, "d"), ("x", 5, 5, None)]
    assert sorted(map(str, rows(kept.read(1)))) == before
    assert kept.update(make(("w", 1, 7, None), ("w", 77, 1, "q")), "at", ["v"]) == 3
    assert rows(kept.read().where("role = 'w'")) == [("w", 1, 3, None), ("w", 2, 0, "d")]
    assert rows(kept.missing(make(("w", 77, 1, "q"), ("w", 1, 1, "")))) == [("w", 77)]
    kept.vacuum(1)
    assert kept.versions() == [3] and kept.read().count() == 4


def test_a_lost_race_changes_nothing(spark, tmp_path, monkeypatch):
    import pytest
    from py4j.protocol import Py4JJavaError

    one, two = (KeyedTable(spark, f"{tmp_path}/t", BEAT, ("role", "id"), 4) for _ in range(2))
    stale = one.manifest()
    two.upsert(spark.createDataFrame([("w", 1, 1, "two")], BEAT), "at")
    monkeypatch.setattr(KeyedTable, "manifest", lambda self, version=None: stale)
    with pytest.raises(Py4JJavaError):
        one.upsert(spark.createDataFrame([("w", 1, 1, "one")], BEAT), "at")
    monkeypatch.undo()
    assert rows(one.read()) == [("w", 1, 1, "two")]


def test_stream_of_upserts(spark, tmp_path):
    kept = KeyedTable(spark, f"{tmp_path}/t", BEAT, ("role", "id"), 4)
    for i, batch in enumerate([[("w", 1, 1, "a")], [("w", 1, 0, "b"), ("w", 2, 2, "c")]]):
        spark.createDataFrame(batch, BEAT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = upsert_stream(spark.readStream.schema(BEAT).parquet(f"{tmp_path}/in"), kept, "at", "beats")
        stream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        assert kept.manifest()["batches"] == {"beats": i}
    assert rows(kept.read()) == [("w", 1, 0, "b"), ("w", 2, 2, "c")]


LOG = [
    "noise(1,2): nothing yet",
    "src/a.ts(3,5): error TS2304: Cannot find name 'x'.",
    "  more  ",
    "lib/b.ts(7,1): 'x' is declared here, see TS2728",
    "plain words",
    "",
    "lib/c.ts:9:2 - The file is in the program",
    "~~~",
    "✘ [ERROR] Could not resolve",
    "    src/b.ts:7:2:",
    "    src/c.ts:8:2:",
    "src/d.ts:8:2:",
    "[vite:css] bad",
    "[vite]: Failed to load from 'x/y.css'",
    "  q.ts:1:1:",
    "error TS5: global",
    None,
]


def looped(lines):
    found = []
    for raw in lines:
        raw = raw or ""
        line, bare = raw.rstrip(), raw.strip()
        if len(found) >= 100:
            break
        if not bare:
            continue
        m = re.match(r"(?i)^(.+?)\((\d+),(\d+)\):\s*(error|warning|message|suggestion)\s+(TS\d+):\s*(.*)$", bare)
        head = ("tsc", m[1], int(m[2]), int(m[3]), m[4], m[5]) if m else None
        if m := re.match(r"(?i)^(error)\s+(TS\d+):", bare):
            head = ("tsc", None, None, None, m[1], m[2])
        if bare.startswith("✘ [ERROR]"):
            head = ("esbuild", None, None, None, "error", None)
        if m := re.match(r"(?i)^\[vite(?::[^\]]+)?\]:?\s*(.+)$", bare):
            source = re.search(r"from '([^']+)'", m[1])
            head = ("vite", source[1] if source else None, None, None, "error" if "ailed" in m[1] else "unknown", None)
        if head:
            found.append([*head, [], []])
        elif found:
            last = found[-1]
            if m := re.match(r"^(.+?)\((\d+),(\d+)\):\s*(.+)$", bare) or re.match(r"^(.+?):(\d+):(\d+)\s+-\s*(.+)$", bare):
                code = re.search(r"\bTS\d+\b", m[4])
                last[7].append((m[1], int(m[2]), int(m[3]), m[4], code[0] if code else None))
            elif (m := re.match(r"^(.+?):(\d+):(\d+):\s*$", bare)) and last[0] == "esbuild" and last[1] is None:
                last[1:4] = [m[1], int(m[2]), int(m[3])]
                last[6].append(line)
            elif raw[:1].isspace() or bare[0] in ">|│╵~^":
                last[6].append(line)
    return [(*d[:6], d[6][:30], d[7]) for d in found]


def test_diagnostics_equal_a_loop(spark):
    rng = random.Random(8)
    logs = [LOG, [LOG[1]] * 120, [LOG[8]] + [f"   {i}" for i in range(50)], [], [rng.choice(LOG) for _ in range(400)], LOG[:1]]
    lines = spark.createDataFrame([(f"l{n}", i, t) for n, log in enumerate(logs) for i, t in enumerate(log)], "log_id string, line_no int, line string").repartition(3)
    found = builds.with_related(builds.diagnostics(lines), builds.related_information(lines))
    got = {}
    for d in found.orderBy("log_id", "number").collect():
        got.setdefault(d.log_id, []).append((d.form, d.path, d.line, d.column, d.category, d.code, d.context, [tuple(r)[1:] for r in d.related]))
    assert got == {f"l{n}": looped(log) for n, log in enumerate(logs) if looped(log)}


def test_other_places_are_sorted_once_and_narrow(spark):
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(LOG)], "log_id string, line_no int, line string")
    plan = builds.related_information(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    found = [(r.number, r.nth, r.path, r.code) for r in builds.related_information(spark.createDataFrame([("l", 1, "a.ts(1,2): error TS1: x"), ("l", 2, "b.ts(1,2): see TS5"), ("l", 3, " c.ts:1:2 - d"), ("l", 4, "e:1:2:"), ("l", 5, "[vite] f"), ("l", 6, "g.ts(3,4): h"), ("m", 1, "g.ts(3,4): h")], lines.schema)).collect()]
    assert sorted(found) == [(1, 1, "b.ts", "TS5"), (1, 2, "c.ts", None), (2, 1, "g.ts", None)]


def test_references_in_program_order(spark):
    tokens = [("f", 0, "a", "use"), ("f", 1, "a", "declare"), ("f", 2, "a", "use"), ("f", 3, "b", "use"), ("f", 4, "b", "top"), ("f", 5, "c", "use"), ("g", 0, "a", "declare"), ("f", 6, "a", "declare")]
    found = inventory.symbol_references(spark.createDataFrame(tokens, "file string, position int, name string, role string"))
    assert rows(found) == [("f", "a", 3), ("f", "b", 2), ("g", "a", 1)]


def test_uses_are_not_asked_for_declarations(spark):
    tokens = spark.createDataFrame([("f", 0, "a", "use"), ("f", 1, "a", "declare"), ("f", None, "b", "declare"), ("f", 2, "b", "use"), ("f", 3, "a", None)], "file string, position int, name string, role string")
    found = inventory.symbol_references(tokens)
    assert rows(found) == [("f", "a", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "role#" in plan and " IN (top,declare)" in plan


def test_limited_outputs_equal_python(spark):
    rng = random.Random(4)
    raws = [(bytes(rng.choice([0x61, 0xC3, 0xA9, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xE6, 0x97]) for _ in range(rng.randrange(12))), "日é🙂a".encode()[: rng.randrange(11)]) for _ in range(60)] + [(None, b"x"), (b"", None)]
    for limit in (-1, 0, 3, 8, 100):
        df = spark.createDataFrame([(i, bytearray(a) if a is not None else None, bytearray(b) if b is not None else None) for i, (a, b) in enumerate(raws)], "i int, a binary, b binary")
        for r in df.select("i", text.limited_output(F.col("a"), F.col("b"), limit).alias("o")).collect():
            a, b = (x or b"" for x in raws[r.i])
            most = max(limit, 0)
            out, err = (a[:most], b[: max(0, most - min(len(a), most))]) if len(a) + len(b) > most else (a, b)
            assert tuple(r.o) == (out.decode("utf-8", "replace"), err.decode("utf-8", "replace"), len(a) + len(b) > most)
