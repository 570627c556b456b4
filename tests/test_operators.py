import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import audit, budget, builds, dedupe, diff, inventory, knowledge, lineage, ops, queue, retention, rollups, settings


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def T(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in values.items())).select(column).first()[0]


def test_latest_attempts_keep_ties_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 0, "n"), (None, 0, "m"), ("b", -1, "b")], "k string, n int, v string")
    assert rows(dedupe.latest_attempts(df, ["k"], "n"), "v") == [("b",), ("m",), ("n",), ("y",), ("z",)]
    values = spark.createDataFrame([("3", 3, 2.7, True), ("x", -2, 1.0, False), (None, None, None, None)], "text string, n long, d double, b boolean")
    found = values.select(*[dedupe.attempt_number(F.col(c)) for c in ("text", "n", "d", "b")]).collect()
    assert [tuple(r) for r in found] == [(0, 3, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    nothing = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert rows(dedupe.latest_attempts(nothing, ["k"], "n"), "v") == [("x",), ("z",)]
    failed = spark.createDataFrame([("g", "k", None, "fail", "1")], "group string, key string, attempt int, status string, id string")
    assert rows(rollups.completion(failed)) == [("g", "completed_best_effort", 1)]


def test_first_last_and_best(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("b", 4, None)], "k string, seq int, c double")
    assert rows(dedupe.keep_first(df, ["k"], "seq"), "seq") == [(1,), (4,)]
    assert rows(dedupe.keep_last(df, ["k"], "seq"), "seq") == [(3,), (4,)]
    assert rows(dedupe.keep_best(df, ["k"], "c", ["seq"]), "seq") == [(2,), (4,)]
    named = dedupe.numbered_names(df, "k", "seq")
    assert rows(named, "unique_name") == [("a",), ("a-2",), ("a-3",), ("b",)]
    assert rows(dedupe.top_with_rest(df, ["k"], [F.col("seq")], 2, "seq")) == [("a", 1, "1", 0), ("a", 2, "2", 0), ("a", 3, None, 1), ("b", 1, "4", 0)]


def test_audit_risk(spark):
    data = [("1", "pass", "none"), ("2", "pass", "runtime"), ("3", "retry", "none"), ("4", "rejected", "none"), ("5", None, None), ("6", "unverified", None)]
    part = spark.createDataFrame(data, "id string, status string, failure_class string").withColumn("category", F.lit("review"))
    records = audit.union_records(part)
    assert rows(audit.counts_by_risk(records)) == [("blocking", 2), ("passing", 2), ("review", 2)]
    assert rows(audit.counts_by_risk(records.limit(0))) == [("blocking", 0), ("passing", 0), ("review", 0)]
    assert rows(records.where(audit.matches(status="attention")), "id") == [("2",), ("3",), ("4",), ("6",)]
    assert rows(records.where(audit.matches(query=" RUNtime ")), "id") == [("2",)]
    assert rows(audit.status_counts(spark.createDataFrame([("a",), ("",), (" ",), (None,)], "status string"))) == [("a", 1), ("unknown", 3)]
    evidence = spark.createDataFrame([("j1", "runtime", "x")], "job_id string, failure_class string, reason string")
    jobs = spark.createDataFrame([("j1", "build", "y"), ("j2", "build", "z"), ("j3", "none", "-")], "job_id string, failure_class string, reason string")
    assert rows(audit.failure_summary(evidence, jobs)) == [("j1", "runtime", "x"), ("j2", "build", "z")]


def test_heartbeats_and_rules(spark):
    beats = spark.createDataFrame([("w", "b", T(1), T(2)), ("w", "a", T(1), T(3)), ("x", "c", T(0), None)], "service_role string, instance_id string, checked_at timestamp, expires_at timestamp")
    now = F.lit(T(2))
    assert rows(ops.heartbeat_counts(beats, now)) == [("w", 1, 1), ("x", 0, 1)]
    assert rows(ops.latest_metrics(beats), "instance_id") == [("b",), ("c",)]
    assert rows(ops.latest_heartbeat(beats, ["service_role"]), "instance_id") == [("a",), ("c",)]
    cases = [("5", "gt", "3", True), ("true", "gt", "0", False), ("5", "gte", "true", False), ("5", "eq", "5.0", True), ('"a"', "eq", '"a"', True), ('"5"', "gte", "5", False), (None, "lt", "1", False), (None, "neq", "1", False), (None, "eq", None, False), ("1", "like", "1", False)]
    df = spark.createDataFrame(cases, "v string, o string, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(ops.rule_matches(F.col("v"), F.col("o"), F.col("t")), "want").collect())
    metrics = spark.createDataFrame([('{"browserRunner": {"queuedCount": 12, "retryRate": 0.1, "expired-x": true}, "staleHeartbeatCount": 1}',), ("no json",)], "metrics string")
    found = ops.alerts(metrics, spark.createDataFrame(ops.DEFAULT_RULES, ops.RULE))
    assert rows(found, "code") == [("browser_runner_queue_backlog",), ("ops_stale_heartbeats",)]
    rules = spark.createDataFrame([("number", "i", "a", "gte", "50", None, True), ("text", "i", "b", "eq", '"abc"', None, None), ("off", "i", "a", "gt", "0", None, False), ("quoted", "i", "c", "gte", "1", None, True), ("other", "i", "d.e", "neq", "1", None, True), ("gone", "i", "z", "neq", "1", None, True)], ops.RULE + ", enabled boolean")
    metrics = spark.createDataFrame([('{"a": 90, "b": "abc", "c": "90", "d": {"e": true}, "z": null}',), ('{"a": true}',), ("no json",), (None,)], "metrics string")
    assert rows(ops.alerts(metrics, rules), "code", "value") == [("number", "90"), ("other", "true"), ("text", '"abc"')]
    given = ops.configured_rules(spark, '{"rules": [{"code": "mine", "metric_path": "a.b", "operator": "gt", "threshold": 3}, {"code": "bad", "operator": "no"}, 5]}')
    assert rows(given.where("code not like 'browser%'"), "code", "threshold", "enabled") == [("mine", "3", True), ("ops_stale_heartbeats", "0", True)]
    assert ops.configured_rules(spark, "no json").count() == ops.configured_rules(spark, None).count() == 4
    events = spark.createDataFrame([("c", None, "i", None, 2), ("c", None, "i", None, 1), ("d", "r", None, "f", 3)], "code string, service_role string, instance_id string, field string, seq int")
    assert rows(ops.dedupe_alerts(events), "seq") == [(1,), (3,)]


RUN = "id string, status string, created_at timestamp, next_run_at timestamp, started_at timestamp, finished_at timestamp, attempt int, max_attempts int, lease_owner string, lease_expires_at timestamp, lease_recovered boolean, error string"


def test_queue(spark):
    data = [
        ("a", "queued", T(1), None, None, None, 0, 2, None, None, False, None),
        ("b", "queued", T(0), T(3), None, None, 1, 2, None, None, False, None),
        ("c", "queued", T(0), T(9), None, None, 1, 2, None, None, False, None),
        ("d", "running", T(0), None, T(0), None, 1, 2, "w", T(2), False, None),
        ("e", "running", T(0), None, T(0), None, 2, 2, "w", T(4), False, None),
        ("f", "pass", T(0), None, T(2), T(1), 2, 2, None, None, True, None),
        ("g", "fail", T(0), None, T(1), T(1, 1), 2, 2, None, None, False, None),
        ("h", "pass", T(0), None, None, T(1), 1, 2, None, None, False, None),
    ]
    runs, now = spark.createDataFrame(data, RUN), F.lit(T(4))
    m = queue.metrics(runs, now).first()
    assert (m.queued, m.running, m.terminal, m.oldest_queued_ms, m.claim_latency_ms, m.mean_run_ms, m.recovered, m.expired_running) == (3, 2, 3, 4 * 3600000, 3 * 3600000, 30000, 1, 2)
    assert m.retry_rate == pytest.approx(3 / 7)
    empty = queue.metrics(runs.limit(0), now).first()
    assert (empty.queued, empty.oldest_queued_ms, empty.mean_run_ms, empty.retry_rate) == (0, None, None, 0.0)
    assert [r.id for r in queue.due(runs, now).collect()] == ["a", "b"]
    claimed = queue.claim(runs, now, "me", 60, exclude=spark.createDataFrame([("a",)], "id string")).collect()
    assert [(r.id, r.status, r.attempt, r.lease_owner) for r in claimed] == [("b", "running", 2, "me")]
    after = {r.id: r for r in queue.recover_expired(runs, now).collect()}
    assert (after["d"].status, after["d"].lease_recovered, after["d"].lease_owner) == ("queued", True, None)
    assert (after["e"].status, after["e"].error, after["e"].lease_recovered) == ("best_effort", "timeout", False)
    events = spark.createDataFrame([("j", 1, "queued", None, None), ("j", 2, "failed", None, None), ("j", 3, "queued", None, None), ("k", 1, "leased", "w", "w"), ("k", 2, "completed", "v", "w")], "job_id string, seq int, status string, worker string, expected_worker string")
    assert rows(queue.replay(events), "job_id", "status") == [("j", "failed"), ("k", "leased")]
    ends = spark.createDataFrame([("fail", "network", 1, 3), ("fail", "policy_denied", 1, 3), ("fail", "network", 3, 3), ("pass", "none", 1, 3)], "status string, failure_class string, attempt int, max_attempts int")
    assert [r.status for r in queue.finish(ends, now, 5).collect()] == ["queued", "best_effort", "best_effort", "pass"]


def test_retention(spark):
    data = [("1", "build_log", "ephemeral", T(1), None), ("2", "memory_record", "project", None, None), ("3", "unheard_of", "project", T(2), None), ("4", "build_log", "ephemeral", T(3), T(0)), ("5", None, None, T(1), None)]
    df = spark.createDataFrame(data, "id string, kind string, retention_class string, expires_at timestamp, deleted_at timestamp")
    now = F.lit(T(2))
    assert rows(df.where(retention.expired(F.col("expires_at"), now)), "id") == [("1",), ("3",), ("5",)]
    assert rows(df.where(retention.matches(now, delete_expired=True, categories=["logs"])), "id") == [("1",)]
    assert rows(df.where(retention.matches(now, categories=["derived"])), "id") == [("3",), ("5",)]
    assert rows(df.where(retention.matches(now)), "id") == []
    assert rows(retention.outcomes(df, retention.matches(now, classes=["ephemeral"]), True)) == [("1", "dry_run")]


def test_diffs(spark):
    df = spark.createDataFrame([(["b", "a", "a"], ["b", "c"])], "l array<string>, r array<string>")
    d = df.select(diff.collection_diff(F.col("l"), F.col("r")).alias("d")).first().d
    assert (d.changed, d.left_count, d.right_count, d.shared, d.left_only, d.right_only) == (True, 3, 2, ["b"], ["a"], ["c"])
    lines = spark.createDataFrame([("404 /x",), ("network_policy_denied y",), ("z request failed",), ("hi",)], "l string")
    assert [r[0] for r in lines.select(diff.network_group(F.col("l"))).collect()] == ["status_4xx", "policy_denied", "request_failed", "network_other"]
    docs = spark.createDataFrame([("1", '{"a": {"b": [1, "x"]}, "n": null}'), ("2", '{"a": {"b": [2, "x"]}}'), ("3", "{")], "id string, doc string")
    flat = diff.flatten(docs, "id", "doc")
    assert rows(flat.where("id = '1'"), "path", "value") == [("a.b[0]", "1"), ("a.b[1]", '"x"'), ("n", "null")]
    got = diff.value_differences(flat.where("id = '1'").select("path", "value"), flat.where("id = '2'").select("path", "value"), [])
    assert rows(got, "path", "left_value", "right_value") == [("a.b[0]", "1", "2"), ("n", "null", None)]
    deep = spark.createDataFrame([("1", '{"l": ' + str(list(range(14))) + ', "d": {"e": {"f": {"g": 1}}}}')], "id string, doc string")
    assert ("l.truncated", "2") in rows(diff.flatten(deep, "id", "doc"), "path", "value") and ("d.e.f.g", "1") in rows(diff.flatten(deep, "id", "doc"), "path", "value")
    pair = spark.createDataFrame([("1", ["http://a:1"], ["http://b:2"], ["200 http://a:1/x"], ["200 http://b:2/x"], ["log: 1"], ["error: 1"], "pass", "retry")], "id string, left_origins array<string>, right_origins array<string>, left_requests array<string>, right_requests array<string>, left_console array<string>, right_console array<string>, left_status string, right_status string")
    c = diff.compare_captures(pair).first()
    assert (c.network.changed, c.console.changed, c.status) == (False, True, "retry")
    comparisons = spark.createDataFrame([("1", "pass", True, False, False, "compared", 0.02, True), ("2", "pass", False, False, False, "size_mismatch", None, True), ("3", "pass", False, False, False, "compared", 0.01, True)], "id string, status string, dom_changed boolean, network_changed boolean, console_changed boolean, pixel_status string, changed_ratio double, screenshot_changed boolean")
    found = diff.gate_observations(comparisons, ["dom", "screenshot"], 0.01)
    assert rows(found) == [("1", "dom_changed"), ("1", "pixel_ratio"), ("2", "changed_without_pixels")]
    assert diff.gate_verdict(comparisons, found).first().status == "fail"
    assert diff.gate_verdict(comparisons.limit(0), found.limit(0)).first().status == "fail"
    assert diff.gate_verdict(comparisons, found.limit(0)).first().status == "pass"


def test_rollups(spark):
    records = spark.createDataFrame([("name", "X ", "foo", "a"), ("name", "x", "bar", "b"), ("kind", "y", "k", "a"), ("kind", "y", None, "b"), ("dead_code", "x", "Unused", "c"), ("note", None, "1", "a"), ("note", " ", "2", "b")], "type string, target string, value string, agent string")
    executions = spark.createDataFrame([("a", "pass"), ("b", "fail")], "agent string, status string")
    got = {r.key: r.severity for r in rollups.all_conflicts(records, executions).collect()}
    assert got == {"conflict:name:x": "warning", "overlap:kind:y": "info", "overlap:note": "info", "conflict:retention:x": "warning", "stage:status-divergence": "warning"}
    actions = spark.createDataFrame([(1, "set", "p", "1"), (2, "set", "p", "2"), (3, "set", "q", "1"), (4, "set", "q", "1"), (5, "mirror_original_static_entry", "z", "v")], "seq int, action string, path string, value string")
    assert [r.verdict for r in rollups.approve_actions(actions).orderBy("seq").collect()] == ["conflict", "conflict", "approved", "duplicate", "approved"]
    stages = spark.createDataFrame([(1, "skipped"), (1, "skipped"), (2, "skipped"), (2, "pass"), (3, "retry"), (3, "fail"), (4, "pass")], "k int, status string")
    assert rows(stages.groupBy("k").agg(rollups.stage_status(F.col("status")))) == [(1, "skipped"), (2, "best_effort"), (3, "fail"), (4, "pass")]
    decisions = spark.createDataFrame([("g", "k", 1, "fail", "1"), ("g", "k", 2, "pass", "2"), ("h", "k", 1, "retry", "3"), ("i", "k", 1, "fail", "4")], "group string, key string, attempt int, status string, id string")
    overruled = spark.createDataFrame([("4",)], "id string")
    assert rows(rollups.completion(decisions, overruled)) == [("g", "completed", 0), ("h", "completed_best_effort", 1), ("i", "completed", 0)]
    reviews = spark.createDataFrame([("g", "best_effort", None, True), ("h", "best_effort", "none", True), ("g", "fail", "none", True)], "group string, status string, failure_class string, uncertain boolean")
    facts = spark.createDataFrame([("g", "review", "pass"), ("g", "report", "pass"), ("h", "review", "pass")], "group string, source string, status string")
    assert rows(rollups.superseded(reviews, facts), "group", "status") == [("g", "best_effort")]


def test_lineage(spark):
    artifacts = spark.createDataFrame([("a", []), ("b", ["a", "gone"]), ("c", ["b"]), ("d", None)], "id string, parent_artifact_ids array<string>")
    edges = lineage.parent_edges(artifacts)
    assert rows(edges, "src", "dst") == [("a", "b"), ("b", "c")]
    spark.sparkContext.setCheckpointDir("/tmp/spark-lineage-test")
    assert rows(lineage.ancestors(edges, 5)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    specs = spark.createDataFrame([("x", 1), ("y", 2), ("y", 2), ("z", 2)], "name string, stage_order int")
    needs = spark.createDataFrame([("y", "x"), ("z", "y"), ("z", "nope")], "name string, needs string")
    assert rows(lineage.graph_problems(specs, needs)) == [("y", "duplicate"), ("z", "missing"), ("z", "not_earlier")]


HTML = """<!-- <script src="no.js"></script> --><html><link rel="modulepreload" href="/a.js?x=1"><link rel=stylesheet href='css/s.css'><script src="./a.js"></script>
<script>var x = '<img src="inline.png">';</script><img src="i.png" srcset="i2.png 2x, https://cdn/x.png 3x" /><video poster="p.jpg" src="../../out.mp4"></video><link rel=preload as=style href="css/s.css">
<title><img src="t.png"></title><input type=image src="b.png"><a href="c.html">"""


def test_inventory(spark):
    found = inventory.page_references(HTML, "site/index.html")
    assert [(p, k) for _, p, k, *_ in found] == [("a.js", "script"), ("site/css/s.css", "style"), ("site/a.js", "script"), ("site/i.png", "asset"), ("site/i2.png", "asset"), ("site/p.jpg", "asset"), ("site/b.png", "asset")]
    pages = spark.createDataFrame([("site/index.html", HTML), ("e.html", None)], "path string, content string")
    references = inventory.html_references(pages)
    files = spark.createDataFrame([("a.js",), ("site/css/s.css",), ("site/i.png",)], "path string").withColumn("kind", inventory.file_kind(F.col("path")))
    assert rows(inventory.referenced_kinds(references, files)) == [("a.js", "script"), ("site/css/s.css", "style"), ("site/i.png", "asset")]
    assert ("site/index.html -> asset:site/p.jpg",) in rows(inventory.missing_references(references, files))
    kinds = spark.createDataFrame([("x/A.HTM", "html"), ("a.tsx", "script"), ("m.json", "asset?"), ("app.manifest.json", "manifest"), ("package.json", "manifest"), ("b", "asset"), (".css", "asset?"), ("c.map", "source_map")], "path string, want string")
    got = {r.path: r.k for r in kinds.select("path", inventory.file_kind(F.col("path")).alias("k")).collect()}
    assert got == {"x/A.HTM": "html", "a.tsx": "script", "m.json": "unknown", "app.manifest.json": "manifest", "package.json": "manifest", "b": "asset", ".css": "asset", "c.map": "source_map"}
    # A source with a dot, be it that of ./, is taken as it stands.
    imports = spark.createDataFrame([("src/m.js", "./u"), ("src/m.js", "../lib/v.js?raw"), ("src/m.js", "react"), ("src/m.js", "https://x/y.js"), ("src/m.js", "w")], "importer string, source string")
    scripts = spark.createDataFrame([("src/u.ts", "script"), ("lib/v.js", "script"), ("src/w.mjs", "script")], "path string, kind string")
    assert rows(inventory.resolved_imports(imports, scripts), "source", "path") == sorted([("./u", None), ("../lib/v.js?raw", "lib/v.js"), ("react", None), ("https://x/y.js", None), ("w", "src/w.mjs")], key=str)
    maps = spark.createDataFrame([("d/b.js.map", '{"version": 3, "file": "b.js", "sources": ["webpack:///./s/a.js", "https://x/b.js", "./c.js"], "sourcesContent": ["A"]}'), ("bad.map", "{")], "path string, content string")
    assert rows(inventory.source_map_sources(maps), "position", "source", "content") == [(0, "s/a.js", "A"), (1, None, None), (2, "c.js", None)]


def test_budget(spark):
    parts = spark.createDataFrame([("p", 1, 1, True, 50), ("p", 1, 2, True, 50), ("p", 2, 1, False, 30), ("p", 2, 2, False, 30), ("p", None, 0, False, 40)], "k string, step int, seq int, whole_step boolean, tokens long").withColumn("budget", F.lit(75))
    assert rows(budget.trimmed(parts, "k", "budget"), "step", "seq", "kept") == sorted([(1, 1, False), (1, 2, False), (2, 1, False), (2, 2, True), (None, 0, True)], key=str)
    matrix = spark.range(10).withColumnRenamed("id", "index")
    assert rows(budget.balanced(matrix, 3)) == [(0,), (4,), (9,)] and rows(budget.balanced(matrix, 1)) == [(0,)] and budget.balanced(matrix, 20).count() == 10
    scenarios = spark.createDataFrame([("s", 1, ["m"]), ("t", 2, None)], "scenario string, seq int, viewports array<string>")
    assert rows(budget.viewport_matrix(scenarios, ["a", "b"])) == [("s", "m", 0), ("t", "a", 1), ("t", "b", 2)]


def test_knowledge_and_builds(spark):
    df = spark.createDataFrame([("1", "var __webpack_require__; define.amd; React.createElement"), ("2", ""), ("3", None)], "id string, t string")
    kinds = df.select("id", knowledge.runtime_kinds(F.col("t")).alias("k"))
    assert [r.k for r in kinds.orderBy("id").collect()] == [["webpack", "umd"], [], []]
    assert {r.id for r in knowledge.framework_hits(df.withColumnRenamed("id", "key"), "key", "t").collect()} == {"knowledge_framework_react", "knowledge_framework_webpack"}
    log = ["noise", "src/a.ts(3,5): error TS2304: Cannot find name 'x'.", "  more", "✘ [ERROR] Could not resolve", "", "    src/b.ts:7:2:", "  ctx", "[vite:css] bad", "error TS5: global"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(log)], "log_id string, line_no int, line string")
    got = builds.diagnostics(lines).orderBy("number").collect()
    assert [(d.form, d.path, d.line, d.category, d.code) for d in got] == [("tsc", "src/a.ts", 3, "error", "TS2304"), ("esbuild", "src/b.ts", 7, "error", None), ("vite", None, None, "unknown", None), ("tsc", None, None, "error", "TS5")]
    assert got[0].context == ["  more"] and len(got[1].context) == 2


def test_text_and_settings(spark):
    assert one(spark, text.redact(F.col("v"), "path"), v="abc") == "redacted:path:ba7816bf8f01"
    assert one(spark, text.redact_locator(F.col("v")), v="artifact:1") == "artifact:1"
    assert one(spark, text.redact_locator(F.col("v")), v="file:abc") == "file:redacted:locator:ba7816bf8f01"
    assert one(spark, text.slug(F.col("v")), v="  Hello, Wörld! ") == "hello_wörld"
    assert one(spark, text.normalized(F.col("v")), v="  ") is None
    assert one(spark, text.without_origins(F.col("v"), F.array(F.lit("http://a"), F.lit("http://a:1"))), v="http://a:1/x http://a/y") == "<runtime-origin>/x <runtime-origin>/y"
    assert one(spark, text.prometheus_sample(F.lit("m"), F.create_map(F.lit("b"), F.lit('x"y'), F.lit("a"), F.lit("1")), F.lit(2)), v="") == 'm{a="1",b="x\\"y"} 2'
    revisions = spark.createDataFrame([("project", "p", 1, "{}"), ("project", "p", 2, '{"a": 1}')], "scope string, scope_id string, revision int, settings string")
    scopes = spark.createDataFrame([("project", "p"), ("system", "")], "scope string, scope_id string")
    assert rows(settings.latest_settings(revisions, scopes)) == [("project", "p", 2, '{"a": 1}'), ("system", "", 0, "{}")]
    jobs = spark.createDataFrame([("j", "p", '{"a": {"y": [2]}}'), ("k", "q", None)], "job_id string, project_id string, settings string")
    projects = spark.createDataFrame([("p", '{"a": {"x": 1, "y": [1, 1]}}')], "project_id string, settings string")
    assert rows(settings.effective(jobs, '{"b": 0, "a": {"x": 0}}', projects)) == [("j", '{"a":{"x":1,"y":[2]},"b":0}'), ("k", '{"a":{"x":0},"b":0}')]
    hidden = spark.createDataFrame([('{"apiKey": "s", "keySecretRef": "env:X", "n": [{"password": 1}]}',)], "t string").select(settings.redact_json("t")).first()[0]
    assert hidden == '{"apiKey":"[redacted]","keySecretRef":"env:X","n":[{"password":"[redacted]"}]}'
    docs = spark.createDataFrame([("1", '{"a-Token": 1, "token": "x", "n": [{"value": {"p": "<you>"}}, {"containsSecretValues": true, "secret": ""}]}'), ("2", "{")], "id string, j string")
    assert rows(settings.findings(docs, "id", "j"), "path", "finding") == [("$.n[0].value", "secret"), ("$.n[0].value.p", "placeholder"), ("$.n[1].containsSecretValues", "flag"), ("$.token", "secret")]


def test_source_paths(spark):
    cases = {"node:fs": "node:fs", "C:x/y.js": "C:x/y.js", "/abs/a.js": "abs/a.js", " ./a\\b.js ": "a/b.js", "webpack:///./src/a.js": "src/a.js", "https://x/y.js": None, " ": None}
    df = spark.createDataFrame(list(cases.items()), "source string, want string")
    assert all(r[0] == r[1] for r in df.select(inventory.source_path(F.col("source")), "want").collect())


def test_times_without_zone_are_utc(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00",), ("2024-01-01T12:00:00+02:00",), ("2024-01-01 10:00:00Z",), ("2024-01-01",), ("x",)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    got = [r[0] for r in df.select(F.unix_timestamp(text.try_parse_time(F.col("t")))).collect()]
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [1704103200, 1704103200, 1704103200, 1704067200, None]
