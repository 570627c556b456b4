from pyspark.sql import functions as F

from tracewright.operators import graphs, inventory, knowledge, releases, reports
from tracewright.plans.agents import dealt
from tests.test_operators import rows


def test_graphs_of_a_package(spark):
    files = spark.createDataFrame([("p", "i.html", "html"), ("p", "a.js", "script"), ("p", "s.css", "style"), ("q", "b.js", "script"), ("q", None, "asset")], "package string, path string, kind string")
    imports = spark.createDataFrame([("p", "a.js", "./i", None), ("q", "b.js", "./c", "c.js")], "package string, importer string, source string, path string")
    maps = spark.createDataFrame([("p", "a.js", "a.js.map", ["x.ts", "x.ts"])], "package string, bundle_path string, map_path string, sources array<string>")
    symbols = spark.createDataFrame([("p", "a.js", "f", "variable", 2), ("p", "a.js", "f", "function", 1)], "package string, file string, name string, kind string, seq int")
    nodes, edges = graphs.package_graphs(files, imports, maps, symbols)
    assert rows(nodes.where("id like 'symbol:%'")) == [("p", "module", "symbol:a.js:f", "function", "f")]
    assert rows(edges.where("graph = 'chunk'"), "package", "src", "dst") == [("p", "entry:i.html", "script:a.js"), ("q", "script:b.js", "script:c.js")]
    assert nodes.count() == nodes.select("package", "graph", "id").distinct().count() and nodes.where("label is null").count() == 0
    assert rows(graphs.entry_points(files)) == [("p", "i.html"), ("q", "b.js")]
    assert rows(graphs.graph_warnings(files, maps)) == [("q", "chunk", "no_html_entry"), ("q", "chunk", "no_source_map")]
    nothing = graphs.package_graphs(files.limit(0), imports.limit(0), maps.limit(0), symbols.limit(0))
    assert nothing[0].count() == nothing[1].count() == 0


def test_agent_flow_shows_eighteen_records(spark):
    records = spark.range(20).select(
        F.lit("j").alias("job_id"), F.lit("review").alias("role"), F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("pass").alias("status"), F.lit(None).cast("string").alias("failure_class"),
        F.lit(None).cast("array<string>").alias("inputs"), F.array(F.lit("x"), F.lit(None)).alias("outputs"), F.lit(None).cast("array<struct<artifact_id:string,label:string>>").alias("refs"),
    )
    nodes, edges = graphs.agent_flow(records, spark.createDataFrame([], "job_id string, id string, kind string, stage string"))
    assert edges.count() == 18 and rows(edges.select("src").distinct()) == [("artifact:x",)]
    assert nodes.count() == 19 and rows(nodes.where("kind = 'artifact'"), "title", "tone", "column") == [("artifact", "warn", 2)]


def test_digests(spark):
    digest = "sha256:" + "0a" * 32
    images = spark.createDataFrame([(1, "api", "h/api:1", None), (2, None, "h/b@c:2", ""), (3, "ui", "h/ui:1", "h/ui"), (4, "", "", None)], "image_id int, service string, version_tag string, repository string")
    entries = [(0, "api", "h/api:9", digest, None), (1, "api", None, None, "z@" + digest), (2, None, None, None, "h/b@c@" + digest), (3, "ui", "h/ui:1", "bad", None)]
    found = releases.matched_digests(images, spark.createDataFrame(entries, "position int, service string, tag string, digest string, reference string"))
    assert rows(found, "image_id", "reference", "missing") == [(1, f"h/api@{digest}", None), (2, None, "registryDigests..digest"), (3, None, "registryDigests.ui.digest"), (4, None, "registryDigests.unknown")]
    checks = spark.createDataFrame([("g", 2, "b", None), ("g", 1, "a", "fail"), ("h", 1, "a", "pass")], "g string, seq int, name string, status string")
    assert rows(releases.check_rollup(checks, ["g"])) == [("g", "fail", 2, ["a", "b"]), ("h", "pass", 1, [])]


def test_knowledge_of_empty_packages_and_evidence(spark):
    none = "k int, entries array<string>, scripts array<string>, styles array<string>, source_maps array<string>, manifests array<string>, runtimes array<string>, has_exports boolean, single_bundle boolean, text string"
    packages = spark.createDataFrame([(1,) + (None,) * 9, (2, [], ["a", "b"], [], [], [], ["vite", "?"], True, False, "globalThis.x")], none)
    assert rows(knowledge.structural_hits(packages, ["k"]), "k", "id") == [(1, "knowledge_browser_shim_missing_html_entry"), (2, "knowledge_browser_shim_missing_html_entry"), (2, "knowledge_esm_exports"), (2, "knowledge_runtime_multi_chunk")]
    assert rows(knowledge.runtime_hits(packages, ["k"]), "k", "id") == [(2, "knowledge_detected_runtime_vite")]
    assert rows(knowledge.shim_hits(packages, ["k"], "text"), "k", "id") == [(2, f"knowledge_browser_shim_{x}") for x in ("generated_host", "global_this", "node_globals")]
    schema = "k int, kind string, status string, failure_class string, review_type string, phase string, target string, target_stage string, risk_level string, runners array<string>, artifact string"
    docs = spark.createDataFrame([(1, "runtime_trace", "fail", None, None, None, None, None, None, ["a"], None), (2, None, "fail", *[None] * 8), (3, "repair_instruction", *[None] * 9)], schema)
    assert rows(knowledge.prior_hits(docs, ["k"]), "id", "confidence") == [("knowledge_browser_shim_runtime_boundary_a", 0.77), ("knowledge_repair_case_repair_unknown", 0.72), ("knowledge_validation_runtime_trace_runtime_trace_none", 0.79)]
    assert rows(knowledge.historical_hits(docs, ["k"], "artifact"), "id", "confidence") == [("knowledge_historical_repair_case_repair_unknown_historical", 0.58)]


def test_missing_dependencies(spark):
    usage = spark.createDataFrame([("p", "d/a.js", s) for s in ("./b.js?x", "../../c.js", "..\\c", "./e\\f", "./dir", "./gone", "react", "./")], "package string, importer string, specifier string")
    paths = spark.createDataFrame([("p", "d/b.js", True), ("p", "d/dir", False), ("q", "d/gone", True)], "package string, path string, is_file boolean")
    found = rows(inventory.missing_dependencies(usage, paths).where("specifier <> './'"), "specifier", "resolved_path", "reason")
    assert found == [("../../c.js", None, "unsafe_relative_dependency"), ("./dir", "d/dir", "dependency_path_conflict"), ("./e\\f", None, "unsafe_relative_dependency"), ("./gone", "d/gone", "missing_static_relative_dependency")]


def test_fallback_sections_and_their_gaps(spark):
    jobs = spark.createDataFrame([(1,), (2,), (None,)], "job_id long")
    kinds = [(1, "a", "audit_report", True), (1, "b", "html_report", None), (1, "c", "*", False), (1, "d", "other", True), (3, "e", "review_run", True), (None, "f", "review_run", True)]
    artifacts = spark.createDataFrame(kinds, "job_id long, id string, kind string, included boolean")
    found = [(r.job_id or 0, r.position, r.anchor, r.artifact_id or "") for r in reports.fallback_sections(jobs, artifacts).collect()]
    anchors = list(reports.SECTIONS)
    held = [(1, 0, "a"), (1, 0, "b"), (1, 3, "a"), (1, 3, "d")]
    empty = [(1, n, "") for n in (1, 2, 4)] + [(j, n, "") for j in (0, 2) for n in range(5)]
    assert sorted(found) == sorted((j, n, anchors[n], i) for j, n, i in held + empty)


def test_fallback_sections_broadcast_no_more_than_jobs(spark):
    jobs = spark.range(100_000).withColumnRenamed("id", "job_id")
    artifacts = jobs.select("job_id", F.lit("a").alias("id"), F.lit("audit_report").alias("kind"), F.lit(True).alias("included"))
    found = reports.fallback_sections(jobs, artifacts)
    assert found.count() == 500_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.split("Join ")[1:]
    assert joins and not any("anti" in j.split("\n")[0].lower() for j in joins)


def test_report_choices(spark):
    rows_ = [("a", "k1", "s", "r", 5, True), ("b", None, "s", "r", 5, True), ("c", "k1", None, "r", 50, True), ("d", "k1", "s", "r", 50, True), ("e", "k1", "s", "r", 5, None)]
    artifacts = spark.createDataFrame(rows_, "id string, kind string, sensitivity_class string, retention_class string, size int, is_file boolean")
    reason = reports.attachment_reason(include_kinds=["k1"], sensitivity=["s"], retention=["r"], max_bytes=10)
    assert [r[0] for r in artifacts.orderBy("id").select(reason).collect()] == [None, "kind_not_included", "sensitivity_not_included", "too_large", "no_file"]
    assert [r[0] for r in artifacts.orderBy("id").select(reports.attachment_reason()).collect()] == [None, None, None, None, "no_file"]
    plans = spark.createDataFrame([("pass", None, ["b", None], ["b"]), ("pass", "timeout", ["b"], ["b"]), ("pass", None, ["c", "b"], ["b", "c"]), (None, None, None, ["b"])], "status string, failure_class string, planned array<string>, available array<string>")
    found = reports.planner_selection(plans, ["b", "c"]).select("fallback", "selected").collect()
    assert [tuple(r) for r in found] == [("planner_selection_outside_allowlist", ["b"]), ("planner_execution_pass:timeout", ["b"]), (None, ["b", "c"]), ("planner_execution_missing", ["b"])]


def test_archives_are_read_once_and_meet_without_broadcasts(spark):
    pushed = '{"config":{"push":true},"images":%s}'
    archives = [
        (1, pushed % "3", "[]", None, '[{"token":"x"}]'),
        (2, pushed % '[{"service":"a"},1,{"service":"b","versionTag":"r:1"}]', "", None, '{"token":{"token":null},"registryDigests":[null,{"service":"a","digest":"short"}]}'),
        (3, None, None, None, '{"token":0.0,"a":[{"Pass-word":""},"<b>"],"databaseSnapshot":[[{"path":"p"}]],"serviceLogs":[],"artifactStoreExport":"path","rollbackEvidence":[{"path":" "}]}'),
        (4, None, "1", None, '{"x":{"containsSecretValues":true},"secretManager":{"provider":"p","environment":"e","revisionRef":"r","containsSecretValues":false}}'),
        (5, pushed % "[]", None, None, '{"registryDigests":"none","databaseSnapshot":{"url":1},"ciRun":[{"runUrl":"u"}]}'),
    ]
    checks = releases.archive_checks(spark.createDataFrame(archives, "release_id int, gate string, compose string, deployment string, manifest string").coalesce(1))
    found = releases.archive_reports(checks)
    fixed = {"ciRun", "deploymentSmoke.archive_manifest.archiveReady", "releaseGate.executed", "secretManager", "artifactStoreExport", "databaseSnapshot", "rollbackEvidence", "serviceLogs"}
    assert {r.release_id: set(r.missing) for r in found.collect()} == {
        1: fixed | {"registryDigests.images"},
        2: fixed | {"secretValuesAbsent", "registryDigests.a.digest", "registryDigests.b"},
        3: fixed - {"databaseSnapshot"} | {"placeholderValuesReplaced"},
        4: fixed - {"secretManager"} | {"containsSecretValuesFalse"},
        5: fixed | {"registryDigests"},
    }
    # Tables of many releases may look small, so nothing of them is broadcast; the documents are read in two passes, for their members and for their leaves.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert checks.select("release_id").distinct().count() == 5


def test_small_tables_are_dealt_by_rows(spark):
    keys = spark.range(25).coalesce(1)
    assert dealt(keys, "id", 10).rdd.getNumPartitions() == 3 and dealt(keys.where("id < 0"), "id", 10).rdd.getNumPartitions() == 1
    assert sorted(r.id for r in dealt(keys, "id", 10).collect()) == list(range(25))
