"""Snapshots of services, convergence of reviews, and operators of rows, over columns made from keys with nulls and odd values among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import budget, dedupe, diff, inventory, knowledge, lineage, ops, queue, reports, snapshot
from tracewright.plans.registry import query
from tracewright.sources import documents

NOW = "2024-01-25 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(key: Column, *values: str | None) -> Column:
    """One of several values by a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + key % len(values)).cast("int"))


BEATS = f"""SELECT CASE event_type WHEN 'view' THEN 'browser-runner' ELSE event_type END AS service_role, 'i' || user_id AS instance_id, CASE WHEN event_id % 9 = 0 THEN 'degraded' ELSE 'ok' END AS status, ts AS checked_at, ts + INTERVAL 3 DAY AS expires_at,
  CASE WHEN event_id % 5 = 0 THEN 'no json' ELSE props END AS metrics, event_id FROM events WHERE ts <= TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1"""


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each type and user up to a time as a heartbeat, some with an alert of their own."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).where(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz"))
    last = dedupe.keep_one(events, ["event_type", "user_id"], [F.col("event_id").desc()])
    role = F.when(F.col("event_type") == "view", "browser-runner").otherwise(F.col("event_type"))
    instance = F.concat(F.lit("i"), F.col("user_id").cast("string"))
    own = F.struct(F.lit("slow").alias("code"), F.lit("warning").alias("severity"), F.lit("k").alias("field"), F.get_json_object("props", "$.k").alias("value"), F.lit("90").alias("threshold"), role.alias("service_role"), instance.alias("instance_id"), F.col("ts").alias("checked_at"))
    return last.select(
        role.alias("service_role"), instance.alias("instance_id"), F.when(F.col("event_id") % 9 == 0, "degraded").otherwise("ok").alias("status"), F.col("ts").alias("checked_at"), ops.expires_at(F.col("ts"), 3 * 86400).alias("expires_at"),
        F.when(F.col("event_id") % 5 == 0, "no json").otherwise(F.col("props")).alias("metrics"), F.when(F.get_json_object("props", "$.k").cast("int") > 90, F.array(own)).alias("alerts"),
    )


@query(
    "ops_snapshot",
    f"""
    WITH b AS ({BEATS}), r AS (SELECT service_role, count(*) AS n FROM b GROUP BY 1), s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
    l AS (SELECT service_role AS role, json_extract_string(metrics, '$.k') AS k, instance_id, status FROM b WHERE metrics <> 'no json' QUALIFY row_number() OVER (PARTITION BY service_role ORDER BY checked_at DESC, instance_id DESC) = 1
      UNION ALL SELECT 'browserRunner', json_extract_string(metrics, '$.k'), instance_id, status FROM b WHERE metrics <> 'no json' AND service_role = 'browser-runner' QUALIFY row_number() OVER (ORDER BY checked_at DESC, instance_id) = 1)
    SELECT 'total' AS name, CAST(count(*) AS VARCHAR) AS value FROM b UNION ALL SELECT 'active', CAST(count(*) FILTER (expires_at > TIMESTAMP '{NOW}') AS VARCHAR) FROM b
    UNION ALL SELECT 'stale', CAST(count(*) FILTER (expires_at <= TIMESTAMP '{NOW}') AS VARCHAR) FROM b UNION ALL SELECT 'role ' || service_role, CAST(n AS VARCHAR) FROM r UNION ALL SELECT 'job ' || o_orderstatus, CAST(n AS VARCHAR) FROM s
    UNION ALL SELECT 'metrics ' || role, k || ' ' || instance_id || ' ' || status FROM l
    """,
)
def ops_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of users as services, with orders as jobs."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    one = snapshot.metrics_snapshot(_beats(spark, sf_dir), jobs, F.lit(NOW).cast("timestamp_ntz"), "local")
    map_of = lambda path: F.from_json(F.get_json_object("metrics", path), "map<string, bigint>")
    single = F.array(*[F.struct(F.lit(n).alias("name"), F.get_json_object("metrics", f"$.{p}").alias("value")) for n, p in (("total", "totalHeartbeatCount"), ("active", "activeHeartbeatCount"), ("stale", "staleHeartbeatCount"))])
    counted = lambda prefix, found: F.transform(F.map_entries(found), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("name"), e["value"].cast("string").alias("value")))
    roles = F.map_keys(map_of("$.serviceHeartbeatCounts"))
    members = F.from_json("metrics", "map<string, string>")
    latest = F.transform(F.filter(F.array_append(roles, "browserRunner"), lambda r: F.map_contains_key(members, r)), lambda r: F.struct(F.concat(F.lit("metrics "), r).alias("name"), _said(members[r]).alias("value")))
    return one.select(F.explode(F.concat(single, counted("role ", map_of("$.serviceHeartbeatCounts")), counted("job ", map_of("$.jobStatusCounts")), latest)).alias("e")).select("e.*")


def _said(json: Column) -> Column:
    return F.concat_ws(" ", *[F.get_json_object(json, f"$.{n}") for n in ("k", "instanceId", "status")])


@query(
    "snapshot_alerts",
    f"""
    WITH b AS ({BEATS}), stale AS (SELECT count(*) FILTER (expires_at <= TIMESTAMP '{NOW}') AS n FROM b),
    a AS (
      SELECT 'slow' AS code, 'warning' AS severity, 'k' AS field, service_role, instance_id, '"' || json_extract_string(props, '$.k') || '"' AS value, '"90"' AS threshold, false AS ruled FROM b JOIN events USING (event_id) WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 90
      UNION ALL SELECT service_role || '_heartbeat_degraded', 'warning', 'status', service_role, instance_id, '"degraded"', '"ok"', false FROM b WHERE status <> 'ok'
      UNION ALL SELECT 'heartbeat_expired', 'critical', 'expiresAt', service_role, instance_id, '"' || strftime(expires_at, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim(strftime(expires_at, '.%f'), '0'), '.') || '"', '"{NOW}"', false FROM b WHERE expires_at <= TIMESTAMP '{NOW}'
      UNION ALL SELECT 'ops_stale_heartbeats', 'critical', 'staleHeartbeatCount', NULL, NULL, CAST(n AS VARCHAR), '0', true FROM stale WHERE n > 0)
    SELECT code, severity, field, service_role, instance_id, value, threshold, ruled, CAST(n AS VARCHAR) AS stale_kept FROM a, stale
    """,
)
def snapshot_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of users as services: their own, those of their state, and those of the default rules."""
    beats, now = _beats(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    found = snapshot.alert_events(beats, snapshot.metrics_snapshot(beats, jobs, now, "local"), spark.createDataFrame(ops.DEFAULT_RULES, ops.RULE), now)
    return found.select("code", "severity", "field", "service_role", "instance_id", "value", "threshold", F.col("rule_path").isNotNull().alias("ruled"), F.get_json_object("metrics", "$.staleHeartbeatCount").alias("stale_kept"))


RUNS = """a AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderkey % 3 = 0 AS triggered, o_orderkey % 7 <> 0 AS enabled, o_orderkey % 4 = 1 AS planned, o_orderkey % 4 = 2 AS applied, o_orderkey % 5 AS art FROM orders),
    g AS (SELECT k, count(*) AS used, count(*) FILTER (planned) AS planned, count(*) FILTER (applied) AS applied, count(*) FILTER (triggered) AS triggered, max_by(triggered, seq) AS lt, max_by(enabled, seq) AS le FROM a GROUP BY k),
    r AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'retry_budget_exhausted' WHEN 1 THEN 'repair_not_applied' WHEN 2 THEN 'passed' END AS stop_reason FROM customer)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs of review and repair and their orders as attempts; customers without any have none."""
    key = F.col("o_orderkey")
    name = lambda rest: F.when(key % 4 == rest, key.cast("string")).otherwise("")
    attempts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), key.alias("seq"), (key % 3 == 0).alias("gate_triggered"), (key % 7 != 0).alias("gate_enabled"), name(1).alias("planned_id"), name(2).alias("applied_id"),
        F.array(F.concat(F.lit("a"), (key % 5).cast("string")), F.lit(None).cast("string"), F.lit("")).alias("artifact_ids"),
    )
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), _of(F.col("c_custkey"), "retry_budget_exhausted", "repair_not_applied", "passed", None).alias("stop_reason"), F.lit("summary").alias("summary_id"))
    return reports.runtime_convergence(attempts, runs, ["run"])


@query(
    "runtime_convergences",
    f"""WITH {RUNS}, f AS (SELECT k, art, min(seq) AS seq FROM a GROUP BY ALL), e AS (SELECT k, string_agg('a' || art, ',' ORDER BY seq) AS ids FROM f GROUP BY k)
    SELECT k AS run, coalesce(used, 0) AS used, coalesce(planned, 0) AS planned, coalesce(applied, 0) AS applied, coalesce(triggered, 0) AS triggered, CASE WHEN NOT le THEN 'best_effort' WHEN lt THEN 'fail' ELSE 'pass' END AS final_review_status,
      stop_reason = 'retry_budget_exhausted' AS budget_exhausted, coalesce(triggered, 0) > 0 AS failed, 'summary' || coalesce(',' || ids, '') AS evidence
    FROM r LEFT JOIN g USING (k) LEFT JOIN e USING (k)""",
)
def runtime_convergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _runs(spark, sf_dir)
    return found.select("run", "used", "planned", "applied", "triggered", "final_review_status", "budget_exhausted", (F.size("failure_classes") > 0).alias("failed"), F.array_join("evidence_ids", ",").alias("evidence"))


@query(
    "review_next_steps",
    f"""WITH {RUNS}, s AS (
      SELECT r.k, coalesce(triggered, 0) AS triggered, stop_reason, CASE r.k % 3 WHEN 0 THEN 'repaired_passed' ELSE 'best_effort_with_limitations' END AS outcome, r.k % 2 = 0 AS attention,
        CASE r.k % 5 WHEN 0 THEN ['type_error', 'build_error'] WHEN 1 THEN ['dependency_missing', 'type_error', 'build_error'] WHEN 2 THEN ['runtime_error'] WHEN 3 THEN [] END AS classes FROM r LEFT JOIN g ON g.k = r.k),
    t AS (SELECT *, list_filter([CASE WHEN stop_reason = 'retry_budget_exhausted' THEN 'budget_exhausted' END, CASE WHEN stop_reason = 'repair_not_applied' THEN 'repair_not_applied' END, CASE WHEN attention THEN 'build_needs_attention' END], lambda x: x IS NOT NULL)
      || list_filter([CASE WHEN list_contains(classes, 'build_error') THEN 'failure:build_error' END, CASE WHEN list_contains(classes, 'type_error') THEN 'failure:type_error' END, CASE WHEN list_contains(classes, 'dependency_missing') THEN 'failure:dependency_missing' END,
        CASE WHEN triggered > 0 THEN 'failure:runtime_error' END], lambda x: x IS NOT NULL)[1:3] AS open FROM s)
    SELECT k AS run, CASE WHEN outcome = 'repaired_passed' THEN 'keep_summary' WHEN len(open) > 0 THEN array_to_string(open, ',') ELSE 'review_limitations' END AS steps FROM t""",
)
def review_next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after a run, by the classes of its failures."""
    run = F.col("run")
    lists = [["type_error", "build_error"], ["dependency_missing", "type_error", "build_error"], ["runtime_error"], [], None]
    classes = F.element_at(F.array(*[F.lit(None).cast("array<string>") if c is None else F.array(*[F.lit(x) for x in c]).cast("array<string>") for c in lists]), (1 + run % 5).cast("int"))
    found = _runs(spark, sf_dir).withColumns({"build_classes": classes, "needs_attention": run % 2 == 0, "outcome": F.when(run % 3 == 0, "repaired_passed").otherwise("best_effort_with_limitations")})
    steps = reports.next_steps(found, reports.failure_actions(found, ["run"]), ["run"])
    return steps.select("run", F.array_join("steps", ",").alias("steps"))


@query(
    "source_kinds",
    """
    WITH s AS (SELECT page_id, html || ['', ' module.exports = 1', ' exports.a', ' __webpack_require__ factory', ' amodule.exports', ' newRequire exports.$x'][1 + page_id % 6] AS t, page_id % 4 = 0 AS linked, page_id % 3 = 0 AS single FROM pages),
    m(o, kind, marker) AS (VALUES (1, 'webpack', '__webpack_require__'), (1, 'webpack', 'webpackJsonp'), (1, 'webpack', 'webpackChunk'), (2, 'vite_or_rollup', '__vitePreload'), (2, 'vite_or_rollup', 'import.meta'), (2, 'vite_or_rollup', 'modulepreload'),
      (3, 'rollup', 'Object.freeze'), (3, 'rollup', '__esModule'), (4, 'esbuild', '__defProp'), (4, 'esbuild', '__export'), (4, 'esbuild', '__toESM'), (4, 'esbuild', '__commonJS'), (5, 'umd', 'typeof exports'), (5, 'umd', 'define.amd'), (5, 'umd', 'factory'),
      (6, 'browserify', 'function r(e,n,t)'), (6, 'browserify', 'function o(i,f)'), (6, 'browserify', 'browserify'), (7, 'systemjs', 'System.register'), (7, 'systemjs', 'System.import'), (8, 'parcel', 'parcelRequire'), (8, 'parcel', 'newRequire')),
    k AS (SELECT DISTINCT page_id, o, kind FROM s, m WHERE contains(t, marker) UNION SELECT page_id, 2, 'vite_or_rollup' FROM s WHERE linked UNION SELECT page_id, 9, 'commonjs' FROM s WHERE regexp_matches(t, '\\bmodule\\.exports\\b|\\bexports\\.[A-Za-z_$]')),
    p AS (SELECT page_id, string_agg(kind, ',' ORDER BY kind) AS kinds, min_by(kind, o) AS preferred FROM k GROUP BY 1)
    SELECT page_id, coalesce(kinds, CASE WHEN single THEN 'iife' ELSE 'unknown' END) AS kinds, coalesce(preferred, CASE WHEN single THEN 'iife' ELSE 'unknown' END) AS preferred, CAST(strpos(t, 'exports') - 1 AS INTEGER) AS at FROM s LEFT JOIN p USING (page_id)
    """,
)
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as scripts, some of them with more markers, links to modules or alone in their bundle."""
    page = F.col("page_id")
    source = F.concat("html", _of(page, "", " module.exports = 1", " exports.a", " __webpack_require__ factory", " amodule.exports", " newRequire exports.$x"))
    scripts = table(spark, sf_dir, "pages").select("page_id", source.alias("t"), F.when(page % 4 == 0, 2).alias("links"), (page % 3 == 0).alias("single"))
    kinds = knowledge.source_kinds(F.col("t"), F.col("links"), F.col("single"))
    found = scripts.select("page_id", kinds.alias("k"), knowledge.marker_offset(F.col("t"), F.lit("exports")).alias("at"))
    return found.select("page_id", F.array_join(F.array_sort("k"), ",").alias("kinds"), knowledge.preferred_kind(F.col("k")).alias("preferred"), "at")


@query(
    "build_report_rows",
    """
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'phase' WHEN 2 THEN 'stage' END AS review_type, CAST(greatest(o_orderkey % 5 - 1, 0) AS INTEGER) AS attempt, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 'fail' END, 'unknown') AS status,
      CAST(o_orderkey % 12 AS INTEGER) AS diagnostic_count, least(o_orderkey % 12, 8) - CASE WHEN o_orderkey % 12 >= 2 THEN 1 ELSE 0 END AS shown, CASE WHEN o_orderkey % 12 > 0 THEN 180 END AS longest,
      array_to_string(list_filter(['b' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'log' END, 'fix', CASE WHEN o_orderkey % 2 = 1 THEN 'log' END], lambda x: x IS NOT NULL), ',') AS links
    FROM orders
    """,
)
def build_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as validated builds with up to eleven diagnostics, one of them null, whose messages are long."""
    key = F.col("o_orderkey")
    fields = ["source", "tool", "category", "code", "file_path"]
    one = F.struct(*[F.lit("x").alias(f) for f in fields], F.repeat(F.lit("m"), 200).alias("message"), F.lit(1).alias("line"), F.lit(2).alias("column"))
    diagnostics = F.transform(F.filter(F.sequence(F.lit(0), F.lit(10)), lambda i: i < key % 12), lambda i: F.when(i != 1, one))
    repairs = F.when(key % 2 == 1, F.array(F.lit("fix"), F.lit("log"), F.lit("fix"))).otherwise(F.array(F.lit("fix"), F.lit(None)))
    builds = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("b"), key.cast("string")).alias("id"), F.when(key % 4 == 0, "build").alias("review_type"), F.when(key % 4 == 1, "phase").alias("phase"), F.when(key % 4 == 2, "stage").alias("stage"), (key % 5 - 1).alias("attempt"),
        F.when(key % 3 > 0, "fail").alias("status"), F.lit(None).cast("string").alias("failure_class"), diagnostics.alias("diagnostics"), F.when(key % 2 == 0, "log").alias("logs_id"), repairs.alias("repair_ids"),
    )
    found = reports.build_rows(builds)
    longest = F.array_max(F.transform("diagnostics", lambda d: F.length(d["message"])))
    return found.select(F.substring("id", 2, 20).cast("long").alias("id"), "review_type", "attempt", "status", "diagnostic_count", F.size("diagnostics").cast("long").alias("shown"), longest.alias("longest"), F.array_join("links", ",").alias("links"))


@query(
    "placeholders",
    """
    SELECT p_partkey AS plan_id, CASE WHEN p_partkey % 2 = 0 THEN 'resolved' ELSE 'unsupported' END AS status, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, 'unknown') AS importer, 'unknown' AS specifier,
      CASE p_partkey % 5 WHEN 0 THEN 'default, a, namespace' WHEN 1 THEN 'load only' WHEN 2 THEN 'default, b' WHEN 3 THEN 'a, export-all' ELSE 'default' END AS exports
    FROM part
    """,
)
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plans with a placeholder for a dependency each."""
    key = F.col("p_partkey")
    names = F.when(key % 5 == 0, F.array(F.lit("a"))).when(key % 5 == 2, F.array(F.lit("default"), F.lit("b"), F.lit("default"))).when(key % 5 == 3, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    one = F.struct(
        F.when(key % 2 == 0, "resolved").alias("status"), F.when(key % 3 > 0, F.col("p_name")).alias("importer"), F.lit(None).cast("string").alias("specifier"), names.alias("names"),
        (key % 5).isin(0, 2, 4).alias("default_import"), (key % 5 == 0).alias("namespace_import"), (key % 5 == 3).alias("export_all"),
    )
    return reports.placeholder_rows(table(spark, sf_dir, "part").select(key.alias("plan_id"), F.array(one).alias("placeholders")))


@query(
    "decision_keys",
    """SELECT CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE CASE o_orderkey % 4 WHEN 0 THEN 'runtime_smoke' WHEN 1 THEN 'runtime_smoke' ELSE 'runtime_compare' END || ':' || CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' ELSE o_orderstatus END END AS key, count(*) AS n FROM orders GROUP BY 1""",
)
def decision_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews and as records of runs, by the key of their decision."""
    key = F.col("o_orderkey")
    found = reports.decision_key(F.when(key % 3 == 0, F.col("o_orderpriority")), _of(key, "", None, "c", "d"), F.when(key % 5 == 0, "").when(key % 5 > 1, F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").groupBy(found.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("matching_comparisons", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount > 0.05")
def matching_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as comparisons of a scenario and viewport that differ."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("viewport"), F.when(F.col("l_discount") > 0.05, "fail").otherwise("pass").alias("status"), F.when(F.col("l_discount") > 0.05, F.lit("{}")).alias("differences"))
    return reports.comparisons_matching(reports.comparison_records(lines), scenario="R", viewport="F", status="all").select("l_orderkey", "l_linenumber")


@query(
    "line_groups",
    """
    WITH l AS (SELECT DISTINCT user_id, ['404 GET /x', '200 GET /x', 'network_policy_denied /x', 'GET /x request failed', 'GET /x', ' 500', '5000 odd'][1 + event_id % 7] || ' ' || event_type AS line FROM events)
    SELECT user_id, CASE WHEN regexp_matches(split_part(line, ' ', 1), '^\\d+$') THEN 'status_' || CAST(split_part(line, ' ', 1) AS INTEGER) // 100 || 'xx' WHEN line LIKE 'network_policy_denied%' THEN 'policy_denied' WHEN line LIKE '%request failed%' THEN 'request_failed' ELSE 'network_other' END AS "group",
      string_agg(line, '|' ORDER BY line) AS lines FROM l GROUP BY ALL
    """,
)
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as lines of a capture's network log."""
    line = F.concat_ws(" ", _of(F.col("event_id"), "404 GET /x", "200 GET /x", "network_policy_denied /x", "GET /x request failed", "GET /x", " 500", "5000 odd"), "event_type")
    lines = table(spark, sf_dir, "events").select("user_id", line.alias("line"))
    return diff.grouped_lines(lines, "user_id", "line", diff.network_group(F.col("line"))).select("user_id", "group", F.array_join("lines", "|").alias("lines"))


@query(
    "throughputs",
    "SELECT o_custkey, CASE WHEN sum(o_orderkey % 3) = 0 THEN CAST(count(*) AS DOUBLE) ELSE round_even(count(*) / (sum(o_orderkey % 3) * 500 / 1000), 3) END AS throughput FROM orders GROUP BY 1",
)
def throughputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as runs of a soak; some last no time."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("runs"), (F.sum(F.col("o_orderkey") % 3) * 500).alias("ms"))
    return sums.select("o_custkey", queue.throughput(F.col("runs"), F.col("ms")).alias("throughput"))


@query(
    "job_artifacts",
    """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS id FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount <= 0.08
    UNION ALL SELECT 'report ' || o_orderkey FROM orders WHERE o_custkey = 7""",
)
def job_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as a job's artifacts of a kind and stage that are not deleted, and a customer's orders as its reports, by time."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    artifacts = table(spark, sf_dir, "lineitem").select(line.alias("id"), F.col("l_suppkey").cast("string").alias("job_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("stage"), F.when(F.col("l_discount") > 0.08, "x").alias("deleted_at"), F.col("l_shipdate").alias("created_at"))
    own = documents.artifacts_of(artifacts, "7", kind="R", stage="F").select("id", F.col("created_at").cast("timestamp").alias("created_at"))
    others = table(spark, sf_dir, "orders").where("o_custkey = 7").select(F.concat(F.lit("report "), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return reports.merged_reports(own, others).select("id")


@query(
    "column_rows",
    """SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) - 1 AS INTEGER) AS row_index FROM part""",
)
def column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts laid out in columns by size."""
    return dedupe.row_index(table(spark, sf_dir, "part"), ["p_size"], [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]).select("p_partkey", "row_index")


@query("first_nodes", "SELECT p_brand AS id, min(p_partkey) AS seq FROM part GROUP BY 1")
def first_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as nodes of a graph that several parts add; the first stays."""
    return lineage.unique_nodes(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("seq"))).select("id", "seq")


@query(
    "matrix_samples",
    """
    WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN [] ELSE ['phone', 'wide', 'tall'] END AS v FROM customer),
    r AS (SELECT c_custkey, unnest(CASE WHEN v IS NULL OR len(v) = 0 THEN ['desktop', 'mobile'] ELSE v END) AS viewport, unnest(range(CASE WHEN v IS NULL OR len(v) = 0 THEN 2 ELSE 3 END)) AS place FROM s),
    m AS (SELECT CAST(row_number() OVER (ORDER BY c_custkey, place) - 1 AS INTEGER) AS index, c_custkey, viewport FROM r), n AS (SELECT count(*) AS n FROM m),
    k AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 23.0, 0) AS INTEGER) AS index FROM n, range(24) t(i))
    SELECT 's' || c_custkey AS scenario, viewport, index FROM m SEMI JOIN k USING (index)
    """,
)
def matrix_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scenarios with viewports of their own or the default ones, of which 24 runs are sampled evenly."""
    key = F.col("c_custkey")
    viewports = F.when(key % 3 == 1, F.array().cast("array<string>")).when(key % 3 == 2, F.array(F.lit("phone"), F.lit("wide"), F.lit("tall")))
    scenarios = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), key.cast("string")).alias("scenario"), key.alias("seq"), viewports.alias("viewports"))
    return budget.balanced(budget.viewport_matrix(scenarios, ["desktop", "mobile"]), 24)


@query(
    "short_symbols",
    """WITH s AS (SELECT doc_id AS k, unnest(string_split(text, ' ')) AS name FROM documents)
    SELECT k, round(avg(CASE WHEN length(name) BETWEEN 1 AND 2 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN length(name) BETWEEN 1 AND 2 THEN 1.0 ELSE 0.0 END) >= 0.5 AS obfuscated FROM s GROUP BY k""",
)
def short_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as names of symbols."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.explode(F.split("text", " ")).alias("name"))
    return inventory.short_symbol_share(words, "k").select("k", F.round("share", 6).alias("share"), "obfuscated")


@query(
    "knowledge_parts",
    """
    WITH h AS (SELECT p_partkey AS job, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'build' WHEN lower(p_type) LIKE '%steel%' THEN 'runtime' ELSE 'review' END AS stage, p_size FROM part),
    a AS (SELECT job, stage AS id, p_size / 100 AS confidence FROM h WHERE p_size > 25)
    SELECT p.job, coalesce(a.id, 'minimal') AS id, coalesce(a.confidence, 0.1) AS confidence FROM h p LEFT JOIN a USING (job)
    """,
)
def knowledge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as jobs with a hit by their type, or the fallback."""
    stage = knowledge.by_part(F.col("p_type"), [("brass", "build"), ("steel", "runtime")], "review")
    parts = table(spark, sf_dir, "part")
    hits = parts.where("p_size > 25").select(F.col("p_partkey").alias("job"), stage.alias("id"), (F.col("p_size") / 100).alias("confidence"), F.lit(0).alias("seq"))
    fallback = parts.select(F.col("p_partkey").alias("job"), F.lit("minimal").alias("id"), F.lit(0.1).alias("confidence"), F.lit(0).alias("seq"))
    return knowledge.merged_hits(hits, fallback, ["job"]).select("job", "id", "confidence")


@query(
    "text_pieces",
    r"""
    SELECT page_id, left(coalesce(nullif(trim([' ', NULL, '', 'first'][1 + page_id % 4]), ''), nullif(trim(html), ''), url), 300) AS first_text, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
      CASE WHEN page_id % 2 = 0 THEN 'sha256:' || sha256(url) END AS digest, ['some_name', 'h_t_m_l_page', '_up', ''][1 + page_id % 4] AS snake, least(page_id % 8, 5) AS shown, greatest(page_id % 8 - 5, 0) AS more, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id * 1500 END AS ms
    FROM pages
    """,
)
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, digests, origins, names, previews and durations of pages."""
    page = F.col("page_id")
    digest = F.when(page % 2 == 0, F.concat(F.lit("image@sha256:"), F.sha2(F.encode("url", "utf-8"), 256), F.lit(" sha256:short"))).otherwise(F.concat(F.lit("sha256:"), F.repeat(F.lit("a"), 65)))
    listed = budget.preview(F.transform(F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: i <= page % 8), lambda i: i.cast("string")))
    begun = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ended = F.when(page % 3 > 0, F.timestamp_millis(F.unix_millis(begun) + page * 1500))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.first_text(_of(page, " ", None, "", "first"), F.col("html"), F.col("url"), F.lit(None).cast("string")).alias("first_text"),
        text.origin(F.col("url")).alias("origin"),
        reports.digest_of(digest).alias("digest"),
        reports.snake_case(_of(page, "someName", "hTMLPage", "_up", "")).alias("snake"),
        F.size(listed["shown"]).cast("long").alias("shown"),
        listed["more"].cast("long").alias("more"),
        text.millis_between(begun, ended).alias("ms"),
    )
