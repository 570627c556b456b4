"""What agents leave behind, over columns made from keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import agents, releases, reports
from tracewright.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 10_000) -> DataFrame:
    """A table of few bytes whose rows give much work, with a part for every ``rows`` of them: Spark cuts files by their bytes, and one task would do it all."""
    return df.repartition(max(1, math.ceil(df.count() / rows)), key)


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as executions of agents, by priority as their stage, each with up to two drafts."""
    key = F.col("o_orderkey")
    drafts = F.when(key % 3 == 0, F.array().cast("array<string>")).when(key % 3 == 1, F.array(F.concat(F.lit("d"), key.cast("string")))).otherwise(F.array(F.lit("same"), F.lit("same")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("stage"), F.substring("o_orderpriority", 1, 1).cast("int").alias("stage_order"), key.alias("seq"), F.concat(F.lit("agent"), (key % 7).cast("string")).alias("agent"),
        F.when(key % 5 == 0, F.array(F.lit("agent0"), F.lit("agent1"))).alias("dependencies"), drafts.alias("drafts"),
    )


@query(
    "agent_drafts",
    """
    WITH e AS (SELECT o_custkey AS job_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS st, o_orderkey AS seq, 'agent' || (o_orderkey % 7) AS agent, CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['d' || o_orderkey] ELSE ['same', 'same'] END AS ds FROM orders),
    x AS (SELECT job_id, st, seq, agent, unnest(ds) AS draft, unnest(range(len(ds))) AS place FROM e),
    d AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY st, seq, place) AS position, agent, draft FROM x),
    f AS (SELECT c_custkey AS job_id, 1 AS position, 'feedback' AS agent, c_mktsegment AS draft FROM customer WHERE c_nationkey > 12),
    l AS (SELECT job_id, max(position) AS n FROM d GROUP BY 1)
    SELECT job_id, CAST(position AS INTEGER) AS position, agent, draft FROM d UNION ALL SELECT f.job_id, CAST(f.position + coalesce(l.n, 0) AS INTEGER), agent, draft FROM f LEFT JOIN l USING (job_id)
    """,
)
def agent_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drafts of all agents of a job, and of a refinement after them."""
    feedback = table(spark, sf_dir, "customer").where("c_nationkey > 12").select(F.col("c_custkey").alias("job_id"), F.lit(1).alias("position"), F.lit("feedback").alias("agent"), F.col("c_mktsegment").alias("draft"))
    return agents.with_feedback(agents.flat_drafts(_executions(spark, sf_dir), "drafts"), feedback)


@query("agent_decisions", "SELECT c_custkey AS job_id, c_name || CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN ' ' || c_mktsegment ELSE '' END AS decision FROM customer")
def agent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of customers whose decision a refinement adds to; some refinements add nothing."""
    key, customers = F.col("c_custkey"), table(spark, sf_dir, "customer")
    fragments = customers.where(key % 2 == 0).select(key.alias("job_id"), F.when(key % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("fragment"))
    return agents.decided(customers.select(key.alias("job_id"), F.col("c_name").alias("decision")), fragments)


@query(
    "stage_plans",
    """
    WITH e AS (SELECT o_custkey AS job_id, o_orderpriority AS stage, CAST(left(o_orderpriority, 1) AS INTEGER) AS st, o_orderkey AS seq, 'agent' || (o_orderkey % 7) AS agent FROM orders)
    SELECT job_id, stage, st AS stage_order, st = 2 AND job_id % 2 = 0 AS parallel, CASE WHEN st = 2 AND job_id % 2 = 0 THEN 3 ELSE 1 END AS worker_count, string_agg(agent, ',' ORDER BY seq) AS agents FROM e GROUP BY ALL
    """,
)
def stage_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a job with their agents; those of high priority run in parallel for every other customer."""
    workers = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("job_id"), F.lit("2-HIGH").alias("stage"), F.lit(3).alias("worker_count"))
    return agents.stage_plan(_executions(spark, sf_dir), workers).withColumn("agents", F.array_join("agents", ","))


@query(
    "agent_edges",
    "SELECT o_custkey AS job_id, src, 'agent' || (o_orderkey % 7) AS dst FROM orders, (VALUES ('agent0'), ('agent1')) d(src) WHERE o_orderkey % 5 = 0",
)
def agent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.agent_edges(_executions(spark, sf_dir))


@query("executions_by_stage", "SELECT coalesce(nullif(trim(CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 9 > 0 THEN o_orderpriority END), ''), 'unknown') AS stage, count(*) AS n FROM orders GROUP BY 1")
def executions_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions by stage; some have none."""
    key = F.col("seq")
    return agents.executions_by_stage(_executions(spark, sf_dir).withColumn("stage", F.when(key % 4 == 0, " ").when(key % 9 > 0, F.col("stage"))))


@query(
    "repair_actions",
    """
    WITH p AS (SELECT c_custkey AS job_id, ['{}', '{"build":"x"}', '{"build":"node scripts/build.mjs","check":"y"}', '{"typecheck":"tsc","build":7}', NULL, 'no json'][1 + c_custkey % 6] AS scripts, c_custkey % 4 <> 3 AS b_shim, c_custkey % 5 <> 4 AS t_shim,
      CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ['add_package_script'] ELSE ['replace_package_script'] END AS allowed FROM customer),
    f AS (SELECT DISTINCT o_custkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'build' ELSE 'typecheck' END AS review FROM orders WHERE o_orderstatus <> 'O'),
    j AS (SELECT *, CASE WHEN json_valid(scripts) THEN scripts ELSE '{}' END AS s FROM p WHERE scripts IS NOT NULL),
    r AS (
      SELECT job_id, 'build' AS review, 0 AS position, 'add_package_script' AS action, 'build' AS script FROM j WHERE b_shim AND (allowed IS NULL OR list_contains(allowed, 'add_package_script')) AND json_extract(s, '$.build') IS NULL
      UNION ALL SELECT job_id, 'typecheck', 1, 'add_package_script', 'typecheck' FROM j WHERE t_shim AND (allowed IS NULL OR list_contains(allowed, 'add_package_script')) AND json_extract(s, '$.typecheck') IS NULL AND json_extract(s, '$.check') IS NULL
      UNION ALL SELECT job_id, 'build', 2, 'replace_package_script', 'build' FROM j WHERE b_shim AND (allowed IS NULL OR list_contains(allowed, 'replace_package_script')) AND json_type(s, '$.build') = 'VARCHAR' AND json_extract_string(s, '$.build') <> 'node scripts/build.mjs'
      UNION ALL SELECT job_id, 'typecheck', 3, 'replace_package_script', 'typecheck' FROM j WHERE t_shim AND (allowed IS NULL OR list_contains(allowed, 'replace_package_script')) AND json_type(s, '$.typecheck') = 'VARCHAR' AND json_extract_string(s, '$.typecheck') <> 'node scripts/typecheck.mjs')
    SELECT job_id, position, action, 'package.json:scripts.' || script AS path, 'node scripts/' || script || '.mjs' AS value FROM r SEMI JOIN f USING (job_id, review)
    """,
)
def repair_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs with package files of every kind, whose orders are failed stages."""
    key = F.col("c_custkey")
    scripts = F.element_at(F.array(*[F.lit(s) for s in ("{}", '{"build":"x"}', '{"build":"node scripts/build.mjs","check":"y"}', '{"typecheck":"tsc","build":7}', None, "no json")]), (1 + key % 6).cast("int"))
    shims = F.array_compact(F.array(F.when(key % 4 != 3, "scripts/build.mjs"), F.when(key % 5 != 4, "scripts/typecheck.mjs")))
    allowed = F.when(key % 3 == 1, F.array(F.lit("add_package_script"))).when(key % 3 == 2, F.array(F.lit("replace_package_script")))
    projects = table(spark, sf_dir, "customer").select(key.alias("job_id"), scripts.alias("scripts"), shims.alias("shims"), allowed.alias("allowed"))
    failed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, "build").otherwise("typecheck").alias("review_type"))
    return agents.repair_actions(failed, projects)


@query(
    "execution_boundaries",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'runtime' ELSE event_type END AS stage, 'local' AS runner_kind, NULL AS remote_run_id FROM events WHERE event_id % 6 = 0
    UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'runtime' ELSE event_type END, NULL, 'r' || user_id FROM events WHERE event_id % 6 = 1
    UNION ALL SELECT event_id, s.stage, CASE s.stage WHEN 'a' THEN 'local' END, CASE s.stage WHEN 'b' THEN '7' END FROM events, (VALUES ('a'), ('b')) s(stage) WHERE event_id % 6 = 2
    """,
)
def execution_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces with the boundary of a run, of runs by stage, of none, or something else."""
    key = F.col("event_id")
    json = F.when(key % 6 == 0, '{"runnerKind":"local"}').when(key % 6 == 1, F.concat(F.lit('{"remoteRunId":"r'), F.col("user_id").cast("string"), F.lit('"}'))).when(key % 6 == 2, '{"a":{"runnerKind":"local"},"b":{"remoteRunId":7},"c":{},"d":1}').when(key % 6 == 3, "[1]").when(key % 6 == 4, '{"x":{"y":{"runnerKind":1}}}')
    traces = table(spark, sf_dir, "events").select("event_id", json.alias("json"), F.when(key % 3 == 0, "").otherwise(F.col("event_type")).alias("target"))
    return agents.execution_boundaries(traces, "event_id", "json", "target")


@query(
    "redacted_summaries",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'redacted:path:' || substr(sha256(url), 1, 12) END AS entries, 'redacted:symbol:' || substr(sha256('s' || page_id), 1, 12) || ',redacted:symbol:' || substr(sha256('t'), 1, 12) AS symbols, url AS kept FROM pages""",
)
def redacted_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of pages for a model: paths and symbols give way to placeholders."""
    page = F.col("page_id")
    summaries = table(spark, sf_dir, "pages").select("page_id", F.when(page % 3 > 0, F.array("url", F.lit(None))).alias("entries"), F.array(F.concat(F.lit("s"), page.cast("string")), F.lit("t")).alias("symbolSample"), F.col("url").alias("kept"))
    return agents.redacted_summary(summaries, "page_id").select("page_id", F.array_join("entries", ",").alias("entries"), F.array_join("symbolSample", ",").alias("symbols"), "kept")


@query(
    "action_summaries",
    """SELECT c_custkey AS run, CASE c_custkey % 3 WHEN 0 THEN 'type_error->add_package_script, replace_package_script' WHEN 1 THEN 'dependency_missing->audit_only; runtime_error->mirror_original_static_entry'
      ELSE 'build_error->add_package_script, replace_package_script; type_error->add_package_script, replace_package_script; dependency_missing->audit_only; runtime_error->mirror_original_static_entry' END AS summary FROM customer""",
)
def action_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs with one, two or no active classes of failure."""
    key = F.col("c_custkey")
    classes = F.when(key % 3 == 0, F.array(F.lit("type_error"))).when(key % 3 == 1, F.array(F.lit("dependency_missing")))
    runs = table(spark, sf_dir, "customer").select(key.alias("run"), classes.alias("build_classes"), F.when(key % 3 == 1, 2).alias("triggered"))
    return agents.action_summary(reports.failure_actions(runs, ["run"]), ["run"])


@query(
    "artifact_policies",
    """SELECT o_custkey AS job_id, 'sensitivity_class' AS field, CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'derived' ELSE 'unknown' END AS value, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT o_custkey, 'retention_class', o_orderpriority, count(*) FROM orders GROUP BY ALL""",
)
def artifact_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts by their classes of sensitivity and retention."""
    kind = F.when(F.col("o_orderstatus") == "F", "public").when(F.col("o_orderstatus") == "O", "derived")
    artifacts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), kind.alias("sensitivity_class"), F.col("o_orderpriority").alias("retention_class"))
    return agents.policy_counts(artifacts, ["sensitivity_class", "retention_class"])


GATE = '{"kind":"release_gate_report","status":"pass","mode":"execute","config":{"execute":true,"push":%s},"images":[{"service":"api","versionTag":"r/api:1"},{"service":"web","repository":"r/web"}]}'
GOOD = '{"kind":"production_release_evidence_manifest","ciRun":{"runUrl":"u","runId":"1","commit":"c","environment":"e"},"secretManager":{"provider":"p","environment":"e","revision":"3"},"databaseSnapshot":{"snapshotId":"s"},"artifactStoreExport":[{"path":"p"},{"uri":"u"}],"serviceLogs":{"url":"u"},"rollbackEvidence":{"reference":"r"},"registryDigests":[{"service":"api","digest":"sha256:%s"},{"reference":"r/web@sha256:%s"}]}' % ("a" * 64, "b" * 64)
SMOKES = ('{"kind":"compose_smoke_report","status":"pass","deploymentSmoke":{"archive_manifest":{"archiveReady":true}}}', '{"kind":"deployment_smoke_report","status":"pass","archive_manifest":{"archiveReady":1}}')
#: Gate, smokes and manifest of an archive, and its failed checks and missing evidence.
ARCHIVES = [
    (GATE % "true", *SMOKES, GOOD, "", ""),
    (GATE % "false", *SMOKES, GOOD.replace('"registryDigests":[', '"registryDigests":{},"was":['), "", ""),
    (GATE % "true", *SMOKES, GOOD.replace('"service":"api"', '"service":"other"').replace("b" * 64, "short"), "registry_digest_evidence", "registryDigests.api,registryDigests.web.digest"),
    (GATE % "1", *SMOKES, GOOD.replace('"runUrl":"u"', '"runUrl":" "').replace('"revision":"3"', '"containsSecretValues":true,"revision":"3"'), "ci_run_evidence,secret_values_absent,secret_manager_evidence", "ciRun,containsSecretValuesFalse,secretManager"),
    (GATE % "false", *SMOKES, GOOD.replace('"commit":"c"', '"commit":"<commit>"').replace('"serviceLogs":{"url":"u"}', '"serviceLogs":[{"url":"u"},{}],"more":[{"Access-Token":"x"},{"password":""}]'), "placeholder_values_replaced,secret_values_absent,service_logs_evidence", "placeholderValuesReplaced,secretValuesAbsent,serviceLogs"),
    (
        None, "no json", "[]", None,
        "release_gate_report_present,release_gate_passed,release_gate_executed,compose_smoke_passed,deployment_smoke_passed,deployment_archive_ready,evidence_manifest_kind,ci_run_evidence,secret_manager_evidence,database_snapshot_evidence,artifact_store_export_evidence,service_logs_evidence,rollback_evidence_evidence",
        "artifactStoreExport,ciRun,databaseSnapshot,deploymentSmoke.archive_manifest.archiveReady,releaseGate.executed,rollbackEvidence,secretManager,serviceLogs",
    ),
]


@query(
    "archive_reports",
    f"""SELECT p_partkey AS release_id, CASE WHEN failed = '' THEN 'pass' ELSE 'fail' END AS status, failed, missing FROM part JOIN (VALUES {", ".join(f"({i}, '{a[4]}', '{a[5]}')" for i, a in enumerate(ARCHIVES))}) a(i, failed, missing) ON p_partkey % {len(ARCHIVES)} = i""",
)
def archive_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as archives of releases that are whole, or lack evidence of every kind."""
    key = F.col("p_partkey")
    of = lambda n: F.element_at(F.array(*[F.lit(a[n]) for a in ARCHIVES]), (1 + key % len(ARCHIVES)).cast("int"))
    archives = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(key.alias("release_id"), of(0).alias("gate"), of(1).alias("compose"), of(2).alias("deployment"), of(3).alias("manifest"))
    found = releases.archive_reports(releases.archive_checks(archives))
    return found.select("release_id", "status", F.array_join("failed", ",").alias("failed"), F.array_join("missing", ",").alias("missing"))
