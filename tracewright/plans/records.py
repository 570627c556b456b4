"""More operators over the driver's tables, whose columns stand for those of jobs, alerts, reviews, reports and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import audit, dedupe, diff, inventory, lineage, ops, queue, reports, rollups
from tracewright.plans.registry import query
from tracewright.sources import documents

NOW = "1998-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts: errors are critical, every fifth user has no role."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("code"),
        F.when(F.col("event_type") == "error", "critical").otherwise("warning").alias("severity"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("role"), (F.col("user_id") % 3).cast("string"))).alias("service_role"),
        F.concat(F.lit("i"), (F.col("user_id") % 7).cast("string")).alias("instance_id"),
        F.lit("k").alias("field"),
        "value",
        F.col("ts").alias("checked_at"),
        F.lit(1.0).alias("threshold"),
        F.when(F.col("user_id") % 2 == 0, F.struct(F.lit("sent").alias("status"), F.lit(True).alias("attempted"), F.lit(None).cast("string").alias("error"))).alias("delivery"),
    )


EVENTS = """SELECT event_id AS id, ts AS created_at, event_type AS code, CASE event_type WHEN 'error' THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN user_id % 5 <> 0 THEN 'role' || (user_id % 3) END AS service_role, 'i' || (user_id % 7) AS instance_id, 'k' AS field, value, user_id FROM events"""


@query("alert_feed", f"SELECT id, code, severity FROM ({EVENTS}) WHERE severity = 'critical' AND service_role = 'role1' ORDER BY created_at DESC, id DESC LIMIT 500")
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest critical alerts of a role; a limit of 9000 is held at 500."""
    return ops.alert_events(_events(spark, sf_dir), role="role1", severity="critical", limit=9000).select("id", "code", "severity")


@query("alert_totals", f"SELECT severity, code, coalesce(service_role, 'unknown') AS service_role, count(*) AS n FROM ({EVENTS}) GROUP BY ALL")
def alert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.alert_counts(_events(spark, sf_dir))


@query("alert_first", f"SELECT min(id) AS id, code, service_role, instance_id, field FROM ({EVENTS}) GROUP BY code, service_role, instance_id, field")
def alert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alert of each code, role, instance and field; null roles are equal."""
    return ops.dedupe_alerts(_events(spark, sf_dir), "id").select("id", "code", "service_role", "instance_id", "field")


@query(
    "alert_report_rows",
    f"""SELECT id, code, severity, CASE WHEN user_id % 2 = 0 THEN 'sent' END AS delivery_status, code || ' / ' || coalesce(service_role, 'global') AS label,
      CASE severity WHEN 'critical' THEN 'fail' ELSE 'best_effort' END AS status, CASE severity WHEN 'critical' THEN 'resource_limit' ELSE 'unknown' END AS failure_class FROM ({EVENTS})""",
)
def alert_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_rows(_events(spark, sf_dir)).select("id", "code", "severity", "delivery_status", "label", "status", "failure_class")


@query(
    "alert_rules_typed",
    """
    WITH m AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT code, count(*) AS n FROM (
      SELECT 'number' AS code FROM m WHERE k % 3 = 0 AND k >= 50 UNION ALL SELECT 'text' FROM m WHERE event_type = 'click'
      UNION ALL SELECT 'flag' FROM m WHERE event_type = 'view' UNION ALL SELECT 'other' FROM m WHERE event_type <> 'click') GROUP BY code
    """,
)
def alert_rules_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over JSON numbers, quoted numbers, texts, booleans, nulls and missing values; one rule is disabled."""
    k = F.get_json_object("props", "$.k")
    metrics = F.concat(
        F.lit('{"k": '), F.when(k.cast("int") % 3 == 0, k).when(k.cast("int") % 3 == 1, F.concat(F.lit('"'), k, F.lit('"'))).otherwise("null"),
        F.lit(', "type": "'), F.col("event_type"), F.lit('", "is": {"view": '), (F.col("event_type") == "view").cast("string"), F.lit("}}"),
    )
    rules = [("number", "k", "gte", "50", True), ("off", "k", "gte", "0", False), ("text", "type", "eq", '"click"', None), ("flag", "is.view", "eq", "true", True), ("order", "is.view", "gte", "0", True), ("other", "type", "neq", '"click"', True), ("gone", "no.such", "neq", "1", True)]
    rules = spark.createDataFrame([(c, "warning", p, o, t, None, e) for c, p, o, t, e in rules], ops.RULE + ", enabled boolean")
    return ops.alerts(table(spark, sf_dir, "events").select(metrics.alias("metrics")), rules).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("heartbeat_latest", "SELECT service_role, max(instance_id) AS last_wins, min(instance_id) AS first_wins FROM (SELECT event_type AS service_role, user_id AS instance_id FROM events QUALIFY rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC) = 1) GROUP BY 1")
def heartbeat_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest heartbeat of a role by day: of equals the last instance for metrics, the first for runners."""
    beats = table(spark, sf_dir, "events").select(F.col("event_type").alias("service_role"), F.col("user_id").alias("instance_id"), F.col("ts").cast("date").alias("checked_at"))
    last = ops.latest_metrics(beats).select("service_role", F.col("instance_id").alias("last_wins"))
    return last.join(ops.latest_heartbeat(beats, ["service_role"]).select("service_role", F.col("instance_id").alias("first_wins")), "service_role")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: O queued, P leased, F completed; every seventh has no input."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    until = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(status == "O", "queued").when(status == "P", "leased").otherwise("completed").alias("status"),
        F.when(key % 7 != 0, key).alias("input_artifact_id"),
        (key % 4).cast("int").alias("run_attempt"),
        F.col("o_orderdate").alias("created_at"),
        F.lit("none").alias("failure_class"),
        F.when(status == "P", F.struct(F.lit("w").alias("worker_id"), until.alias("expires_at"))).alias("worker_lease"),
        F.when(status == "P", F.concat(F.lit("w"), (key % 2).cast("string"))).alias("lease_owner"),
        F.when(status == "P", until).alias("lease_expires_at"),
    )


@query("job_lease_order", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 <> 0 AND o_orderkey % 4 < 3 ORDER BY o_orderdate, o_orderkey LIMIT 40")
def job_lease_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty jobs that workers would lease first."""
    return queue.leasable(_jobs(spark, sf_dir), 3).limit(40).select("id")


@query(
    "job_requeue",
    f"""SELECT CASE WHEN e AND o_orderkey % 4 >= 3 THEN 'failed' WHEN e THEN 'queued' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'leased' ELSE 'completed' END AS status,
      CASE WHEN e AND o_orderkey % 4 >= 3 THEN 'timeout' ELSE 'none' END AS failure_class, count(*) AS n
      FROM (SELECT *, o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '{NOW}' AS e FROM orders) GROUP BY 1, 2""",
)
def job_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of jobs after their expired leases are taken back."""
    after = queue.requeue_jobs(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 3)
    return after.groupBy("status", "failure_class").agg(F.count(F.lit(1)).alias("n"))


@query("job_renewal", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN TIMESTAMP '{NOW}' ELSE o_orderdate + INTERVAL 30 DAY END AS lease_expires_at FROM orders WHERE o_orderstatus = 'P'")
def job_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases after one of two workers renews its own."""
    after = reports.renewed(_jobs(spark, sf_dir), "w1", F.lit(NOW).cast("timestamp_ntz"), queue.TERMINAL_JOBS)
    return after.where("status = 'leased'").select("id", "lease_expires_at")


@query("job_replay", "WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' ELSE event_type END AS status FROM events WHERE user_id % 3 <> 1 OR event_id % 2 = 0), t AS (SELECT job_id, min(seq) AS e FROM e WHERE status = 'completed' GROUP BY 1) SELECT job_id, seq, status FROM e LEFT JOIN t USING (job_id) WHERE t.e IS NULL OR seq <= t.e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1")
def job_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: a purchase ends one, and of every third only events of the worker that holds it count."""
    e = table(spark, sf_dir, "events")
    worker = (F.col("event_id") % 2).cast("string")
    moves = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("status"), F.when(F.col("user_id") % 3 == 1, "0").alias("expected_worker"), worker.alias("worker"))
    return queue.replay(moves).select("job_id", "seq", "status")


@query("run_outcomes", f"SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 < 3 AND o_orderkey % 5 <> 0 THEN 'queued' WHEN o_orderstatus = 'F' THEN 'best_effort' ELSE 'pass' END AS status, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 4 < 3 AND o_orderkey % 5 <> 0) AS later FROM orders GROUP BY 1")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as failures: tried again unless denied or out of attempts."""
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("status"), F.when(key % 5 == 0, "policy_denied").otherwise("runtime").alias("failure_class"), (key % 4).alias("attempt"), F.lit(3).alias("max_attempts"))
    after = queue.finish(runs, F.lit(NOW).cast("timestamp_ntz"), 60)
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("next_run_at").alias("later"))


@query(
    "repair_approval",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'risk' WHEN o_orderstatus <> 'O' THEN 'not_planned' END AS reason FROM orders
      WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) OR o_orderkey IN (SELECT s_suppkey * 3 FROM supplier)""",
)
def repair_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repairs that reviews approve by artifact (customer) or by instruction (order), and the first reason against each."""
    key = F.col("o_orderkey")
    repairs = table(spark, sf_dir, "orders").select(key.cast("string").alias("instruction_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("artifact_id"), key.alias("id"), F.when(key % 3 == 0, "high").otherwise("low").alias("risk"), F.when(F.col("o_orderstatus") == "O", "planned").otherwise("done").alias("status"))
    named = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("repair_ids"))
    named = named.union(table(spark, sf_dir, "supplier").select(F.array((F.col("s_suppkey") * 3).cast("string"))))
    good = rollups.approved_repairs(repairs, named)
    return good.select("id", rollups.rejection(F.lit(True), F.col("risk"), F.col("status")).alias("reason"))


@query("unknown_repairs", "SELECT l_suppkey AS id, count(DISTINCT l_orderkey) FILTER (o_orderkey IS NULL) AS unknown, CASE WHEN count(*) FILTER (o_orderkey IS NULL) > 0 THEN 'fail' ELSE 'pass' END AS status FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1")
def unknown_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as reviews that name orders; pending ones are not known."""
    reviews = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("l_orderkey").alias("repair_ids"), F.lit("pass").alias("status"))
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return reports.unknown_references(reviews, known).select("id", "unknown", "status")


@query("blocked_nodes", "SELECT l_orderkey AS name, 'f' || s_nationkey AS failure_class FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 3000 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) = 1")
def blocked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes that suppliers of low balance block; the first of them names the failure."""
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_acctbal") < 3000, "fail").otherwise("pass").alias("status"), F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("failure_class"))
    needs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("needs"), F.col("l_linenumber").alias("position"))
    return lineage.blocked(runs, needs)


@query("failure_first", "SELECT o_custkey, coalesce(first(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderpriority <> '5-LOW'), 'none') AS failure_class, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'agent_failed' WHEN bool_or(o_orderstatus = 'P') THEN 'completed_best_effort' ELSE 'completed' END AS status FROM orders GROUP BY 1")
def failure_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure class of a customer's orders that is not none, and the status of them as stages of one run."""
    failure = F.when(F.col("o_orderpriority") == "5-LOW", "none").otherwise(F.col("o_orderpriority"))
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "retry").otherwise("pass")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rollups.first_failure(failure, F.col("o_orderkey")).alias("failure_class"), rollups.runtime_status(status).alias("status"))


@query("package_digests", r"SELECT p_brand, sha256(string_agg(p_name || '#' || p_partkey || chr(0) || sha256(p_type), chr(10) ORDER BY p_name || '#' || p_partkey)) AS digest FROM part GROUP BY 1")
def package_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of each brand over its sorted parts."""
    files = table(spark, sf_dir, "part").select("p_brand", F.concat_ws("#", "p_name", "p_partkey").alias("path"), F.sha2("p_type", 256).alias("hash"))
    return inventory.package_hash(files, "p_brand")


@query(
    "map_bundles",
    """WITH m AS (SELECT p_partkey AS k, 'd/' || p_partkey || '.js.map' AS map_path, 'd/' || (p_partkey + 1) || '.js' AS named, 'd/' || p_partkey || '.js' AS own FROM part WHERE p_partkey % 2 = 0)
      SELECT map_path, CASE WHEN (k + 1) % 3 = 0 THEN named ELSE own END AS path FROM m""",
)
def map_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of parts: the bundle that a map names, if it is there, else its own name."""
    key = F.col("p_partkey")
    maps = table(spark, sf_dir, "part").where(key % 2 == 0).select(F.format_string("d/%d.js.map", key).alias("path"), F.format_string('{"file": "%d.js"}', key + 1).alias("content"))
    files = table(spark, sf_dir, "part").select(F.explode(F.array(key, key + 1)).alias("n")).where("n % 3 = 0").select(F.format_string("d/%d.js", F.col("n")).alias("path"))
    return inventory.bundle_paths(maps, files)


@query("source_candidates", "SELECT map_path, unnest(list_distinct_ordered) AS candidate FROM (SELECT 'm/' || p_partkey || '.map' AS map_path, CASE WHEN p_partkey % 2 = 0 THEN ['m/' || p_size || '.ts', 'b/' || p_size || '.ts', 'src/' || p_size || '.ts', p_size || '.ts'] ELSE ['m/' || p_size || '.ts', 'b/' || p_size || '.ts', p_size || '.ts'] END AS list_distinct_ordered FROM part)")
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where the source of a part's map may be."""
    key = F.col("p_partkey")
    sources = table(spark, sf_dir, "part").select(F.format_string("m/%d.map", key).alias("map_path"), F.format_string("b/%d.js", key).alias("bundle_path"), F.when(key % 2 == 0, "src/").alias("source_root"), F.format_string("%d.ts", F.col("p_size")).alias("source"))
    return reports.source_candidates(sources).select("map_path", "candidate")


@query("completions", "WITH l AS (SELECT o_custkey AS g, o_orderpriority AS k, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS a, o_orderstatus AS s FROM orders), t AS (SELECT * FROM l QUALIFY rank() OVER (PARTITION BY g, k ORDER BY a DESC) = 1) SELECT g AS \"group\", count(*) FILTER (s <> 'F') AS observations, CASE WHEN count(*) FILTER (s <> 'F') > 0 THEN 'completed_best_effort' ELSE 'completed' END AS decision FROM t GROUP BY 1")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as groups of decisions by priority; a missing attempt counts as 0."""
    key = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderpriority").alias("key"), F.when(key % 3 != 0, key % 4).alias("attempt"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("retry").alias("status"), key.alias("id"))
    return rollups.completion(records)


@query("build_convergence", "SELECT o_custkey, CAST(max(o_orderkey % 4) AS INTEGER) AS max_attempt, bool_and(o_orderstatus = 'F') AS all_passed, bool_or(o_orderstatus = 'P') AS needs_attention, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_orderstatus = 'P'), '') AS failed_types FROM orders GROUP BY 1")
def build_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as stages of a build."""
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "P", "retry").otherwise("skipped")
    stages = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 4).alias("attempt"), status.alias("status"), F.col("o_orderpriority").alias("review_type"), F.lit("none").alias("failure_class"))
    return reports.convergence(stages, ["o_custkey"]).select("o_custkey", "max_attempt", "all_passed", "needs_attention", F.array_join("failed_types", ",").alias("failed_types"))


@query("final_outcomes", "SELECT CASE WHEN l_returnflag = 'A' THEN 'budget_exhausted_best_effort' WHEN l_linestatus = 'X' THEN 'no_deterministic_repair' WHEN l_returnflag = 'R' AND (l_linenumber > 3 OR l_quantity > 25) THEN 'repaired_passed' WHEN l_returnflag = 'R' THEN 'passed_without_repair' ELSE 'best_effort_with_limitations' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def final_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as runs of review and repair, by outcome."""
    flag, number, many = F.col("l_returnflag"), F.col("l_linenumber"), (F.col("l_quantity") > 25).cast("int")
    outcome = reports.final_outcome(flag == "A", F.when(F.col("l_linestatus") == "X", "repair_not_applied").otherwise("done"), F.greatest(number - 3, F.lit(0)), F.greatest(number - 3, F.lit(0)), F.when(flag == "R", "pass").otherwise("fail"), many, many, F.lit(True))
    return table(spark, sf_dir, "lineitem").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("comparison_summaries", "SELECT l_suppkey, count(*) AS comparisons, count(DISTINCT l_returnflag || l_linestatus) AS scopes, count(*) FILTER (l_discount > 0.08) AS attention, CASE WHEN count(*) FILTER (l_discount > 0.08) > 0 THEN 'best_effort' ELSE 'pass' END AS status FROM lineitem GROUP BY 1")
def comparison_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a supplier as comparisons whose scope is their flag and status."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", reports.scope_key(F.col("l_returnflag"), F.col("l_linestatus")).alias("scope"), F.when(F.col("l_discount") > 0.08, "retry").otherwise("pass").alias("status"))
    return reports.comparison_summary(lines, ["l_suppkey"])


@query("comparison_latest", "WITH r AS (SELECT user_id, event_type, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS a FROM events) SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type) AS history FROM r QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY a DESC, event_id DESC) = 1")
def comparison_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type as attempts at a comparison: the last of the highest attempt."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("attempt"))
    return reports.latest_by_scope(rows, ["user_id", "event_type"]).select("user_id", "event_type", F.col("seq").alias("event_id"), "history")


@query("retry_summaries", "SELECT o_custkey, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 4 END DESC, o_orderkey) = 1")
def retry_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of most attempts of each customer; of equals the first."""
    key = F.col("o_orderkey")
    return reports.retry_summary(table(spark, sf_dir, "orders").select("o_custkey", key.alias("seq"), F.when(key % 5 != 0, key % 4).alias("attempts_used")), ["o_custkey"]).select("o_custkey", "seq")


@query("summary_or_default", "SELECT c_custkey AS job_id, coalesce(o.p, 'best_effort_with_limitations') AS outcome, o.p IS NOT NULL AS available FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) o ON c_custkey = o_custkey")
def summary_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer as its summary; customers without any have the default."""
    last = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("outcome"))
    return reports.last_or_default(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")), last, "best_effort_with_limitations")


@query("settings_history", "SELECT o_orderkey AS id, o_custkey AS revision FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 500")
def settings_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revisions of a scope; a limit of 9000 is held at 500."""
    return reports.revisions(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("revision")), 9000)


@query("graph_columns", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS graph_column, count(*) AS n FROM orders GROUP BY 1")
def graph_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "source_index").when(p == "2-HIGH", "tool_call").when(p == "3-MEDIUM", "build_log").otherwise("report")
    return table(spark, sf_dir, "orders").groupBy(reports.graph_column(kind).alias("graph_column")).agg(F.count(F.lit(1)).alias("n"))


@query("failure_classes", "SELECT CASE WHEN l_discount = 0 THEN 'timeout' WHEN l_tax > 0.05 AND l_linenumber = 1 THEN 'resource_limit' WHEN l_linenumber <> 1 THEN 'build' ELSE 'none' END AS sandbox, CASE l_returnflag WHEN 'A' THEN 'timeout' WHEN 'R' THEN 'invalid_input' ELSE 'unknown' END AS error, count(*) AS n FROM lineitem GROUP BY 1, 2")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sandboxed runs and as errors, by failure class."""
    sandbox = reports.sandbox_failure(F.col("l_discount") == 0, F.col("l_tax") > 0.05, F.col("l_linenumber") - 1, F.lit("build"))
    name = F.when(F.col("l_returnflag") == "A", "TimeoutError").when(F.col("l_returnflag") == "R", "ValueError").otherwise("OSError")
    error = reports.error_class(name, ["FileNotFoundError", "ValueError"], "unknown")
    return table(spark, sf_dir, "lineitem").groupBy(sandbox.alias("sandbox"), error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("attempt_budgets", "SELECT greatest(1, least(5, CASE WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 4 = 1 THEN p_size ELSE p_size % 7 - 1 END)) AS budget, count(*) AS n FROM part GROUP BY 1")
def attempt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as numbers of attempts in settings: of the job, or else of its project; a text is none."""
    size = F.col("p_size")
    own = F.when(size % 4 == 1, size.cast("string")).when(size % 4 == 0, "many")
    return table(spark, sf_dir, "part").groupBy(reports.attempt_budget(own, (size % 7 - 1).cast("string")).alias("budget")).agg(F.count(F.lit(1)).alias("n"))


@query("project_history", "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderkey % 9 <> 0 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def project_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents of a project: finished orders of a nation's customers."""
    artifacts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate")).alias("deleted_at"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    return documents.project_history(artifacts, jobs, 7, ["F"], limit=12).select("id")


@query("parent_edges", "SELECT n_regionkey AS src, n_nationkey AS dst FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 100, n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND false")
def parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as parents of nations; the parents 3, 4 and 100 are not in the set."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).alias("id"), F.array(F.col("n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, 100)).alias("parent_artifact_ids"))
    regions = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("id"), F.array().cast("array<int>").alias("parent_artifact_ids"))
    return lineage.parent_edges(nations.union(regions)).select("src", (F.col("dst") - 1000).alias("dst"))


@query("graph_edges", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 3 = 0")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as edges, once each, of which both ends are nodes."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"), F.lit("uses").alias("kind"), F.col("l_orderkey").alias("seq"))
    nodes = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey") + 10_000_000))
    return lineage.unique_edges(lineage.resolved_edges(edges, nodes)).select("src", (F.col("dst") - 10_000_000).alias("dst"))


@query("capture_statuses", "SELECT CASE WHEN len(string_split(text, ' ')) > 30 AND role = 'user' THEN 'fail' ELSE 'pass' END AS status, count(*) AS n FROM conversations GROUP BY 1")
def capture_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as captures: words of a user's long turn are page errors, all else has none."""
    errors = F.when((F.col("role") == "user") & (F.size(F.split("text", " ")) > 30), F.split("text", " "))
    return table(spark, sf_dir, "conversations").groupBy(reports.capture_status(errors, F.array()).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("text_excerpts", "SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:79] || '…' ELSE text END AS shown, list_aggregate(string_split(text, ' ')[1:2], 'string_agg', '; ') || '; ' || lang AS excerpt FROM documents")
def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to eighty characters, and the first two words of each with its language."""
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text"), 80).alias("shown"), reports.excerpt(F.split("text", " "), F.array("lang")).alias("excerpt"))


@query("page_sets", "SELECT u.user_id, list_aggregate(list_sort(list_intersect(a, b)), 'string_agg', ',') AS shared, list_aggregate(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), 'string_agg', ',') AS left_only, len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 AS changed FROM (SELECT user_id, list(DISTINCT event_type) FILTER (event_id % 2 = 0) AS a, list(DISTINCT event_type) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1) u WHERE a IS NOT NULL AND b IS NOT NULL")
def page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a user's even and odd events as two collections."""
    even = F.col("event_id") % 2 == 0
    sides = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(even, F.col("event_type"))).alias("a"), F.collect_set(F.when(~even, F.col("event_type"))).alias("b")).where("size(a) > 0 and size(b) > 0")
    found = sides.select("user_id", diff.collection_diff(F.col("a"), F.col("b")).alias("d"))
    join = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return found.select("user_id", join(F.col("d.shared")).alias("shared"), join(F.col("d.left_only")).alias("left_only"), F.col("d.changed").alias("changed"))


@query("last_of_text", "SELECT text_hash, doc_id FROM (SELECT sha256(text) AS text_hash, doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY doc_id DESC) = 1")
def last_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each content hash."""
    return dedupe.keep_last(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id"), ["text_hash"], "doc_id")


@query("audit_filtered", "SELECT event_id AS id FROM events WHERE event_type IN ('error', 'signup')")
def audit_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit records that need attention."""
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "retry").otherwise("pass")
    records = audit.union_records(table(spark, sf_dir, "events").select(F.lit("event").alias("category"), F.col("event_id").cast("string").alias("id"), status.alias("status"), F.lit("none").alias("failure_class")))
    return records.where(audit.matches(status="attention")).select(F.col("id").cast("long").alias("id"))
