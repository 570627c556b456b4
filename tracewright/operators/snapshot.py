"""The state of the services at a time: counts, metrics of roles, and the alerts that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import ops
from tracewright.operators.audit import status_counts
from tracewright.operators.dedupe import keep_one

# Metrics that an alert keeps, those of the browser runner on their own.
KEPT = ["jobStatusCounts", "activeHeartbeatCount", "staleHeartbeatCount", "serviceHeartbeatCounts", "deploymentProfile"]
KEPT_OF_RUNNER = ["queueBackend", "backendStatus", "queuedCount", "runningCount", "retryRate", "leaseRecoveryCount", "expiredRunningCount"]
RUNNER = "browser-runner"
ALERT = ["code", "severity", "field", "value", "threshold", "service_role", "instance_id", "checked_at"]


def heartbeat_alerts(heartbeats: DataFrame, now: Column) -> DataFrame:
    """The alerts that heartbeats carry (``alerts``, an array of structs of ``ALERT``), one for each that is not ok, and one for each that has expired.

    ``heartbeats`` has service_role, instance_id, status, checked_at, expires_at, alerts; one without an expiry has expired.
    """
    text = lambda c: c.cast("string")
    own = ["service_role", "instance_id", "checked_at"]
    carried = heartbeats.select(F.explode("alerts").alias("a")).select(*[F.col(f"a.{c}").alias(c) for c in ALERT])
    degraded = heartbeats.where("status <> 'ok' or status is null").select(
        F.concat("service_role", F.lit("_heartbeat_degraded")).alias("code"), F.lit("warning").alias("severity"), F.lit("status").alias("field"), F.col("status").alias("value"), F.lit("ok").alias("threshold"), *own
    )
    expired = heartbeats.where(~ops.active(F.col("expires_at"), now)).select(
        F.lit("heartbeat_expired").alias("code"), F.lit("critical").alias("severity"), F.lit("expiresAt").alias("field"), text(F.col("expires_at")).alias("value"), text(now).alias("threshold"), *own
    )
    return carried.unionByName(degraded.select(*ALERT)).unionByName(expired.select(*ALERT))


def _with(metrics: Column) -> Column:
    """A heartbeat's metrics as a JSON object with what it says of itself."""
    members = F.from_json(metrics, "map<string, variant>")
    own = {"status": "status", "instanceId": "instance_id", "checkedAt": "checked_at", "expiresAt": "expires_at"}
    said = [F.variant_get(F.to_variant_object(F.array(F.col(c).cast("string"))), "$[0]", "variant") for c in own.values()]
    kept = F.map_filter(members, lambda k, _: ~k.isin(list(own)))
    return F.map_concat(kept, F.create_map(*[x for name, value in zip(own, said, strict=True) for x in (F.lit(name), value)]))


def metrics_snapshot(heartbeats: DataFrame, jobs: DataFrame, now: Column, profile: str) -> DataFrame:
    """One row, ``metrics``: a JSON object of the counts of jobs and heartbeats, the latest metrics of each role (the last of equal times by name of the instance), and of the browser runner (the first).

    ``heartbeats`` has service_role, instance_id, status, checked_at, expires_at, metrics (JSON text; what is no object counts for the totals only). Roles and statuses are few, a map of each.
    """
    live = ops.active(F.col("expires_at"), now)
    totals = heartbeats.agg(F.count(F.lit(1)).alias("total"), F.count_if(live).alias("active"), F.count_if(~live).alias("stale"))
    by_role = _as_map(heartbeats.groupBy("service_role").agg(F.count(F.lit(1)).alias("n")), "service_role", "roles")
    by_status = _as_map(status_counts(jobs), "status", "jobs")
    sound = heartbeats.where(F.coalesce(F.schema_of_variant(F.try_parse_json("metrics")).startswith("OBJECT"), F.lit(False)))
    latest = ops.latest_metrics(sound).select("service_role", F.to_json(_with(F.col("metrics"))).alias("json"))
    runner = ops.latest_heartbeat(sound.where(F.col("service_role") == RUNNER), ["service_role"]).select(F.lit("browserRunner").alias("service_role"), F.to_json(_with(F.col("metrics"))).alias("json"))
    services = latest.unionByName(runner).agg(F.map_from_entries(F.collect_list(F.struct("service_role", "json"))).alias("services"))
    one = totals.crossJoin(by_role).crossJoin(by_status).crossJoin(services)
    fixed = F.create_map(
        F.lit("jobStatusCounts"), F.to_json("jobs"), F.lit("totalHeartbeatCount"), F.col("total").cast("string"), F.lit("activeHeartbeatCount"), F.col("active").cast("string"),
        F.lit("staleHeartbeatCount"), F.col("stale").cast("string"), F.lit("serviceHeartbeatCounts"), F.to_json("roles"), F.lit("deploymentProfile"), F.lit(f'"{profile}"'),
    )
    whole = F.map_concat(F.map_filter(fixed, lambda k, _: ~F.map_contains_key("services", k)), "services")
    entry = lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])
    return one.select(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(whole)), entry), ","), F.lit("}")).alias("metrics"))


def _as_map(counts: DataFrame, key: str, to: str) -> DataFrame:
    return counts.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(to))


def compact_metrics(metrics: Column, value: Column, threshold: Column, rule_path: Column) -> Column:
    """What an alert keeps of a snapshot's metrics, as a JSON object of its value, threshold and rule, and of the known metrics that are there. Values are JSON texts; a null path is no rule's."""
    parsed = F.try_parse_json(metrics)
    member = lambda holder, name: F.to_json(F.try_variant_get(holder, f"$.{name}", "variant"))
    pair = lambda name, json: F.when(json.isNotNull(), F.concat(F.lit(f'"{name}":'), json))
    runner = F.try_variant_get(parsed, "$.browserRunner", "variant")
    of_runner = F.concat(F.lit("{"), F.concat_ws(",", *[pair(n, member(runner, n)) for n in KEPT_OF_RUNNER]), F.lit("}"))
    inner = F.when(F.schema_of_variant(runner).startswith("OBJECT"), of_runner)
    path = F.to_json(F.array(rule_path))
    parts = [pair("alertValue", F.coalesce(value, F.lit("null"))), pair("alertThreshold", F.coalesce(threshold, F.lit("null"))), pair("ruleMetricPath", F.when(rule_path.isNotNull(), path.substr(F.lit(2), F.length(path) - 2)))]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, *[pair(n, member(parsed, n)) for n in KEPT], pair("browserRunner", inner)), F.lit("}"))


def alert_events(heartbeats: DataFrame, snapshot: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """The alerts of heartbeats and of rules on a snapshot's metrics, one for each (code, role, instance, field): those of heartbeats come first, by role, instance and code.

    Columns are those of ``ALERT``, rule_path (null for those of heartbeats) and metrics, what is kept of the snapshot's. Values and thresholds of both are JSON texts.
    """
    json = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    beats = heartbeat_alerts(heartbeats, now).withColumns({"value": F.when(F.col("value").isNotNull(), json(F.col("value"))), "threshold": F.when(F.col("threshold").isNotNull(), json(F.col("threshold"))), "rule_path": F.lit(None).cast("string"), "first": F.lit(0)})
    ruled = ops.alerts(snapshot, rules).withColumns({"instance_id": F.lit(None).cast("string"), "checked_at": now, "rule_path": F.col("field"), "first": F.lit(1)})
    every = beats.select(*ALERT, "rule_path", "first").unionByName(ruled.select(*ALERT, "rule_path", "first"))
    kept = keep_one(every, ["code", "service_role", "instance_id", "field"], [F.col("first").asc(), F.col("checked_at").asc(), F.col("value").asc()])
    return kept.crossJoin(F.broadcast(snapshot.select(F.col("metrics").alias("all")))).select(*ALERT, "rule_path", compact_metrics(F.col("all"), F.col("value"), F.col("threshold"), F.col("rule_path")).alias("metrics"))
