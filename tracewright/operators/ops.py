"""Heartbeats, metrics and alert rules at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.dedupe import keep_one

# The default alert rules (code, severity, metric path, operator, threshold, role).
DEFAULT_RULES = [
    ("browser_runner_queue_backlog", "warning", "browserRunner.queuedCount", "gte", "10", "browser-runner"),
    ("browser_runner_retry_rate_high", "warning", "browserRunner.retryRate", "gte", "0.25", "browser-runner"),
    ("browser_runner_expired_running", "critical", "browserRunner.expiredRunningCount", "gt", "0", "browser-runner"),
    ("ops_stale_heartbeats", "critical", "staleHeartbeatCount", "gt", "0", None),
]
OPERATORS = ["gt", "gte", "lt", "lte", "eq", "neq"]
#: More rules than this are no configuration.
MOST_RULES = 1000
RULE = "code string, severity string, metric_path string, operator string, threshold string, service_role string"


def expires_at(checked_at: Column, ttl_seconds: int) -> Column:
    return checked_at + F.expr(f"INTERVAL {ttl_seconds} SECONDS")


def active(expiry: Column, now: Column) -> Column:
    """Unexpired, strictly: a heartbeat that expires now is stale."""
    return F.coalesce(expiry > now, F.lit(False))


def latest_metrics(heartbeats: DataFrame) -> DataFrame:
    """The latest heartbeat of each role; of equal times the last instance by name."""
    return keep_one(heartbeats, ["service_role"], [F.col("checked_at").desc(), F.col("instance_id").desc()])


def latest_heartbeat(heartbeats: DataFrame, keys: list[str]) -> DataFrame:
    """The latest heartbeat of each key; of equal times the first instance by name."""
    return keep_one(heartbeats, keys, [F.col("checked_at").desc(), F.col("instance_id").asc()])


def heartbeat_counts(heartbeats: DataFrame, now: Column) -> DataFrame:
    """service_role, active, stale."""
    live = active(F.col("expires_at"), now)
    return heartbeats.groupBy("service_role").agg(F.count_if(live).alias("active"), F.count_if(~live).alias("stale"))


def metric_value(metrics: Column, path: Column) -> Column:
    """The value at a dotted path of a JSON text or variant, as JSON text (strings keep their quotes); null where the path leads nowhere or to null."""
    steps = F.transform(F.split(path, r"\."), lambda s: F.concat(F.lit("['"), s, F.lit("']")))
    found = F.try_variant_get(F.try_parse_json(metrics), F.concat(F.lit("$"), F.array_join(steps, "")), "variant")
    return F.nullif(F.to_json(found), F.lit("null"))


def _number(json: Column) -> Column:
    """A JSON number; booleans, strings and null are none."""
    return F.when(F.trim(json).rlike(r"^-?\d"), json.try_cast("double"))


def rule_matches(value: Column, operator: Column, threshold: Column) -> Column:
    """Order needs two JSON numbers (a boolean is none); ``eq`` and ``neq`` compare any JSON texts, numbers by value. A missing value matches nothing. Never null."""
    a, b = _number(value), _number(threshold)
    same = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(value.eqNullSafe(threshold))
    found = (
        F.when(operator == "gt", a > b)
        .when(operator == "gte", a >= b)
        .when(operator == "lt", a < b)
        .when(operator == "lte", a <= b)
        .when(operator == "eq", same)
        .when(operator == "neq", ~same)
    )
    return F.coalesce(found & value.isNotNull(), F.lit(False))


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """code, severity, service_role, field, value, threshold of the enabled rules that match any row of ``metrics`` (a JSON text column ``metrics``).

    ``rules`` has the columns of ``RULE`` and perhaps ``enabled`` (null counts as enabled). At most ``MOST_RULES`` of them are read, more are an error: each row of
    metrics is parsed once and meets them as an array.
    """
    if "enabled" in rules.columns:
        rules = rules.where(F.coalesce("enabled", F.lit(True)))
    names = ["code", "severity", "metric_path", "operator", "threshold", "service_role"]
    known = rules.select(names).limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>"
    each = F.array(*[F.struct(*[F.lit(r[n]).cast("string").alias(n) for n in names]) for r in known]).cast(rule)
    parsed = metrics.select(F.try_parse_json("metrics").alias("json"))
    met = parsed.select("json", F.explode(each).alias("r")).select("json", "r.*")
    steps = F.transform(F.split("metric_path", r"\."), lambda s: F.concat(F.lit("['"), s, F.lit("']")))
    value = F.nullif(F.to_json(F.try_variant_get("json", F.concat(F.lit("$"), F.array_join(steps, "")), "variant")), F.lit("null"))
    met = met.withColumn("value", value).where(rule_matches(F.col("value"), F.col("operator"), F.col("threshold")))
    return met.select("code", "severity", "service_role", F.col("metric_path").alias("field"), "value", "threshold")


def configured_rules(spark: SparkSession, text: str | None) -> DataFrame:
    """The default rules and those of a JSON text (a list, or an object with ``rules``); bad rules and bad JSON are passed over."""
    columns = f"{RULE}, enabled boolean"
    default = spark.createDataFrame([(*r, True) for r in DEFAULT_RULES], columns)
    item = "code string, severity string, metric_path string, operator string, threshold variant, service_role string, enabled boolean"
    given = spark.createDataFrame([(text,)], "text string")
    listed = F.coalesce(F.get_json_object("text", "$.rules"), F.when(F.ltrim("text").startswith("["), F.col("text")))
    read = given.select(F.explode(F.from_json(listed, "array<string>")).alias("rule")).select(F.from_json("rule", item).alias("r")).select("r.*")
    good = F.col("operator").isin(OPERATORS) & F.col("threshold").isNotNull() & F.col("metric_path").isNotNull() & F.col("code").isNotNull()
    read = read.where(good).withColumns({"threshold": F.to_json("threshold"), "severity": F.coalesce("severity", F.lit("warning")), "enabled": F.coalesce("enabled", F.lit(True))})
    return default.unionByName(read)


def dedupe_alerts(events: DataFrame, seq: str = "seq") -> DataFrame:
    """The first alert of each (code, role, instance, field); nulls are equal."""
    return keep_one(events, ["code", "service_role", "instance_id", "field"], [F.col(seq).asc()])


def alert_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("severity", "code", F.coalesce("service_role", F.lit("unknown")).alias("service_role")).agg(F.count(F.lit(1)).alias("n"))


def alert_events(events: DataFrame, role: str | None = None, severity: str | None = None, code: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; the limit is held between 1 and 500."""
    for name, value in (("service_role", role), ("severity", severity), ("code", code)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return events.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max(1, min(limit, 500)))
