"""JSON documents as trees, and policies from the configurations of jobs, over documents that are made from keys so that every rule is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import without_origins
from tracewright.operators import policies, settings, trees
from tracewright.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "json_redacted",
    """
    WITH o AS (SELECT o_orderkey AS k, ['{}', '""', 'false', '0', '"s3"', '{"k":[1]}', '[]', 'null'][1 + o_orderkey % 8] AS v FROM orders),
    h AS (SELECT *, CASE WHEN v IN ('""', 'false', '0', 'null') THEN v ELSE '"<redacted>"' END AS shown FROM o)
    SELECT k AS id, '{"Access-Token":' || shown || ',"a":{"n":[' || k || ',{"token":' || shown || '}],"password_x":' || v || '},"id":' || k || ',"value":' || CASE WHEN k = 0 THEN '0' ELSE '"<redacted>"' END || '}' AS json FROM h
    """,
)
def json_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with named secrets on several levels, whose values are of every kind."""
    key = F.col("o_orderkey")
    value = F.element_at(F.array(*[F.lit(v) for v in ("{}", '""', "false", "0", '"s3"', '{"k":[1]}', "[]", "null")]), (1 + key % 8).cast("int"))
    number = key.cast("string")
    json = F.concat(F.lit('{"id": '), number, F.lit(', "value": '), number, F.lit(', "a": {"password_x": '), value, F.lit(', "n": ['), number, F.lit(', {"token": '), value, F.lit('}]}, "Access-Token": '), value, F.lit("}"))
    docs = table(spark, sf_dir, "orders").select(key.alias("id"), json.alias("json"))
    return trees.put_together(trees.hide_values(trees.leaves(docs, "id", "json"), "id", settings.SECRET_NAMES, "<redacted>"), "id")


@query(
    "json_origins",
    """SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, replace(replace(text, 'https://a.example:8443', '<runtime-origin>'), 'https://a.example', '<runtime-origin>') || ' <runtime-origin>/' || turn || ' and http://other' AS text
    FROM conversations""",
)
def json_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents in whose strings the origins of a run give way to a marker."""
    said = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(" https://a.example/")).otherwise(" https://a.example:8443/"), F.col("turn").cast("string"), F.lit(" and http://other"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").cast("int").alias("turn"), "role", said.alias("text")).alias("t"))
    docs = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("t")).alias("turns"))).alias("json"))
    origins = F.array(F.lit("https://a.example"), F.lit("https://a.example:8443"))
    built = trees.put_together(trees.with_texts(trees.leaves(docs, "conv_id", "json"), lambda t: without_origins(t, origins)), "conv_id")
    parsed = F.from_json("json", "struct<turns: array<struct<turn: int, role: string, text: string>>>")
    return built.select("conv_id", F.explode(parsed["turns"]).alias("t")).select("conv_id", "t.*")


ALLOWED = [(role, path) for role, paths in {"click": ["$.status", "$.review", "$.review.status"], "view": ["$.status", "$.items", "$.items[*].id"], "error": ["$.status", "$.items", "$.items[*].id", "$.items[*].more", "$.items[*].more.deep"]}.items() for path in paths]


@query(
    "role_fields",
    f"""
    WITH allowed(role, path) AS (VALUES {", ".join(str(a) for a in ALLOWED)}),
    d AS (SELECT event_id AS id, event_type AS role, CASE event_id % 5
      WHEN 0 THEN '{{"status":"pass","review":{{"status":"x","extra":[1,2]}}}}' WHEN 1 THEN '{{"items":[{{"id":1}},{{"id":2,"more":{{"deep":[],"no":{{"x":1}}}}}}]}}'
      WHEN 2 THEN '[1]' WHEN 3 THEN 'no json' ELSE '{{}}' END AS json FROM events),
    p AS (SELECT DISTINCT d.id, d.role, regexp_replace(t.fullkey, '\\[\\d+\\]', '[*]', 'g') AS path FROM (SELECT * FROM d WHERE event_id_ok(json)) d, json_tree(d.json) t WHERE t.key IS NOT NULL AND NOT regexp_matches(t.fullkey, '\\]$')),
    bad AS (SELECT p.* FROM p ANTI JOIN allowed a ON a.role = p.role AND a.path = p.path)
    SELECT id, role, path FROM bad b WHERE NOT EXISTS (SELECT 1 FROM bad o WHERE o.id = b.id AND o.path <> b.path AND (starts_with(b.path, o.path || '.') OR starts_with(b.path, o.path || '[')))
    UNION ALL SELECT id, role, '$' FROM d WHERE NOT event_id_ok(json)
    """.replace("event_id_ok(json)", "(json_valid(json) AND json[1] = '{')"),
)
def role_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outputs of roles, each of which may have certain fields only."""
    kinds = ['{"status":"pass","review":{"status":"x","extra":[1,2]}}', '{"items":[{"id":1},{"id":2,"more":{"deep":[],"no":{"x":1}}}]}', "[1]", "no json", "{}"]
    json = F.element_at(F.array(*[F.lit(k) for k in kinds]), (1 + F.col("event_id") % 5).cast("int"))
    outputs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("role"), json.alias("json"))
    return trees.forbidden_paths(outputs, spark.createDataFrame(ALLOWED, "role string, path string"))


def configured(spark: SparkSession, sf_dir: str, configs: list[str | None]) -> DataFrame:
    """Parts as jobs, each of which has one of the configurations."""
    text = F.element_at(F.array(*[F.lit(c) for c in configs]), (1 + F.col("p_partkey") % len(configs)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job"), F.try_parse_json(text).alias("config"))


def _answers(name: str, columns: str, answers: list[str], n: int) -> str:
    """SQL for jobs whose configuration number i has the answers of row i."""
    return f"SELECT p_partkey AS job, {columns} FROM part JOIN (VALUES {', '.join(f'({i}, {a})' for i, a in enumerate(answers))}) {name}(i, {columns}) ON p_partkey % {n} = i"


ALL_ACTIONS = "'add_package_script,replace_package_script,mirror_original_static_entry'"
REVIEWS = {
    None: f"2, true, {ALL_ACTIONS}, 2, true, {ALL_ACTIONS}",
    "no json": f"2, true, {ALL_ACTIONS}, 2, true, {ALL_ACTIONS}",
    "[]": f"2, true, {ALL_ACTIONS}, 2, true, {ALL_ACTIONS}",
    '{"reviewFix":{"maxAttempts":4,"allowLowRiskRepairs":false}}': f"4, false, {ALL_ACTIONS}, 4, false, {ALL_ACTIONS}",
    '{"reviewFix":{"maxAttempts":4,"buildValidation":{"maxAttempts":9}},"buildValidation":{"maxAttempts":null}}': f"2, true, {ALL_ACTIONS}, 4, true, {ALL_ACTIONS}",
    '{"reviewFix":{"maxAttempts":"3","buildValidation":{"maxAttempts":-1},"runtimeCompare":{"maxAttempts":" 5 "}}}': f"1, true, {ALL_ACTIONS}, 5, true, {ALL_ACTIONS}",
    '{"buildValidation":{"maxAttempts":2.9,"allowLowRiskRepairs":"no"},"runtimeCompare":{"maxAttempts":true},"reviewFix":{"allowLowRiskRepairs":false}}': f"2, true, {ALL_ACTIONS}, 1, false, {ALL_ACTIONS}",
    '{"reviewFix":{"allowLowRiskRepairs":0,"buildValidation":{"allowLowRiskRepairs":false},"runtimeCompare":{"allowLowRiskRepairs":null}}}': f"2, false, {ALL_ACTIONS}, 2, true, {ALL_ACTIONS}",
    '{"reviewFix":{"allowedRepairActions":["replace_package_script","x","add_package_script","replace_package_script",7]},"buildValidation":{"allowedRepairActions":[]}}': "2, true, 'replace_package_script,add_package_script', 2, true, 'replace_package_script,add_package_script'",
    '{"reviewFix":{"allowedRepairActions":"x","runtimeCompare":{"allowedRepairActions":[]}},"buildValidation":{"allowedRepairActions":["mirror_original_static_entry"]}}': "2, true, 'mirror_original_static_entry', 2, true, ''",
    '{"reviewFix":[1],"runtimeCompare":"on","buildValidation":{"maxAttempts":"3.5"}}': f"2, true, {ALL_ACTIONS}, 2, true, {ALL_ACTIONS}",
}


@query("review_policies", _answers("a", "build_attempts, build_low_risk, build_actions, runtime_attempts, runtime_low_risk, runtime_actions", list(REVIEWS.values()), len(REVIEWS)))
def review_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of review and repair from layered configurations with absent, null and mistyped values."""
    found = configured(spark, sf_dir, list(REVIEWS)).select("job", policies.review_policy(F.col("config")).alias("p"))
    side = lambda name: [F.col(f"p.{name}.max_attempts").alias(f"{name}_attempts"), F.col(f"p.{name}.allow_low_risk").alias(f"{name}_low_risk"), F.array_join(f"p.{name}.actions", ",").alias(f"{name}_actions")]
    return found.select("job", *side("build"), *side("runtime"))


GATES = {
    None: "true, true, true, true, true, 0.0",
    '{"runtimeCompare":{"reviewGate":{"enabled":false,"failOnDomChanged":null,"failOnNetworkChanged":0},"imageDiff":{"maxChangedPixelRatio":0.25}}}': "false, true, true, true, true, 0.25",
    '{"reviewGate":{"failOnConsoleChanged":false,"maxChangedPixelRatio":-1},"imageDiff":{"maxChangedPixelRatio":1}}': "true, true, true, false, true, 0.0",
    '{"runtimeCompare":[],"reviewGate":{"failOnScreenshotChanged":false,"maxChangedPixelRatio":true},"imageDiff":{"maxChangedPixelRatio":2}}': "true, true, true, true, false, 2.0",
    '{"runtimeCompare":{},"reviewGate":{"enabled":false}}': "true, true, true, true, true, 0.0",
}


@query("gate_policies", _answers("a", "enabled, dom, network, console, screenshot, max_ratio", [g.rsplit(", ", 1)[0] + f", CAST({g.rsplit(', ', 1)[1]} AS DOUBLE)" for g in GATES.values()], len(GATES)))
def gate_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a comparison fails on, from the configuration of a job or of the comparison alone."""
    return configured(spark, sf_dir, list(GATES)).select("job", policies.gate_policy(F.col("config")).alias("p")).select("job", "p.*")


ATTACHMENTS = {
    None: "NULL, '', NULL, NULL, NULL",
    '{"packaging":{"evidenceAttachments":{"includeKinds":["b","a","b",3],"excludeKinds":"x","maxBytesPerArtifact":10}}}': "'a,b', 'x', NULL, NULL, 10",
    '{"packaging":{"evidenceAttachments":{"includeKinds":[],"includeSensitivityClasses":["public","odd"],"includeRetentionClasses":["odd"],"maxBytesPerArtifact":-1}}}': "'', '', 'public', '', NULL",
    '{"packaging":{"evidenceAttachments":{"includeKinds":null,"includeRetentionClasses":"archive","maxBytesPerArtifact":true}}}': "NULL, '', NULL, 'archive', NULL",
    '{"packaging":{"evidenceAttachments":[]}}': "NULL, '', NULL, NULL, NULL",
}


@query("attachment_policies", _answers("a", "include_kinds, exclude_kinds, sensitivity_classes, retention_classes, max_bytes", [f"{a.rsplit(', ', 1)[0]}, CAST({a.rsplit(', ', 1)[1]} AS BIGINT)" for a in ATTACHMENTS.values()], len(ATTACHMENTS)))
def attachment_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which artifacts go into an archive; what is absent limits nothing."""
    found = configured(spark, sf_dir, list(ATTACHMENTS)).select("job", policies.attachment_policy(F.col("config")).alias("p"))
    listed = [F.array_join(f"p.{c}", ",").alias(c) for c in ("include_kinds", "exclude_kinds", "sensitivity_classes", "retention_classes")]
    return found.select("job", *listed, "p.max_bytes")
