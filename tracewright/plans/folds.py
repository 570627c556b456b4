"""Folds over rows in order, and operators whose rules need odd values: their columns are made from keys so that every rule is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import reports, revisions, rollups
from tracewright.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WRITES = "SELECT event_type AS scope, CASE WHEN user_id % 3 > 0 THEN 'p' || (user_id % 3) ELSE '' END AS scope_id, event_id AS seq, CASE WHEN event_id % 11 > 0 THEN CAST(floor(value) AS BIGINT) % 40 END AS expected_revision FROM events"


@query(
    "settings_writes",
    f"""
    WITH RECURSIVE w AS ({WRITES}),
    chain AS (
      SELECT scope, scope_id, 0 AS level, min(seq) AS seq FROM w WHERE expected_revision = 0 GROUP BY ALL
      UNION ALL
      SELECT c.scope, c.scope_id, c.level + 1, (SELECT min(seq) FROM w WHERE w.scope = c.scope AND w.scope_id = c.scope_id AND w.expected_revision = c.level + 1 AND w.seq > c.seq) AS seq
      FROM chain c WHERE c.seq IS NOT NULL)
    SELECT w.scope, w.scope_id, w.seq, w.expected_revision, c.seq IS NOT NULL AS accepted,
      count(c.seq) OVER (PARTITION BY w.scope, w.scope_id ORDER BY w.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_revision,
      CASE WHEN c.seq IS NOT NULL THEN w.expected_revision + 1 END AS revision
    FROM w LEFT JOIN chain c USING (scope, scope_id, seq)
    """,
)
def settings_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of settings, which name the revision that they expect to replace."""
    scope = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")))
    expected = F.when(F.col("event_id") % 11 > 0, F.floor("value") % 40)
    writes = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), scope.alias("scope_id"), F.col("event_id").alias("seq"), expected.alias("expected_revision"))
    return revisions.settle_writes(writes, block=1024)


CALLS = """SELECT event_id AS seq, epoch_us(ts) AS t, lower(trim(' ' || event_type)) || '/' || (user_id % 3) AS key, value > 20 AS failed, value > 20 AND event_id % 5 > 0 AS cacheable, event_type || event_id AS message FROM events"""


@query(
    "failure_cache",
    f"""
    WITH RECURSIVE c AS ({CALLS}),
    e AS (
      SELECT key, t, seq FROM (SELECT key, t, seq FROM c WHERE failed AND cacheable QUALIFY row_number() OVER (PARTITION BY key ORDER BY t, seq) = 1)
      UNION ALL
      SELECT key, n.t, n.seq FROM (
        SELECT e.key, (SELECT min(struct_pack(t := c.t, seq := c.seq)) FROM c WHERE c.key = e.key AND c.failed AND c.cacheable AND c.t >= e.t + 21600000000) AS n FROM e) WHERE n IS NOT NULL),
    near AS (
      SELECT c.*, (SELECT max(struct_pack(t := e.t, seq := e.seq)) FROM e WHERE e.key = c.key AND (e.t < c.t OR e.t = c.t AND e.seq < c.seq)) AS hit FROM c),
    seen AS (SELECT *, coalesce(hit.t + 21600000000 > t, false) AS cached FROM near)
    SELECT s.seq, CASE WHEN cached THEN 'cached' WHEN s.failed THEN 'failed' ELSE 'passed' END AS outcome, CASE WHEN cached THEN m.message WHEN s.failed THEN s.message END AS message
    FROM seen s LEFT JOIN c m ON m.seq = s.hit.seq
    """,
)
def failure_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a service, of which those of high value fail; failures are cached for six hours."""
    key = revisions.failure_key(F.concat(F.lit(" "), F.upper("event_type")), F.lit("m"), F.lit("HTTP://x/"), (F.col("user_id") % 3).cast("string"))
    failed = F.col("value") > 20
    calls = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), key.alias("key"), failed.alias("failed"), (failed & (F.col("event_id") % 5 > 0)).alias("cacheable"), F.concat("event_type", F.col("event_id").cast("string")).alias("message")
    )
    return revisions.cached_failures(calls, 6 * 3600, block_seconds=86400).select("seq", "outcome", "message")


@query(
    "source_candidate_paths",
    """
    WITH p AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS n FROM part),
    c AS (SELECT k, CASE k % 8
      WHEN 0 THEN ['maps/lib/' || n || '.ts', 'out/lib/' || n || '.ts', 'src/lib/' || n || '.ts', '../lib/' || n || '.ts']
      WHEN 1 THEN ['maps/js/src/' || n || '.ts', 'out/js/src/' || n || '.ts', 'src/' || n || '.ts']
      WHEN 2 THEN []
      WHEN 3 THEN ['maps/js/b/' || n || '.ts', 'out/js/b/' || n || '.ts', 'src/root/b/' || n || '.ts', 'a/../b/' || n || '.ts']
      WHEN 4 THEN ['maps/js/' || n || '.ts', 'out/js/' || n || '.ts', n || '.ts']
      WHEN 5 THEN []
      WHEN 6 THEN ['maps/js/w/' || n || '.ts', 'out/js/w/' || n || '.ts', 'w/' || n || '.ts']
      ELSE ['../' || n || '.ts', '../../../' || n || '.ts'] END AS found FROM p)
    SELECT 'm' || k AS id, unnest(found) AS candidate FROM c
    """,
)
def source_candidate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with dots, schemes, backslashes and blanks, in maps of several depths."""
    key, n = F.col("p_partkey"), F.col("p_size").cast("string")
    case = lambda *values: F.element_at(F.array(*values), (key % 8 + 1).cast("int"))
    none = F.lit(None).cast("string")
    source = case(
        F.concat(F.lit("../lib/"), n, F.lit(".ts")), F.concat(F.lit("webpack:///./src/"), n, F.lit(".ts")), F.concat(F.lit("https://host/"), n, F.lit(".ts")), F.concat(F.lit("a\\..\\b\\"), n, F.lit(".ts")),
        F.concat(F.lit("  ./"), n, F.lit(".ts ")), F.lit("   "), F.concat(F.lit("/w/"), n, F.lit(".ts")), F.concat(F.lit("../../../"), n, F.lit(".ts")),
    )
    root = case(F.lit("src/root/"), none, F.lit("src"), F.lit("webpack://src/root"), F.lit(""), F.lit("x"), F.lit("ftp://no/"), none)
    deep = key % 8 != 7
    path = lambda folder, end: F.concat(F.when(deep, F.lit(f"{folder}/js/")).otherwise(F.lit("a/b/") if folder == "maps" else F.lit("")), F.lit("m"), key.cast("string"), F.lit(end))
    sources = table(spark, sf_dir, "part").select(key.cast("string").alias("k"), source.alias("source"), root.alias("source_root"), path("maps", ".map").alias("map_path"), path("out", ".js").alias("bundle_path"))
    return reports.source_candidates(sources).select(F.regexp_extract("map_path", r"(m\d+)\.map$", 1).alias("id"), "candidate")


DECISIONS = "SELECT o_custkey % 40 AS \"group\", o_orderpriority AS key, o_orderkey % 4 AS attempt, ['pass', 'skipped', 'unknown', 'retry', 'fail', NULL, 'best_effort'][1 + (o_orderkey * 3 + o_custkey) % (1 + 2 * (o_custkey % 4))] AS status FROM orders"


@query(
    "completion_statuses",
    f"""WITH l AS ({DECISIONS}), t AS (SELECT * FROM l QUALIFY rank() OVER (PARTITION BY "group", key ORDER BY attempt DESC) = 1),
    g AS (SELECT "group", count(*) FILTER (status IN ('fail', 'retry', 'best_effort')) AS observations FROM t GROUP BY 1)
    SELECT "group", observations, CASE WHEN observations > 0 THEN 'completed_best_effort' ELSE 'completed' END AS decision FROM g""",
)
def completion_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of every status, a null one among them; what is skipped or unknown is no observation."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pass", "skipped", "unknown", "retry", "fail", None, "best_effort")]), (1 + (key * 3 + who) % (1 + 2 * (who % 4))).cast("int"))
    records = table(spark, sf_dir, "orders").select((who % 40).alias("group"), F.col("o_orderpriority").alias("key"), (key % 4).alias("attempt"), status.alias("status"), key.alias("id"))
    return rollups.completion(records)


@query(
    "comparison_verdicts",
    """
    WITH c AS (SELECT l_suppkey AS k, count(*) AS comparisons, count(DISTINCT l_returnflag || '::' || CASE WHEN l_linenumber % 2 = 0 THEN '默认视口' ELSE l_linestatus || ' ' || l_linenumber || 'x9' END) AS scopes,
        count(*) FILTER (l_suppkey % 3 = 0 AND l_discount > 0.08) AS attention FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1),
    r AS (SELECT s_suppkey AS k, s_suppkey % 5 = 0 AS spent, CASE s_suppkey % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' WHEN 2 THEN 'retry' END AS final FROM supplier WHERE s_suppkey % 2 = 0),
    m AS (SELECT o_custkey AS k, o_orderkey % 9 AS requested, o_orderkey % 9 - o_orderkey % 2 AS selected, o_orderkey % 2 AS omitted, count(*) OVER (PARTITION BY o_custkey) AS matrices
      FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey DESC) = 1)
    SELECT k AS l_suppkey, coalesce(comparisons, 0) AS comparisons, coalesce(scopes, 0) AS scopes, coalesce(attention, 0) AS attention,
      CASE WHEN coalesce(spent, false) OR coalesce(final, '') = 'fail' THEN 'fail' WHEN coalesce(attention, 0) > 0 OR coalesce(final, '') IN ('retry', 'best_effort') THEN 'best_effort' ELSE 'pass' END AS status,
      requested, selected, omitted, coalesce(matrices, 0) AS matrices
    FROM c FULL JOIN r USING (k) FULL JOIN m USING (k)
    """,
)
def comparison_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a supplier as comparisons, suppliers as their retry budgets and orders as matrices of runs; each may be missing."""
    supplier, number = F.col("l_suppkey"), F.col("l_linenumber")
    label = reports.viewport_label(F.when(number % 2 == 1, F.col("l_linestatus")).otherwise(""), F.when(number % 2 == 1, number), F.when(number % 2 == 1, F.lit(9)).otherwise(0))
    status = F.when((supplier % 3 == 0) & (F.col("l_discount") > 0.08), "retry").when(number == 3, "skipped").otherwise("pass")
    lines = table(spark, sf_dir, "lineitem").where(supplier % 7 != 0).select("l_suppkey", reports.scope_key(F.col("l_returnflag"), label).alias("scope"), status.alias("status"))
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    final = F.when(key % 4 == 0, "fail").when(key % 4 == 1, "pass").when(key % 4 == 2, "retry")
    retries = suppliers.where(key % 2 == 0).select(key.alias("l_suppkey"), (key % 5 == 0).alias("budget_exhausted"), final.alias("final_review_status"))
    order = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").join(suppliers.select(key.alias("o_custkey")), "o_custkey", "left_semi")
    matrices = orders.select(F.col("o_custkey").alias("l_suppkey"), (order % 4).alias("attempt"), order.alias("seq"), (order % 9).alias("requested"), (order % 9 - order % 2).alias("selected"), (order % 2).alias("omitted"))
    return reports.comparison_summary(lines, ["l_suppkey"], retries, matrices)


@query(
    "convergence_in_order",
    """
    WITH s AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderpriority AS t, ['pass', 'retry', 'skipped', 'fail'][1 + o_orderkey % 4] AS status FROM orders),
    last AS (SELECT k, string_agg(t || '=' || status, ',' ORDER BY t) AS status_by_type FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY seq DESC) = 1) GROUP BY k)
    SELECT k AS o_custkey, coalesce(string_agg(t, ',' ORDER BY seq) FILTER (status IN ('retry', 'fail')), '') AS failed_types, any_value(status_by_type) AS status_by_type,
      coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (seq % 3 = 0), '') AS instructions, count(*) FILTER (seq % 3 = 1) AS applied, count(*) AS evidence
    FROM s JOIN last USING (k) GROUP BY k
    """,
)
def convergence_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as stages of a build and as its artifacts, a third of them instructions and a third applied projects."""
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pass", "retry", "skipped", "fail")]), (1 + key % 4).cast("int"))
    orders = table(spark, sf_dir, "orders")
    stages = orders.select("o_custkey", key.alias("seq"), F.lit(1).alias("attempt"), status.alias("status"), F.col("o_orderpriority").alias("review_type"), F.lit("none").alias("failure_class"))
    kind = F.when(key % 3 == 0, "repair_instruction").when(key % 3 == 1, "generated_project").otherwise("build_log")
    artifacts = orders.select("o_custkey", key.alias("seq"), key.cast("string").alias("id"), kind.alias("kind"), F.lit(True).alias("repair"))
    both = reports.convergence(stages, ["o_custkey"], "seq").join(reports.convergence_repairs(artifacts, ["o_custkey"], "seq"), "o_custkey")
    types = F.array_join(F.transform(F.array_sort(F.map_entries("status_by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return both.select(
        "o_custkey",
        F.array_join("failed_types", ",").alias("failed_types"),
        types.alias("status_by_type"),
        F.array_join("repair_instruction_ids", ",").alias("instructions"),
        F.col("applied_repair_count").cast("long").alias("applied"),
        F.size("evidence_ids").cast("long").alias("evidence"),
    )


@query(
    "attempt_histories",
    """SELECT user_id, event_type, string_agg(a || ':' || s, ',' ORDER BY a, event_id) AS attempts
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS a, CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END AS s FROM events) GROUP BY ALL""",
)
def attempt_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type as attempts at a comparison; a third have an empty status."""
    number = F.get_json_object("props", "$.k").cast("int") % 4
    status = F.when(F.col("event_id") % 3 == 0, "pass").when(F.col("event_id") % 3 == 1, "fail").otherwise("")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), number.alias("attempt"), status.alias("status"), F.col("event_id").alias("id"))
    found = reports.attempt_history(rows, ["user_id", "event_type"])
    return found.select("user_id", "event_type", F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["attempt"].cast("string"), a["status"])), ",").alias("attempts"))


@query(
    "text_types",
    """WITH t AS (SELECT ['TEXT/plain', 'application/yaml', 'text/markdown', 'application/markdown', 'image/svg+XML', 'application/ld+json', 'application/javascript', 'image/png', '', NULL][1 + p_partkey % 10] AS content_type FROM part)
    SELECT content_type, coalesce(lower(content_type) LIKE 'text/%' OR regexp_matches(lower(content_type), 'json|javascript|xml'), false) AS is_text, count(*) AS n FROM t GROUP BY ALL""",
)
def text_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content types of which a preview is text."""
    kinds = ["TEXT/plain", "application/yaml", "text/markdown", "application/markdown", "image/svg+XML", "application/ld+json", "application/javascript", "image/png", "", None]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (1 + F.col("p_partkey") % 10).cast("int")).alias("content_type")
    return table(spark, sf_dir, "part").select(kind).withColumn("is_text", reports.is_text(F.col("content_type"))).groupBy("content_type", "is_text").agg(F.count(F.lit(1)).alias("n"))
