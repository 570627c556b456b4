"""Operators over the driver's tables, which hold none of their own entities: each query applies an operator's semantics to columns of another meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import prompt_tokens, redact, slug
from tracewright.operators import audit, budget, dedupe, diff, inventory, knowledge, lineage, ops, queue, retention, rollups
from tracewright.plans.registry import query
from tracewright.sources import documents
from tracewright.streaming import heartbeats

NOW = "2024-02-01 00:00:00"
ORDERS_NOW = "1998-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "audit_union",
    """
    WITH r AS (
      SELECT CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'needs_review' ELSE 'accepted' END AS status,
        CASE WHEN event_type = 'error' AND value > 50 THEN 'runtime' ELSE 'none' END AS failure_class FROM events
      UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'P' THEN 'retry' ELSE 'pending' END, 'none' FROM orders
      UNION ALL SELECT CASE quality WHEN 1 THEN 'accepted' ELSE 'unverified' END, CASE toxic WHEN 1 THEN 'policy' ELSE 'none' END FROM labels),
    g AS (SELECT CASE WHEN failure_class <> 'none' OR status IN ('fail', 'rejected') THEN 'blocking'
        WHEN status IN ('best_effort', 'fail', 'needs_review', 'rejected', 'retry', 'unverified') THEN 'review' ELSE 'passing' END AS risk_group FROM r)
    SELECT k.risk_group, count(g.risk_group) AS n FROM (VALUES ('blocking'), ('review'), ('passing')) k(risk_group) LEFT JOIN g USING (risk_group) GROUP BY k.risk_group
    """,
)
def audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, orders and labels as audit records, counted by risk."""
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(
        F.lit("event").alias("category"),
        F.col("event_id").alias("id"),
        F.when(kind == "error", "fail").when(kind == "purchase", "pass").when(kind == "signup", "needs_review").otherwise("accepted").alias("status"),
        F.when((kind == "error") & (F.col("value") > 50), "runtime").otherwise("none").alias("failure_class"),
    )
    state = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("category"), F.col("o_orderkey").alias("id"), F.when(state == "F", "pass").when(state == "P", "retry").otherwise("pending").alias("status"), F.lit("none").alias("failure_class")
    )
    labels = table(spark, sf_dir, "labels").select(
        F.lit("label").alias("category"),
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "accepted").otherwise("unverified").alias("status"),
        F.when(F.col("toxic") == 1, "policy").otherwise("none").alias("failure_class"),
    )
    return audit.counts_by_risk(audit.union_records(events, orders, labels))


@query("ops_status_counts", "SELECT coalesce(nullif(trim(event_type), ''), 'unknown') AS status, count(*) AS n FROM events GROUP BY 1")
def ops_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type as jobs by status."""
    return audit.status_counts(table(spark, sf_dir, "events"), "event_type")


LATEST = "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query("ops_latest_per_user", f"SELECT user_id, event_id, event_type, ts FROM ({LATEST})")
def ops_latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user as the latest heartbeat of a service; the last id wins ties."""
    last = dedupe.keep_one(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return last.select("user_id", "event_id", "event_type", "ts")


@query("ops_ttl_active", f"SELECT event_type, count(*) FILTER (ts + INTERVAL 3 DAY > TIMESTAMP '{NOW}') AS active, count(*) FILTER (NOT (ts + INTERVAL 3 DAY > TIMESTAMP '{NOW}')) AS stale FROM ({LATEST}) GROUP BY 1")
def ops_ttl_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and stale users three days after their latest event, by its type as the role."""
    last = dedupe.keep_one(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    beats = last.select(F.col("event_type").alias("service_role"), ops.expires_at(F.col("ts"), 3 * 86400).alias("expires_at"))
    return ops.heartbeat_counts(beats, _time(NOW)).withColumnRenamed("service_role", "event_type")


@query(
    "ops_rule_match",
    """
    WITH rules(code, op, threshold) AS (VALUES ('high', 'gte', '90'), ('low', 'lt', '5'), ('exact', 'eq', '42'), ('flag', 'gt', 'true'), ('other', 'neq', '0')),
    e AS (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events)
    SELECT code, count(*) AS n FROM e, rules WHERE (op = 'gte' AND v >= TRY_CAST(threshold AS DOUBLE)) OR (op = 'lt' AND v < TRY_CAST(threshold AS DOUBLE))
      OR (op = 'eq' AND v = TRY_CAST(threshold AS DOUBLE)) OR (op = 'neq' AND v <> TRY_CAST(threshold AS DOUBLE)) GROUP BY code
    """,
)
def ops_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rules over the JSON properties of events; a boolean threshold never matches an order."""
    rules = [("high", "gte", "90"), ("low", "lt", "5"), ("exact", "eq", "42"), ("flag", "gt", "true"), ("other", "neq", "0")]
    rules = spark.createDataFrame([(c, "warning", "k", o, t, None) for c, o, t in rules], ops.RULE)
    metrics = table(spark, sf_dir, "events").select(F.col("props").alias("metrics"))
    return ops.alerts(metrics, rules).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: status O queued, P running, F finished; numbers of the order stand for times and attempts."""
    status, key, made = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(status == "O", "queued").when(status == "P", "running").otherwise("pass").alias("status"),
        made.alias("created_at"),
        F.when(key % 3 == 0, made + F.expr("INTERVAL 1 DAYS")).alias("next_run_at"),
        F.when(status != "O", made).alias("started_at"),
        F.when(status == "F", made + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("finished_at"),
        (key % 4).cast("int").alias("attempt"),
        F.lit(3).alias("max_attempts"),
        F.when(status == "P", made + F.expr("INTERVAL 30 DAYS")).alias("lease_expires_at"),
        F.lit("w1").alias("lease_owner"),
        (key % 7 == 0).alias("lease_recovered"),
        F.lit(None).cast("string").alias("error"),
    )


RUNS = """
    SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'pass' END AS status, o_orderdate AS created_at,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS next_run_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS started_at,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS finished_at, CAST(o_orderkey % 4 AS INTEGER) AS attempt, 3 AS max_attempts,
      CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 30 DAY END AS lease_expires_at, o_orderkey % 7 = 0 AS lease_recovered FROM orders
"""


@query(
    "queue_metrics",
    f"""
    WITH r AS ({RUNS})
    SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pass') AS terminal,
      max(greatest(0, date_diff('millisecond', created_at, TIMESTAMP '{ORDERS_NOW}'))) FILTER (status = 'queued') AS oldest_queued_ms,
      max(greatest(0, date_diff('millisecond', coalesce(next_run_at, created_at), TIMESTAMP '{ORDERS_NOW}'))) FILTER (status = 'queued') AS claim_latency_ms,
      CAST(floor(avg(date_diff('millisecond', started_at, finished_at)) FILTER (status = 'pass')) AS BIGINT) AS mean_run_ms,
      CAST(count(*) FILTER (attempt > 1) AS DOUBLE) / count(*) FILTER (attempt > 0) AS retry_rate,
      count(*) FILTER (lease_recovered) AS recovered, count(*) FILTER (status = 'running' AND lease_expires_at <= TIMESTAMP '{ORDERS_NOW}') AS expired_running FROM r
    """,
)
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of orders as a queue."""
    return queue.metrics(_runs(spark, sf_dir), _time(ORDERS_NOW))


@query(
    "queue_claim_order",
    f"""
    WITH r AS ({RUNS})
    SELECT id, next_run_at, created_at FROM r WHERE status = 'queued' AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '{ORDERS_NOW}')
    ORDER BY next_run_at NULLS FIRST, created_at, id LIMIT 50
    """,
)
def queue_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty queued orders that fifty free slots would take."""
    return queue.due(_runs(spark, sf_dir), _time(ORDERS_NOW)).limit(50).select("id", "next_run_at", "created_at")


@query(
    "queue_recovery",
    f"""
    WITH r AS ({RUNS}), x AS (SELECT *, coalesce(status = 'running' AND lease_expires_at <= TIMESTAMP '{ORDERS_NOW}', false) AS e FROM r)
    SELECT CASE WHEN e AND attempt >= max_attempts THEN 'best_effort' WHEN e THEN 'queued' ELSE status END AS status, count(*) AS n,
      count(*) FILTER (lease_recovered OR (e AND attempt < max_attempts)) AS recovered FROM x GROUP BY 1
    """,
)
def queue_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after expired leases are recovered."""
    after = queue.recover_expired(_runs(spark, sf_dir), _time(ORDERS_NOW))
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("lease_recovered").alias("recovered"))


@query("latest_attempt_ties", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1")
def latest_attempt_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the highest number of each order, as records of the latest attempt."""
    return dedupe.latest_attempts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], "l_linenumber")


@query(
    "keep_best",
    """
    SELECT l_partkey, l_discount, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1
    """,
)
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of highest discount of each part, as the most confident hit of an id."""
    columns = ["l_partkey", "l_discount", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    return dedupe.keep_best(table(spark, sf_dir, "lineitem").select(columns), ["l_partkey"], "l_discount", columns[2:])


@query(
    "conflict_groups",
    """
    SELECT l_returnflag AS type, l_partkey AS target, count(DISTINCT l_suppkey) AS agents, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'conflict' ELSE 'overlap' END AS kind
    FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1
    """,
)
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that differ over the status of a part, as agents over a target."""
    records = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("agent"), F.col("l_linestatus").alias("value"))
    return rollups.target_conflicts(records)


KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'build_log' WHEN '2-HIGH' THEN 'result_package' WHEN '3-MEDIUM' THEN 'memory_record' WHEN '4-NOT SPECIFIED' THEN 'runtime_trace' ELSE 'other' END"
CATEGORY = "CASE kind WHEN 'build_log' THEN 'logs' WHEN 'runtime_trace' THEN 'logs' WHEN 'result_package' THEN 'package' WHEN 'memory_record' THEN 'memory' ELSE 'derived' END"


@query(
    "retention_matrix",
    f"""
    WITH a AS (SELECT {KIND} AS kind, o_orderdate AS made FROM orders), b AS (SELECT *, {CATEGORY} AS category FROM a),
    c AS (SELECT *, CASE category WHEN 'package' THEN 'archive' WHEN 'logs' THEN 'ephemeral' ELSE 'project' END AS retention_class FROM b),
    d AS (SELECT *, CASE WHEN retention_class = 'ephemeral' THEN made + INTERVAL 7 DAY END AS expires_at FROM c)
    SELECT category, retention_class, count(*) AS n, count(*) FILTER (coalesce(expires_at <= TIMESTAMP '1995-01-01 00:00:00', false)) AS expired,
      count(*) FILTER (coalesce(expires_at <= TIMESTAMP '1995-01-01 00:00:00', false) AND category = 'logs') AS matched FROM d GROUP BY 1, 2
    """,
)
def retention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts by priority: their retention, what is expired and what a clean-up of logs covers."""
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "build_log").when(p == "2-HIGH", "result_package").when(p == "3-MEDIUM", "memory_record").when(p == "4-NOT SPECIFIED", "runtime_trace").otherwise("other")
    rows = table(spark, sf_dir, "orders").select(kind.alias("kind"), F.col("o_orderdate").alias("made"))
    rows = rows.withColumns({"category": retention.category(F.col("kind")), "retention_class": retention.default_class(F.col("kind"))})
    rows = rows.withColumn("expires_at", retention.default_expiry(F.col("retention_class"), F.col("made")))
    now = _time("1995-01-01 00:00:00")
    return rows.groupBy("category", "retention_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(retention.expired(F.col("expires_at"), now)).alias("expired"), F.count_if(retention.matches(now, ["logs"], None, True)).alias("matched")
    )


@query(
    "join_scope",
    "SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12",
)
def join_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve newest orders of a nation, as artifacts of a project."""
    customers = table(spark, sf_dir, "customer")
    jobs = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("project_id"))
    artifacts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.lit("order").alias("kind"), F.lit(None).cast("string").alias("deleted_at"), F.col("o_orderdate").alias("created_at"))
    found = documents.project_history(artifacts, jobs, "7", ["order"])
    return found.join(customers, F.col("job_id") == F.col("c_custkey")).select(F.col("id").alias("o_orderkey"), "c_name", F.col("created_at").alias("o_orderdate"))


@query(
    "collection_diff",
    """
    WITH p AS (SELECT DISTINCT c_mktsegment AS s, l_partkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    b AS (SELECT k FROM p WHERE s = 'BUILDING'), m AS (SELECT k FROM p WHERE s = 'MACHINERY')
    SELECT coalesce(b.k, m.k) AS l_partkey, CASE WHEN b.k IS NOT NULL AND m.k IS NOT NULL THEN 'shared' WHEN b.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side
    FROM b FULL JOIN m ON b.k = m.k
    """,
)
def collection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought by one customer segment, the other, or both."""
    segment = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(segment, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "c_mktsegment")
    return diff.sides(bought, "l_partkey", F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment") == "MACHINERY")


@query(
    "full_outer_diff",
    """
    WITH a AS (SELECT c_nationkey AS k, CAST(count(*) AS VARCHAR) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, CAST(count(*) AS VARCHAR) AS v FROM supplier GROUP BY 1)
    SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS path, a.v AS left_value, b.v AS right_value FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v ORDER BY path LIMIT 80
    """,
)
def full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose numbers of customers and suppliers differ, as paths of two captures."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("path")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return diff.value_differences(a, b, [])


@query("lineage_semi", "SELECT r_regionkey AS src, n_nationkey AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def lineage_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from regions to nations whose region is in the set."""
    regions = table(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(F.format_string("r%d", "r_regionkey").alias("id"), F.array().cast("array<string>").alias("parent_artifact_ids"))
    nations = table(spark, sf_dir, "nation").select(F.format_string("n%d", "n_nationkey").alias("id"), F.array(F.format_string("r%d", "n_regionkey")).alias("parent_artifact_ids"))
    number = lambda c: F.substring(c, 2, 9).cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType)
    return lineage.parent_edges(regions.unionByName(nations)).select(number(F.col("src")).alias("src"), number(F.col("dst")).alias("dst"))


@query(
    "top_k_overflow",
    """
    WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position FROM documents)
    SELECT source, CAST(position AS INTEGER) AS position, CAST(doc_id AS VARCHAR) AS label, CAST(0 AS BIGINT) AS more FROM r WHERE position <= 8
    UNION ALL SELECT source, 9, NULL, count(*) FROM r WHERE position > 8 GROUP BY source
    """,
)
def top_k_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight longest documents of each source and a row for the rest."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return dedupe.top_with_rest(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id").asc()], 8, "doc_id")


@query("redaction", "SELECT doc_id, 'redacted:source:' || substr(sha256(text), 1, 12) AS redacted FROM documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as excerpts that a model may not see."""
    return table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text"), "source").alias("redacted"))


@query(
    "redaction_counts",
    "SELECT CASE WHEN role = 'user' THEN 'path' ELSE 'symbol' END AS kind, count(*) AS n, count(DISTINCT substr(sha256(text), 1, 12)) AS placeholders FROM conversations GROUP BY 1",
)
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions of turns by kind."""
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "path").otherwise("symbol").alias("kind"), "text")
    return rows.withColumn("p", redact(F.col("text"), F.col("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("placeholders"))


@query(
    "token_budget",
    """
    SELECT conv_id, turn, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, CAST(sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM conversations
    """,
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt tokens of the turns of a conversation and their running total."""
    return budget.running_tokens(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "tokens", "running")


@query(
    "token_trim",
    """
    WITH t AS (SELECT conv_id, turn, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM conversations),
    w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM t)
    SELECT conv_id, turn, total - gone <= 100 AS kept FROM w
    """,
)
def token_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest turns go until a conversation is within a hundred tokens."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("step"), F.col("turn").alias("seq"), F.lit(False).alias("whole_step"), prompt_tokens(F.col("text")).alias("tokens"), F.lit(100).alias("budget"))
    return budget.trimmed(parts, "conv_id", "budget").select("conv_id", "turn", "kept")


@query(
    "marker_rules",
    """
    WITH m(kind, marker) AS (VALUES ('webpack', '__webpack_require__'), ('webpack', 'webpackJsonp'), ('webpack', 'webpackChunk'), ('vite_or_rollup', '__vitePreload'), ('vite_or_rollup', 'import.meta'), ('vite_or_rollup', 'modulepreload'),
      ('rollup', 'Object.freeze'), ('rollup', '__esModule'), ('esbuild', '__defProp'), ('esbuild', '__export'), ('esbuild', '__toESM'), ('esbuild', '__commonJS'), ('umd', 'typeof exports'), ('umd', 'define.amd'), ('umd', 'factory'),
      ('browserify', 'function r(e,n,t)'), ('browserify', 'function o(i,f)'), ('browserify', 'browserify'), ('systemjs', 'System.register'), ('systemjs', 'System.import'), ('parcel', 'parcelRequire'), ('parcel', 'newRequire'),
      ('script', 'function'), ('style', '<style')),
    k AS (SELECT DISTINCT page_id, kind FROM pages, m WHERE contains(html, marker))
    SELECT kind, count(*) AS n FROM k GROUP BY kind
    """,
)
def marker_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of runtimes in pages, and two more, since pages hold few of the runtimes' own."""
    html = F.col("html")
    own = knowledge.runtime_kinds(html)
    extra = F.array_compact(F.array(F.when(F.contains(html, F.lit("function")), "script"), F.when(F.contains(html, F.lit("<style")), "style")))
    return table(spark, sf_dir, "pages").select(F.explode(F.concat(own, extra)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("content_hash_dedupe", "SELECT sha256(text) AS hash, max(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each content hash."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.encode("text", "utf-8"), 256).alias("hash")).agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("zero_filled_counts", "SELECT s.state, count(l.doc_id) AS n FROM (VALUES ('0-0'), ('0-1'), ('1-0'), ('1-1'), ('2-0')) s(state) LEFT JOIN labels l ON s.state = l.quality || '-' || l.toxic GROUP BY s.state")
def zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by quality and toxicity, with a row for each pair, empty ones too."""
    labels = table(spark, sf_dir, "labels").select(F.concat_ws("-", "quality", "toxic").alias("pair"))
    return audit.zero_filled(labels, ["0-0", "0-1", "1-0", "1-1", "2-0"], "pair")


@query(
    "html_refs",
    """SELECT 'p' || page_id || '.html' AS html_path, CASE k WHEN 0 THEN 'js/' || page_id || '.js' WHEN 1 THEN 'css/' || page_id % 7 || '.css' ELSE 'img/' || page_id % 5 || '.png' END AS path,
      CASE k WHEN 0 THEN 'script' WHEN 1 THEN 'style' ELSE 'asset' END AS kind FROM pages, (VALUES (0), (1), (2)) t(k)""",
)
def html_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages to files of their package. The pages have none, so each gets a script, a style sheet and an image, and others that do not count."""
    n = F.col("page_id")
    tags = F.format_string('<script src="js/%d.js?v=1"></script><link rel="stylesheet" href="./css/%d.css"><img src="img/%d.png"><!-- <img src="no.png"> --><script src="https://host/no.js"></script>', n, n % 7, n % 5)
    pages = table(spark, sf_dir, "pages").select(F.format_string("p%d.html", n).alias("path"), F.concat("html", tags).alias("html"))
    return inventory.html_references(pages, "path", "html").select("html_path", "path", "kind")


@query("slug_groups", r"SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug, count(*) AS n FROM part GROUP BY 1")
def slug_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as slugs."""
    return table(spark, sf_dir, "part").groupBy(slug(F.col("p_type")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stage_rollup",
    """
    SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'best_effort' WHEN bool_and(o_orderstatus = 'O') THEN 'skipped' WHEN bool_or(o_orderstatus = 'O') THEN 'best_effort' ELSE 'pass' END AS status,
      count(*) AS n FROM orders GROUP BY 1
    """,
)
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as executions of a stage."""
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(s == "P", "best_effort").when(s == "O", "skipped").otherwise("pass").alias("status"))
    return rows.groupBy("o_custkey").agg(rollups.stage_status(F.col("status")).alias("status"), F.count(F.lit(1)).alias("n"))


@query(
    "numbered_names",
    "SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '-' || n END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)",
)
def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of parts as wanted names, numbered where they repeat."""
    return dedupe.numbered_names(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query(
    "windowed_counts",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, the batch form of the streaming count."""
    return heartbeats.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 day")
