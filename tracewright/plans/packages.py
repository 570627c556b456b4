"""Operators over packages, graphs, releases, knowledge and reports, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import graphs, inventory, knowledge, queue, releases, reports
from tracewright.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Parts as files, ``size`` of them in a package."""
    key = F.col("p_partkey")
    kind = F.when(key % 10 == 0, "html").when(key % 10 < 5, "script").when(key % 10 < 7, "style").otherwise("asset")
    return table(spark, sf_dir, "part").select(F.floor(key / size).cast("string").alias("package"), _text("f", key).alias("path"), kind.alias("kind"), "p_partkey", "p_size", "p_brand")


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sf_dir, 50)
    key = F.col("p_partkey")
    imports = files.where("kind = 'script'").select("package", F.col("path").alias("importer"), _text("./m", F.col("p_size")).alias("source"), F.when(F.col("p_size") % 2 == 0, _text("f", key + 1)).alias("path"))
    maps = files.where(key % 10 == 1).select("package", F.col("path").alias("bundle_path"), _text(F.col("path"), ".map").alias("map_path"), F.array(F.col("p_size").cast("string"), "p_brand").alias("sources"))
    symbols = files.where(key % 10 == 2).select("package", F.col("path").alias("file"), F.col("p_brand").alias("name"), F.explode(F.array(F.struct(F.lit("variable").alias("kind"), F.lit(2).alias("seq")), F.struct(F.lit("function").alias("kind"), F.lit(1).alias("seq")))).alias("s")).select("package", "file", "name", "s.*")
    return graphs.package_graphs(files.select("package", "path", "kind"), imports, maps, symbols)


FILES = """SELECT CAST(p_partkey // {size} AS VARCHAR) AS package, 'f' || p_partkey AS path, p_partkey AS k, p_size AS s, p_brand AS b,
  CASE WHEN p_partkey % 10 = 0 THEN 'html' WHEN p_partkey % 10 < 5 THEN 'script' WHEN p_partkey % 10 < 7 THEN 'style' ELSE 'asset' END AS kind FROM part"""
PACKAGES = FILES.format(size=50)


@query(
    "package_graph_nodes",
    f"""WITH f AS ({PACKAGES}) SELECT DISTINCT package, graph, id, kind, label FROM (
      SELECT package, unnest(['chunk', 'resource']) AS graph, 'entry:' || path AS id, 'entry' AS kind, path AS label FROM f WHERE kind = 'html'
      UNION ALL SELECT package, unnest(['chunk', 'module']), 'script:' || path, 'script', path FROM f WHERE kind = 'script'
      UNION ALL SELECT package, 'resource', kind || ':' || path, kind, path FROM f WHERE kind IN ('style', 'asset')
      UNION ALL SELECT package, 'module', 'source_map:' || path || '.map', 'source_map', path || '.map' FROM f WHERE k % 10 = 1
      UNION ALL SELECT package, 'module', 'source:' || c, 'source_candidate', c FROM (SELECT package, unnest([CAST(s AS VARCHAR), b]) AS c FROM f WHERE k % 10 = 1)
      UNION ALL SELECT package, 'module', 'script:f' || (k + 1), 'script', 'f' || (k + 1) FROM f WHERE kind = 'script' AND s % 2 = 0
      UNION ALL SELECT package, 'module', 'external:./m' || s, 'external_module', './m' || s FROM f WHERE kind = 'script' AND s % 2 = 1
      UNION ALL SELECT package, 'module', 'symbol:' || path || ':' || b, 'function', b FROM f WHERE k % 10 = 2)""",
)
def package_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the three graphs of parts that stand for files."""
    return _graphs(spark, sf_dir)[0]


@query(
    "package_graph_edges",
    f"""WITH f AS ({PACKAGES}) SELECT DISTINCT package, graph, src, dst, kind FROM (
      SELECT e.package, CASE f.kind WHEN 'script' THEN 'chunk' ELSE 'resource' END AS graph, 'entry:' || e.path AS src, f.kind || ':' || f.path AS dst,
        CASE f.kind WHEN 'script' THEN 'entry_includes_script' WHEN 'style' THEN 'entry_includes_style' ELSE 'entry_references_asset' END AS kind
        FROM f AS e JOIN f USING (package) WHERE e.kind = 'html' AND f.kind <> 'html'
      UNION ALL SELECT package, unnest(['chunk', 'module']), 'script:' || path, 'script:f' || (k + 1), 'static_import' FROM f WHERE kind = 'script' AND s % 2 = 0
      UNION ALL SELECT package, 'module', 'script:' || path, 'external:./m' || s, 'static_import' FROM f WHERE kind = 'script' AND s % 2 = 1
      UNION ALL SELECT package, 'module', 'script:' || path, 'source_map:' || path || '.map', 'has_source_map' FROM f WHERE k % 10 = 1
      UNION ALL SELECT package, 'module', 'source_map:' || path || '.map', 'source:' || unnest([CAST(s AS VARCHAR), b]), 'maps_to_source_candidate' FROM f WHERE k % 10 = 1
      UNION ALL SELECT package, 'module', 'script:' || path, 'symbol:' || path || ':' || b, 'declares_symbol' FROM f WHERE k % 10 = 2)""",
)
def package_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir)[1]


@query("package_entry_points", f"WITH f AS ({FILES.format(size=5)}) SELECT package, path FROM f WHERE kind = 'html' OR (kind = 'script' AND package NOT IN (SELECT package FROM f WHERE kind = 'html'))")
def package_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML files, or the scripts of packages that have none."""
    return graphs.entry_points(_files(spark, sf_dir, 5))


@query(
    "package_warnings",
    f"""WITH f AS ({FILES.format(size=3)}), p AS (SELECT package, bool_or(kind = 'html') AS h, bool_or(kind = 'script') AS s, bool_or(kind IN ('style', 'asset')) AS r, bool_or(k % 10 = 1) AS m FROM f GROUP BY 1)
      SELECT package, 'chunk' AS graph, 'no_html_entry' AS warning FROM p WHERE NOT h AND s UNION ALL SELECT package, 'chunk', 'no_source_map' FROM p WHERE NOT m UNION ALL SELECT package, 'resource', 'no_resources' FROM p WHERE NOT r""",
)
def package_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir, 3)
    return graphs.graph_warnings(files, files.where("p_partkey % 10 = 1"))


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as records of a customer's job, with artifacts a0 to a10 of which six are known."""
    key = F.col("o_orderkey")
    item = lambda n: _text("a", key % n)
    records = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"),
        F.when(key % 3 == 0, "inference").when(key % 3 == 1, "tool").otherwise("review").alias("role"),
        key.alias("seq"),
        key.cast("string").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("retry").alias("status"),
        F.when(key % 4 == 0, "timeout").otherwise("none").alias("failure_class"),
        F.array(item(7)).alias("inputs"),
        F.array(item(5)).alias("outputs"),
        F.array(F.struct(item(11).alias("artifact_id"), F.lit("seen").alias("label"))).alias("refs"),
    )
    n = F.col("n")
    artifacts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).select("job_id", _text("a", n).alias("id"), _text("k", n).alias("kind"), F.lit("s").alias("stage"))
    return graphs.agent_flow(records, artifacts)


RECORDS = """SELECT o_custkey AS job_id, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'inference' WHEN 1 THEN 'tool' ELSE 'review' END AS role, o_orderkey % 3 AS o, o_orderpriority AS title,
  CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'warn' END AS tone FROM orders QUALIFY row_number() OVER (PARTITION BY job_id, role ORDER BY o_orderkey) <= 18"""
LINKS = f"""SELECT job_id, k, o, role, 'agent:' || role || ':' || k AS agent, unnest([1, 2, 3]) AS part, 'artifact:a' || unnest([k % 7, k % 5, k % 11]) AS artifact, unnest(['input', 'output', 'seen']) AS label FROM ({RECORDS})"""


@query(
    "agent_flow_nodes",
    f"""SELECT job_id, 'agent:' || role || ':' || k AS id, CASE role WHEN 'inference' THEN 'agent' ELSE role END AS kind, title, CASE WHEN role <> 'inference' AND k % 4 = 0 THEN 'fail' ELSE tone END AS tone,
        CASE role WHEN 'review' THEN 3 ELSE 1 END AS "column", NULL AS detail FROM ({RECORDS})
      UNION ALL SELECT job_id, artifact, 'artifact', CASE WHEN n <= 5 THEN 'k' || n ELSE 'artifact' END, CASE WHEN n <= 5 THEN 'neutral' ELSE 'warn' END, c, CASE WHEN n <= 5 THEN 's / ' ELSE '' END || 'a' || n
        FROM (SELECT job_id, artifact, CAST(artifact[11:] AS INTEGER) AS n, CASE WHEN role = 'review' THEN 2 WHEN part = 1 THEN 0 ELSE part END AS c FROM ({LINKS}) QUALIFY row_number() OVER (PARTITION BY job_id, artifact ORDER BY o, k, part) = 1)""",
)
def agent_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents, tools and reviews of customers' orders, and the artifacts they meet."""
    return _flow(spark, sf_dir)[0]


@query(
    "agent_flow_edges",
    f"SELECT job_id, CASE WHEN part = 1 OR role = 'review' THEN artifact ELSE agent END AS src, CASE WHEN part = 1 OR role = 'review' THEN agent ELSE artifact END AS dst, label FROM ({LINKS})",
)
def agent_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir)[1]


@query(
    "registry_digests",
    """WITH i AS (SELECT s_suppkey AS image_id, 'v' || s_suppkey AS service, 'r' || s_suppkey || ':1' AS tag, 'r' || s_suppkey AS repository FROM supplier),
      d AS (SELECT s_suppkey AS position, CASE WHEN s_suppkey % 3 <> 1 AND s_suppkey % 6 <> 2 THEN 'v' || s_suppkey END AS service,
        CASE s_suppkey % 3 WHEN 0 THEN 'sha256:' || sha256(s_name) WHEN 1 THEN 'sha256:' || sha256(s_name) ELSE 'x' END AS digest, CASE WHEN s_suppkey % 3 = 1 THEN 'r' || s_suppkey || '@' END AS prefix FROM supplier),
      m AS (SELECT image_id, any_value(i.service) AS service, any_value(tag) AS version_tag, any_value(repository) AS repository, arg_min(digest, position) AS found, min(position) AS p
        FROM i LEFT JOIN d ON d.service = i.service OR d.prefix = i.repository || '@' GROUP BY 1)
      SELECT image_id, service, version_tag, nullif(found, 'x') AS digest, repository || '@' || nullif(found, 'x') AS reference, CASE WHEN p IS NULL THEN 'registryDigests.' || service WHEN found = 'x' THEN 'registryDigests.' || service || '.digest' END AS missing FROM m""",
)
def registry_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as images and as entries of a registry: by service, by reference, with a bad digest, or not at all."""
    key, digest = F.col("s_suppkey"), _text("sha256:", F.sha2("s_name", 256))
    suppliers = table(spark, sf_dir, "supplier")
    images = suppliers.select(key.alias("image_id"), _text("v", key).alias("service"), _text("r", key, ":1").alias("version_tag"), F.lit(None).cast("string").alias("repository"))
    entries = suppliers.select(
        key.alias("position"),
        F.when((key % 3 != 1) & (key % 6 != 2), _text("v", key)).alias("service"),
        F.lit("").alias("tag"),
        F.when(key % 3 == 0, digest).when(key % 3 == 2, "x").alias("digest"),
        F.when(key % 3 == 1, _text("r", key, "@", digest)).alias("reference"),
    )
    return releases.matched_digests(images, entries)


@query("release_checks", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'fail' ELSE 'pass' END AS status, count(*) AS checks, coalesce(string_agg('c' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'R'), '') AS failed FROM lineitem GROUP BY 1")
def release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as checks of their order; returned ones failed."""
    checks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), _text("c", F.col("l_linenumber")).alias("name"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("status"))
    return releases.check_rollup(checks, ["l_orderkey"]).withColumn("failed", F.array_join("failed", ","))


@query(
    "evaluation_runs",
    """WITH r AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(round(10000 * (o_orderkey % 4) / (o_orderkey % 5)) AS BIGINT) END AS v, o_orderkey % 3 * 5000 AS a FROM orders)
      SELECT o_custkey, count(*) AS runs, round(avg(k % 100), 3) AS mean_duration_ms, ((2 * sum(v) + count(*)) // (2 * count(*))) / 10000 AS mean_validation_rate,
        ((2 * sum(a) + count(*)) // (2 * count(*))) / 10000 AS mean_approval_rate, CAST(sum(k % 3) AS BIGINT) AS applied, CAST(sum(k % 2) AS BIGINT) AS conflicts FROM r GROUP BY 1""",
)
def evaluation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of an evaluation."""
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select("o_custkey", (key % 100).alias("duration_ms"), (key % 4).alias("valid"), (key % 5).alias("executions"), (key % 3).alias("approved"), F.lit(2).alias("actions"), (key % 3).alias("applied"), (key % 2).alias("conflicts"))
    return releases.evaluation(releases.run_rates(runs), ["o_custkey"])


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    some = lambda rule: F.when(rule, F.array(F.lit("x")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        some(key % 2 == 0).alias("entries"),
        F.array_repeat(F.lit("x"), (size % 3).cast("int")).alias("scripts"),
        some(key % 3 == 0).alias("styles"),
        some(key % 5 == 0).alias("source_maps"),
        some(key % 7 == 0).alias("manifests"),
        F.when(key % 11 == 0, F.array(F.lit("multi_chunk"))).when(key % 13 == 0, F.array("p_brand", F.lit("--"))).alias("runtimes"),
        (size % 2 == 0).alias("has_exports"),
        F.when(size % 5 == 0, True).alias("single_bundle"),
    )


@query(
    "knowledge_structure",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'knowledge_html_entry' ELSE 'knowledge_browser_shim_missing_html_entry' END AS id, CASE WHEN p_partkey % 2 = 0 THEN 'runtime_entry' ELSE 'browser_shim' END AS category, CASE WHEN p_partkey % 2 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.72 AS DOUBLE) END AS confidence FROM part
      UNION ALL SELECT p_partkey, 'knowledge_source_map_available', 'source_map', 0.7 FROM part WHERE p_partkey % 5 = 0
      UNION ALL SELECT p_partkey, 'knowledge_esm_exports', 'module_pattern', 0.65 FROM part WHERE p_size % 2 = 0
      UNION ALL SELECT p_partkey, 'knowledge_runtime_multi_chunk', 'build_runtime', 0.74 FROM part WHERE p_size % 3 = 2 OR p_partkey % 11 = 0
      UNION ALL SELECT p_partkey, 'knowledge_runtime_single_bundle', 'build_runtime', 0.68 FROM part WHERE p_size % 5 = 0
      UNION ALL SELECT p_partkey, 'knowledge_runtime_manifest', 'build_runtime', 0.64 FROM part WHERE p_partkey % 7 = 0
      UNION ALL SELECT p_partkey, 'knowledge_runtime_stylesheet_assets', 'build_runtime', 0.62 FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, 'knowledge_detected_runtime_' || CASE WHEN p_partkey % 11 = 0 THEN 'multi_chunk' ELSE regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') END, 'build_runtime', 0.66 FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0""",
)
def knowledge_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages: hits of their structure and of detected runtimes."""
    packages = _packages(spark, sf_dir)
    return knowledge.structural_hits(packages, ["p_partkey"]).unionByName(knowledge.runtime_hits(packages, ["p_partkey"])).select("p_partkey", "id", "category", "confidence")


@query(
    "knowledge_shims",
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
      SELECT doc_id, 'knowledge_browser_shim_dom_globals' AS id, CAST(0.66 AS DOUBLE) AS confidence FROM d WHERE regexp_matches(t, 'window|document|navigator|location')
      UNION ALL SELECT doc_id, 'knowledge_browser_shim_node_globals', 0.65 FROM d WHERE regexp_matches(t, 'process|buffer|__dirname|__filename|global')
      UNION ALL SELECT doc_id, 'knowledge_browser_shim_global_this', 0.6 FROM d WHERE contains(t, 'globalthis')
      UNION ALL SELECT doc_id, 'knowledge_browser_shim_generated_host', 0.73 FROM d WHERE doc_id % 2 = 1""",
)
def knowledge_shims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the names of packages, every second of them without an entry."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"))).alias("entries"), F.array(F.lit("x")).alias("scripts"))
    return knowledge.shim_hits(docs, ["doc_id"], "text").select("doc_id", "id", "confidence")


KINDS = ["build_log", "runtime_validation", "runtime_comparison", "review_run", "repair_instruction", "runtime_trace"]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % 6 + 1).cast("int")).alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "retry").otherwise("pass").alias("status"),
        F.when(customer % 3 == 1, "timeout").when(customer % 3 == 2, "").alias("failure_class"),
        F.when(customer % 2 == 0, F.col("o_orderpriority")).alias("review_type"),
        F.lit("phase 2").alias("phase"),
        F.when(customer % 2 == 0, F.col("o_orderpriority")).alias("target"),
        F.lit("build").alias("target_stage"),
        F.when(customer % 3 == 0, "low").alias("risk_level"),
        F.when(customer % 5 == 0, F.array(F.lit("local"), F.lit("Remote 2"))).alias("runners"),
        key.cast("string").alias("artifact_id"),
    )


EVIDENCE = """SELECT o_orderkey, o_orderkey % 6 AS kind, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'retry' ELSE 'pass' END AS status, CASE WHEN o_custkey % 3 = 1 THEN 'timeout' ELSE 'none' END AS failure,
  CASE WHEN o_custkey % 2 = 0 THEN regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') END AS p, o_custkey % 3 = 0 AS low, o_custkey % 5 = 0 AS runs FROM orders"""


@query(
    "knowledge_prior",
    f"""WITH e AS ({EVIDENCE}) SELECT * FROM (
      SELECT o_orderkey, CASE kind WHEN 0 THEN 'knowledge_validation_build_' || coalesce(p, 'phase_2') || '_' || failure WHEN 1 THEN 'knowledge_validation_runtime_' || coalesce(p, 'runtime') || '_' || failure
          WHEN 2 THEN 'knowledge_validation_runtime_comparison_' || status WHEN 3 THEN 'knowledge_review_feedback_' || coalesce(p, 'review') || '_' || failure WHEN 5 THEN 'knowledge_validation_runtime_trace_' || coalesce(p, 'runtime_trace') || '_' || failure END AS id,
        CASE kind WHEN 0 THEN CAST(0.78 AS DOUBLE) WHEN 1 THEN 0.8 WHEN 2 THEN 0.82 WHEN 3 THEN 0.76 ELSE 0.79 END AS confidence FROM e WHERE kind <> 4 AND status <> 'pass'
      UNION ALL SELECT o_orderkey, 'knowledge_browser_shim_runtime_boundary_local_remote_2', 0.77 FROM e WHERE kind = 5 AND runs
      UNION ALL SELECT o_orderkey, 'knowledge_repair_case_build_' || CASE WHEN low THEN 'low' ELSE 'unknown' END, CASE WHEN low THEN 0.84 ELSE 0.72 END FROM e WHERE kind = 4)""",
)
def knowledge_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evidence of a job."""
    return knowledge.prior_hits(_evidence(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "id", "confidence")


@query(
    "knowledge_history",
    f"""WITH e AS ({EVIDENCE})
      SELECT o_orderkey, 'knowledge_historical_repair_case_build_' || CASE WHEN low THEN 'low' ELSE 'unknown' END || '_' || o_orderkey AS id, CASE WHEN low THEN CAST(0.66 AS DOUBLE) ELSE CAST(0.58 AS DOUBLE) END AS confidence FROM e WHERE kind = 4
      UNION ALL SELECT o_orderkey, 'knowledge_historical_review_feedback_' || coalesce(p, 'review') || '_' || failure || '_' || o_orderkey, 0.62 FROM e WHERE kind = 3 AND status <> 'pass'
      UNION ALL SELECT o_orderkey, 'knowledge_historical_runtime_comparison_' || status || '_' || CASE failure WHEN 'none' THEN 'unknown' ELSE failure END || '_' || o_orderkey, 0.64 FROM e WHERE kind = 2 AND status <> 'pass'""",
)
def knowledge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evidence of earlier jobs."""
    return knowledge.historical_hits(_evidence(spark, sf_dir), ["o_orderkey"], "artifact_id").select("o_orderkey", "id", "confidence")


@query(
    "feedback_counts",
    """WITH h AS (SELECT o_custkey, o_orderkey % 4 AS c, o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 AS usable FROM orders),
      n AS (SELECT o_custkey, count(*) FILTER (c = 0) AS validation, count(*) FILTER (c = 1 AND usable) AS low_risk_repairs, count(*) FILTER (c = 1 AND NOT usable) AS audit_only_repairs, count(*) FILTER (c >= 2) AS historical FROM h GROUP BY 1)
      SELECT *, CASE WHEN validation > 0 OR audit_only_repairs > 0 THEN 'best_effort' ELSE 'pass' END AS status FROM n""",
)
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of their customer's job."""
    key = F.col("o_orderkey")
    category = F.when(key % 4 == 0, "validation_feedback").when(key % 4 == 1, "repair_case").when(key % 4 == 2, "historical_repair_case").otherwise("historical_validation_feedback")
    hits = table(spark, sf_dir, "orders").select("o_custkey", category.alias("category"), F.when(key % 3 == 0, "low").alias("risk"), (key % 5).alias("n_actions"))
    return knowledge.feedback_counts(hits, ["o_custkey"])


@query(
    "missing_dependencies",
    """WITH u AS (SELECT p_brand AS package, 'd/f' || p_partkey || '.js' AS importer, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '../../x.js' WHEN 1 THEN './f' || (p_partkey + 1) || '.js?v=1' WHEN 2 THEN './dir' ELSE '../e/../d/f' || p_partkey || '.js' END AS specifier FROM part),
      f AS (SELECT DISTINCT p_brand AS package, 'd/f' || p_partkey || '.js' AS path FROM part WHERE p_partkey % 2 = 0),
      r AS (SELECT *, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'd/f' || (k + 1) || '.js' WHEN 2 THEN 'd/dir' ELSE 'd/f' || k || '.js' END AS resolved_path FROM u)
      SELECT package, importer, specifier, resolved_path, CASE k % 4 WHEN 0 THEN 'unsafe_relative_dependency' WHEN 2 THEN 'dependency_path_conflict' ELSE 'missing_static_relative_dependency' END AS reason,
        CASE WHEN k % 4 IN (0, 2) THEN 'unsupported' ELSE 'generated' END AS status FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.package = r.package AND f.path = r.resolved_path)""",
)
def missing_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scripts that import a neighbour, a directory, themselves, or what lies outside."""
    key, own = F.col("p_partkey"), lambda n: _text("d/f", n, ".js")
    specifier = F.when(key % 4 == 0, "../../x.js").when(key % 4 == 1, _text("./f", key + 1, ".js?v=1")).when(key % 4 == 2, "./dir").otherwise(_text("../e/../d/f", key, ".js"))
    parts = table(spark, sf_dir, "part").withColumn("package", F.col("p_brand"))
    paths = parts.where(key % 2 == 0).select("package", own(key).alias("path"), F.lit(True).alias("is_file"))
    paths = paths.unionByName(parts.select("package", F.lit("d/dir").alias("path"), F.lit(False).alias("is_file")))
    return inventory.missing_dependencies(parts.select("package", own(key).alias("importer"), specifier.alias("specifier")), paths)


@query(
    "import_usage",
    """SELECT l_orderkey AS package, l_returnflag AS importer, l_linestatus AS specifier, coalesce(string_agg(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_linenumber END, ',' ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_linenumber END), '') AS names,
      coalesce(bool_or(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity > 20 END), false) AS default_import, coalesce(bool_or(l_linenumber = 1), false) AS side_effect_only FROM lineitem GROUP BY 1, 2, 3""",
)
def import_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as imports of their order."""
    line, no = F.col("l_linenumber"), F.lit(None)
    usages = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("package"),
        F.col("l_returnflag").alias("importer"),
        F.col("l_linestatus").alias("specifier"),
        F.when(line % 2 == 0, _text("n", line)).alias("name"),
        no.cast("string").alias("exported_as"),
        F.when(line % 3 == 0, F.col("l_quantity") > 20).alias("default_import"),
        (line == 1).alias("side_effect_only"),
        no.cast("boolean").alias("namespace_import"),
        no.cast("boolean").alias("export_all"),
    )
    return inventory.import_usage(usages).select("package", "importer", "specifier", F.array_join("names", ",").alias("names"), "default_import", "side_effect_only")


@query(
    "review_report_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'review' END AS review_type, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE CAST(o_orderkey % 4 AS INTEGER) END AS attempt, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'fail' END, 'unknown') AS status,
      CAST(o_orderkey % 12 AS INTEGER) AS ref_count, CAST(least(8, o_orderkey % 12) AS INTEGER) AS listed, o_orderkey || ',log' || CASE WHEN o_orderkey % 12 > 0 THEN ',e' ELSE '' END AS links FROM orders""",
)
def review_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews, with up to eleven references to one artifact."""
    key = F.col("o_orderkey")
    reviews = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.lit("review").alias("stage"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("review_type"),
        F.when(key % 4 != 3, key % 4).cast("int").alias("attempt"),
        F.when(F.col("o_orderstatus") == "F", "fail").alias("status"),
        F.lit(None).cast("string").alias("failure_class"),
        F.lit("log").alias("logs_id"),
        F.array(F.lit("log")).alias("repair_ids"),
        F.array_repeat(F.struct(F.lit("e").alias("artifact_id"), F.lit("seen").alias("label")), (key % 12).cast("int")).alias("refs"),
    )
    return reports.review_rows(reviews).select("id", "review_type", "attempt", "status", "ref_count", F.size("refs").alias("listed"), F.array_join("links", ",").alias("links"))


@query(
    "attachment_counts",
    """WITH r AS (SELECT p_brand, CASE WHEN p_partkey % 4 = 3 OR p_partkey % 4 IS NULL THEN 1 WHEN p_partkey % 4 = 2 THEN 2 WHEN p_size > 30 THEN 3 WHEN p_partkey % 7 = 0 THEN 4 END AS why FROM part)
      SELECT p_brand, count(*) FILTER (why IS NULL) AS included, count(*) FILTER (why IS NOT NULL) AS omitted FROM r GROUP BY 1""",
)
def attachment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as artifacts, some of other kinds, too large, or without a file."""
    key = F.col("p_partkey")
    artifacts = table(spark, sf_dir, "part").select("p_brand", _text("k", key % 4).alias("kind"), F.col("p_size").alias("size"), F.when(key % 7 != 0, True).alias("is_file"))
    return reports.attachment_counts(artifacts, reports.attachment_reason(include_kinds=["k0", "k1", "k2"], exclude_kinds=["k2"], max_bytes=30), ["p_brand"])


@query(
    "action_audit",
    """WITH a AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'blank_field' WHEN o_orderkey % 3 = 0 THEN 'unsupported_action:delete' END AS problem FROM orders)
      SELECT o_custkey, count(*) FILTER (problem IS NULL) AS approved, count(problem) AS rejected, coalesce(string_agg(DISTINCT problem, ',' ORDER BY problem), '') AS problems FROM a GROUP BY 1""",
)
def action_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repair actions of their customer's instruction."""
    key = F.col("o_orderkey")
    problem = reports.action_problem(F.when(key % 3 == 0, "delete").otherwise("add_package_script"), F.lit("p"), F.when(key % 5 == 0, " ").otherwise("v"), F.lit("r"))
    return reports.actions_by_artifact(table(spark, sf_dir, "orders").select("o_custkey", problem.alias("problem")), ["o_custkey"]).withColumn("problems", F.array_join("problems", ","))


@query(
    "planner_selections",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'planner_execution_missing' WHEN o_orderstatus = 'F' THEN 'planner_execution_fail:none' WHEN o_orderkey % 5 = 0 THEN 'planner_selection_empty'
        WHEN o_orderkey % 5 = 1 THEN 'planner_selection_outside_allowlist' WHEN o_orderkey % 5 = 2 THEN 'planner_selection_unavailable' END AS fallback,
      CASE WHEN o_orderkey % 7 > 0 AND o_orderstatus <> 'F' AND o_orderkey % 5 > 2 THEN 'build' ELSE 'review,build' END AS selected FROM orders""",
)
def planner_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans of specialists, of whom build and review are at hand."""
    key, names = F.col("o_orderkey"), lambda *n: F.array(*[F.lit(x) for x in n])
    plans = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass")).alias("status"),
        F.lit("none").alias("failure_class"),
        F.when(key % 5 == 1, names("build", "other")).when(key % 5 == 2, names("runtime")).when(key % 5 > 2, names("runtime", "build")).alias("planned"),
        names("review", "build").alias("available"),
    )
    return reports.planner_selection(plans, ["build", "runtime", "review"]).select("o_orderkey", "fallback", F.array_join("selected", ",").alias("selected"))


@query(
    "queue_threshold_alerts",
    """WITH m AS (SELECT o_orderkey AS k, o_orderkey % 9 AS queued, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 100 END AS age, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 50 END AS latency, o_orderkey % 3 AS expired, (o_orderkey % 8) / 8 AS rate, o_orderstatus <> 'O' AS sick FROM orders)
      SELECT k AS o_orderkey, 'backend_unhealthy' AS code, 'critical' AS severity FROM m WHERE sick UNION ALL SELECT k, 'queue_backlog', 'warning' FROM m WHERE queued > 4 AND latency > 0
      UNION ALL SELECT k, 'queue_age_high', 'warning' FROM m WHERE age > 60 UNION ALL SELECT k, 'claim_latency_high', 'warning' FROM m WHERE latency > 30
      UNION ALL SELECT k, 'expired_running_leases', 'critical' FROM m WHERE expired > 0 UNION ALL SELECT k, 'retry_rate_high', 'warning' FROM m WHERE rate > 0.25""",
)
def queue_threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as metrics of queues."""
    key = F.col("o_orderkey")
    metrics = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "down").alias("backend_status"),
        (key % 9).alias("queued_count"),
        F.when(key % 4 > 0, key % 100).alias("oldest_queued_age_ms"),
        F.when(key % 5 > 0, key % 50).alias("claim_latency_ms"),
        (key % 3).alias("expired_running_count"),
        ((key % 8) / 8).alias("retry_rate"),
    )
    return queue.queue_alerts(metrics, ["o_orderkey"], 4, 60, 30, 0, 0.25).select("o_orderkey", "code", "severity")


@query(
    "section_search",
    """WITH d AS (SELECT o_orderkey, lower(o_orderpriority) LIKE '%urgent%' AS section, unnest([o_orderstatus, CAST(o_custkey AS VARCHAR) || 'urgent' || (o_custkey % 3)]) AS label FROM orders),
      e AS (SELECT o_orderkey, section, label, o_orderkey % 2 = 0 AND label LIKE '%urgent%' AS hit FROM d)
      SELECT o_orderkey, CAST(CASE WHEN bool_or(hit) THEN 1 ELSE 2 END AS INTEGER) AS details FROM e GROUP BY o_orderkey HAVING bool_or(section) OR bool_or(hit)""",
)
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sections of reports; every second one has a detail that matches, urgent ones match themselves."""
    detail = lambda label: F.struct(label.alias("label"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("text"))
    second = F.when(F.col("o_orderkey") % 2 == 0, _text(F.col("o_custkey"), "Urgent", F.col("o_custkey") % 3)).otherwise("x")
    none = F.lit(None).cast("array<string>")
    sections = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("a").alias("anchor"), F.lit(None).cast("string").alias("summary"), F.col("o_orderpriority").alias("title"), none.alias("artifact_ids"), none.alias("artifact_kinds"), none.alias("links"), F.array(detail(F.col("o_orderstatus")), detail(second)).alias("details"))
    return reports.matching_sections(sections, " URGENT ").select("o_orderkey", F.size("details").alias("details"))


@query(
    "fallback_sections",
    """WITH a AS (SELECT o_custkey AS job_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 4 AS kind, o_orderkey % 3 = 0 AS included FROM orders),
      h AS (SELECT job_id, id, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS position FROM a UNION ALL SELECT job_id, id, 3 FROM a WHERE included)
      SELECT c_custkey AS job_id, CAST(p AS INTEGER) AS position, h.id AS artifact_id FROM customer CROSS JOIN range(5) AS r(p) LEFT JOIN h ON h.job_id = c_custkey AND h.position = p""",
)
def fallback_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs, orders as their artifacts."""
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "audit_report").when(key % 4 == 1, "review_run").when(key % 4 == 2, "runtime_trace").otherwise("other")
    artifacts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), key.cast("string").alias("id"), kind.alias("kind"), (key % 3 == 0).alias("included"))
    return reports.fallback_sections(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")), artifacts).select("job_id", "position", "artifact_id")


@query(
    "input_summaries",
    "SELECT doc_id, coalesce(array_to_string(string_split(text, ' ')[1:8], ' '), '') AS words, coalesce(len(string_split(text, ' ')), 0) AS symbol_count FROM documents",
)
def input_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight words of documents, and how many there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("names"))
    return reports.input_summary(docs, [], "names").select("doc_id", F.array_join("symbol_sample", " ").alias("words"), F.col("symbol_count").cast("long").alias("symbol_count"))


@query("viewport_labels", "SELECT o_orderpriority AS value, arg_max(CAST(o_custkey AS VARCHAR), o_orderkey) AS label FROM orders GROUP BY 1")
def viewport_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_labels(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"), F.col("o_custkey").cast("string").alias("label"), F.col("o_orderkey").alias("seq")))


@query(
    "boundary_runners",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'r' || o_custkey % 2 WHEN 2 THEN 'r0,r1' ELSE 'r' || o_custkey % 2 || CASE o_custkey % 2 WHEN 0 THEN ',r1' ELSE '' END END AS runners FROM orders""",
)
def boundary_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners of boundaries that have none, their own, or those of their sides."""
    key, own = F.col("o_orderkey"), (F.col("o_custkey") % 2).cast("int")
    sides = F.lit('{"original": {"runnerKind": "r0"}, "reconstructed": {"runnerKind": "r1"}}')
    both = F.format_string('{"runnerKind": "r%d", "original": null, "reconstructed": {"runnerKind": "r1"}}', own)
    boundary = F.when(key % 4 == 0, '{"runnerKind": ""}').when(key % 4 == 1, F.format_string('{"runnerKind": "r%d"}', own)).when(key % 4 == 2, sides).otherwise(both)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(reports.runner_kinds(boundary), ",").alias("runners"))


@query(
    "role_violations",
    "SELECT p_partkey, CASE WHEN p_size = 7 THEN 'worker' WHEN CAST(p_size AS VARCHAR)[1] = '3' THEN 'web' ELSE 'runner' END AS owner FROM part WHERE p_size = 7 OR CAST(p_size AS VARCHAR)[1] IN ('3', '4', '5')",
)
def role_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as names of variables."""
    variables = table(spark, sf_dir, "part").select("p_partkey", _text("SIZE_", F.col("p_size")).alias("name"))
    return releases.role_violations(variables, {"SIZE_7": "worker"}, {"SIZE_4": "runner", "SIZE_5": "runner", "SIZE_3": "web"}).select("p_partkey", "owner")


@query(
    "context_policies",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cloud' WHEN 'P' THEN 'sanitized_cloud_or_local' ELSE 'local' END AS scope,
      CASE o_orderstatus WHEN 'F' THEN 'full_context_allowed_when_configured' WHEN 'P' THEN 'deterministic_context_redaction' ELSE 'local_context_only' END AS handling, o_orderstatus IN ('F', 'P') AS cloud_allowed FROM orders""",
)
def context_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of three cloud modes, one of them null."""
    mode = F.when(F.col("o_orderstatus") == "F", "cloud_allowed").when(F.col("o_orderstatus") == "P", "desensitized")
    return table(spark, sf_dir, "orders").select("o_orderkey", releases.context_policy(mode).alias("p")).select("o_orderkey", "p.*")
