"""Unique paths, keyed tables, diagnostics with other places, references in program order and limited outputs, over columns made from keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import builds, chains, inventory, paths
from tracewright.plans.registry import query
from tracewright.sources.upserts import KeyedTable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NAMES = "SELECT p_partkey AS seq, 'd' || (p_partkey % 37) AS folder, 'd' || (p_partkey % 37) || '/' || ['m.ts', 'm-2.ts', 'm-3.ts', 'm-2-2.ts', 'm', 'm-2'][1 + (p_partkey * 7 + p_size) % 6] AS path FROM part"


@query(
    "unique_paths",
    f"""
    WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS k FROM ({NAMES})),
    e AS (SELECT seq, folder, path, k, regexp_extract(path, '[^/](\\.[^./]*)$', 1) AS ext FROM p),
    s AS (
      SELECT folder, 0 AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS unique_path, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT folder FROM p)
      UNION ALL
      SELECT folder, k, seq, found, list_append(used, found) FROM (
        SELECT e.folder, e.k, e.seq, s.used,
          list_filter(list_transform(range(1, len(s.used) + 2), lambda i: CASE WHEN i = 1 THEN e.path ELSE left(e.path, len(e.path) - len(e.ext)) || '-' || i || e.ext END), lambda n: NOT list_contains(s.used, n))[1] AS found
        FROM s JOIN e ON e.folder = s.folder AND e.k = s.k + 1))
    SELECT seq, unique_path FROM s WHERE seq IS NOT NULL
    """,
)
def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules whose paths repeat, some of them numbered by themselves."""
    key = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("m.ts", "m-2.ts", "m-3.ts", "m-2-2.ts", "m", "m-2")]), (1 + (key * 7 + F.col("p_size")) % 6).cast("int"))
    modules = table(spark, sf_dir, "part").select(key.alias("seq"), F.concat(F.lit("d"), (key % 37).cast("string"), F.lit("/"), name).alias("path"))
    return paths.unique_paths(modules, "path", "seq", block=256).select("seq", "unique_path")


@query(
    "module_paths",
    """
    WITH n AS (SELECT page_id, url || ['/a/../b c.js', '//x/./y.tsx', '', '/k.d.mjs', '/no.ext/'][1 + page_id % 5] AS url FROM pages),
    c AS (SELECT page_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(replace(url, '\\', '/'), '^[a-zA-Z][a-zA-Z0-9+.-]*:/*', ''), '^/+', ''), '/'), lambda p: p NOT IN ('', '.', '..')), lambda p: regexp_replace(p, '[^A-Za-z0-9._-]', '_', 'g')), '/') AS path FROM n),
    e AS (SELECT page_id, CASE WHEN path = '' THEN 'module' ELSE path END AS path FROM c)
    SELECT page_id, path, CASE WHEN regexp_matches(path, '[^/]\\.tsx?$') THEN path WHEN regexp_matches(path, '[^/]\\.(js|mjs|cjs|jsx)$') THEN regexp_replace(path, '\\.[a-z]+$', '.ts') ELSE path || '.ts' END AS typed FROM e
    """,
)
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of modules from the URLs of pages."""
    ends = ["/a/../b c.js", "//x/./y.tsx", "", "/k.d.mjs", "/no.ext/"]
    url = F.concat("url", F.element_at(F.array(*[F.lit(e) for e in ends]), (1 + F.col("page_id") % 5).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", paths.module_path(url).alias("path")).withColumn("typed", paths.typed_path(F.col("path")))


def _kept(spark: SparkSession, name: str, schema: str, keys: tuple[str, ...]) -> KeyedTable:
    """An empty table of its own in the folder that the cluster shares."""
    return KeyedTable(spark, f"{chains.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", schema, keys, 8)


@query(
    "heartbeat_upserts",
    """
    WITH b AS (SELECT event_type AS service_role, user_id AS instance_id, event_id, value, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 3 END AS batch FROM events)
    SELECT service_role, instance_id, event_id AS beat, value FROM b QUALIFY row_number() OVER (PARTITION BY service_role, instance_id ORDER BY batch DESC, event_id DESC) = 1
    """,
)
def heartbeat_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heartbeats in batches, each put in place of the former one of its instance; the last batch comes twice."""
    beats = table(spark, sf_dir, "events").select(F.col("event_type").alias("service_role"), F.col("user_id").alias("instance_id"), F.col("event_id").alias("beat"), "value")
    kept = _kept(spark, "heartbeats", "service_role string, instance_id long, beat long, value double", ("service_role", "instance_id"))
    kept.upsert(beats.where("beat % 3 in (0, 2)"), "beat", "beats", 0)
    for _ in range(2):
        kept.upsert(beats.where("beat % 3 = 1"), "beat", "beats", 1)
    return kept.read()


@query(
    "alert_deliveries",
    """
    SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 20 THEN 'sent' ELSE 'pending' END AS delivery,
      CASE WHEN event_type = 'error' OR value > 20 THEN ts + INTERVAL 2 MINUTE ELSE ts END AS updated_at, event_type AS code
    FROM events
    """,
)
def alert_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts, of which errors and those of high value are delivered; deliveries of alerts that are not kept change nothing."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept = _kept(spark, "alerts", "id long, delivery string, updated_at timestamp_ntz, code string", ("id",))
    kept.upsert(events.select(F.col("event_id").alias("id"), F.lit("pending").alias("delivery"), F.col("ts").alias("updated_at"), F.col("event_type").alias("code")), "updated_at")
    made = events.where((F.col("event_type") == "error") | (F.col("value") > 20))
    minutes = lambda n: (F.col("ts") + F.expr(f"INTERVAL {n} MINUTE")).alias("updated_at")
    first = made.select(F.col("event_id").alias("id"), F.lit("retry").alias("delivery"), minutes(1))
    last = made.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("delivery"), minutes(2))
    unknown = made.select((-1 - F.col("event_id")).alias("id"), F.lit("sent").alias("delivery"), minutes(3))
    kept.update(first.unionByName(last).unionByName(unknown), "updated_at", ["delivery", "updated_at"])
    return kept.read()


@query(
    "diagnostic_places",
    """
    SELECT o_orderkey AS log_id, l AS number, r AS nth, 'lib/' || r || '.ts' AS path, r * 2 AS line, o_orderkey % 7 AS "column", CASE WHEN r % 2 = 0 THEN 'TS' || r END AS code
    FROM orders, range(1, 3) a(l), range(1, 4) b(r) WHERE r <= (o_orderkey + l) % 4
    """,
)
def diagnostic_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of orders with two diagnostics, each with up to three other places and some context."""
    key = F.col("o_orderkey")
    head = F.array(F.lit("noise"), F.lit("a.ts(1,2): error TS1: bad"), F.lit("b.ts:3:4 - warning TS2: odd"))
    each = table(spark, sf_dir, "orders").select(key.alias("log_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("d"))
    place = lambda r: F.when(r % 2 == 0, F.concat(F.lit("  lib/"), r.cast("string"), F.lit(".ts("), (r * 2).cast("string"), F.lit(","), (F.col("log_id") % 7).cast("string"), F.lit("): see TS"), r.cast("string"))).otherwise(
        F.concat(F.lit("lib/"), r.cast("string"), F.lit(".ts:"), (r * 2).cast("string"), F.lit(":"), (F.col("log_id") % 7).cast("string"), F.lit(" - declared here"))
    )
    many = F.when(F.col("d") > 0, (F.col("log_id") + F.col("d")) % 4).otherwise(0).cast("int")
    body = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda r: r <= many), place)
    said = F.concat(F.array(F.element_at(head, F.col("d") + 1)), F.array(F.lit("    ~~~ mark"), F.lit("")), body)
    lines = each.select("log_id", "d", F.posexplode(said).alias("i", "line")).select("log_id", (F.col("d") * 100 + F.col("i")).alias("line_no"), "line")
    return builds.related_information(lines).select("log_id", F.col("number").cast("long").alias("number"), F.col("nth").cast("long").alias("nth"), "path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "code")


@query(
    "symbol_references",
    """
    WITH t AS (SELECT doc_id AS file, unnest(range(len(ws))) AS position, unnest(ws) AS name FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
    r AS (SELECT *, CASE position % 7 WHEN 0 THEN 'declare' WHEN 3 THEN CASE WHEN position % 5 = 0 THEN 'top' ELSE 'use' END ELSE 'use' END AS role FROM t),
    s AS (SELECT file, name, min(CASE role WHEN 'top' THEN -1 WHEN 'declare' THEN position END) AS since FROM r GROUP BY ALL)
    SELECT file, count(DISTINCT name) AS names, count(*) AS refs FROM r JOIN s USING (file, name) WHERE position >= since GROUP BY file
    """,
)
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as identifiers, some of which declare their name; their references by document."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", " ")).alias("position", "name"))
    position = F.col("position")
    role = F.when(position % 7 == 0, "declare").when((position % 7 == 3) & (position % 5 == 0), "top").otherwise("use")
    found = inventory.symbol_references(words.withColumn("role", role))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("names"), F.sum("references").alias("refs"))


@query(
    "limited_outputs",
    """
    WITH w AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, strlen(source || lang) AS m, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, n + m > 4096 AS truncated, CASE WHEN n <= 4096 THEN t END AS stdout, least(m, greatest(4096 - n, 0)) AS err_bytes FROM w
    """,
)
def limited_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and sources of documents as the two outputs of runs that keep 4096 bytes; outputs that were cut are compared in tests."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), text.limited_output(F.encode("text", "utf-8"), F.encode(F.concat("source", "lang"), "utf-8"), 4096).alias("o"))
    return found.select("doc_id", "o.truncated", F.when(F.col("n") <= 4096, F.col("o.stdout")).alias("stdout"), F.octet_length("o.stderr").cast("long").alias("err_bytes"))
