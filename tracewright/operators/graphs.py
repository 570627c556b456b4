"""Graphs of packages and of agents' work, each as a table of nodes and a table of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.audit import tone

# Edges from an entry to the files of its package, by kind of file; columns in which an agent's artifacts stand; records shown of each role.
ENTRY_EDGES = {"script": ("chunk", "entry_includes_script"), "style": ("resource", "entry_includes_style"), "asset": ("resource", "entry_references_asset")}
ROLE_COLUMNS = {"inference": {"agent": 1, "in": 0, "out": 2, "ref": 3}, "tool": {"agent": 1, "in": 0, "out": 2, "ref": 3}, "review": {"agent": 3, "in": 2, "out": 2, "ref": 2}}
SHOWN = 18


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _nodes(df: DataFrame, graph: str, prefix: str, key: Column, kind: Column | str, label: Column | None = None, seq: Column | int = 0) -> DataFrame:
    kind, seq = (x if isinstance(x, Column) else F.lit(x) for x in (kind, seq))
    label = key if label is None else label
    return df.select("package", F.lit(graph).alias("graph"), F.concat(F.lit(prefix + ":"), key).alias("id"), kind.alias("kind"), label.alias("label"), seq.cast("long").alias("seq"))


def _edges(df: DataFrame, graph: str, src: Column, dst: Column, kind: str) -> DataFrame:
    return df.select("package", F.lit(graph).alias("graph"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))


def package_graphs(files: DataFrame, imports: DataFrame, maps: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunk, resource and module graphs of packages: nodes (package, graph, id, kind, label) and edges (package, graph, src, dst, kind).

    ``files`` has package, path, kind; ``imports`` package, importer, source, path (null for what lies outside); ``maps`` package, bundle_path, map_path,
    sources; ``symbols`` package, file, name, kind, seq. Every HTML entry has an edge to every script, style and asset of its package, as is
    asked for, so that join's result is as large as its product. Of nodes with one id the first symbol by ``seq`` stays; null paths have no node.
    """
    path, importer, bundle, map_path = F.col("path"), F.col("importer"), F.col("bundle_path"), F.col("map_path")
    of = {kind: files.where((F.col("kind") == kind) & path.isNotNull()).select("package", "path") for kind in ("html", *ENTRY_EDGES)}
    sources = maps.select("package", "map_path", F.explode("sources").alias("source"))
    inside, outside = imports.where("path is not null"), imports.where("path is null and source is not null")
    script, symbol = (lambda c: F.concat(F.lit("script:"), c)), F.concat(F.col("file"), F.lit(":"), F.col("name"))
    nodes = [
        *[_nodes(of["html"], graph, "entry", path, "entry") for graph in ("chunk", "resource")],
        *[_nodes(of["script"], graph, "script", path, "script") for graph in ("chunk", "module")],
        *[_nodes(of[kind], "resource", kind, path, kind) for kind in ("style", "asset")],
        _nodes(maps, "module", "script", bundle, "script"),
        _nodes(maps, "module", "source_map", map_path, "source_map"),
        _nodes(sources, "module", "source", F.col("source"), "source_candidate"),
        _nodes(imports, "module", "script", importer, "script"),
        _nodes(inside, "module", "script", path, "script"),
        _nodes(outside, "module", "external", F.col("source"), "external_module"),
        _nodes(symbols, "module", "script", F.col("file"), "script"),
        _nodes(symbols, "module", "symbol", symbol, F.col("kind"), F.col("name"), F.col("seq")),
    ]
    edges = [_edges(inside, graph, script(importer), script(path), "static_import") for graph in ("module", "chunk")]
    edges.append(_edges(outside, "module", script(importer), F.concat(F.lit("external:"), "source"), "static_import"))
    edges.append(_edges(maps, "module", script(bundle), F.concat(F.lit("source_map:"), map_path), "has_source_map"))
    edges.append(_edges(sources, "module", F.concat(F.lit("source_map:"), map_path), F.concat(F.lit("source:"), "source"), "maps_to_source_candidate"))
    edges.append(_edges(symbols, "module", script(F.col("file")), F.concat(F.lit("symbol:"), symbol), "declares_symbol"))
    for kind, (graph, name) in ENTRY_EDGES.items():
        pairs = of["html"].withColumnRenamed("path", "entry").join(of[kind], "package")
        edges.append(_edges(pairs, graph, F.concat(F.lit("entry:"), "entry"), F.concat(F.lit(kind + ":"), path), name))
    first = _union(nodes).where("id is not null").groupBy("package", "graph", "id").agg(F.min_by(F.struct("kind", "label"), "seq").alias("n"))
    return first.select("package", "graph", "id", "n.kind", "n.label"), _union(edges).where("src is not null and dst is not null").distinct()


def entry_points(files: DataFrame) -> DataFrame:
    """(package, path): the HTML files of a package, or its scripts if it has none."""
    pages = files.where("kind = 'html'").select("package", "path")
    return pages.unionByName(files.where("kind = 'script'").select("package", "path").join(pages.select("package").distinct(), "package", "left_anti"))


def graph_warnings(files: DataFrame, maps: DataFrame) -> DataFrame:
    """(package, graph, warning): scripts without an entry, packages without source maps, packages without styles and assets."""
    seen = files.groupBy("package").agg(*[F.bool_or(F.col("kind") == kind).alias(kind) for kind in ("html", *ENTRY_EDGES)])
    seen = seen.join(maps.select("package", F.lit(True).alias("mapped")).distinct(), "package", "left")
    tell = lambda graph, warning, rule: F.when(rule, F.struct(F.lit(graph).alias("graph"), F.lit(warning).alias("warning")))
    warnings = F.array_compact(
        F.array(
            tell("chunk", "no_html_entry", ~F.col("html") & F.col("script")),
            tell("chunk", "no_source_map", F.col("mapped").isNull()),
            tell("resource", "no_resources", ~F.col("style") & ~F.col("asset")),
        )
    )
    return seen.select("package", F.explode(warnings).alias("w")).select("package", "w.graph", "w.warning")


def agent_flow(records: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flow of agents' work: nodes (job_id, id, kind, title, tone, column, detail) and edges (job_id, src, dst, label).

    ``records`` has job_id, role (inference, tool, review), seq, id, title, status, failure_class, inputs, outputs (arrays of artifact ids) and refs
    (array of artifact_id, label); of each role the first 18 of a job are shown. An artifact stands in the column in which it is met first; one that is not among
    ``artifacts`` (job_id, id, kind, stage) is a placeholder. Reviews are led to by all their artifacts, other records lead to outputs and evidence.
    """
    rank = F.row_number().over(Window.partitionBy("job_id", "role").orderBy("seq", "id"))
    shown = records.withColumn("shown", rank).where(F.col("shown") <= SHOWN)
    role = F.create_map(*[F.lit(x) for n, name in enumerate(ROLE_COLUMNS) for x in (name, n)])[F.col("role")]
    column = lambda part: F.create_map(*[F.lit(x) for name, by in ROLE_COLUMNS.items() for x in (name, by[part])])[F.col("role")]
    item = lambda part, artifact, label: F.struct(F.lit(part).alias("part"), column(part).alias("column"), artifact.alias("artifact_id"), label.alias("label"))
    none = F.array().cast("array<struct<part:string,column:int,artifact_id:string,label:string>>")
    every = F.concat(
        F.coalesce(F.transform("inputs", lambda x: item("in", x, F.lit("input"))), none),
        F.coalesce(F.transform("outputs", lambda x: item("out", x, F.lit("output"))), none),
        F.coalesce(F.transform("refs", lambda x: item("ref", x["artifact_id"], x["label"])), none),
    )
    agent = F.concat_ws(":", F.lit("agent"), "role", "id")
    links = shown.select("job_id", "role", agent.alias("agent"), role.alias("order"), "seq", F.posexplode(every).alias("position", "x")).select("*", "x.*").where("artifact_id is not null")
    artifact, out = F.concat(F.lit("artifact:"), "artifact_id"), (F.col("part") != "in") & (F.col("role") != "review")
    edges = links.select("job_id", F.when(out, F.col("agent")).otherwise(artifact).alias("src"), F.when(out, artifact).otherwise(F.col("agent")).alias("dst"), "label")
    workers = shown.select(
        "job_id",
        agent.alias("id"),
        F.when(F.col("role") == "inference", "agent").otherwise(F.col("role")).alias("kind"),
        "title",
        F.when((F.col("role") != "inference") & (F.coalesce("failure_class", F.lit("")) != "none"), "fail").otherwise(tone(F.col("status"))).alias("tone"),
        column("agent").alias("column"),
        F.lit(None).cast("string").alias("detail"),
    )
    met = links.groupBy("job_id", "artifact_id").agg(F.min_by("column", F.struct("order", "seq", "agent", "position")).alias("column"))
    known = artifacts.select("job_id", F.col("id").alias("artifact_id"), "kind", "stage").dropDuplicates(["job_id", "artifact_id"])
    held = met.join(known, ["job_id", "artifact_id"], "left").select(
        "job_id",
        artifact.alias("id"),
        F.lit("artifact").alias("kind"),
        F.coalesce("kind", F.lit("artifact")).alias("title"),
        F.when(F.col("kind").isNull(), "warn").otherwise("neutral").alias("tone"),
        "column",
        F.concat_ws(" / ", "stage", "artifact_id").alias("detail"),
    )
    return workers.unionByName(held), edges
