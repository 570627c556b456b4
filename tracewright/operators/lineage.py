"""Lineage and dependency graphs as tables of nodes (id, ...) and edges (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.dedupe import keep_one


def parent_edges(artifacts: DataFrame) -> DataFrame:
    """(src, dst): an edge from every parent that is in the set to its child; dangling parents have none."""
    edges = artifacts.select(F.explode("parent_artifact_ids").alias("src"), F.col("id").alias("dst"))
    return edges.join(artifacts.select(F.col("id").alias("src")), "src", "left_semi")


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def unique_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    return keep_one(nodes, ["id"], [F.col(seq).asc()])


def unique_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    return keep_one(edges, ["src", "dst", "kind"], [F.col(seq).asc()])


def graph_problems(specs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name, problem): duplicate names, missing dependencies, dependencies in the same or a later stage.

    ``specs`` has name, stage_order; ``dependencies`` has name, needs. A graph whose dependencies all lie in earlier stages has no cycle.
    """
    twice = specs.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate").alias("problem"))
    stages = specs.groupBy("name").agg(F.min("stage_order").alias("stage"))
    needed = dependencies.join(stages.select(F.col("name").alias("needs"), F.col("stage").alias("before")), "needs", "left").join(stages, "name")
    missing = needed.where("before is null").select("name", F.lit("missing").alias("problem"))
    late = needed.where("before >= stage").select("name", F.lit("not_earlier").alias("problem"))
    return twice.union(missing).union(late).distinct()


def blocked(executions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name, failure_class) of the nodes of which a dependency failed; of several the first by order gives the class."""
    failed = executions.where("status = 'fail'").select(F.col("name").alias("needs"), "failure_class")
    hit = dependencies.join(failed, "needs")
    return keep_one(hit, ["name"], [F.col("position").asc(), F.col("needs").asc()]).select("name", "failure_class")


def ancestors(edges: DataFrame, max_depth: int) -> DataFrame:
    """(src, dst, depth): all pairs within ``max_depth`` edges, with the least depth. An extension: lineage is shown one step deep elsewhere.

    Every round joins the frontier to the edges and drops the pairs it knew, so cycles end.
    """
    found = edges.select("src", "dst").distinct().withColumn("depth", F.lit(1))
    frontier = found
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    for depth in range(2, max_depth + 1):
        reach = frontier.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = reach.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found
