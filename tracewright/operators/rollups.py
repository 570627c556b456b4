"""Verdicts over groups: conflicts, stage status, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import normalized, ordered_case
from tracewright.operators.dedupe import latest_attempts

# Values by which an inference calls its target dead.
DEAD = ["dead", "remove", "removed", "unused", "delete", "drop"]


def target_conflicts(records: DataFrame) -> DataFrame:
    """(type, target, agents, kind) where two agents or more speak of a target: a conflict if their non-null values differ, else an overlap."""
    found = records.where(F.col("target").isNotNull()).groupBy("type", "target").agg(F.count_distinct("agent").alias("agents"), F.count_distinct("value").alias("values"))
    return found.where("agents > 1").select("type", "target", "agents", F.when(F.col("values") > 1, "conflict").otherwise("overlap").alias("kind"))


def all_conflicts(records: DataFrame, executions: DataFrame) -> DataFrame:
    """(key, severity, agents) of conflicts and overlaps by target, overlaps without target, dead against retained, and diverging statuses.

    ``records`` has type, target, value, agent; ``executions`` has agent, status.
    """
    clean = records.withColumns({"target": normalized(F.col("target")), "value": normalized(F.col("value"))})
    agents = F.array_sort(F.collect_set("agent")).alias("agents")
    scoped = clean.where("target is not null")
    by_target = scoped.groupBy("type", "target").agg(agents, F.count_distinct("value").alias("n")).where(F.size("agents") > 1)
    by_target = by_target.select(
        F.concat(F.when(F.col("n") > 1, "conflict:").otherwise("overlap:"), "type", F.lit(":"), "target").alias("key"), F.when(F.col("n") > 1, "warning").otherwise("info").alias("severity"), "agents"
    )
    loose = clean.where("target is null").groupBy("type").agg(agents).where(F.size("agents") > 1).select(F.concat(F.lit("overlap:"), "type").alias("key"), F.lit("info").alias("severity"), "agents")
    dead = (F.col("type") == "dead_code") & F.coalesce(F.col("value").isin(DEAD), F.lit(False))
    kept = F.col("type") != "dead_code"
    against = scoped.where(dead | kept).groupBy("target").agg(agents, F.bool_or(dead).alias("d"), F.bool_or(kept).alias("k")).where("d and k")
    against = against.select(F.concat(F.lit("conflict:retention:"), "target").alias("key"), F.lit("warning").alias("severity"), "agents")
    status = executions.agg(F.array_sort(F.collect_list("agent")).alias("agents"), F.bool_or(F.col("status") == "fail").alias("f"), F.count_distinct("status").alias("n")).where("f and n > 1")
    status = status.select(F.lit("stage:status-divergence").alias("key"), F.lit("warning").alias("severity"), "agents")
    return by_target.unionByName(loose).unionByName(against).unionByName(status)


def approve_actions(actions: DataFrame, seq: str = "seq") -> DataFrame:
    """All actions with ``verdict``: of a target with several signatures all conflict; else the first is approved and the rest are duplicates.

    An action that mirrors an original entry targets the project's root, whatever its path.
    """
    target = F.when(F.col("action") == "mirror_original_static_entry", "mirror:projectRoot").otherwise(F.col("path"))
    per = Window.partitionBy("target")
    signed = actions.withColumn("target", target).withColumn("signature", F.struct("action", "value"))
    several = F.min("signature").over(per) != F.max("signature").over(per)
    first = F.row_number().over(per.orderBy(seq)) == 1
    return signed.withColumn("verdict", F.when(several, "conflict").when(first, "approved").otherwise("duplicate")).drop("signature")


def stage_status(status: Column) -> Column:
    """An aggregate: fail, best_effort, retry; skipped if all are, best_effort if some are; else pass."""
    any_of = lambda s: F.bool_or(status == s)
    return ordered_case([(any_of("fail"), "fail"), (any_of("best_effort"), "best_effort"), (any_of("retry"), "retry"), (F.bool_and(status == "skipped"), "skipped"), (any_of("skipped"), "best_effort")], "pass")


def runtime_status(status: Column) -> Column:
    """An aggregate over stages."""
    return ordered_case([(F.bool_or(status == "fail"), "agent_failed"), (F.bool_or(status.isin("best_effort", "retry", "skipped")), "completed_best_effort")], "completed")


def first_failure(failure_class: Column, seq: Column) -> Column:
    """An aggregate: the first class in order that is not ``none``; sequence numbers are unique."""
    return F.coalesce(F.min_by(F.when(failure_class != "none", failure_class), F.when(failure_class != "none", seq)), F.lit("none"))


def approved_repairs(instructions: DataFrame, reviews: DataFrame) -> DataFrame:
    """The instructions that a review approves by artifact id or by instruction id: two equi-joins, not one join by OR."""
    ids = reviews.select(F.explode("repair_ids").alias("id")).distinct()
    by_artifact = instructions.join(ids, instructions.artifact_id == ids.id, "left_semi")
    by_instruction = instructions.join(ids, instructions.instruction_id == ids.id, "left_semi")
    return by_artifact.union(by_instruction).distinct()


def rejection(approved: Column, risk: Column, status: Column) -> Column:
    """The first reason against a repair, or null: not approved, not of low risk, not planned."""
    return ordered_case([(~approved, "not_approved"), (F.coalesce(risk != "low", F.lit(True)), "risk"), (F.coalesce(status != "planned", F.lit(True)), "not_planned")])


def superseded(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Uncertain agent reviews that later runtime evidence settles, group by group.

    ``decisions`` has group, source (``review`` or ``report``), status: both sources must have rows, and all must pass.
    """
    one = decisions.groupBy("group").agg(*[(F.coalesce(F.bool_and(F.when(F.col("source") == s, F.col("status") == "pass")), F.lit(False))).alias(s) for s in ("review", "report")])
    settled = one.where("review and report").select("group")
    uncertain = (F.col("status") == "best_effort") & F.coalesce(F.col("failure_class"), F.lit("unknown")).isin("none", "unknown") & F.col("uncertain")
    return reviews.where(uncertain).join(settled, "group", "left_semi")


def completion(records: DataFrame, overruled: DataFrame | None = None) -> DataFrame:
    """(group, decision, observations): the latest attempts of each key that fail, are to be retried or are best effort, and are not overruled; without any the group is completed.

    ``records`` has group, key, attempt, status, id.
    """
    latest = latest_attempts(records, ["group", "key"], "attempt")
    bad = latest.where(F.col("status").isin("fail", "retry", "best_effort"))
    if overruled is not None:
        bad = bad.join(overruled.select("id"), "id", "left_anti")
    found = bad.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return records.select("group").distinct().join(found, "group", "left").select("group", F.when(F.coalesce("n", F.lit(0)) > 0, "completed_best_effort").otherwise("completed").alias("decision"), F.coalesce("n", F.lit(0)).alias("observations"))
