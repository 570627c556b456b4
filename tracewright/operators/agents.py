"""What agents leave behind: their drafts, their graph and stages, repairs of failed stages, boundaries of runs, and summaries for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import redact
from tracewright.operators.audit import status_counts

# Repairs of failed stages (review type, action, script, scripts that must be absent, whether another text must be there), in order; keys of a summary by the kind of their values.
REPAIRS = [
    ("build", "add_package_script", "build", ["build"], False),
    ("typecheck", "add_package_script", "typecheck", ["typecheck", "check"], False),
    ("build", "replace_package_script", "build", [], True),
    ("typecheck", "replace_package_script", "typecheck", [], True),
]
SUMMARY_KINDS = {"entries": "path", "scripts": "path", "styles": "path", "sourceMaps": "path", "symbolSample": "symbol"}
BOUNDARY = ["runnerKind", "remoteRunId"]
SHOWN = 4


def flat_drafts(executions: DataFrame, drafts: str, job: str = "job_id") -> DataFrame:
    """(job, position, agent, draft): the drafts of all executions of a job, in order of stage, execution and place; repeated ones stay.

    ``executions`` has the job, stage_order, seq, agent and an array of drafts. A job's drafts are a bounded list.
    """
    each = executions.select(job, "stage_order", "seq", "agent", F.posexplode(drafts).alias("place", "draft"))
    position = F.row_number().over(Window.partitionBy(job).orderBy("stage_order", "seq", "place"))
    return each.select(job, position.alias("position"), "agent", "draft")


def with_feedback(drafts: DataFrame, feedback: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, position, agent, draft) of ``flat_drafts`` and of the refinement after them, whose positions go on from theirs; jobs may have either alone."""
    last = drafts.groupBy(job).agg(F.max("position").alias("__last"))
    later = feedback.join(last, job, "left").withColumn("position", F.col("position") + F.coalesce("__last", F.lit(0))).drop("__last")
    return drafts.unionByName(later)


def decided(reviews: DataFrame, feedback: DataFrame, job: str = "job_id") -> DataFrame:
    """Reviews (job, decision, ...) whose decision the fragment of the refinement (job, fragment) follows; all else of the review stays."""
    added = reviews.join(feedback.select(job, F.nullif("fragment", F.lit("")).alias("__fragment")), job, "left")
    return added.withColumn("decision", F.concat_ws(" ", "decision", "__fragment")).drop("__fragment")


def agent_edges(executions: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, src, dst): an edge to each agent from each one that it depends on (``dependencies``, an array)."""
    return executions.select(job, F.explode("dependencies").alias("src"), F.col("agent").alias("dst"))


def stage_plan(executions: DataFrame, workers: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, stage, parallel, worker_count, agents): the stages of a job and their agents in order; a stage without a number of ``workers`` (job, stage, worker_count) has one."""
    agents = F.transform(F.array_sort(F.collect_list(F.struct("seq", "agent"))), lambda a: a["agent"])
    stages = executions.groupBy(job, "stage").agg(F.min("stage_order").alias("stage_order"), agents.alias("agents")).join(workers, [job, "stage"], "left")
    count = F.coalesce("worker_count", F.lit(1))
    return stages.select(job, "stage", "stage_order", (count > 1).alias("parallel"), count.alias("worker_count"), "agents")


def executions_by_stage(executions: DataFrame) -> DataFrame:
    """(stage, n); a stage that is null or blank counts as ``unknown``."""
    return status_counts(executions, "stage").withColumnRenamed("status", "stage")


def repair_actions(failed: DataFrame, projects: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, position, action, path, value): the repairs that a job's failed stages allow.

    ``failed`` has the key and review_type; ``projects`` the key, scripts (the JSON object of its package file, null without one), shims (the generated scripts that are there) and allowed (actions,
    null for all). A script that is no text counts as there but is not replaced. Without a package file nothing can be repaired.
    """
    parsed = F.try_parse_json("scripts")
    member = lambda name: F.try_variant_get(parsed, f"$.{name}", "variant")
    rules = []
    for position, (review, action, script, absent, replaces) in enumerate(REPAIRS):
        shim = f"scripts/{script}.mjs"
        free = F.lit(True)
        for name in absent:
            free = free & member(name).isNull()
        other = (F.schema_of_variant(member(script)) == "STRING") & (F.try_variant_get(member(script), "$", "string") != f"node {shim}") if replaces else F.lit(True)
        open_to = F.col("allowed").isNull() | F.array_contains("allowed", action)
        fits = F.array_contains("shims", shim) & free & other & open_to
        row = F.struct(F.lit(position).alias("position"), F.lit(review).alias("review_type"), F.lit(action).alias("action"), F.lit(f"package.json:scripts.{script}").alias("path"), F.lit(f"node {shim}").alias("value"))
        rules.append(F.when(F.coalesce(fits, F.lit(False)), row))
    possible = projects.where("scripts is not null").select(key, F.explode(F.array_compact(F.array(*rules))).alias("r")).select(key, "r.*")
    return possible.join(failed.select(key, "review_type").distinct(), [key, "review_type"], "left_semi").select(key, "position", "action", "path", "value")


def execution_boundaries(traces: DataFrame, key: str, json: str, target: str) -> DataFrame:
    """(key, stage, runner_kind, remote_run_id) of the boundary in a trace's JSON: its own, whose stage is the trace's target, or those that it holds by stage. What holds neither has none."""
    boundary = F.try_parse_json(json)
    rows = traces.select(key, F.coalesce(F.nullif(target, F.lit("")), F.lit("runtime")).alias("stage"), boundary.alias("b")).where(F.schema_of_variant("b").startswith("OBJECT"))
    held = lambda v: F.try_variant_get(v, f"$.{BOUNDARY[0]}", "variant").isNotNull() | F.try_variant_get(v, f"$.{BOUNDARY[1]}", "variant").isNotNull()
    members = F.map_filter(F.try_variant_get(F.col("b"), "$", "map<string, variant>"), lambda _, v: F.schema_of_variant(v).startswith("OBJECT") & held(v))
    nested = F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("stage"), e["value"].alias("b")))
    each = rows.select(key, F.explode(F.when(held(F.col("b")), F.array(F.struct("stage", "b"))).otherwise(nested)).alias("e"))
    named = [F.try_variant_get("e.b", f"$.{n}", "string").alias(c) for n, c in zip(BOUNDARY, ("runner_kind", "remote_run_id"), strict=True)]
    return each.select(key, "e.stage", *named)


def redacted_summary(summaries: DataFrame, key: str) -> DataFrame:
    """Summaries whose lists of paths and symbols (columns named in ``SUMMARY_KINDS``) hold placeholders instead of texts; nulls in a list go, a null list is empty, other columns stay."""

    def hidden(column: str, kind: str) -> Column:
        texts = F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: x.isNotNull())
        return F.transform(texts, lambda x: redact(x, kind))

    return summaries.withColumns({c: hidden(c, kind) for c, kind in SUMMARY_KINDS.items() if c in summaries.columns and c != key})


def action_summary(actions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, summary): the first four active classes of failure with their actions, or the first four of all where none is active."""
    entry = F.struct(F.when(F.col("status") == "active", 0).otherwise(1).alias("idle"), "position", F.coalesce("failure_class", F.lit("unknown")).alias("name"), "actions")
    listed = F.array_sort(F.collect_list(entry))
    active = F.filter("all", lambda a: a["idle"] == 0)
    shown = F.slice(F.when(F.size(active) > 0, active).otherwise(F.col("all")), 1, SHOWN)
    text = F.array_join(F.transform(shown, lambda a: F.concat(a["name"], F.lit("->"), F.coalesce(F.nullif(F.array_join(a["actions"], ", "), F.lit("")), F.lit("audit_only")))), "; ")
    return actions.groupBy(*keys).agg(listed.alias("all")).select(*keys, text.alias("summary"))


def policy_counts(artifacts: DataFrame, columns: list[str], job: str = "job_id") -> DataFrame:
    """(job, field, value, n): a job's artifacts by each of several fields, nulls as ``unknown``; all fields in one pass."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    return artifacts.select(job, F.explode(fields).alias("f")).groupBy(job, "f.field", "f.value").agg(F.count(F.lit(1)).alias("n"))

