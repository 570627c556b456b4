"""Rows of reports: compact projections, summaries of attempts, decisions, and the classes of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import ordered_case, shortened
from tracewright.operators.dedupe import attempt_number, keep_one, latest_attempts
from tracewright.operators.inventory import normal_path, source_path

# Columns of the artifact graph by kind, all other kinds stand in the last one.
GRAPH_COLUMNS = {
    0: ["source_input", "input_inventory", "source_index"],
    1: ["ast_index", "agent_plan", "inference_record", "memory_record", "knowledge_evidence", "tool_call"],
    2: ["reconstruction_plan", "generated_project", "build_log", "build_artifact", "runtime_validation", "runtime_trace", "runtime_screenshot", "runtime_scenario", "runtime_comparison", "repair_instruction"],
}
LISTED, MESSAGE = 8, 180
ATTENTION = ["fail", "retry", "best_effort"]
ATTEMPTS, MOST_ATTEMPTS = 2, 5
# Classes of failure with the stage that they concern and the actions that may be taken by themselves, in order; those that builds give.
FAILURE_ACTIONS = {
    "build_error": ("building", ["add_package_script", "replace_package_script"]),
    "type_error": ("typechecking", ["add_package_script", "replace_package_script"]),
    "dependency_missing": ("building", []),
    "runtime_error": ("runtime_compare", ["mirror_original_static_entry"]),
    "invalid_input": ("runtime_smoke", []),
}
BUILD_CLASSES = ["build_error", "type_error", "dependency_missing"]
MOST_REVISIONS = 500
# A fixed value: the label of a viewport that has neither name nor size.
DEFAULT_VIEWPORT = "默认视口"
# Sections of a report by the kinds of their artifacts, in order; the index of attachments has none.
SECTIONS = {
    "completion-decision": ["audit_report", "html_report"],
    "risk-and-failure-groups": ["build_artifact", "runtime_validation", "review_run"],
    "runtime-compare-difference-summary": ["runtime_comparison", "runtime_scenario", "runtime_trace", "runtime_screenshot"],
    "evidence-attachment-index": [],
    "reproduction": ["result_package", "evidence_index"],
}
REPAIR_ACTIONS = ["add_package_script", "replace_package_script", "mirror_original_static_entry"]


def compact(items: Column, fields: list[str], text: str | None = None) -> Column:
    """Of the first eight structs of an array those that are not null, with some of their fields; ``text`` is one that is cut to its length."""
    pick = lambda x: F.struct(*[(shortened(x[f], MESSAGE) if f == text else x[f]).alias(f) for f in fields])
    return F.transform(F.filter(F.slice(items, 1, LISTED), lambda x: x.isNotNull()), pick)


def alert_rows(events: DataFrame) -> DataFrame:
    """Alert events as report rows, with the state of their delivery; critical ones fail, others are best effort."""
    columns = ["id", "checked_at", "severity", "code", "service_role", "instance_id", "field", "value", "threshold"]
    critical = F.coalesce(F.col("severity") == "critical", F.lit(False))
    return events.select(
        *columns,
        F.col("delivery.status").alias("delivery_status"),
        F.col("delivery.attempted").alias("delivery_attempted"),
        F.col("delivery.error").alias("delivery_error"),
        F.concat_ws(" / ", F.coalesce("code", F.lit("unknown")), F.coalesce("service_role", F.lit("global"))).alias("label"),
        F.when(critical, "fail").otherwise("best_effort").alias("status"),
        F.when(critical, "resource_limit").otherwise("unknown").alias("failure_class"),
    )


def build_rows(builds: DataFrame) -> DataFrame:
    """Build validations as report rows: the number of diagnostics, the first of them, and links to evidence in order without repeats."""
    fields = ["source", "tool", "category", "code", "message", "file_path", "line", "column"]
    return builds.select(
        "id",
        F.coalesce("review_type", "phase", "stage").alias("review_type"),
        attempt_number(F.col("attempt")).alias("attempt"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("failure_class", F.lit("unknown")).alias("failure_class"),
        F.coalesce(F.size("diagnostics"), F.lit(0)).alias("diagnostic_count"),
        compact(F.col("diagnostics"), fields, "message").alias("diagnostics"),
        links(F.col("id"), F.col("logs_id"), F.col("repair_ids")).alias("links"),
    )


def links(*ids: Column) -> Column:
    """Non-null texts in order without repeats; the last argument is an array."""
    return F.array_distinct(F.array_compact(F.concat(F.array(*ids[:-1]), F.coalesce(ids[-1], F.array().cast("array<string>")))))


def comparison_records(records: DataFrame) -> DataFrame:
    return records.where("differences is not null")


def decision_key(review_type: Column, comparison_id: Column, target: Column) -> Column:
    """The review's type, or the phase and target of a record without one."""
    phase = F.when(F.coalesce(comparison_id, F.lit("")) != "", "runtime_compare").otherwise("runtime_smoke")
    return F.coalesce(review_type, F.concat_ws(":", phase, F.coalesce(F.nullif(target, F.lit("")), F.lit("unknown"))))


def comparisons_matching(reports: DataFrame, scenario: str = "all", viewport: str = "all", status: str = "all") -> DataFrame:
    for name, value in (("scenario", scenario), ("viewport", viewport), ("status", status)):
        if value != "all":
            reports = reports.where(F.col(name) == value)
    return reports


def convergence(stages: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """For each key the highest attempt, whether all stages passed, whether one needs attention, the failed review types and the failure classes.

    With ``seq``, the order of the stages, failed_types has one entry for each failed stage in that order, and status_by_type the last status of each type; without it they are sorted and distinct.
    A key's stages are a bounded list.
    """
    bad = F.col("status").isin(ATTENTION)
    failed = F.array_sort(F.collect_set(F.when(bad, F.col("review_type"))))
    more = []
    if seq is not None:
        failed = F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct(seq, "review_type")))), lambda s: s["review_type"])
        entries = F.array_sort(F.collect_list(F.struct(seq, "review_type", "status")))
        last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s["review_type"]), F.create_map(s["review_type"], s["status"])))
        more = [last.alias("status_by_type")]
    return stages.groupBy(*keys).agg(
        F.max(attempt_number(F.col("attempt"))).alias("max_attempt"),
        F.bool_and(F.coalesce(F.col("status") == "pass", F.lit(False))).alias("all_passed"),
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("needs_attention"),
        failed.alias("failed_types"),
        F.array_sort(F.collect_set(F.when(bad & (F.col("failure_class") != "none"), F.col("failure_class")))).alias("failure_classes"),
        *more,
    )


def convergence_repairs(artifacts: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """For each key, of its artifacts (id, kind, repair) in order: repair_instruction_ids and applied_project_ids of the repairs with their counts, and the distinct evidence_ids of all. Such lists are bounded."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(seq, "id", "kind", "repair"))), lambda a: F.struct(a["id"].alias("id"), F.when(a["repair"], a["kind"]).alias("kind")))
    listed = artifacts.groupBy(*keys).agg(ordered.alias("__all"))
    of = lambda kind: F.transform(F.filter("__all", lambda a: a["kind"] == kind), lambda a: a["id"])
    named = listed.select(*keys, of("repair_instruction").alias("repair_instruction_ids"), of("generated_project").alias("applied_project_ids"), F.array_distinct(F.filter(F.transform("__all", lambda a: a["id"]), lambda i: i != "")).alias("evidence_ids"))
    return named.withColumns({"repair_instruction_count": F.size("repair_instruction_ids"), "applied_repair_count": F.size("applied_project_ids")})


def runtime_convergence(attempts: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """For each run (keys, stop_reason, summary_id) its attempts: used, planned, applied, triggered, final_review_status, budget_exhausted, failure_classes and evidence_ids.

    ``attempts`` has the keys, seq (their order), gate_triggered, gate_enabled, planned_id, applied_id, artifact_ids. The last attempt gives the review: best effort where its gate is off, fail where it was
    triggered, else pass, as without any attempt. Evidence is the summary and what the attempts name, in order, each once. The retry budget bounds a run's attempts.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    entry = F.struct("seq", F.coalesce("artifact_ids", F.array().cast("array<string>")).alias("ids"))
    last = F.max_by(F.struct(on("gate_triggered").alias("triggered"), on("gate_enabled").alias("enabled")), "seq")
    found = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("used"), F.count_if(named("planned_id")).alias("planned"), F.count_if(named("applied_id")).alias("applied"), F.count_if(on("gate_triggered")).alias("triggered"),
        last.alias("last"), F.flatten(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["ids"])).alias("ids"),
    )
    both = runs.join(found, keys, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("used", "planned", "applied", "triggered")}
    review = ordered_case([(F.col("last").isNotNull() & ~F.col("last.enabled"), "best_effort"), (F.col("last.triggered"), "fail")], "pass")
    evidence = F.array_distinct(F.filter(F.concat(F.array("summary_id"), F.coalesce("ids", F.array().cast("array<string>"))), lambda i: F.coalesce(i, F.lit("")) != ""))
    classes = F.when(zero["triggered"] > 0, F.array(F.lit("runtime_error"))).otherwise(F.array().cast("array<string>"))
    return both.select(*keys, *[v.alias(c) for c, v in zero.items()], review.alias("final_review_status"), (F.col("stop_reason") == "retry_budget_exhausted").alias("budget_exhausted"), "stop_reason", classes.alias("failure_classes"), evidence.alias("evidence_ids"))


def failure_actions(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, failure_class, target_stage, actions, status): what can be done about each class of failure; active where it occurred, else available.

    ``summaries`` has the keys, build_classes (failure classes of its builds) and triggered (comparisons whose gate was triggered).
    """
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("failure_class"), F.lit(s).alias("target_stage"), F.array(*[F.lit(a) for a in actions]).cast("array<string>").alias("actions")) for i, (c, (s, actions)) in enumerate(FAILURE_ACTIONS.items())])
    each = summaries.select(*keys, "build_classes", "triggered", F.explode(rows).alias("r")).select(*keys, "build_classes", "triggered", "r.*")
    built = F.col("failure_class").isin(BUILD_CLASSES) & F.array_contains(F.coalesce("build_classes", F.array().cast("array<string>")), F.col("failure_class"))
    ran = (F.col("failure_class") == "runtime_error") & (F.coalesce("triggered", F.lit(0)) > 0)
    return each.select(*keys, "position", "failure_class", "target_stage", "actions", F.when(built | ran, "active").otherwise("available").alias("status"))


def next_steps(outcomes: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, steps): what is left to do, as ids in order: keep the summary if all passed; else what of the budget, the repair and the build is open, and the first three active classes of failure.

    ``outcomes`` has the keys, outcome, budget_exhausted, stop_reason, needs_attention; ``actions`` is ``failure_actions``.
    """
    active = actions.where("status = 'active'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "failure_class"))).alias("__active"))
    classes = F.transform(F.slice(F.coalesce("__active", F.array().cast("array<struct<position:int,failure_class:string>>")), 1, 3), lambda a: F.concat(F.lit("failure:"), a["failure_class"]))
    flag = lambda c, name: F.when(F.coalesce(c, F.lit(False)), name)
    given = F.array_compact(F.array(flag(F.col("budget_exhausted"), "budget_exhausted"), flag(F.col("stop_reason") == "repair_not_applied", "repair_not_applied"), flag(F.col("needs_attention"), "build_needs_attention")))
    some = F.concat(given, classes)
    steps = F.when(F.col("outcome").isin("passed_without_repair", "repaired_passed"), F.array(F.lit("keep_summary"))).when(F.size(some) > 0, some).otherwise(F.array(F.lit("review_limitations")))
    return outcomes.join(active, keys, "left").select(*keys, steps.alias("steps"))


def final_outcome(exhausted: Column, stopped: Column, runtime_repairs: Column, planned: Column, review: Column, build_repairs: Column, instructions: Column, built: Column) -> Column:
    """The outcome of review and repair, by the first rule that holds."""
    passed = review == "pass"
    return ordered_case(
        [
            (exhausted, "budget_exhausted_best_effort"),
            (stopped == "repair_not_applied", "no_deterministic_repair"),
            (passed & ((runtime_repairs > 0) | ((build_repairs > 0) & built)), "repaired_passed"),
            (passed & built & (instructions == 0) & (planned == 0), "passed_without_repair"),
        ],
        "best_effort_with_limitations",
    )


def comparison_summary(comparisons: DataFrame, keys: list[str], retries: DataFrame | None = None, matrices: DataFrame | None = None) -> DataFrame:
    """For each key the comparisons, their distinct scopes, those that need attention, and the verdict on them all.

    ``retries`` (keys, budget_exhausted, final_review_status), one row of a key, makes the verdict ``fail`` where the budget is spent or the final review failed, and ``best_effort`` where that
    review did not pass; ``matrices`` (keys, attempt, seq, requested, selected, omitted) adds the runs of the latest one and their number. Keys that only these have are there, too; one with nothing at all is in none.
    """
    bad = F.coalesce(F.col("status").isin(ATTENTION), F.lit(False))
    found = comparisons.groupBy(*keys).agg(F.count(F.lit(1)).alias("comparisons"), F.count_distinct("scope").alias("scopes"), F.count_if(bad).alias("attention"))
    spent, final = F.lit(False), F.lit("")
    if retries is not None:
        found = found.join(retries.select(*keys, F.col("budget_exhausted").alias("__spent"), F.col("final_review_status").alias("__final")), keys, "full")
        spent, final = F.coalesce("__spent", F.lit(False)), F.coalesce("__final", F.lit(""))
    columns: list[Column | str] = []
    if matrices is not None:
        order = F.struct(attempt_number(F.col("attempt")), "seq")
        last = matrices.groupBy(*keys).agg(F.max_by(F.struct("requested", "selected", "omitted"), order).alias("__last"), F.count(F.lit(1)).alias("__matrices"))
        found = found.join(last, keys, "full")
        columns = ["__last.requested", "__last.selected", "__last.omitted", F.coalesce("__matrices", F.lit(0)).alias("matrices")]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("comparisons", "scopes", "attention")]
    status = ordered_case([(spent | (final == "fail"), "fail"), ((F.coalesce("attention", F.lit(0)) > 0) | final.isin("retry", "best_effort"), "best_effort")], "pass")
    return found.select(*keys, *counts, status.alias("status"), *columns)


def status_totals(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, n); a null or empty status counts as ``unknown``."""
    return comparisons.groupBy(*keys, F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def viewport_label(name: Column, width: Column, height: Column) -> Column:
    """The name and the size of a viewport, whichever it has."""
    size = F.when((F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0), F.format_string("%dx%d", width.cast("long"), height.cast("long")))
    return F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(name, F.lit("")), size), F.lit("")), F.lit(DEFAULT_VIEWPORT))


def scope_key(scenario: Column, viewport: Column) -> Column:
    """What comparisons are grouped by: the scenario and the label of the viewport."""
    return F.concat(F.coalesce(F.nullif(scenario, F.lit("")), F.lit("unknown")), F.lit("::"), F.coalesce(viewport, F.lit(DEFAULT_VIEWPORT)))


def latest_by_scope(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the last record of the latest attempt, and how many records it has."""
    counts = comparisons.groupBy(*keys).agg(F.count(F.lit(1)).alias("history"))
    return keep_one(latest_attempts(comparisons, keys, "attempt"), keys, [F.col("seq").desc()]).join(counts, keys)


def attempt_history(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempts): attempt, status and id of a key's records in order of attempt and, among equal ones, of seq. The retry budget bounds them."""
    entry = F.struct(attempt_number(F.col("attempt")).alias("attempt"), "seq", F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status"), "id")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda a: F.struct(a["attempt"].alias("attempt"), a["status"].alias("status"), a["id"].alias("id")))
    return comparisons.groupBy(*keys).agg(ordered.alias("attempts"))


def retry_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """The summary with the most attempts used; of equals the first."""
    return keep_one(records, keys, [F.coalesce("attempts_used", F.lit(0)).desc(), F.col("seq").asc()])


def last_or_default(jobs: DataFrame, summaries: DataFrame, default: str) -> DataFrame:
    """(job_id, outcome, available): the last summary of each job, or the default outcome where there is none."""
    last = keep_one(summaries, ["job_id"], [F.col("seq").desc()]).select("job_id", "outcome", F.lit(True).alias("found"))
    return jobs.select("job_id").join(last, "job_id", "left").select("job_id", F.coalesce("outcome", F.lit(default)).alias("outcome"), F.coalesce("found", F.lit(False)).alias("available"))


def attempt_budget(*values: Column) -> Column:
    """The first given number of attempts, between one and five; two where none is given or the first is no number."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_ATTEMPTS), F.coalesce(F.coalesce(*values).try_cast("int"), F.lit(ATTEMPTS))))


def revisions(settings: DataFrame, limit: int = 50) -> DataFrame:
    """The newest revisions first; the limit is held between 1 and 500."""
    return settings.orderBy(F.col("revision").desc(), F.col("id").desc()).limit(max(1, min(limit, MOST_REVISIONS)))


def merged_reports(*parts: DataFrame) -> DataFrame:
    """Reports of several kinds in order of time and id."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.orderBy("created_at", "id")


def graph_column(kind: Column) -> Column:
    """The column of the graph in which artifacts of a kind stand."""
    return ordered_case([(kind.isin(kinds), F.lit(n)) for n, kinds in GRAPH_COLUMNS.items()], F.lit(3))


def capture_status(*problems: Column) -> Column:
    """``fail`` if one of several arrays has an item."""
    some = F.lit(False)
    for items in problems:
        some = some | (F.coalesce(F.size(items), F.lit(0)) > 0)
    return F.when(some, "fail").otherwise("pass")


def excerpt(*lists: Column) -> Column:
    """The first two of each list in one text."""
    return F.array_join(F.concat(*[F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, 2) for x in lists]), "; ")


def sandbox_failure(timed_out: Column, truncated: Column, exit_code: Column, failure: Column) -> Column:
    """The class of a sandboxed run: timeout, then cut output of a run that ended well, then the command's own class."""
    return ordered_case([(timed_out, F.lit("timeout")), (truncated & (exit_code == 0), F.lit("resource_limit")), (exit_code != 0, failure)], F.lit("none"))


def error_class(error: Column, invalid: list[str], other: str) -> Column:
    """The failure class of an error by its type's name; ``invalid`` names the types that tell of bad input."""
    return F.when(error == "TimeoutError", "timeout").when(error.isin(invalid), "invalid_input").when(error == "PermissionError", "sandbox_denied").otherwise(other)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))


def digest_of(text: Column) -> Column:
    """The first sha-256 digest in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(sha256:[0-9a-f]{64})(?![0-9a-f])", 1), F.lit(""))


def is_text(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.startswith("text/") | kind.rlike(r"json|javascript|xml")


def renewed(jobs: DataFrame, worker: str, until: Column, terminal: list[str]) -> DataFrame:
    """All jobs; the lease of those that ``worker`` holds and that have not ended runs until then."""
    held = F.coalesce((F.col("lease_owner") == worker) & ~F.col("status").isin(terminal), F.lit(False))
    return jobs.withColumn("lease_expires_at", F.when(held, until).otherwise(F.col("lease_expires_at")))


def unknown_references(reviews: DataFrame, known: DataFrame) -> DataFrame:
    """All reviews (id, repair_ids, status); one that names an unknown repair fails."""
    named = reviews.select("id", F.explode("repair_ids").alias("repair_id"))
    bad = named.join(known.select(F.col("id").alias("repair_id")).distinct(), "repair_id", "left_anti").groupBy("id").agg(F.count_distinct("repair_id").alias("unknown"))
    return reviews.join(bad, "id", "left").withColumns({"unknown": F.coalesce("unknown", F.lit(0)), "status": F.when(F.col("unknown") > 0, "fail").otherwise(F.col("status"))})


def source_candidates(sources: DataFrame) -> DataFrame:
    """(map_path, source, position, candidate): the path of a source beside its map, beside the bundle, below the source root, and by itself, without repeats.

    Paths are those of ``source_path``, with ``.`` and ``..`` resolved after they are joined; a source of another scheme or without a path has no candidates.
    """
    own = source_path(F.col("source"))
    beside = lambda path: F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    joined = lambda folder: F.coalesce(source_path(normal_path(F.concat(folder, F.lit("/"), own))), own)
    root = F.nullif(source_path(F.coalesce("source_root", F.lit(""))), F.lit(""))
    every = F.array_compact(F.array(joined(beside(F.col("map_path"))), joined(beside(F.col("bundle_path"))), F.when(root.isNotNull(), joined(root)), own))
    usable = sources.where(F.coalesce(own, F.lit("")) != "")
    return usable.select("map_path", "source", F.posexplode(F.filter(F.array_distinct(every), lambda c: c != "")).alias("position", "candidate"))


def placeholder_rows(plans: DataFrame) -> DataFrame:
    """One row for each dependency placeholder of a plan, with the exports that it stands for; without any it is loaded only."""
    p = F.col("p")
    default = F.when(p["default_import"] & ~F.array_contains(p["names"], "default"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    more = F.array_compact(F.array(F.when(p["namespace_import"], "namespace"), F.when(p["export_all"], "export-all")))
    exports = F.array_join(F.array_distinct(F.concat(default, p["names"], more)), ", ")
    rows = plans.select("plan_id", F.explode("placeholders").alias("p"))
    return rows.select("plan_id", F.coalesce(p["status"], F.lit("unsupported")).alias("status"), F.coalesce(p["importer"], F.lit("unknown")).alias("importer"), F.coalesce(p["specifier"], F.lit("unknown")).alias("specifier"), F.coalesce(F.nullif(exports, F.lit("")), F.lit("load only")).alias("exports"))


def review_rows(reviews: DataFrame) -> DataFrame:
    """Reviews as report rows: the first references, their number, and links to evidence in order without repeats. ``refs`` is an array of structs with artifact_id and label."""
    ids = F.concat(F.coalesce("repair_ids", F.array().cast("array<string>")), F.coalesce(F.transform("refs", lambda r: r["artifact_id"]), F.array().cast("array<string>")))
    return reviews.select(
        "id",
        F.coalesce("review_type", "stage").alias("review_type"),
        attempt_number(F.col("attempt")).alias("attempt"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("failure_class", F.lit("unknown")).alias("failure_class"),
        compact(F.col("refs"), ["artifact_id", "label"]).alias("refs"),
        F.coalesce(F.size("refs"), F.lit(0)).alias("ref_count"),
        links(F.col("id"), F.col("logs_id"), ids).alias("links"),
    )


def attachment_reason(
    include_kinds: list[str] | None = None, exclude_kinds: list[str] | None = None, sensitivity: list[str] | None = None, retention: list[str] | None = None, max_bytes: int | None = None
) -> Column:
    """Why an artifact (kind, sensitivity_class, retention_class, size, is_file) is not attached, by the first rule that holds; null if it is."""
    outside = lambda name, values: F.lit(False) if values is None else ~F.coalesce(F.col(name).isin(values), F.lit(False))
    rules = [
        (outside("kind", include_kinds), "kind_not_included"),
        (F.coalesce(F.col("kind").isin(exclude_kinds or []), F.lit(False)), "kind_excluded"),
        (outside("sensitivity_class", sensitivity), "sensitivity_not_included"),
        (outside("retention_class", retention), "retention_not_included"),
        (F.lit(False) if max_bytes is None else F.col("size") > max_bytes, "too_large"),
        (~F.coalesce("is_file", F.lit(False)), "no_file"),
    ]
    return ordered_case(rules, F.lit(None).cast("string"))


def attachment_counts(artifacts: DataFrame, reason: Column, keys: list[str]) -> DataFrame:
    return artifacts.groupBy(*keys).agg(F.count_if(reason.isNull()).alias("included"), F.count_if(reason.isNotNull()).alias("omitted"))


def action_problem(action: Column, path: Column, value: Column, reason: Column) -> Column:
    """Why a repair action is not taken: a blank field, or an action that is not known; null for a good one."""
    blank = F.lit(False)
    for field in (action, path, value, reason):
        blank = blank | (F.coalesce(F.trim(field), F.lit("")) == "")
    return F.when(blank, "blank_field").when(~action.isin(REPAIR_ACTIONS), F.concat(F.lit("unsupported_action:"), action))


def actions_by_artifact(actions: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the numbers of approved and rejected actions, and the reasons of the rejected ones; null ``problem`` is approved."""
    return actions.groupBy(*keys).agg(F.count_if(F.col("problem").isNull()).alias("approved"), F.count_if(F.col("problem").isNotNull()).alias("rejected"), F.array_sort(F.collect_set("problem")).alias("problems"))


def planner_selection(plans: DataFrame, allowed: list[str]) -> DataFrame:
    """(all columns, selected, fallback): the planned names in allowed order, or all that are available with the reason why.

    ``plans`` has status (null without a plan), failure_class, planned and available (arrays).
    """
    names, bad = F.array(*[F.lit(a) for a in allowed]), F.col("status").isin("fail", "retry", "skipped") | (F.coalesce("failure_class", F.lit("none")) != "none")
    outside = F.exists("planned", lambda name: name.isNull()) | (F.size(F.array_except("planned", names)) > 0)
    chosen = F.filter(names, lambda name: F.array_contains("planned", name) & F.array_contains("available", name))
    why = ordered_case(
        [
            (F.col("status").isNull(), F.lit("planner_execution_missing")),
            (bad, F.concat(F.lit("planner_execution_"), "status", F.lit(":"), F.coalesce("failure_class", F.lit("none")))),
            (F.coalesce(F.size("planned"), F.lit(0)) < 1, F.lit("planner_selection_empty")),
            (F.coalesce(outside, F.lit(False)), F.lit("planner_selection_outside_allowlist")),
            (F.size(chosen) == 0, F.lit("planner_selection_unavailable")),
        ],
        F.lit(None).cast("string"),
    )
    return plans.withColumn("fallback", why).withColumn("selected", F.when(F.col("fallback").isNull(), chosen).otherwise(F.col("available")))


def matching_sections(sections: DataFrame, query: str) -> DataFrame:
    """The sections in which, or in whose details, a text stands in any case, with the matching details; all of them where only the section matches.

    ``sections`` has anchor, summary, title, arrays artifact_ids, artifact_kinds, links, and details (array of structs with label, value, status, text). A blank query keeps everything.
    """
    wanted = query.strip().lower()
    if not wanted:
        return sections
    held = lambda *texts: F.contains(F.lower(F.array_join(F.array_compact(F.concat(*texts)), " ")), F.lit(wanted))
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("artifact_ids", "artifact_kinds", "links")]
    found = F.filter("details", lambda d: held(F.array(d["label"], d["value"], d["status"], d["text"])))
    some = F.coalesce(F.size(found), F.lit(0)) > 0
    return sections.where(held(F.array("anchor", "summary", "title"), *lists) | some).withColumn("details", F.when(some, found).otherwise(F.col("details")))


def fallback_sections(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job_id, position, anchor, artifact_id): the sections of a report of which nothing but artifacts (job_id, id, kind, included) is known.

    Each section has a row for each artifact of its kinds, the index of attachments one for each that is included, and one without an id where there is none.
    """
    anchors, no_ids = F.array(*[F.lit(a) for a in SECTIONS]), F.lit(None).cast("string")
    of_kinds = F.array(*[F.when(F.col("kind").isin(kinds) if kinds else F.col("included"), F.lit(n)) for n, kinds in enumerate(SECTIONS.values())])
    held = artifacts.select("job_id", F.col("id").cast("string").alias("artifact_id"), F.explode(F.array_compact(of_kinds)).alias("position"))
    # Sections that a job has as bits, so that only a row a job, and no table that an explode has made longer than its estimate, can be broadcast.
    bits = F.array(*[F.lit(1 << n) for n in range(len(SECTIONS))])
    had = held.groupBy("job_id").agg(F.bit_or(F.element_at(bits, F.col("position") + 1)).alias("had"))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce("had", F.lit(0)).bitwiseAND(1 << n) == 0, F.lit(n)) for n in range(len(SECTIONS))]))
    empty = jobs.select("job_id").distinct().join(had, "job_id", "left").select("job_id", F.explode(lacking).alias("position"), no_ids.alias("artifact_id"))
    found = jobs.select("job_id").join(held, "job_id").select("job_id", "position", "artifact_id").unionByName(empty)
    return found.select("job_id", "position", F.element_at(anchors, F.col("position") + 1).alias("anchor"), "artifact_id")


def runner_kinds(boundary: Column) -> Column:
    """The kinds of runners of an execution boundary (JSON), its own and those of its two sides, in order without repeats."""
    paths = ["$.runnerKind", "$.original.runnerKind", "$.reconstructed.runnerKind"]
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(F.get_json_object(boundary, p), F.lit("")) for p in paths])))


def input_summary(packages: DataFrame, lists: list[str], symbols: str) -> DataFrame:
    """All columns; the first eight texts of each list, and ``symbol_count`` and ``symbol_sample`` of the symbols."""
    first = lambda c: F.array_compact(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, LISTED))
    return packages.withColumns({**{c: first(F.col(c)) for c in lists}, "symbol_count": F.coalesce(F.size(symbols), F.lit(0)), "symbol_sample": first(F.col(symbols))})


def latest_labels(viewports: DataFrame) -> DataFrame:
    """(value, label): of each viewport the last label by ``seq``, in order of labels."""
    return viewports.groupBy("value").agg(F.max_by("label", "seq").alias("label")).orderBy("label", "value")
