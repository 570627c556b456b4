"""Checks of a release: images and their registry digests, checks rolled up, blockers of an archive, rates of evaluation runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import ordered_case
from tracewright.operators.chains import cut
from tracewright.operators.policies import as_object, child
from tracewright.operators.settings import PLACEHOLDER, SECRET_NAMES
from tracewright.operators.trees import is_hidden, leaves, named_at

# Members by which evidence is referenced, and parts of an archive's evidence with the names of their checks.
REFERENCES = ["evidenceRef", "path", "uri", "url", "snapshotId", "artifactId", "reference"]
EVIDENCE = {"databaseSnapshot": "database_snapshot", "artifactStoreExport": "artifact_store_export", "serviceLogs": "service_logs", "rollbackEvidence": "rollback_evidence"}
DIGEST = r"^sha256:[0-9a-fA-F]{64}$"


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _apart(keys: list[str] | None) -> Callable[[DataFrame], DataFrame]:
    """Entries of many keys are as many as their images and are never broadcast, though the table that they are exploded from may look small."""
    return (lambda df: df.hint("merge")) if keys else (lambda df: df)


def digest_candidates(images: DataFrame, digests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(image_id, position, digest): of each image the first registry entry of its service and tag, or whose reference names its repository.

    ``images`` has image_id, service, version_tag, repository; ``digests`` position, service, tag, digest, reference. An entry without a tag goes with all tags.
    A reference names every repository that it holds before an ``@``, so both rules are joins on equal keys. With ``keys``, columns of both tables, images go with the entries of their own keys only.
    """
    apart, keys = _apart(keys), keys or []
    tag = F.coalesce("version_tag", F.lit(""))
    wanted = images.select(*keys, "image_id", F.coalesce("service", F.lit("")).alias("service"), tag.alias("version_tag"), F.coalesce(_filled("repository"), F.regexp_replace(tag, ":[^:]*$", "")).alias("repository"))
    own = F.coalesce(_filled("digest"), F.when(F.contains("reference", F.lit("@sha256:")), F.regexp_extract("reference", "^[^@]*@(.*)$", 1)))
    held = digests.select(*keys, "position", F.col("service").alias("of"), F.coalesce("tag", F.lit("")).alias("tag"), own.alias("digest"), F.split("reference", "@").alias("parts"))
    by_service = wanted.join(apart(held.withColumnRenamed("of", "service")), [*keys, "service"]).where("tag in ('', version_tag)")
    names = held.where(F.size("parts") > 1).withColumn("named", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "@"))))
    by_name = wanted.join(apart(names.withColumnRenamed("named", "repository")), [*keys, "repository"])
    both = by_service.select("image_id", "position", "digest").unionByName(by_name.select("image_id", "position", "digest"))
    return both.groupBy("image_id").agg(F.min("position").alias("position"), F.min_by("digest", "position").alias("digest"))


def matched_digests(images: DataFrame, digests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All images, with ``keys`` in front, with their digest and reference, or with what is missing: an entry of the registry, or a digest of the right form."""
    rows = images.join(_apart(keys)(digest_candidates(images, digests, keys).select("image_id", "position", "digest")), "image_id", "left")
    repository = F.coalesce(_filled("repository"), F.regexp_replace(F.coalesce("version_tag", F.lit("")), ":[^:]*$", ""))
    name = F.coalesce(_filled("service"), _filled("version_tag"), F.lit("unknown"))
    good = F.coalesce(F.col("digest").rlike(DIGEST), F.lit(False))
    missing = F.when(F.col("position").isNull(), F.concat(F.lit("registryDigests."), name)).when(~good, F.concat(F.lit("registryDigests."), F.coalesce("service", F.lit("")), F.lit(".digest")))
    return rows.select(*(keys or []), "image_id", "service", "version_tag", F.when(good, F.col("digest")).alias("digest"), F.when(good, F.concat(repository, F.lit("@"), "digest")).alias("reference"), missing.alias("missing"))


def _truth(value: Column) -> Column:
    """Whether a JSON value counts as true: not absent, null, false, zero, or empty."""
    return F.coalesce(~F.to_json(value).isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _filled_text(value: Column, *names: str) -> Column:
    """Whether all of some members are texts that are not blank."""
    found = F.lit(True)
    for name in names:
        # A member that is absent or blank, as most are, is not looked at again.
        held = F.btrim(F.try_variant_get(value, f"$.{name}", "string"), F.lit(" \t\n\r"))
        found = found & F.coalesce(F.when(held != "", F.schema_of_variant(child(value, name)) == "STRING"), F.lit(False))
    return found


def _referenced(value: Column, depth: int = 2) -> Column:
    """Whether an object names its evidence, or a list is not empty and all of its members do, down to some lists in lists."""
    own = F.lit(False)
    for name in REFERENCES:
        own = own | _filled_text(value, name)
    if not depth:
        return own
    # What is no object names nothing, and what is no list has no members.
    members = F.try_variant_get(value, "$", "array<variant>")
    return own | F.coalesce((F.size(members) > 0) & F.forall(members, lambda v: _referenced(v, depth - 1)), F.lit(False))


def archive_checks(archives: DataFrame) -> DataFrame:
    """(release_id, seq, name, status, missing): the checks of each release's archive in order, and the evidence that a failed one lacks (an array).

    ``archives`` has release_id and the JSON texts gate, compose, deployment and manifest; what is no JSON object counts as an empty one. Placeholders and secrets are told on the leaves of the manifest,
    registry digests by joins on the images of the gate where these are pushed.
    """
    docs = archives.select("release_id", *[F.try_parse_json(c).alias(c) for c in ("gate", "compose", "deployment", "manifest")])
    # A document that is no object has no members. What several checks look into is taken out first, once.
    members = {"ci": "ciRun", "manager": "secretManager"}
    docs = docs.select("*", *[child(F.col("manifest"), name).alias(c) for c, name in members.items()], F.array(*[child(F.col("manifest"), name) for name in EVIDENCE]).alias("evidence"), _truth(F.try_variant_get("gate", "$.config.push", "variant")).alias("push"))
    gate, compose, deployment, manifest = (F.col(c) for c in ("gate", "compose", "deployment", "manifest"))
    is_ = lambda value, name, text: F.coalesce(F.try_variant_get(value, f"$.{name}", "string") == text, F.lit(False))
    inner = lambda value, *names: F.try_variant_get(value, "$." + ".".join(names), "variant")
    text = lambda v, n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit(""))
    objects = lambda value, name, *parts: F.when(F.col("push"), F.transform(F.try_variant_get(value, f"$.{name}", "array<variant>"), lambda v: F.when(as_object(v).isNotNull(), F.struct(*[part(v) for part in parts]))))
    of = lambda n, c: lambda v: text(v, n).alias(c)
    ci, manager = F.col("ci"), F.col("manager")
    sound = _filled_text(manager, "provider", "environment") & (_filled_text(manager, "revision") | _filled_text(manager, "revisionRef") | _filled_text(manager, "approvalRecord"))
    sound = sound & F.coalesce(F.to_json(child(manager, "containsSecretValues")) == "false", child(manager, "containsSecretValues").isNull())
    told = {
        "reported": is_(gate, "kind", "release_gate_report"),
        "passed": is_(gate, "status", "pass"),
        "executed": is_(gate, "mode", "execute") & _truth(inner(gate, "config", "execute")),
        "composed": is_(compose, "kind", "compose_smoke_report") & is_(compose, "status", "pass"),
        "deployed": is_(deployment, "kind", "deployment_smoke_report") & is_(deployment, "status", "pass"),
        "ready": _truth(inner(deployment, "archive_manifest", "archiveReady")) & _truth(inner(compose, "deploymentSmoke", "archive_manifest", "archiveReady")),
        "kind": is_(manifest, "kind", "production_release_evidence_manifest"),
        "ci": _filled_text(ci, "runUrl", "runId", "commit", "environment"),
        "sound": sound,
        "referenced": F.transform("evidence", lambda v: _referenced(v)),
        "push": F.col("push"),
        "some_images": child(gate, "images").isNotNull(),
        "some_digests": child(manifest, "registryDigests").isNotNull(),
        "images": objects(gate, "images", of("service", "service"), of("versionTag", "version_tag"), of("repository", "repository")),
        "digests": objects(manifest, "registryDigests", of("service", "service"), of("tag", "tag"), of("digest", "digest"), lambda v: F.coalesce(F.nullif(text(v, "digestReference"), F.lit("")), text(v, "reference")).alias("reference")),
    }
    # Cut, so that what is read from the documents, which is little, is read once and not for each join.
    facts = cut(docs.select("release_id", *[value.alias(c) for c, value in told.items()]))
    wanted = facts.where("digests is not null").select("release_id", F.posexplode("images").alias("place", "v")).where("v is not null").select("release_id", F.struct("release_id", "place").alias("image_id"), "v.*")
    held = facts.select("release_id", F.posexplode("digests").alias("position", "v")).where("v is not null").select("release_id", "position", "v.*")
    lacking = matched_digests(wanted, held, ["release_id"]).where("missing is not null").groupBy("release_id").agg(F.array_sort(F.collect_set("missing")).alias("lacking"))
    # A manifest that is no object has no leaf below a key.
    parts = leaves(archives.select("release_id", "manifest"), "release_id", "manifest").where(F.get("steps", F.lit(0))["key"].isNotNull()).withColumn("at", named_at(SECRET_NAMES))
    flagged = (F.element_at("steps", -1)["key"] == "containsSecretValues") & (F.col("json") == "true")
    any_ = lambda found, name: F.bool_or(F.coalesce(found, F.lit(False))).alias(name)
    hints = parts.groupBy("release_id").agg(any_(F.col("text").rlike(PLACEHOLDER), "placeholder"), any_(flagged, "flag"), any_(is_hidden(), "secret"))
    every = facts.join(hints.hint("merge"), "release_id", "left").join(lacking.hint("merge"), "release_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = F.array().cast("array<string>")
    without = F.when(F.col("push") & F.col("images").isNull() & F.col("some_images"), F.array(F.lit("registryDigests.images"))).when(F.col("push") & F.col("digests").isNull() & F.col("some_digests"), F.array(F.lit("registryDigests")))
    without = F.coalesce(without.when(F.col("push"), F.col("lacking")), none)
    one = lambda bad, name: F.when(bad, F.array(F.lit(name))).otherwise(none)
    checks = [
        ("release_gate_report_present", F.col("reported"), none),
        ("release_gate_passed", F.col("passed"), none),
        ("release_gate_executed", F.col("executed"), one(~F.col("executed"), "releaseGate.executed")),
        ("compose_smoke_passed", F.col("composed"), none),
        ("deployment_smoke_passed", F.col("deployed"), none),
        ("deployment_archive_ready", F.col("ready"), one(~F.col("ready"), "deploymentSmoke.archive_manifest.archiveReady")),
        ("evidence_manifest_kind", F.col("kind"), none),
        ("ci_run_evidence", F.col("ci"), one(~F.col("ci"), "ciRun")),
        ("placeholder_values_replaced", ~yes("placeholder"), one(yes("placeholder"), "placeholderValuesReplaced")),
        ("secret_values_absent", ~yes("secret") & ~yes("flag"), F.concat(one(yes("secret"), "secretValuesAbsent"), one(yes("flag"), "containsSecretValuesFalse"))),
        ("secret_manager_evidence", F.col("sound"), one(~F.col("sound"), "secretManager")),
    ]
    checks += [(f"{snake}_evidence", F.get("referenced", F.lit(i)), one(~F.get("referenced", F.lit(i)), name)) for i, (name, snake) in enumerate(EVIDENCE.items())]
    checks.append(("registry_digest_evidence", F.size(without) == 0, without))
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(n).alias("name"), F.when(passed, "pass").otherwise("fail").alias("status"), missing.alias("missing")) for i, (n, passed, missing) in enumerate(checks)])
    return every.select("release_id", F.explode(rows).alias("c")).select("release_id", "c.*")


def archive_reports(checks: DataFrame) -> DataFrame:
    """(release_id, status, failed, missing) of ``archive_checks``: the failed checks in order, and the missing evidence sorted, each once."""
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing")
    return check_rollup(checks, ["release_id"], lists).select("release_id", "status", "failed", "missing")


def check_rollup(checks: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """For each key ``pass`` if all its checks (name, status, seq) passed, else ``fail``, with the failed checks in order; and ``more`` aggregates of them. A run's checks are a fixed list."""
    failed = ~F.coalesce(F.col("status") == "pass", F.lit(False))
    names = F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("seq", "name")))), lambda c: c["name"])
    return checks.groupBy(*keys).agg(F.when(F.bool_or(failed), "fail").otherwise("pass").alias("status"), F.count(F.lit(1)).alias("checks"), names.alias("failed"), *more)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A share; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def run_rates(runs: DataFrame) -> DataFrame:
    """All runs with the shares of valid executions and of approved actions."""
    return runs.withColumns({"validation_rate": rate(F.col("valid"), F.col("executions")), "approval_rate": rate(F.col("approved"), F.col("actions"))})


def evaluation(runs: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the runs, their mean duration and rates, and the totals of applied actions and conflicts. Rates are added as decimals, so that their order tells nothing."""
    mean = lambda name: F.round(F.avg(F.col(name).cast("decimal(20,10)")), 4).cast("double").alias(f"mean_{name}")
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("duration_ms"), 3).alias("mean_duration_ms"),
        mean("validation_rate"),
        mean("approval_rate"),
        F.sum("applied").alias("applied"),
        F.sum("conflicts").alias("conflicts"),
    )


def role_violations(variables: DataFrame, exact: dict[str, str], prefixes: dict[str, str]) -> DataFrame:
    """(all columns, owner) of the variables (``name``) that a service must not carry: those named, else those of the first prefix; ``owner`` is the role they belong to."""
    rules = [(F.col("name") == name, F.lit(owner)) for name, owner in exact.items()] + [(F.col("name").startswith(p), F.lit(owner)) for p, owner in prefixes.items()]
    return variables.withColumn("owner", ordered_case(rules, F.lit(None).cast("string"))).where("owner is not null")


def context_policy(mode: Column) -> Column:
    """What a model may see of a job by its cloud mode; any unknown mode keeps it local."""
    policy = lambda scope, handling, allowed: F.struct(F.lit(scope).alias("scope"), F.lit(handling).alias("handling"), F.lit(allowed).alias("cloud_allowed"))
    rules = [
        (mode == "cloud_allowed", policy("cloud", "full_context_allowed_when_configured", True)),
        (mode == "desensitized", policy("sanitized_cloud_or_local", "deterministic_context_redaction", True)),
    ]
    return ordered_case(rules, policy("local", "local_context_only", False))
